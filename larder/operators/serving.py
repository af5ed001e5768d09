"""Filters and pages of the serving reads. An empty selection is no filter."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.operators.matching import total_rank
from larder.operators.skew import sized_join


def _any(conditions: list[Column]) -> Column:
    return reduce(Column.__or__, conditions)


def filter_recipes(
    df: DataFrame, search: str = "", max_minutes: float | None = None, min_rating: float | None = None,
    tags: tuple[str, ...] = ()
) -> DataFrame:
    """Pattern in name or ingredients in any case, time and rating (null counts as 0), any tag as part of the tag text."""
    out = df
    if search:
        hit = [F.coalesce(F.col(c).rlike("(?i)" + search), F.lit(False)) for c in ("name", "top_ingredients")]
        out = out.filter(_any(hit))
    if max_minutes is not None:
        out = out.filter(F.coalesce("avg_cook_minutes", F.lit(0)) <= max_minutes)
    if min_rating is not None:
        out = out.filter(F.coalesce("display_rating", F.lit(0)) >= min_rating)
    if tags:
        out = out.filter(_any([F.contains(F.lower("tags"), F.lit(t.lower())) for t in tags]))
    return out


def filter_gaps(
    df: DataFrame, statuses: tuple[str, ...] = (), low: float | None = None, high: float | None = None,
    tags: tuple[str, ...] = (), sources: tuple[str, ...] = ()
) -> DataFrame:
    """Gap rows by status, explicit score bounds, any of the tags (joined by bars) and source."""
    out = df
    if statuses:
        out = out.filter(F.col("match_status").isin(*statuses))
    if low is not None:
        out = out.filter(F.col("gap_score") >= low)
    if high is not None:
        out = out.filter(F.col("gap_score") <= high)
    if tags:
        out = out.filter(F.arrays_overlap(F.split("tags", "[|]"), F.array(*[F.lit(t) for t in tags])))
    if sources:
        out = out.filter(F.col("source").isin(*sources))
    return out


def top_gaps(df: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` highest gaps that are no strong match (a top list is the feature)."""
    return filter_gaps(df, ("gap", "weak_match")).orderBy(
        F.col("gap_score").desc_nulls_last(), "source", "canonical_term"
    ).limit(n)


def page_count(rows: int, size: int = 10) -> int:
    return max(1, -(-rows // size))


def page(df: DataFrame, order: list[Column], number: int, size: int = 10) -> DataFrame:
    """Page ``number`` from 1, cut to the pages there are; ``order`` must tell all rows apart."""
    last = page_count(df.count(), size)
    number = min(max(1, number), last)
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def first_batches(df: DataFrame, order: list[tuple[str, bool]], match: Column, size: int, wanted: int, most: int) -> DataFrame:
    """Matching rows of the first batches of ``size`` rows: batches are taken until ``wanted`` matches are there, at most
    ``most`` of them. ``order`` must tell rows apart."""
    ranked = total_rank(df, F.lit(True), order, "_rank")
    rows = ranked.withColumn("batch", F.floor((F.col("_rank") - 1) / size).cast("int")).filter(F.col("batch") < most)
    hits = rows.filter(match).drop("_rank")
    per = hits.groupBy("batch").agg(F.count(F.lit(1)).alias("n"))  # at most ``most`` rows
    before = F.coalesce(F.sum("n").over(Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ = per.withColumn("_had", before).filter(F.col("_had") < wanted).select("batch")
    return hits.join(F.broadcast(open_), "batch", "left_semi")


def placed_by(df: DataFrame, group: str, score: str, tie: str) -> DataFrame:
    """Adds ``place``: 1, 2, ... within each group (not null) by score descending, without bringing a group to one task."""
    ranked = total_rank(df, F.lit(True), [(group, True), (score, False), (tie, True)], "_rank")
    first = ranked.groupBy(group).agg(F.min("_rank").alias("_first"))
    out = sized_join(ranked, first, [group])
    return out.withColumn("place", (F.col("_rank") - F.col("_first") + 1).cast("int")).drop("_rank", "_first")


def apply_swaps(active: DataFrame, changes: DataFrame) -> DataFrame:
    """(candidate, substitute) after ``changes`` (candidate, substitute, at): the last change of a candidate sets its
    substitute, a null one removes it."""
    last = changes.groupBy("candidate").agg(F.max_by(F.struct("substitute"), F.struct("at", "substitute")).alias("c"))
    kept = active.join(last, "candidate", "left_anti").select("candidate", "substitute")
    return kept.unionByName(last.select("candidate", F.col("c.substitute").alias("substitute")).filter("substitute is not null"))


def with_rising(rows: DataFrame, queries: DataFrame, key: str, query: str, value: str, most: int = 5) -> DataFrame:
    """``rows`` with ``rising``: the ``most`` queries of highest value of each key, joined by bars. Spark keeps that many a key
    in every task before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.col(value).desc(), query)
    top = queries.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= most)
    lists = top.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_k", query))).alias("_l"))
    lists = lists.select(key, F.array_join(F.transform("_l", lambda s: s[query]), "|").alias("rising"))
    return rows.join(lists, key, "left")


def first_stage(stages: list[tuple[str, int]], prefix: str) -> tuple[str, int] | tuple[None, None]:
    """The first (label, rows) whose label starts with ``prefix``."""
    return next((s for s in stages if s[0].startswith(prefix)), (None, None))
