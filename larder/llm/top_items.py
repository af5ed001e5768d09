"""Top N items within every group, by descending score bands.

Rows are written in range-partitioned bands of score. Runs of bands are taken from the top, as many as the places still
open call for: groups already filled are anti-joined away before anything is ranked, the rest is ranked exactly and takes
what it still needs. Low bands are read only for groups that the higher ones left open.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.operators.skew import sized_join
from larder.session import BROADCAST_BYTES, materialize, release


def latest_scores(df: DataFrame, group: str, item: str, score: str, at: str) -> DataFrame:
    """(grp, item, score): of each pair the row of the latest ``at``. Null times come first, of rows at the same time
    the highest score counts; pairs with a null key, or whose score is then null or NaN, are left out."""
    col = lambda n: F.col(f"`{n}`")
    rows = df.select(
        col(group).alias("grp"), col(item).alias("item"), col(at).alias("at"),
        F.nanvl(col(score).cast("double"), F.lit(None)).alias("score")
    )
    last = rows.filter(
        F.col("grp").isNotNull() & F.col("item").isNotNull()
    ).groupBy("grp", "item").agg(F.max(F.struct("at", "score")).alias("m"))
    return last.select("grp", "item", F.col("m.score").alias("score")).filter(F.col("score").isNotNull())


def _run(sizes: list[int], first: int, wanted: int) -> int:
    """The end of the run of bands from ``first``: as many as hold twice the rows ``wanted``, yet, as long as a fifth of
    all rows is left, no more than three fifths of what is left, so that filled groups can be spared the rest."""
    left, have, end = sum(sizes[first:]), 0, first
    most = left if 5 * left <= sum(sizes) else 0.6 * left
    while end < len(sizes) and (end == first or (have < 2 * wanted and have + sizes[end] <= most)):
        have += sizes[end]
        end += 1
    return end


def top_n(rows: DataFrame, n: int, bands: int = 20, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(grp, item, score, rank): the first ``n`` of each group by score descending, then item ascending.

    ``rows`` has grp, item, score without nulls; repeated rows count as one. Bands are cut at ``bands`` quantiles of score;
    equal scores always share a band. The table of filled groups is broadcast up to ``limit`` bytes; beyond it hot groups
    are split off and the rest is joined by shuffle. A group with fewer items gives all of them, an empty table an empty
    result.
    """
    shares = [k / bands for k in range(1, bands)]
    cuts = rows.agg(F.percentile_approx("score", shares, 1000)).first()[0]
    cuts = sorted(set(cuts or []))
    band = F.lit(0)
    for c in cuts:  # fewer than ``bands``
        band = band + (F.col("score") < F.lit(c)).cast("int")
    banded = materialize(rows.select("grp", "item", "score", band.alias("band")).distinct(), "bands", ["band"])
    held = dict(banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).collect())  # a row per band
    sizes = [held.get(k, 0) for k in range(len(cuts) + 1)]
    places = n * (banded.agg(F.approx_count_distinct("grp")).first()[0] or 0)
    order = Window.partitionBy("grp").orderBy(F.col("score").desc(), F.col("item"))
    done: DataFrame | None = None
    have: DataFrame | None = None
    at = taken = 0
    while at < len(sizes):
        end = _run(sizes, at, max(places - taken, 0))
        part = banded.filter(F.col("band").between(at, end - 1)).select("grp", "item", "score")
        if have is not None:
            part = sized_join(part, have.filter(F.col("have") >= n).select("grp"), ["grp"], "left_anti", limit)
        # Spark limits each group to n rows within every task before the shuffle
        won = part.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
        if have is not None:
            won = sized_join(won, have.filter(F.col("have") < n), ["grp"], "left", limit)
            won = won.withColumn("rank", F.col("rank") + F.coalesce("have", F.lit(0)).cast("int")).filter(F.col("rank") <= n)
        won = materialize(won.select("grp", "item", "score", "rank"), "top")
        done = won if done is None else done.unionByName(won)
        at = end
        if at < len(sizes):
            old, have = have, materialize(done.groupBy("grp").agg(F.count(F.lit(1)).alias("have")), "have")
            taken = have.agg(F.sum("have")).first()[0] or 0
            if old is not None:
                release(old)
    return done if done is not None else banded.select("grp", "item", "score", F.lit(0).alias("rank"))
