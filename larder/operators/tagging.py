"""Tagging by a keyword taxonomy, term indexes, demand signals and their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions import text as X
from larder.functions.numeric import steady_round
from larder.functions.vocabulary import JUNK, TAXONOMY
from larder.session import broadcast_if_small


def tags_of(t: Column, rules: list[tuple[str, str, list[str]]] | None = None) -> Column:
    """The tags of a normalised text with the first keyword, in list order, that stands in it as a word.

    One alternation per tag decides; only for tags that match is the first keyword looked for. Both run in the JVM.
    """
    found = []
    for tag, dimension, keys in rules or TAXONOMY:
        word = F.coalesce(*[F.when(t.rlike(rf"\b{k}\b"), F.lit(k)) for k in keys])
        hit = F.struct(F.lit(tag).alias("tag"), F.lit(dimension).alias("dimension"), word.alias("word"))
        found.append(F.when(t.rlike(X.keyword_pattern(keys)), hit))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def tag_rows(df: DataFrame, text: Column, keep: list[str]) -> DataFrame:
    """(keep..., tag, dimension, matched_term): a row per text and tag."""
    ready = df.select(*keep, X.normalize_for_tags(text).alias("_text"))
    hits = ready.select(*keep, F.explode(tags_of(F.col("_text"))).alias("_t"))
    return hits.select(*keep, "_t.tag", "_t.dimension", X.normalize_term(F.col("_t.word")).alias("matched_term"))


def weakly_tagged(df: DataFrame, tags: DataFrame, key: str, most: int = 1) -> DataFrame:
    """Keys of ``df`` with at most ``most`` tags, those without any included."""
    n = tags.groupBy(key).agg(F.countDistinct("tag").alias("n_tags"))
    out = df.select(key).distinct().join(n, key, "left").withColumn("n_tags", F.coalesce("n_tags", F.lit(0)))
    return out.filter(F.col("n_tags") <= most)


def joined_sorted(values: Column) -> Column:
    return F.array_join(F.array_sort(F.collect_set(values)), "|")


def term_index(
    recipes: DataFrame, tags: DataFrame, id_col: str, name_col: str, list_col: str, shown: int = 5
) -> DataFrame:
    """One row per recipe: canonical terms, tags and dimensions joined and sorted, and the first ingredients."""
    agg = tags.groupBy(id_col).agg(
        joined_sorted(F.col("tag")).alias("tags"), joined_sorted(F.col("dimension")).alias("tag_dimensions")
    )
    base = recipes.select(id_col, F.col(name_col).alias("recipe_name"), X.canonical_strict(F.col(name_col)).alias("canonical_term"),
                          X.canonical_loose(F.col(name_col)).alias("loose_term"),
                          F.array_join(F.slice(list_col, 1, shown), ", ").alias("ingredients_summary"))
    return base.join(agg, id_col, "left")


def phrase_scores(blocks: DataFrame, body: str) -> DataFrame:
    """(term, raw_frequency, normalised_score): dish phrases of listings with their count and its z-score over all terms."""
    junk = F.col(body).rlike("(?i)" + "|".join(JUNK))
    cleaned = F.transform(X.phrase_parts(F.col(body)), X.clean_phrase)
    terms = blocks.filter((F.length(body) >= 5) & ~junk).select(
        F.explode(F.filter(cleaned, X.is_dish_phrase)).alias("term")
    )
    counts = terms.groupBy("term").agg(F.count(F.lit(1)).alias("raw_frequency"))
    return with_z(counts, "raw_frequency", "normalised_score")


def with_z(df: DataFrame, value: str, name: str, digits: int = 6) -> DataFrame:
    """Adds the z-score over all rows (sample deviation; 0 where that is null or 0). Mean and deviation are one row."""
    s = df.agg(F.avg(value).alias("m"), F.stddev(value).alias("s")).first()
    z = F.lit(0.0) if not s["s"] else (F.col(value) - F.lit(s["m"])) / F.lit(s["s"])
    return df.withColumn(name, F.when(F.col(value).isNotNull(), steady_round(z, digits)))


def group_z(df: DataFrame, groups: list[str], value: str, name: str, digits: int = 6) -> DataFrame:
    """Adds the z-score within groups, from statistics joined back instead of a window over whole groups."""
    stats = df.groupBy(*groups).agg(F.avg(value).alias("_m"), F.stddev(value).alias("_s"))
    z = F.when(F.coalesce("_s", F.lit(0.0)) == 0, 0.0).otherwise(
        (F.col(value) - F.col("_m")) / F.nullif("_s", F.lit(0.0))
    )
    return df.join(broadcast_if_small(stats), groups).withColumn(name, steady_round(z, digits)).drop("_m", "_s")


def external_terms(rows: DataFrame, tags: DataFrame) -> DataFrame:
    """Search terms of all sources: valid ones with canonical form, tags, and of each (source, canonical term) the best.

    ``rows`` has source, raw_term, source_score; ``tags`` has raw_term, tag, dimension.
    """
    ok = X.is_external_term(F.col("raw_term")) & ~X.is_blocked_topic(F.col("raw_term")) & X.has_food_intent(F.col("raw_term"))
    terms = rows.filter(F.coalesce(ok, F.lit(False))).withColumn(
        "canonical_term", X.canonical_strict(F.col("raw_term"))
    ).filter("canonical_term <> ''")
    w = Window.partitionBy("source", "canonical_term").orderBy(F.col("source_score").desc_nulls_last(), "raw_term")
    best = terms.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    agg = tags.groupBy("raw_term").agg(
        joined_sorted(F.col("tag")).alias("tags"), joined_sorted(F.col("dimension")).alias("tag_dimensions")
    )
    return best.join(agg, "raw_term", "left").select(
        "source", "raw_term", "canonical_term", "source_score", "tags", "tag_dimensions"
    )


def monthly_interest(points: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """(key, month_end, interest): monthly means on an unbroken spine of months between a key's first and last point."""
    rows = points.select(
        F.col(key).alias("_k"), F.last_day(F.col(at).cast("date")).alias("month_end"), F.col(value).alias("_v")
    )
    means = rows.groupBy("_k", "month_end").agg(F.avg("_v").alias("_m"))
    span = means.groupBy("_k").agg(F.min("month_end").alias("a"), F.max("month_end").alias("b"))
    months = F.sequence(F.trunc("a", "month"), F.trunc("b", "month"), F.expr("interval 1 month"))
    spine = span.select("_k", F.explode(months).alias("_d")).select("_k", F.last_day("_d").alias("month_end"))
    out = spine.join(means, ["_k", "month_end"], "left")
    return out.select(F.col("_k").alias(key), "month_end", steady_round(F.col("_m"), 2).alias("interest"))


def supply_demand_gap(demand: DataFrame, supply: DataFrame) -> DataFrame:
    """(term, combined_score, recipe_count, gap_score, opportunity_tier): demand (term, combined_score) against the
    z-score of supply (term, recipe_count); where only one side knows a term, that side decides."""
    from larder.functions.vocabulary import TIER_HIGH, TIER_MEDIUM

    z = with_z(supply, "recipe_count", "_z")
    both = demand.join(z, "term", "full_outer")
    gap = F.when(F.col("_z").isNull(), F.col("combined_score")).otherwise(
        F.coalesce("combined_score", F.lit(0.0)) - F.col("_z")
    )
    g = steady_round(gap)
    tier = F.when(g > TIER_HIGH, "high").when(g > TIER_MEDIUM, "medium").otherwise("low")
    return both.select("term", "combined_score", "recipe_count", g.alias("gap_score"), tier.alias("opportunity_tier"))
