"""Ratings and users: Bayesian ratings, user statistics, category profiles, ingredient features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.numeric import steady_round
from larder.functions.vocabulary import CATEGORIES, PSEUDO_COUNT
from larder.operators.skew import count_keys, heavy_of, split_join


def bayes_rating(rows: DataFrame, item: str, user: str, value: str, m: float = PSEUDO_COUNT) -> DataFrame:
    """(item, rating, weight, n): (sum of w v + m C) / (sum of w + m); w = 1 / the user's number of scored rows.

    The user counts are combined before the shuffle and joined back, those of heavy users by broadcast, so that a user
    with a third of all rows is not brought to one task; C is one number.
    """
    scored = rows.filter(F.col(value).isNotNull() & F.col(user).isNotNull() & F.col(item).isNotNull())
    mean = scored.agg(F.avg(value)).first()[0]
    counts = count_keys(scored, [user])
    w = 1.0 / F.col("_n")
    weighed = split_join(scored.select(user, item, value), counts, [user], heavy=heavy_of(counts, [user]))
    per = weighed.groupBy(item).agg(
        F.sum(w * F.col(value)).alias("_wv"), F.sum(w).alias("weight"), F.count(F.lit(1)).alias("n")
    )
    rating = (F.col("_wv") + F.lit(m * mean if mean is not None else None)) / (F.col("weight") + m)
    return per.select(item, steady_round(rating).alias("rating"), steady_round(F.col("weight")).alias("weight"), "n")


def user_stats(rows: DataFrame) -> DataFrame:
    """Per user: mean and spread of ratings, counts, mean sentiment and gap, share of positive scores, active days.

    ``rows`` has user_id, recipe_id, date, rating, sentiment_score. The number of different recipes comes from a first
    aggregation by user and recipe; the rest are sums that combine before the shuffle.
    """
    gap = (F.col("rating") - 3) / 2.0 - F.col("sentiment_score")
    x = F.col("rating").cast("double")
    part = rows.filter(F.col("user_id").isNotNull()).groupBy("user_id", "recipe_id").agg(
        F.count("rating").alias("n"), F.sum(x).alias("sx"), F.sum(x * x).alias("sxx"),
        F.count("sentiment_score").alias("ns"), F.sum("sentiment_score").alias("ss"), F.sum(
            F.when(F.col("sentiment_score") > 0, 1).otherwise(0)
        ).alias("pos"),
        F.count(gap).alias("ng"), F.sum(gap).alias("sg"), F.min("date").alias("first"), F.max("date").alias("last"),
    )
    s = part.groupBy("user_id").agg(
        *[F.sum(c).alias(c) for c in ("n", "sx", "sxx", "ns", "ss", "pos", "ng", "sg")],
        F.count("recipe_id").alias("recipe_diversity"), F.min("first").alias("first_review_date"), F.max("last").alias("last_review_date"),
    )
    n = F.col("n")
    var = (F.col("sxx") - F.col("sx") * F.col("sx") / F.nullif(n, F.lit(0))) / F.nullif(n - 1, F.lit(0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return s.select(
        "user_id", n.alias("review_count"),
        steady_round(F.col("sx") / F.nullif(n, F.lit(0))).alias("avg_rating_given"),
        steady_round(zero(F.sqrt(F.greatest(var, F.lit(0.0))))).alias("std_rating_given"),
        "recipe_diversity",
        steady_round(zero(F.col("ss") / F.nullif("ns", F.lit(0)))).alias("avg_sentiment_score"),
        steady_round(zero(F.col("sg") / F.nullif("ng", F.lit(0)))).alias("avg_rating_gap"),
        steady_round(zero(F.col("pos") / F.nullif("ns", F.lit(0)))).alias("pct_positive_sentiment"),
        F.date_diff(
            "last_review_date", "first_review_date"
        ).alias("active_days"), "first_review_date", "last_review_date",
    )


def recipe_categories(recipes: DataFrame, id_col: str, list_col: str, categories: dict = CATEGORIES) -> DataFrame:
    """(id, category): a recipe is in a category if one of its ingredients contains one of its words."""

    def contains_any(words: list[str]) -> Column:
        return F.exists(list_col, lambda i: i.rlike("|".join(words)))

    has = [F.when(contains_any(ws), F.lit(c)) for c, ws in categories.items()]
    found = F.filter(F.array(*has), lambda c: c.isNotNull())
    return recipes.select(F.col(id_col), F.explode(found).alias("category"))


def category_profile(rows: DataFrame, categories: DataFrame, user: str, item: str, names: list[str]) -> DataFrame:
    """Mean rating of each user per category in columns avg_rating_<category>; gaps get the column's mean.

    The mean rating per user and item is built first, so the fan-out over categories works on combined rows.
    """
    pairs = rows.filter(F.col(user).isNotNull() & F.col("rating").isNotNull()).groupBy(user, item).agg(
        F.sum("rating").alias("s"), F.count("rating").alias("n")
    )
    wide = (
        split_join(pairs, categories.withColumnRenamed(categories.columns[0], item), [item])  # few categories per item
        .groupBy(user)
        .pivot("category", names)
        .agg((F.sum("s") / F.sum("n")).alias("m"))
    )
    means = wide.agg(*[F.avg(c).alias(c) for c in names]).first()
    fill = [steady_round(F.coalesce(F.col(c), F.lit(means[c]))).alias(f"avg_rating_{c}") for c in names]
    return wide.select(user, *fill)


def ingredient_features(ratings: DataFrame, recipes: DataFrame, id_col: str, list_col: str) -> DataFrame:
    """(ingredient, recipe_count, avg_rating): different recipes, and the mean of the recipes' mean ratings."""
    per = ratings.groupBy("recipe_id").agg(F.avg("rating").alias("m"))
    listed = recipes.select(
        F.col(id_col).alias("recipe_id"), F.explode(list_col).alias("ingredient")
    ).join(per, "recipe_id", "left")
    by_pair = listed.groupBy("ingredient", "recipe_id").agg(F.count(F.lit(1)).alias("k"), F.first("m").alias("m"))
    return by_pair.groupBy("ingredient").agg(
        F.count(F.lit(1)).alias("recipe_count"),
        steady_round(
            F.sum(F.col("m") * F.col("k")) / F.nullif(F.sum(F.when(F.col("m").isNotNull(), F.col("k"))), F.lit(0))
        ).alias("avg_rating"),
    )


def running_counts(rows: DataFrame, key: str) -> DataFrame:
    """Each row with a key and its key's number of rows, by a combined count joined back rather than a window per key."""
    counts = count_keys(rows, [key], "n_of_key")
    return split_join(rows, counts, [key], heavy=heavy_of(counts, [key], "n_of_key"))


def mode_of(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, n): the most frequent value, the smallest on ties."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(group).orderBy(F.col("n").desc(), value)
    return counts.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
