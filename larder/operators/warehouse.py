"""Star schema: keyed upserts, surrogate keys, dimension and fact builds, serving view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from larder.operators.quality import keep_first
from larder.session import broadcast_if_small


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """The columns of ``schema`` in its order, cast, missing ones null, others dropped."""
    cols = [
        (F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema
    ]
    return df.select(*cols)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], update: list[str]) -> DataFrame:
    """Rows of both; on equal keys only the columns of ``update`` take the new value. Keys are unique on each side.

    One full outer join on the keys; null keys never meet, as in a database.
    """
    o = old.select(*[F.col(c).alias(f"_o_{c}") for c in old.columns], F.lit(True).alias("_old"))
    n = new.select(*[F.col(c).alias(f"_n_{c}") for c in old.columns], F.lit(True).alias("_new"))
    on = F.col(f"_o_{keys[0]}") == F.col(f"_n_{keys[0]}")
    for k in keys[1:]:
        on = on & (F.col(f"_o_{k}") == F.col(f"_n_{k}"))
    both = F.col("_old").isNotNull() & F.col("_new").isNotNull()

    def value(c: str) -> Column:
        a, b = F.col(f"_o_{c}"), F.col(f"_n_{c}")
        if c in update:
            return F.when(F.col("_new").isNotNull(), b).otherwise(a).alias(c)
        return F.when(both | F.col("_new").isNull(), a).otherwise(b).alias(c)

    return o.join(n, on, "full_outer").select(*[value(c) for c in old.columns])


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the rows whose key is not there yet, of several new rows with a key the smallest."""
    fresh = new.select(*old.columns).join(old.select(*keys), keys, "left_anti")
    return old.unionByName(keep_first(fresh, keys, [F.col(c) for c in old.columns if c not in keys] or keys))


def date_dimension(rows: DataFrame, col: str) -> DataFrame:
    """(date_id, full_date, year, month, day_of_week, quarter): the distinct days, numbered in order.

    The window has one group, of as many rows as there are different days.
    """
    d = F.col("full_date")
    days = rows.select(F.col(col).cast("date").alias("full_date")).filter("full_date is not null").distinct()
    return days.select(
        F.dense_rank().over(Window.orderBy("full_date")).alias("date_id"), "full_date", F.year(d).alias("year"),
        F.month(d).alias("month"), F.date_format(d, "EEEE").alias("day_of_week"), F.quarter(d).alias("quarter"),
    )


def new_dates(rows: DataFrame, col: str, stored: DataFrame | None) -> DataFrame:
    """The days that ``stored`` lacks, numbered on from its highest date_id, so that stored ids stay as they are."""
    if stored is None:
        return date_dimension(rows, col)
    day = F.col(col).cast("date")
    fresh = rows.select(day.alias("full_date")).distinct().join(stored.select("full_date"), "full_date", "left_anti")
    top = stored.agg(F.max("date_id")).first()[0] or 0
    return date_dimension(fresh, "full_date").withColumn("date_id", (F.col("date_id") + top).cast("int"))


def interaction_id(user: Column, recipe: Column, day: Column) -> Column:
    """60 bits of SHA-256 over user_recipe_date: the same id for the same review, whatever brought it."""
    text = F.concat_ws("_", user.cast("string"), recipe.cast("string"), day.cast("date").cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")


def fact_interactions(rows: DataFrame, days: DataFrame) -> DataFrame:
    """Facts with the date's key; rows of unmapped days are dropped. ``days`` has a row per calendar day."""
    mapped = rows.join(
        broadcast_if_small(days.select("full_date", "date_id")), rows["date"].cast("date") == days["full_date"]
    )
    return mapped.select(
        interaction_id(F.col("user_id"), F.col("recipe_id"), F.col("date")).alias("interaction_id"),
        "user_id", "recipe_id", "date_id", "rating", "sentiment_score",
        ((F.col("rating") - 3) / 2.0).alias("rating_normalized"),
        (
            (F.col("rating") - 3) / 2.0 - F.col("sentiment_score")
        ).alias("rating_sentiment_gap"), F.lit("batch").alias("source"),
    )


def serving_view(batch: DataFrame, stream: DataFrame, key: str) -> DataFrame:
    """Batch rows and those stream rows that the batch does not have yet."""
    return batch.unionByName(stream.join(batch.select(key), key, "left_anti"))
