"""Cleaning and validation of interactions and recipes. Each rule is a narrow step unless its text names a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.numeric import finite
from larder.functions.text import list_literal
from larder.operators.quantiles import exact_quantiles
from larder.operators.skew import sized_join, split_join
from larder.session import materialize

NUTRITION = [
    "calories_pdv", "total_fat_pdv", "sugar_pdv", "sodium_pdv", "protein_pdv", "saturated_fat_pdv", "carbs_pdv"
]


def lacking_columns(df: DataFrame, names: list[str]) -> list[str]:
    return [n for n in names if n not in df.columns]


def require_columns(df: DataFrame, names: list[str]) -> None:
    missing = lacking_columns(df, names)
    if missing:
        raise ValueError(f"missing columns: {missing}")


def require_keys(df: DataFrame, names: list[str]) -> None:
    """Raises if a key column is missing or holds nulls: one aggregate row."""
    require_columns(df, names)
    row = df.agg(*[F.count_if(F.col(n).isNull()).alias(n) for n in names]).first()
    bad = {n: row[n] for n in names if row[n]}
    if bad:
        raise ValueError(f"null keys: {bad}")


def parse_dates(df: DataFrame, col: str) -> DataFrame:
    """Text to timestamp; unreadable dates drop the row."""
    return df.withColumn(col, F.try_to_timestamp(F.col(col).cast("string"))).filter(F.col(col).isNotNull())


def valid_ratings(df: DataFrame, col: str = "rating", low: int = 1, high: int = 5) -> DataFrame:
    return df.filter(F.col(col).between(low, high))


def coerce_rating(x: Column, low: int = 1, high: int = 5) -> Column:
    """Anything to an integer rating, half-even; null if unreadable or out of range."""
    r = F.rint(F.expr(f"try_cast({x} as double)")) if isinstance(x, str) else F.rint(x.try_cast("double"))
    return F.when(r.between(low, high), r.cast("int"))


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the first in a total order. Shuffles by the keys; Spark prunes to one row a key before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def date_parts(df: DataFrame, col: str = "date") -> DataFrame:
    d = F.col(col)
    return df.withColumns(
        {"year": F.year(d), "month": F.month(d), "day_of_week": F.date_format(d, "EEEE"), "quarter": F.quarter(d)}
    )


def not_after(df: DataFrame, col: str, as_of: str) -> DataFrame:
    """Drops rows dated after ``as_of``."""
    return df.filter(F.col(col) <= F.lit(as_of).cast("timestamp"))


def busy_users(df: DataFrame, user: str, day: Column, more_than: int = 50) -> DataFrame:
    """Users with more than so many rows on any one day: counts are combined before the shuffle, so a hot user is cheap."""
    per = df.filter(F.col(user).isNotNull()).groupBy(user, day.alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    return per.filter(F.col("_n") > more_than).select(user).distinct()


def drop_users(df: DataFrame, users: DataFrame, user: str) -> DataFrame:
    """``df`` without the rows of ``users`` (unique)."""
    return sized_join(df, materialize(users, "users"), [user], "left_anti")


def cap(x: Column, most: float) -> Column:
    return F.when(x.isNotNull(), F.least(x, F.lit(most)))


def clean_minutes(x: Column, most: int = 4320) -> Column:
    """Not positive is null, long is capped."""
    return F.when(x > 0, F.least(x, F.lit(most)))


def negative_as_null(x: Column) -> Column:
    return F.when(x >= 0, x)


def parse_nutrition(x: Column) -> list[Column]:
    """The seven nutrition values of a list literal; all null unless it is a list of exactly seven."""
    a = list_literal(x, "double")
    return [F.when(F.size(a) == len(NUTRITION), F.get(a, F.lit(i))).alias(n) for i, n in enumerate(NUTRITION)]


def clean_name(x: Column, most: int = 200) -> Column:
    """NUL out, blanks collapsed, cut to length; null without a letter or digit."""
    t = F.trim(F.regexp_replace(F.regexp_replace(x, "\\x00", ""), r"\s+", " "))
    t = F.substring(t, 1, most)
    return F.when(t.rlike("[a-zA-Z0-9]"), t)


def canonical_ingredients(df: DataFrame, id_col: str, list_col: str, mapping: DataFrame) -> DataFrame:
    """(id, ingredients, joined, n): each list mapped name by name (raw, canonical), unmapped names kept, in order.

    Joins on the ingredient name (``mapping`` is unique by it), names on many lists by broadcast; the list is put together
    again by id.
    """
    raw = df.select(id_col, F.posexplode(list_col).alias("_p", "_raw")).withColumn(
        "raw", F.regexp_replace(F.lower(F.trim("_raw")), r"\s+", " ")
    )
    named = split_join(
        raw, mapping.select("raw", "canonical"), ["raw"], "left"
    ).withColumn("_c", F.coalesce("canonical", "raw"))
    lists = named.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("_p", "_c"))).alias("_l"))
    names = F.transform("_l", lambda s: s["_c"])
    return lists.select(
        id_col, names.alias("ingredients"), F.array_join(names, "|").alias("joined"), F.size("_l").alias("n")
    )


def upper_fences(df: DataFrame, cols: list[str], q: float = 0.95) -> dict[str, float | None]:
    """The exact q-quantile of each column, NaN left out."""
    return {c: v for (c, _), v in exact_quantiles(df, cols, [q]).items()}


def flag_outliers(df: DataFrame, cols: list[str] = NUTRITION, q: float = 0.95) -> DataFrame:
    """Adds ``is_outlier``: any column above its own quantile over all rows. The quantiles are one row of numbers."""
    fences = upper_fences(df, cols, q)
    above = [F.coalesce(finite(F.col(c)) > F.lit(fences[c]).cast("double"), F.lit(False)) for c in cols]
    flag = above[0]
    for a in above[1:]:
        flag = flag | a
    return df.withColumn("is_outlier", flag)


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def balance_score(
    df: DataFrame, good: str = "protein_pdv",
    bad: tuple = (("saturated_fat_pdv", 0.25), ("sugar_pdv", 0.2), ("sodium_pdv", 0.15))
) -> Column:
    """0.4 good - weighted bad, each as a share of its 95th percentile cut to 0..1; the sum cut to -1..1."""
    q = upper_fences(df, [good, *[c for c, _ in bad]])

    def norm(c: str) -> Column:
        top = q[c]
        return clip(finite(F.col(c)) / F.lit(top), 0.0, 1.0) if top and top > 0 else F.lit(0.0)

    total = norm(good) * 0.4
    for c, w in bad:
        total = total - norm(c) * w
    return clip(total, -1.0, 1.0)


def null_profile(df: DataFrame) -> DataFrame:
    """(column_name, n_rows, n_null): one pass over the table, one row per column."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_all"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns]
    )
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("n_null")) for c in df.columns])
    )
    return counts.select("_all", pairs.alias("x")).select("x.column_name", F.col("_all").alias("n_rows"), "x.n_null")
