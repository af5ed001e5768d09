"""Percentiles of very large numeric columns per group, by radix selection.

Floating values are mapped to integers of the same order. The leading digits of all values are counted; only values
whose leading digits hold a wanted rank are counted by the next digit, until all 64 bits are known. The counts of the
first digit are a summary that can be added up over partitions or days and gives percentiles with bounded error.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.operators.skew import sized_join
from larder.session import materialize, release

SIGN = -(2**63)


@F.pandas_udf(T.LongType())
def ordered_key(x: pd.Series) -> pd.Series:
    """A bigint whose unsigned order is the order of the doubles; -0.0 counts as 0.0."""
    b = (x.to_numpy(dtype="float64") + 0.0).view("int64")
    return pd.Series(b ^ ((b >> 63) | np.int64(SIGN)))


@F.pandas_udf(T.DoubleType())
def key_value(k: pd.Series) -> pd.Series:
    b = k.to_numpy(dtype="int64")
    return pd.Series((b ^ (~(b >> 63) | np.int64(SIGN))).view("float64"))


def keyed_values(df: DataFrame, group: str, fields: list[str]) -> DataFrame:
    """(field_name, grp, key) for each value that is neither null nor NaN."""
    spec = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"`{f}`").cast("double").alias("v")) for f in fields])
    long = df.select(F.col(f"`{group}`").alias("grp"), F.explode(spec).alias("x")).select(
        F.col("x.f").alias("field_name"), "grp", F.col("x.v").alias("v")
    )
    long = long.filter(F.col("v").isNotNull() & ~F.isnan("v"))
    return long.select("field_name", "grp", ordered_key("v").alias("key"))


def _digit(key: Column, done: int, bits: int) -> Column:
    return F.shiftrightunsigned(F.shiftleft(key, done) if done else key, 64 - bits)


def summary(values: DataFrame, bits: int = 16) -> DataFrame:
    """Mergeable histogram (field_name, grp, prefix, n) of the leading ``bits``: 12 + m bits keep m bits of the fraction,
    so a percentile read from it is off by a factor of at most 1 + 2^-m (m = bits - 12)."""
    return values.groupBy(
        "field_name", "grp", F.shiftrightunsigned("key", 64 - bits).alias("prefix")
    ).agg(F.count(F.lit(1)).alias("n"))


def merge_summaries(*parts: DataFrame) -> DataFrame:
    """Adds up summaries of disjoint partitions or days."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("field_name", "grp", "prefix").agg(F.sum("n").alias("n"))


def summary_percentiles(hist: DataFrame, pcts: list[int], bits: int = 16) -> DataFrame:
    """(field_name, grp, pct, value, low, high): bounds of the exact percentile and their middle."""
    w = Window.partitionBy("field_name", "grp").orderBy("prefix")
    cum = hist.withColumn("upto", F.sum("n").over(w)).withColumn(
        "total", F.sum("n").over(Window.partitionBy("field_name", "grp"))
    )
    rank = F.greatest(F.ceil(F.col("total") * F.col("pct") / F.lit(100)), F.lit(1))
    hit = cum.withColumn("pct", F.explode(F.array(*[F.lit(p) for p in pcts]))).filter(
        (F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank)
    )
    low = F.shiftleft("prefix", 64 - bits)
    high = low.bitwiseOR(F.lit(2 ** (64 - bits) - 1))
    out = hit.select("field_name", "grp", "pct", key_value(low).alias("a"), key_value(high).alias("b"))
    return out.select(
        "field_name", "grp", "pct", ((F.col("a") + F.col("b")) / 2).alias("value"), F.least("a", "b").alias("low"),
        F.greatest("a", "b").alias("high")
    )


def radix_percentiles(values: DataFrame, pcts: list[int], bits: int = 16) -> DataFrame:
    """(field_name, grp, pct, value, n): the smallest value that at least pct % of a group's values do not exceed, exactly.

    ``values`` is a table of ``keyed_values`` (cut its lineage first: it is read once per digit). A null group is a
    group; groups without values give no row. ``bits`` divides 64; counts per group have at most 2^bits rows.
    """
    group = ["field_name", "grp"]
    values, state, last = values.select(*group, "key"), None, None
    for done in range(0, 64, bits):
        rows = values
        by = [*group, "prefix"]
        if state is None:
            rows = rows.withColumn("prefix", F.lit(0).cast("bigint"))
        else:
            rows = rows.withColumn("prefix", F.shiftrightunsigned("key", 64 - done))
            # a null group joins by a mark; a group with a large share of the rows is split off beyond the broadcast size
            marked = [F.coalesce(F.concat(F.lit("="), F.col("grp").cast("string")), F.lit("")).alias("_grp")]
            live = state.select("field_name", *marked, "prefix").distinct()
            on = ["field_name", "_grp", "prefix"]
            rows = sized_join(rows.select("*", *marked), live, on, "left_semi")
        hist = rows.groupBy(*by, _digit(F.col("key"), done, bits).alias("digit")).agg(F.count(F.lit(1)).alias("n"))
        w = Window.partitionBy(*by).orderBy("digit")
        cum = hist.withColumn("upto", F.sum("n").over(w))
        if state is None:
            total = F.sum("n").over(Window.partitionBy(*by))
            cum = cum.withColumn("total", total).withColumn("pct", F.explode(F.array(*[F.lit(int(p)) for p in pcts])))
            cum = cum.withColumn("rank", F.greatest(F.expr("(total * pct + 99) div 100"), F.lit(1)))
        else:
            s = state.withColumnsRenamed({c: f"_{c}" for c in by})
            on = (
                cum["field_name"] == s["_field_name"]
            ) & cum["grp"].eqNullSafe(s["_grp"]) & (cum["prefix"] == s["_prefix"])
            cum = cum.join(s, on)
        hit = cum.filter((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
        prefix = F.shiftleft("prefix", bits).bitwiseOR(F.col("digit")) if done else F.col("digit")
        state = hit.select(
            *group, prefix.alias("prefix"), "pct", "total", (F.col("rank") - (F.col("upto") - F.col("n"))).alias("rank")
        )
        old, state = last, materialize(state, "ranks")
        if old is not None:
            release(old)
        last = state
    return state.select(*group, "pct", key_value("prefix").alias("value"), F.col("total").alias("n"))
