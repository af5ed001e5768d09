"""Joins that stand a key with a large share of all rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.session import BROADCAST_BYTES, materialize, table_bytes


def count_keys(df: DataFrame, keys: list[str], name: str = "_n") -> DataFrame:
    """A written table of the rows per key, null keys left out."""
    return materialize(df.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias(name)), "keys")


def heavy_of(counts: DataFrame, keys: list[str], name: str = "_n", share: float = 0.01) -> DataFrame:
    """The keys of a table of counts with at least ``share`` of all rows."""
    total = counts.agg(F.sum(name)).first()[0] or 0
    return counts.filter(F.col(name) >= max(1.0, share * total)).select(*keys)


def heavy_keys(df: DataFrame, keys: list[str], share: float = 0.01) -> DataFrame:
    """Keys with at least ``share`` of all rows with a key: at most 1 / share of them. Counts combine before the shuffle."""
    return heavy_of(count_keys(df, keys), keys, share=share)


def split_join(
    left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", share: float = 0.01,
    heavy: DataFrame | None = None
) -> DataFrame:
    """``left`` joined with ``right`` (unique by ``on``); rows of heavy keys meet their few partners by broadcast.

    ``how`` is inner, left, left_semi or left_anti. Null keys meet nothing. ``heavy`` saves the count if known already.
    """
    heavy = heavy_keys(left, on, share) if heavy is None else heavy
    marked = left.join(F.broadcast(heavy.withColumn("_heavy", F.lit(True))), on, "left")  # at most 1 / share rows
    few = right.join(F.broadcast(heavy), on, "left_semi")
    a = marked.filter(F.col("_heavy").isNull()).drop("_heavy").join(right, on, how)
    b = marked.filter(F.col("_heavy")).drop("_heavy").join(F.broadcast(few), on, how)  # at most 1 / share rows
    return a.unionByName(b)


def sized_join(
    left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", limit: int = BROADCAST_BYTES,
    heavy: Callable[[], DataFrame] | None = None, share: float = 0.01
) -> DataFrame:
    """``left`` joined with ``right`` (unique by ``on``, read more than once): by broadcast where the measured bytes of
    ``right`` stay within ``limit``, else by ``split_join``, so that no size of ``right`` brings a hot key to one task."""
    if table_bytes(right) <= limit:
        return left.join(F.broadcast(right), on, how)
    return split_join(left, right, on, how, share, heavy and heavy())
