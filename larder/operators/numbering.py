"""Exact numbering within groups, without a task that holds a whole group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_in_groups(
    df: DataFrame, keys: list[str], order: list[str], name: str = "number", salts: int = 64
) -> DataFrame:
    """Adds ``name``: 0, 1, ... within each group.

    Rows are spread over ``salts`` parts of their group by the hash of ``order`` (which should tell rows apart), ordered
    in each part, and get the summed sizes of the parts before theirs as offset. The numbers depend on the data only,
    not on partitions. Null keys form a group; rows equal in ``order`` get different numbers in any order.
    """
    salt = F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int")
    part = [*keys, "_salt"]
    local = df.withColumn("_salt", salt).withColumn(
        "_in", F.row_number().over(Window.partitionBy(*part).orderBy(*order)) - 1
    )
    sizes = local.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    offsets = offsets.withColumnsRenamed({c: f"_k_{c}" for c in part})
    on = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in part])
    return local.join(offsets, on).select(*df.columns, (F.col("_off") + F.col("_in")).cast("bigint").alias(name))
