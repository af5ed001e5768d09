"""Exact quantiles of several columns over all rows, without a task that holds all values of a column.

Equal values are counted first, the counts are range-partitioned by column and value, and their totals per partition
tell in which partition a wanted rank lies. Only those partitions are searched.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.numeric import finite
from larder.session import materialize, release


def exact_quantiles(df: DataFrame, cols: list[str], shares: list[float]) -> dict[tuple[str, float], float | None]:
    """{(column, share): value}: the quantile with linear interpolation between the two ranks beside it.

    Null and NaN do not count; a column without values gives None. Brought to the driver are a number per partition and
    column, and two values per column and share.
    """
    spec = F.array(*[F.struct(F.lit(c).alias("c"), finite(F.col(f"`{c}`")).alias("v")) for c in cols])
    long = df.select(F.explode(spec).alias("x")).select("x.c", "x.v").filter("v is not null")
    counts = long.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n")).repartitionByRange("c", "v")
    counts = materialize(counts.withColumn("part", F.spark_partition_id()), "values")
    held: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for c, part, n in counts.groupBy("c", "part").agg(F.sum("n")).orderBy("part").collect():
        held[c].append((part, n))
    asked: dict[tuple[str, float], tuple[int, int, float]] = {}
    wanted: set[tuple[str, int, int, int]] = set()
    for c in cols:
        total = sum(n for _, n in held[c])
        for q in shares if total else []:
            at = q * (total - 1)
            low, high = math.floor(at), math.ceil(at)
            asked[c, q] = (low, high, at - low)
            for rank in (low, high):
                before = 0
                for part, n in held[c]:
                    if rank < before + n:
                        wanted.add((c, part, rank, rank - before))
                        break
                    before += n
    value: dict[tuple[str, int], float] = {}
    if wanted:
        ranks = counts.sparkSession.createDataFrame(sorted(wanted), "c string, part int, rank bigint, inside bigint")
        near = counts.join(F.broadcast(ranks.select("c", "part").distinct()), ["c", "part"], "left_semi")  # two rows a quantile
        upto = near.withColumn("upto", F.sum("n").over(Window.partitionBy("c", "part").orderBy("v")))
        hit = upto.join(F.broadcast(ranks), ["c", "part"]).filter("inside < upto and inside >= upto - n")
        value = {(r["c"], r["rank"]): r["v"] for r in hit.select("c", "rank", "v").collect()}
    release(counts)
    out: dict[tuple[str, float], float | None] = {(c, q): None for c in cols for q in shares}
    for (c, q), (low, high, part) in asked.items():
        a, b = value[c, low], value[c, high]
        out[c, q] = a if part == 0 else a + (b - a) * part
    return out
