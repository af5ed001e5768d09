"""Per-key results when a few keys hold most records: exact offset chunking.

The rows of every heavy key are numbered exactly: they are counted per input partition, the counts are summed up to
offsets, and each row gets its offset plus its place in the partition. Equal-sized chunks of numbers are processed
on their own and their states merged in order, so no task gets more than a chunk of one key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.session import materialize


def located(df: DataFrame) -> DataFrame:
    """Adds the input partition and the place in it. ``df`` must be read the same way again after a lost task
    (a scan of files and narrow steps on it); cut the lineage of anything else first."""
    at = F.monotonically_increasing_id()
    return df.withColumn("_part", F.shiftright(at, 33).cast("int")).withColumn("_at", at)


def in_order(df: DataFrame, order: list[str]) -> DataFrame:
    """``located`` in the order of the columns ``order`` (nulls first) instead of the input's: the rows are
    range-partitioned and written, so that a lost task finds the same places again. Rows equal in ``order`` should be
    equal in all that counts."""
    cols = [F.col(f"`{c}`").asc_nulls_first() for c in order]
    return materialize(located(df.repartitionByRange(*cols).sortWithinPartitions(*cols)), "order")


def number_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``_number``: 1, 2, ... within each key in input order, without bringing a key's rows to one task."""
    by = [*keys, "_part"]
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = rows.withColumn("_local", F.row_number().over(Window.partitionBy(*by).orderBy("_at")))
    return local.join(offsets, by).withColumn("_number", F.col("_offset") + F.col("_local")).drop("_offset", "_local")


def _states(df: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for m in measures:
        aggs += [F.count(m).alias(f"n_{m}"), F.sum(m).alias(f"sum_{m}")]
    return df.groupBy(*by).agg(*aggs)


def _long(df: DataFrame, key_fields: list[str], others: list[str]) -> DataFrame:
    """(field_name, key_id, _part, _at, others...): a row per key that is not null."""
    keys = F.array(*[F.struct(F.lit(k).alias("f"), F.col(f"`{k}`").cast("bigint").alias("k")) for k in key_fields])
    long = df.select(F.explode(keys).alias("_k"), "_part", "_at", *others)
    return long.select(
        F.col("_k.f").alias("field_name"), F.col("_k.k").alias("key_id"), "_part", "_at", *others
    ).filter(F.col("key_id").isNotNull())


def _heavy(long: DataFrame, share: float, chunk_rows: int) -> DataFrame:
    """(field_name, key_id, _size) of the keys with at least ``share`` of a field's rows, at most 1 / share a field, with
    the rows of a chunk: that share of the rows, but no more than ``chunk_rows``. Counts combine before the shuffle."""
    counts = materialize(long.groupBy("field_name", "key_id").agg(F.count(F.lit(1)).alias("_n")), "counts")
    least = counts.groupBy("field_name").agg((F.sum("_n") * share).alias("_least"))
    size = F.greatest(F.least(F.ceil("_least"), F.lit(chunk_rows)), F.lit(1)).cast("bigint")
    rows = counts.join(F.broadcast(least), "field_name").filter(F.col("_n") >= F.col("_least"))  # a row per field
    return materialize(rows.select("field_name", "key_id", size.alias("_size")), "heavy")


def per_key_stats(
    df: DataFrame, key_fields: list[str], measures: list[str], share: float = 0.01, chunk_rows: int = 50_000
) -> DataFrame:
    """Rows (field_name, key_id, n_rows, n_chunks, mean_<measure>...) for each value of each key field.

    Keys are counted first. The rows of heavy keys, those with at least ``share`` of a field's rows, are numbered exactly and
    aggregated in chunks of equal size (that share of the rows, at most ``chunk_rows``), whose states are merged; all
    other rows take one two-phase aggregate. So every row is aggregated once, at any size of the table. Null keys give
    no row; null and NaN measures do not count; a mean without values is null; repeated rows count as often as they
    occur; an empty table gives an empty result. Other columns are ignored.
    """
    clean = [F.nanvl(F.col(f"`{m}`").cast("double"), F.lit(None)).alias(m) for m in measures]
    named = [F.col(f"`{k}`") for k in key_fields if k not in measures]
    by = ["field_name", "key_id"]
    long = _long(located(df.select(*named, *clean)), key_fields, measures)
    heavy = _heavy(long, share, chunk_rows)
    few = F.broadcast(heavy)  # at most 1 / share rows a field
    light = _states(long.join(few, by, "left_anti"), by, measures).withColumn("n_chunks", F.lit(1).cast("bigint"))
    numbered = number_rows(long.join(few, by), by)
    chunk = F.floor((F.col("_number") - 1) / F.col("_size"))
    chunks = _states(numbered.withColumn("chunk_no", chunk), [*by, "chunk_no"], measures)
    merged = chunks.groupBy(*by).agg(
        F.sum("n_rows").alias("n_rows"),
        F.count(F.lit(1)).alias("n_chunks"),
        *[F.sum(f"{p}_{m}").alias(f"{p}_{m}") for m in measures for p in ("n", "sum")],
    )
    out = light.unionByName(merged)
    means = [F.when(F.col(f"n_{m}") > 0, F.col(f"sum_{m}") / F.col(f"n_{m}")).alias(f"mean_{m}") for m in measures]
    return out.select(*by, "n_rows", "n_chunks", *means)


def value_changes(
    df: DataFrame, key_fields: list[str], measure: str, order: list[str] | None = None, share: float = 0.01,
    chunk_rows: int = 50_000
) -> DataFrame:
    """Rows (field_name, key_id, n_rows, n_changes, first_value, last_value): how often ``measure`` differs from the row
    before of the same key, in the order of the columns ``order``, without it in input order.

    A result that hangs on order: each chunk counts its own changes and hands on its first and last value, and the
    chunks of a key are merged in order, a change between two chunks counting once. Keys below ``share`` of a field's
    rows are one chunk. Null is a value; null keys give no row.
    """
    by = ["field_name", "key_id"]
    kept = list(dict.fromkeys([*key_fields, *(order or [])]))
    rows = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{measure}`").alias("_m"))
    long = _long(in_order(rows, [*order, "_m"]) if order else located(rows), key_fields, ["_m"])
    size = long.join(F.broadcast(_heavy(long, share, chunk_rows)), by, "left")  # at most 1 / share rows a field
    chunk = F.coalesce(F.floor((F.col("_number") - 1) / F.col("_size")), F.lit(0))
    rows = number_rows(size, by).withColumn("_chunk", chunk)
    inside = Window.partitionBy(*by, "_chunk").orderBy("_number")
    differs = lambda a, b: (~a.eqNullSafe(b)).cast("int")
    step = F.when(F.row_number().over(inside) > 1, differs(F.col("_m"), F.lag("_m").over(inside))).otherwise(0)
    chunks = rows.withColumn("_step", step).groupBy(*by, "_chunk").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_step").alias("c"),
        F.min_by(F.struct("_m"), "_number").alias("a"), F.max_by(F.struct("_m"), "_number").alias("z"),
    )
    order = Window.partitionBy(*by).orderBy("_chunk")
    seam = F.when(F.col("_chunk") > 0, differs(F.col("a._m"), F.lag("z").over(order)["_m"])).otherwise(0)
    merged = chunks.withColumn("_seam", seam).groupBy(*by)
    return merged.agg(
        F.sum("n").alias("n_rows"), (F.sum("c") + F.sum("_seam")).alias("n_changes"),
        F.min_by("a", "_chunk")["_m"].alias("first_value"), F.max_by("z", "_chunk")["_m"].alias("last_value"),
    )
