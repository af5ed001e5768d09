"""Streaming side: cleaning of live interactions, keyed append, serving with the batch, daily counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larder.operators.warehouse import serving_view
from larder.sources.readers import read_if_there

EVENT = "interaction_id bigint, user_id bigint, recipe_id bigint, date_id int, rating smallint, sentiment_score double, source string, loaded_at timestamp"


def read_events(spark: SparkSession, path: str, schema: str = EVENT, files_per_batch: int = 4) -> DataFrame:
    """A stream over the Parquet files at ``path``: a folder that grows, or one file."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        return r.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())
    return r.parquet(path)


def clean_stream(events: DataFrame, as_of: str | None = None, late: str | None = None) -> DataFrame:
    """Stateless rules: keys known, rating 1 to 5, not dated after ``as_of``; with ``late`` copies of an id that arrive
    within that delay are dropped by bounded state."""
    rows = events.filter(
        F.col("interaction_id").isNotNull() & F.col("user_id").isNotNull() & F.col("recipe_id").isNotNull() & F.col("rating").between(1, 5)
    )
    if as_of:
        rows = rows.filter(F.col("loaded_at") <= F.lit(as_of).cast("timestamp"))
    if late:
        rows = rows.withWatermark("loaded_at", late).dropDuplicatesWithinWatermark(["interaction_id"])
    norm = (F.col("rating") - 3) / 2.0
    return rows.withColumns(
        {"rating_normalized": norm, "rating_sentiment_gap": norm - F.col("sentiment_score"), "source": F.lit("stream")}
    )


#: Days of date_id in one part of the sink.
PART_DAYS = 100


def start_ingest(rows: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Appends rows whose id the sink lacks, all that is there now, then stops.

    Each micro-batch owns the folder epoch=<id> and overwrites it when replayed, so a replay changes nothing. Copies of
    an interaction agree in their date_id, so the sink is divided by it and a batch reads the ids of its own dates only.
    """

    def put(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        once = batch.groupBy("interaction_id").agg(
            F.min_by(F.struct("*"), F.struct("loaded_at", "user_id", "recipe_id")).alias("r")
        ).select("r.*").withColumn("part", F.coalesce(F.floor(F.col("date_id") / PART_DAYS).cast("int"), F.lit(-1)))
        seen = read_if_there(spark, sink)
        if seen is not None:
            parts = [r[0] for r in once.select("part").distinct().collect()]  # as many as the batch has spans of dates
            seen = seen.filter(F.col("part").isin(*parts) & (F.col("epoch") != epoch)).select("interaction_id")
            once = once.join(seen, "interaction_id", "left_anti")
        once.write.mode("overwrite").partitionBy("part").parquet(f"{sink}/epoch={epoch}")

    return rows.writeStream.foreachBatch(put).option(
        "checkpointLocation", checkpoint
    ).trigger(availableNow=True).start()


def serve(batch: DataFrame, sink: str) -> DataFrame:
    """Batch rows and stream rows the batch does not have yet; when the daily batch lands it replaces them."""
    stream = read_if_there(batch.sparkSession, sink)
    if stream is None:
        return batch
    return serving_view(batch, stream.select(*batch.columns), "interaction_id")


def daily_counts(events: DataFrame, late: str = "2 days") -> DataFrame:
    """(day, user_id, n) in daily windows of loading time, as a stateful stream: state of closed days is dropped by the
    watermark, and rows later than it are lost by design. Write it with ``start_latest``."""
    rows = events.filter("user_id is not null").withWatermark("loaded_at", late)
    out = rows.groupBy(F.window("loaded_at", "1 day").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").cast("date").alias("day"), "user_id", "n")


def start_latest(counts: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Writes the rows each micro-batch changed under its epoch; ``latest`` reads the last one of each key."""

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")

    return counts.writeStream.outputMode("update").foreachBatch(put).option(
        "checkpointLocation", checkpoint
    ).trigger(availableNow=True).start()


def latest(spark: SparkSession, sink: str, keys: list[str]) -> DataFrame:
    """The last written row of each key."""
    df = spark.read.parquet(sink)
    rest = [c for c in df.columns if c not in (*keys, "epoch")]
    return df.groupBy(*keys).agg(*[F.max_by(c, "epoch").alias(c) for c in rest])


def start_partial_counts(events: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Counts (day, user_id) of each micro-batch alone, under its epoch; ``summed`` adds them up.

    No state and no watermark: a row counts however late it comes, and a replayed batch overwrites its own counts.
    """

    def put(batch: DataFrame, epoch: int) -> None:
        day = F.col("loaded_at").cast("date").alias("day")
        rows = batch.filter("user_id is not null and loaded_at is not null").groupBy(day, "user_id")
        rows.agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")

    return events.writeStream.foreachBatch(put).option(
        "checkpointLocation", checkpoint
    ).trigger(availableNow=True).start()


def summed(spark: SparkSession, sink: str) -> DataFrame:
    """(day, user_id, n) over all micro-batches."""
    return spark.read.parquet(sink).groupBy("day", "user_id").agg(F.sum("n").alias("n"))
