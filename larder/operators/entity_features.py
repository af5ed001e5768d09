"""Per-entity feature table from events, kept as time-bucketed partial aggregates.

The state folder holds one Parquet partition per time bucket with a row per entity and event type, and manifests that name
the live generation of each bucket with a fingerprint of its source rows. ``refresh`` recomputes only changed buckets;
``features`` merges whole buckets and adds the raw events of buckets that a time range cuts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.session import file_system

#: Bucket of the events without a date; below that of any day.
NO_DATE = -1_000_000
MANIFEST = "bucket int, gen int, rows bigint, mark decimal(38,0), seen timestamp"
PARTIAL = "entity bigint, type string, n bigint, n_rated bigint, total double, n_scored bigint, score double, first_day date, last_day date, bucket int"


@dataclass(frozen=True)
class EventColumns:
    """Names of the columns of the event table; ``day`` is a date column (null where the date is unknown), ``loaded`` the time
    at which a row came, if the table has one."""

    event_id: str = "interaction_id"
    entity: str = "user_id"
    type: str = "event_type"
    day: str = "full_date"
    rating: str = "rating"
    score: str = "sentiment_score"
    loaded: str | None = None


def _events(df: DataFrame, c: EventColumns, bucket_days: int) -> DataFrame:
    col = lambda n: F.col(f"`{n}`")
    score = F.nanvl(col(c.score).cast("double"), F.lit(None))
    return df.select(
        col(c.event_id).alias("event_id"),
        col(c.entity).cast("bigint").alias("entity"),
        col(c.type).alias("type"),
        col(c.day).alias("day"),
        col(c.rating).cast("double").alias("rating"),
        score.alias("score"),
        (col(c.loaded) if c.loaded else F.lit(None)).cast("timestamp").alias("loaded"),
    ).withColumn("bucket", F.coalesce(F.floor(F.unix_date("day") / bucket_days).cast("int"), F.lit(NO_DATE)))


def _partial(ev: DataFrame) -> DataFrame:
    """Counts each event id once within its bucket, then aggregates by bucket, entity and type."""
    once = (
        ev.filter(F.col("event_id").isNotNull() & F.col("entity").isNotNull())
        .groupBy("bucket", "event_id")
        .agg(F.min(F.struct("entity", "type", "day", "rating", "score")).alias("e"))
        .select("bucket", "e.*")
    )
    return once.groupBy("bucket", "entity", "type").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("rating").alias("n_rated"),
        F.sum("rating").alias("total"),
        F.count("score").alias("n_scored"),
        F.sum("score").alias("score"),
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
    )


class EntityFeatures:
    """Incremental feature state in ``folder`` (a shared file system).

    Copies of an event must agree in their date, so that they meet in one bucket; of copies that differ otherwise the
    smallest row counts. Events without id or entity are left out, those without a date are kept in a bucket of
    their own, NaN scores count as null, a null type counts in the totals but not in ``by_type``.

    Each refresh writes the buckets it recomputes under a generation of its own and then a manifest that names the live
    generation of every bucket. So a refresh holds as a whole or not at all, and a bucket that has lost its rows is empty.
    """

    def __init__(self, spark: SparkSession, folder: str, columns: EventColumns | None = None, bucket_days: int = 30):
        self.spark, self.folder, self.columns, self.days = spark, folder.rstrip("/"), columns or EventColumns(), bucket_days

    def _generation(self) -> int:
        """The number of the next generation: one more than the last manifest's."""
        fs, path = file_system(self.spark, f"{self.folder}/manifests")
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        done = [int(n.split("=")[1]) for n in names if fs.exists(file_system(self.spark, f"{self.folder}/manifests/{n}/_SUCCESS")[1])]
        return max(done, default=-1) + 1

    def _manifest(self, gen: int) -> list:
        """(bucket, gen, rows, mark, seen) of every live bucket: as many rows as the time span has buckets."""
        return self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifests/gen={gen}").collect() if gen >= 0 else []

    def _changes(self, ev: DataFrame, was: dict, verify: bool) -> tuple[dict, set[int]]:
        """The manifest entries as they should be and the buckets to recompute."""
        mark = F.sum(F.xxhash64("event_id", "entity", "type", "day", "rating", "score").cast("decimal(20,0)"))
        by_time = self.columns.loaded is not None and was and not verify
        if not by_time:
            got = ev.groupBy("bucket").agg(F.count(F.lit(1)), mark, F.max("loaded")).collect()
            now = {b: (n, m, t) for b, n, m, t in got}
            return now, {b for b in now if b not in was or tuple(was[b][1:3]) != now[b][:2]}
        seen = max((w[3] for w in was.values() if w[3] is not None), default=None)
        late = F.lit(True) if seen is None else F.col("loaded") > F.lit(seen)
        fresh = ev.filter(late | F.col("loaded").isNull())
        got = fresh.groupBy("bucket").agg(F.count(F.lit(1)), mark, F.max("loaded")).collect()
        now = {b: tuple(w[1:]) for b, w in was.items()}
        for b, n, m, t in got:
            old = now.get(b, (0, 0, None))
            now[b] = (old[0] + n, old[1] + m, max((x for x in (old[2], t) if x is not None), default=None))
        return now, {r[0] for r in got}

    def refresh(self, events: DataFrame, verify: bool = False) -> list[int]:
        """Brings the state up to date with ``events`` (all rows of the source) and returns the changed buckets.

        Where the columns name a load time, only rows loaded after the last refresh (or without a load time) are looked
        at to tell which buckets changed, a filter that reaches the scan; rows edited or deleted in place are found with
        ``verify``, or without a load time always, by a fingerprint of every bucket. Then only changed buckets are read.
        Buckets are time slices, so their list is as short as the time span divided by the bucket length.
        """
        ev = _events(events, self.columns, self.days)
        gen = self._generation()
        was = {r["bucket"]: (r["gen"], r["rows"], r["mark"], r["seen"]) for r in self._manifest(gen - 1)}
        now, changed = self._changes(ev, was, verify)
        if changed:
            part = ev if len(changed) == len(now) else ev.filter(F.col("bucket").isin(*changed))
            _partial(part).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/buckets/gen={gen}")
        rows = [(b, gen if b in changed else was[b][0], *x) for b, x in sorted(now.items())]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(
            f"{self.folder}/manifests/gen={gen}"
        )
        return sorted(changed)

    def partials(self) -> DataFrame:
        """The partial aggregates of all live buckets."""
        live: dict[int, list[int]] = {}
        for r in self._manifest(self._generation() - 1):
            live.setdefault(r["gen"], []).append(r["bucket"])
        out = self.spark.createDataFrame([], PARTIAL)
        fs, _ = file_system(self.spark, self.folder)
        paths = [f"{self.folder}/buckets/gen={g}" for g in sorted(live)]
        paths = [p for p in paths if fs.exists(file_system(self.spark, p)[1])]
        if not paths:
            return out
        stored = self.spark.read.schema(f"{PARTIAL}, gen int").option("basePath", f"{self.folder}/buckets").parquet(*paths)
        wanted = reduce(Column.__or__, [(F.col("gen") == g) & F.col("bucket").isin(*bs) for g, bs in live.items()])
        return stored.filter(wanted).drop("gen")

    def vacuum(self) -> None:
        """Removes manifests but the last, and generations it does not name. No reader may hold an older state."""
        last = self._generation() - 1
        keep = {f"gen={r['gen']}" for r in self._manifest(last)}
        for name, kept in (("buckets", keep), ("manifests", {f"gen={last}"})):
            fs, path = file_system(self.spark, f"{self.folder}/{name}")
            for f in fs.listStatus(path) if fs.exists(path) else []:
                if f.getPath().getName() not in kept:
                    fs.delete(f.getPath(), True)

    def features(
        self, since: str | None = None, until: str | None = None, events: DataFrame | None = None
    ) -> DataFrame:
        """One row per entity; with ``since``/``until`` (inclusive days) only events of that range count.

        Buckets wholly inside the range come from the state; those the range cuts are aggregated from ``events``,
        without which a range that cuts a stored bucket is an error.
        """
        part = self.partials()
        if since or until:
            lo = F.lit(since).cast("date") if since else F.lit("0001-01-01").cast("date")
            hi = F.lit(until).cast("date") if until else F.lit("9999-12-31").cast("date")
            start = F.date_add(F.lit("1970-01-01").cast("date"), F.col("bucket") * self.days)
            end = F.date_add(start, self.days - 1)
            whole = (F.col("bucket") != NO_DATE) & (start >= lo) & (end <= hi)
            cut = ~whole & (start <= hi) & (end >= lo)
            if events is None and not part.filter((F.col("bucket") != NO_DATE) & cut).isEmpty():
                raise ValueError("the range cuts a stored bucket: give the events")
            part = part.filter(whole)
            if events is not None:
                ev = _events(events, self.columns, self.days).filter(F.col("day").isNotNull() & cut)
                edge = _partial(ev.filter(F.col("day").between(lo, hi)))
                part = part.unionByName(edge)
        by_type = part.groupBy("entity", "type").agg(
            F.sum("n").alias("n"),
            F.sum("n_rated").alias("n_rated"),
            F.sum("total").alias("total"),
            F.sum("n_scored").alias("n_scored"),
            F.sum("score").alias("score"),
            F.min("first_day").alias("first_day"),
            F.max("last_day").alias("last_day"),
        )
        entry = F.struct("type", F.struct("n", F.col("total").alias("rating_total"), "last_day").alias("v"))
        return by_type.groupBy("entity").agg(
            F.sum("n").alias("n_events"),
            F.sum("n_rated").alias("review_count"),
            F.sum("total").alias("rating_total"),
            F.when(F.sum("n_scored") > 0, F.sum("score") / F.sum("n_scored")).alias("avg_score"),
            F.min("first_day").alias("first_day"),
            F.max("last_day").alias("last_day"),
            F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("type").isNotNull(), entry)))).alias("by_type"),
        )
