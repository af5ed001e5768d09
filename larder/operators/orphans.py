"""References to records that do not exist: keyed pending-orphan state, kept up incrementally in a folder.

State per (ref_field, key): the number of references so far and how many of them wait for a parent; beside it the life
spans of parents and the orphans found. A batch of new references probes the parent index; arriving parents resolve
waiting references, deletions reopen the satisfied ones; each batch ends with a snapshot of the counts.

All parts are logs: a batch adds rows for the keys it touches and rewrites nothing. The last row of a key counts, and
``compact`` folds the logs.
"""

from __future__ import annotations

import json
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.operators.skew import split_join
from larder.session import BROADCAST_BYTES, file_system, materialize, release, scratch_path

KEY = ["ref_field", "key"]
PARENTS = "ref_field string, key bigint, born timestamp, gone timestamp, span bigint"
STATE = (
    "ref_field string, key bigint, n_refs bigint, n_waiting bigint, n_new bigint, n_resolved bigint, n_reopened bigint, "
    "was_waiting bigint"
)
FOUND = "ref_field string, key bigint, interaction_id bigint, ref_at timestamp"
SNAPSHOT = "ref_field string, until timestamp, n_new bigint, n_resolved bigint, n_reopened bigint, n_waiting bigint"
SCHEMAS = {"parents": PARENTS, "state": STATE, "found": FOUND}
#: Memory of a key in a broadcast table: its field's name, the key, and what the table needs beside them.
KEY_BYTES = 100

#: A key is hot in a batch if it holds this share of its references; there are at most 1 / HOT such keys.
HOT = 0.01


def references(facts: DataFrame, id_col: str, at_col: str, fields: list[str]) -> DataFrame:
    """(ref_field, key, interaction_id, ref_at): each reference that is not null."""
    spec = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"`{f}`").cast("bigint").alias("k")) for f in fields])
    return (
        facts.select(
            F.col(f"`{id_col}`").alias("interaction_id"), F.col(f"`{at_col}`").alias("ref_at"),
            F.explode(spec).alias("r")
        )
        .select(F.col("r.f").alias("ref_field"), F.col("r.k").alias("key"), "interaction_id", "ref_at")
        .filter(F.col("key").isNotNull())
    )


def parent_rows(
    dim: DataFrame, ref_field: str, key_col: str, born: str | None = None, gone: str | None = None
) -> DataFrame:
    """(ref_field, key, born, gone): the life spans of a dimension; without ``born`` a row has always been there."""
    return dim.select(
        F.lit(ref_field).alias("ref_field"),
        F.col(f"`{key_col}`").cast("bigint").alias("key"),
        (F.col(f"`{born}`") if born else F.lit("0001-01-01 00:00:00").cast("timestamp")).alias("born"),
        (F.col(f"`{gone}`") if gone else F.lit(None).cast("timestamp")).alias("gone"),
    ).filter(F.col("key").isNotNull() & F.col("born").isNotNull())


def _live(spans: DataFrame, since, until):
    """A span that holds from ``since`` to ``until``."""
    return (spans["born"] <= since) & (spans["gone"].isNull() | (spans["gone"] > until))


class OrphanTracker:
    """Reference state over batches in order of time, in ``folder`` (a shared file system; a new scratch folder without
    it). A tracker opened on a folder goes on where the last one ended.

    A reference is live at its time if a parent row was born by then and not gone. References with a null key or a
    null time are no cases; repeated deliveries count as references of their own in the state, and once in
    ``found()`` if distinct; parents with a null key or birth are left out; a parent may be born and go several times.

    A batch is valid once its marker is written, last of all; what a broken batch left is overwritten.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, limit: int = BROADCAST_BYTES):
        self.spark, self.limit = spark, limit
        self.folder = (folder or scratch_path(spark, "orphans")).rstrip("/")

    def _marks(self) -> list[dict]:
        """What the marker of each valid batch says: its kind and its snapshot, a row per field."""
        fs, path = file_system(self.spark, f"{self.folder}/done")
        if not fs.exists(path):
            return []
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString
        out = []
        for k in range(len(fs.listStatus(path))):
            stream = fs.open(file_system(self.spark, f"{self.folder}/done/{k}")[1])
            out.append(json.loads(text(stream, "UTF-8")))
            stream.close()
        return out

    def _mark(self, batch: int, kind: str, until=None, counts: dict | None = None) -> None:
        said = {"kind": kind, "until": until and until.isoformat(), "counts": counts or {}}
        fs, path = file_system(self.spark, f"{self.folder}/done/{batch}")
        out = fs.create(path)
        out.write(bytearray(json.dumps(said), "utf-8"))
        out.close()

    @staticmethod
    def _first(marks: list[dict]) -> int:
        """The batch from which parents and state are read: the last fold."""
        return max((k for k, m in enumerate(marks) if m["kind"] == "base"), default=0)

    def _read(self, name: str, batches: int, first: int = 0) -> DataFrame:
        """The rows of a log with the batch that wrote them."""
        schema = f"{SCHEMAS[name]}, batch int"
        fs, _ = file_system(self.spark, self.folder)
        paths = [f"{self.folder}/{name}/batch={b}" for b in range(first, batches)]
        paths = [p for p in paths if fs.exists(file_system(self.spark, p)[1])]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{name}").parquet(*paths)

    def _write(self, df: DataFrame, name: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}")

    @staticmethod
    def _spans(parents: DataFrame) -> DataFrame:
        """The last known end of each span."""
        return parents.groupBy(*KEY, "born", "span").agg(F.max_by("gone", "batch").alias("gone"))

    @staticmethod
    def _last(state: DataFrame) -> DataFrame:
        return state.groupBy(*KEY).agg(*[F.max_by(c, "batch").alias(c) for c in ("n_refs", "n_waiting")])

    def _probe(self, refs: DataFrame, touched: DataFrame, spans: DataFrame) -> DataFrame:
        """References without a live parent at their time.

        Keys with a span that covers all their references of the batch need no look at single rows. Of the rest, those
        of hot keys meet their spans by broadcast, if the counted spans of all such keys stay within the limit.
        """
        open_keys = touched.filter("n_new > 0 and not covered").select(*KEY, "n_new", "n_spans")
        zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
        n_keys, total, n_spans = open_keys.agg(F.count(F.lit(1)), zero("n_new"), zero("n_spans")).first()
        hot = open_keys.filter(F.col("n_new") >= max(1.0, HOT * total)).select(*KEY)
        if n_keys * KEY_BYTES <= self.limit:
            rows = refs.join(F.broadcast(open_keys.select(*KEY)), KEY, "left_semi")
        else:
            rows = split_join(refs, open_keys.select(*KEY), KEY, "left_semi", heavy=hot)
        marked = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), KEY, "left")  # at most 1 / HOT rows
        cold, warm = marked.filter("_hot is null").drop("_hot"), marked.filter("_hot").drop("_hot")
        few = spans.join(F.broadcast(hot), KEY, "left_semi")
        few = F.broadcast(few) if n_spans * KEY_BYTES <= self.limit else few
        some = spans.join(open_keys.select(*KEY), KEY, "left_semi")

        def without(r: DataFrame, s: DataFrame) -> DataFrame:
            on = (r["ref_field"] == s["ref_field"]) & (r["key"] == s["key"]) & _live(s, r["ref_at"], r["ref_at"])
            return r.join(s, on, "left_anti")

        return without(cold, some).unionByName(without(warm, few))

    def apply(self, refs: DataFrame, parents: DataFrame, until) -> None:
        """Takes in the references up to ``until`` and the parent rows born or gone since the last batch.

        ``refs`` is read twice. ``parents`` may have a column span that tells rows of one key and birth apart; without it
        a row given again updates the one of its key and birth, and such rows of one batch are kept apart.
        """
        marks = self._marks()
        k, first = len(marks), self._first(marks)
        new = parents
        if "span" not in parents.columns:
            w = Window.partitionBy(*KEY, "born").orderBy(F.col("gone").desc_nulls_first())
            new = parents.withColumn("span", (F.row_number().over(w) - 1).cast("bigint"))
        self._write(new.select("ref_field", "key", "born", "gone", "span"), "parents", k)
        t = F.lit(until).cast("timestamp")
        one = refs.filter("ref_at is not null").select(*KEY, "ref_at", F.lit(1).alias("_one"))
        changed = self._read("parents", k + 1, k).select(*KEY, F.lit(None).cast("timestamp"), F.lit(0)).toDF(
            *KEY, "ref_at", "_one"
        )
        keys = one.unionByName(changed).groupBy(*KEY).agg(
            F.sum("_one").alias("n_new"), F.min("ref_at").alias("lo"), F.max("ref_at").alias("hi")
        )
        spans = self._spans(self._read("parents", k + 1, first))
        no = F.lit(False)
        touched = materialize(
            keys.join(spans, KEY, "left").groupBy(*KEY, "n_new").agg(
                F.count(spans["born"]).alias("n_spans"),
                F.coalesce(F.max(_live(spans, t, t)), no).alias("alive"),
                F.coalesce(F.max(_live(spans, keys["lo"], keys["hi"])), no).alias("covered"),
            ),
            "touched"
        )
        found = self._probe(refs.filter("ref_at is not null"), touched, spans)
        self._write(found.select("ref_field", "key", "interaction_id", "ref_at"), "found", k)
        n_found = self._read("found", k + 1, k).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_found"))
        had = self._last(self._read("state", k, first).join(touched.select(*KEY), KEY, "left_semi"))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        all_refs, waits = zero("n_refs") + F.col("n_new"), zero("n_waiting") + zero("n_found")
        delta = touched.join(n_found, KEY, "left").join(had, KEY, "left").select(
            *KEY, all_refs.alias("n_refs"), F.when(F.col("alive"), 0).otherwise(all_refs).alias("n_waiting"),
            zero("n_found").alias("n_new"), F.when(F.col("alive"), waits).otherwise(0).alias("n_resolved"),
            F.when(F.col("alive"), 0).otherwise(all_refs - waits).alias("n_reopened"), zero("n_waiting").alias("was_waiting"),
        )
        self._write(delta.filter("n_refs > 0"), "state", k)
        step = self._read("state", k + 1, k).groupBy("ref_field").agg(
            *[F.sum(c) for c in ("n_new", "n_resolved", "n_reopened")], F.sum(F.col("n_waiting") - F.col("was_waiting"))
        )
        before = next((m["counts"] for m in reversed(marks) if m["kind"] == "batch"), {})
        counts = {f: [0, 0, 0, c[3]] for f, c in before.items()}
        for f, *c in step.collect():  # a row per field
            counts[f] = [*c[:3], c[3] + counts.get(f, [0, 0, 0, 0])[3]]
        self._mark(k, "batch", until, counts)
        release(touched)

    def compact(self) -> None:
        """Folds the logs of parents and state into their last rows; found references and snapshots stay."""
        marks = self._marks()
        k, first = len(marks), self._first(marks)
        self._write(self._spans(self._read("parents", k, first)).select("ref_field", "key", "born", "gone", "span"), "parents", k)
        none = [F.lit(0).cast("bigint").alias(c) for c in ("n_new", "n_resolved", "n_reopened", "was_waiting")]
        self._write(self._last(self._read("state", k, first)).select(*KEY, "n_refs", "n_waiting", *none), "state", k)
        self._mark(k, "base")

    def pending(self) -> DataFrame:
        """(ref_field, key, n_refs, n_waiting) of the keys without a living parent: the state of waiting references."""
        marks = self._marks()
        state = self._last(self._read("state", len(marks), self._first(marks)))
        return state.filter("n_waiting > 0").select(*KEY, "n_refs", "n_waiting")

    def found(self) -> DataFrame:
        """References that had no live parent at their time, as they entered the state."""
        return self._read("found", len(self._marks())).drop("batch")

    def snapshot(self) -> DataFrame:
        """(ref_field, until, n_new, n_resolved, n_reopened, n_waiting): the counts after each batch."""
        rows = [
            (f, datetime.fromisoformat(m["until"]), *c)
            for m in self._marks() if m["kind"] == "batch" for f, c in sorted(m["counts"].items())
        ]
        return self.spark.createDataFrame(rows, SNAPSHOT)


def cuts_of(lo, hi, periods: int) -> list:
    """The ends of ``periods`` equal spans from ``lo`` to ``hi``, in whole microseconds."""
    us = (hi - lo) // timedelta(microseconds=1)
    return [lo + timedelta(microseconds=us * k // periods) for k in range(1, periods)] + [hi]


def track(refs: DataFrame, parents: DataFrame, periods: int = 3, folder: str | None = None) -> OrphanTracker:
    """Replays history in ``periods`` equal spans of time, as increments would have brought it.

    The references are read once and written by span of time, so that each batch reads its own.
    """
    tracker = OrphanTracker(refs.sparkSession, folder)
    lo, hi = refs.agg(F.min("ref_at"), F.max("ref_at")).first()
    if hi is None:
        return tracker
    cuts = cuts_of(lo, hi, periods)
    number = F.lit(0)
    for c in cuts[:-1]:
        number = number + (F.col("ref_at") > F.lit(c).cast("timestamp")).cast("int")
    parts = materialize(refs.filter("ref_at is not null").withColumn("_batch", number), "refs", ["_batch"])
    rows = materialize(parents.withColumn("span", F.xxhash64("born", "gone")), "parents")
    since = None
    for n, until in enumerate(cuts):
        t = F.lit(until).cast("timestamp")
        known = rows.filter(F.col("born") <= t)
        if since is not None:
            s = F.lit(since).cast("timestamp")
            known = known.filter((F.col("born") > s) | ((F.col("gone") > s) & (F.col("gone") <= t)))
        known = known.withColumn("gone", F.when(F.col("gone") <= t, F.col("gone")))
        tracker.apply(parts.filter(F.col("_batch") == n).drop("_batch"), known, until)
        since = until
    release(parts)
    release(rows)
    return tracker
