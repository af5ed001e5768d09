"""Session factory, shared scratch folder and lineage cutting."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes up to which a table measured beforehand may be broadcast (``broadcast_if_small``, ``skew.sized_join``).
BROADCAST_BYTES = 32_000_000

_own_folders: dict[str, str] = {}


def build_session(
    app: str = "larder", master: str | None = None, shuffle_partitions: int | None = None
) -> SparkSession:
    """A session with UTC time, AQE and Arrow; cluster settings given from outside win."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a folder of our own only on one machine without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = "file://" + tempfile.mkdtemp(prefix="larder-")
    return _own_folders[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_folder(spark)}/larder-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def file_system(spark: SparkSession, path: str):
    """The file system of ``path`` and the path in its terms."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _remove(spark: SparkSession, path: str) -> None:
    local = path.removeprefix("file://")
    if os.path.isdir(local):
        import shutil

        shutil.rmtree(local, ignore_errors=True)
        return
    try:
        fs, p = file_system(spark, path)
        fs.delete(p, True)
    except Exception:  # the JVM may be gone already
        pass


def materialize(df: DataFrame, name: str = "cut", partition_by: list[str] | None = None) -> DataFrame:
    """Cuts the lineage: writes ``df`` as Parquet to the shared folder and reads it back.

    The files survive the loss of executors, keep column pruning and push-down, and take less room than an RDD
    checkpoint.
    """
    path = scratch_path(df.sparkSession, name)
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._larder_path = path
    return out


def release(df: DataFrame) -> None:
    """Removes the files of a materialized table that nothing reads any more."""
    path = getattr(df, "_larder_path", None)
    if path:
        _remove(df.sparkSession, path)


def table_bytes(df: DataFrame) -> int:
    """Bytes of the rows of ``df`` as they lie in memory, by one aggregate: fixed widths, lengths of strings, and twice the
    JSON length of nested values."""
    width = F.lit(16)
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            width = width + F.coalesce(F.octet_length(c), F.lit(0)) + 16
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            width = width + 2 * F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
        else:
            width = width + 16
    return df.agg(F.sum(width.cast("bigint"))).first()[0] or 0


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Marks ``df`` for broadcast only where its measured bytes stay within ``limit``; else Spark shuffles it. Where the
    other side may hold hot keys use ``skew.sized_join``, which splits them off beyond the limit."""
    return F.broadcast(df) if table_bytes(df) <= limit else df
