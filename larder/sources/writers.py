"""Writers: atomic tables, keyed tables, text and JSON files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators.warehouse import insert_ignore, upsert
from larder.sources.tables import change_table, part_of, replace_table


def replace_parquet(df: DataFrame, path: str, part: Column | None = None) -> None:
    """Puts ``df`` in place of the table at ``path``: readers see the old or the new version; ``df`` may read ``path``."""
    replace_table(df, path, part)


def write_upsert(
    df: DataFrame, path: str, keys: list[str], update: list[str], part: Column | None = None
) -> list[str]:
    """Merges ``df`` (unique by ``keys``) into the table at ``path``; creates it if missing; an empty ``df`` keeps it.

    Only the parts that hold keys of ``df`` are read and written again; they are returned. ``part`` divides the table,
    for instance by month; it must be the same for all rows of a key. By default keys are spread by their hash.
    """
    return change_table(df, path, part_of(keys) if part is None else part, lambda old, new: upsert(old, new, keys, update))


def write_new_only(df: DataFrame, path: str, keys: list[str], part: Column | None = None) -> list[str]:
    """Adds rows whose key the table lacks, of several with a key the smallest."""

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        return insert_ignore(old, new, keys)

    return change_table(df, path, part_of(keys) if part is None else part, merge)


def save_metadata(spark: SparkSession, path: str, values: dict[str, str]) -> None:
    """A key-value table."""
    write_upsert(
        spark.createDataFrame(sorted(values.items()), "key string, value string"), path, ["key"], ["value"], F.lit(0)
    )


def write_lines(df: DataFrame, col: Column, path: str) -> None:
    """The distinct values in order, one per line."""
    df.select(col.alias("value")).filter("value is not null").distinct().orderBy("value").write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
