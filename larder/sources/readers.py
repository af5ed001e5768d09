"""Readers: typed CSV, Parquet with column probing, nested JSON, archives, JDBC, fall-back and staleness."""

from __future__ import annotations

import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.functions.vocabulary import JUNK
from larder.sources.tables import read_table

RECIPES = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("minutes", T.LongType()),
    T.StructField("tags", T.StringType()), T.StructField("nutrition", T.StringType()), T.StructField("steps", T.StringType()),
    T.StructField("ingredients", T.StringType()),
])
INTERACTIONS = T.StructType([
    T.StructField("user_id", T.LongType()), T.StructField("recipe_id", T.LongType()), T.StructField("date", T.TimestampType()),
    T.StructField("rating", T.ByteType()), T.StructField("review", T.StringType()),
])


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Columns of ``schema`` by header name, whatever else the file has; quoted line breaks are kept."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    missing = [f.name for f in schema if f.name not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return raw.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema])


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The wanted columns that the file has; the scan reads only those."""
    df = spark.read.parquet(path)
    return df if columns is None else df.select(*[c for c in columns if c in df.columns])


def read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    """The last version of a table, or the Parquet files at ``path``; None if missing or unreadable."""
    try:
        df = read_table(spark, path)
        if df is None:
            df = spark.read.parquet(path)
        df.schema  # noqa: B018
        return df
    except Exception:
        return None


def first_available(
    sources: list[Callable[[], DataFrame | None]], schema: T.StructType, spark: SparkSession
) -> DataFrame:
    """The first source that gives a table; else an empty one of ``schema``."""
    for s in sources:
        try:
            df = s()
        except Exception:
            df = None
        if df is not None:
            return df
    return spark.createDataFrame([], schema)


def read_jdbc(
    spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None,
    parts: int = 32, **options: str
) -> DataFrame:
    """A database table, read in ranges of ``key`` if given."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for k, v in options.items():
        r = r.option(k, v)
    if key and bounds:
        r = r.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return r.load()


def extract_member(archive: str, member: str, folder: str) -> str | None:
    """Unpacks a member (by path, else by file name) and returns its path; a broken archive is removed and gives None."""
    try:
        with zipfile.ZipFile(archive) as z:
            names = z.namelist()
            hit = member if member in names else next((n for n in names if Path(n).name == Path(member).name), None)
            return z.extract(hit, folder) if hit else None
    except zipfile.BadZipFile:
        Path(archive).unlink(missing_ok=True)
        return None


NUTRIENT = "struct<nutrient:struct<name:string,unitName:string>,nutrientName:string,name:string,unitName:string,amount:string,value:string>"
FOOD = f"struct<description:string,dataType:string,foodNutrients:array<{NUTRIENT}>>"


def read_foods(spark: SparkSession, files: list[tuple[str, str]]) -> DataFrame:
    """(description, dataType, foodNutrients) of bulk files, each with its foods under its own top-level key.

    Missing files are left out; unreadable ones give no rows.
    """
    parts = []
    for path, key in files:
        try:
            schema = T.StructType([T.StructField(key, T._parse_datatype_string(f"array<{FOOD}>"))])
            df = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
        except Exception:
            continue
        parts.append(df.select(F.explode(key).alias("f")).select("f.*"))
    out = parts[0] if parts else spark.createDataFrame(
        [], f"description string, dataType string, foodNutrients array<{NUTRIENT}>"
    )
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def nutrient_amount(nutrients: Column, names: list[str], units: list[str] | None = None) -> Column:
    """The amount of the first nutrient whose name contains one of ``names`` (and whose unit one of ``units``); null if
    that amount is no number. Reads nested and flat entries."""

    def fits(n: Column) -> Column:
        name = F.lower(F.coalesce(n["nutrient"]["name"], n["nutrientName"], n["name"], F.lit("")))
        unit = F.lower(F.coalesce(n["nutrient"]["unitName"], n["unitName"], F.lit("")))
        ok = name.rlike("|".join(names))
        return ok & unit.rlike("|".join(units)) if units else ok

    first = F.get(F.filter(nutrients, fits), F.lit(0))
    return F.coalesce(first["amount"], first["value"]).try_cast("double")


def timeline_points(results: Column) -> Column:
    """Array of (at, keyword, value) from the JSON of an interest timeline."""
    shape = "struct<interest_over_time:struct<timeline_data:array<struct<timestamp:string,values:array<struct<query:string,extracted_value:int>>>>>>"
    data = F.from_json(results, shape)["interest_over_time"]["timeline_data"]
    points = F.transform(
        data, lambda p: F.transform(
            p["values"],
            lambda v: F.struct(
                F.timestamp_seconds(p["timestamp"].cast("bigint")).alias("at"), v["query"].alias("keyword"),
                v["extracted_value"].alias("value")
            )
        )
    )
    return F.flatten(points)


def related_queries(results: Column) -> Column:
    """Array of (query_type, related_query, raw_value) about recipes; a rise without number counts 5000, other text 0."""
    shape = "struct<related_queries:struct<rising:array<struct<query:string,value:string>>,top:array<struct<query:string,value:string>>>>"
    r = F.from_json(results, shape)["related_queries"]

    def rows(kind: str) -> Column:
        value = lambda v: F.coalesce(v.try_cast("int"), F.when(F.lower(v) == "breakout", 5000).otherwise(0))
        items = F.transform(
            F.coalesce(r[kind], F.array()),
            lambda x: F.struct(
                F.lit(kind).alias("query_type"), x["query"].alias("related_query"), value(x["value"]).alias("raw_value")
            )
        )
        return F.filter(items, lambda x: x["related_query"].rlike(r"(?i)\brecipes?\b"))

    return F.concat(rows("rising"), rows("top"))


def answer_blocks(results: Column, least: int = 5) -> Column:
    """Array of (block_index, title, body) from the JSON of an answer page: the first shape that has text, junk left out,
    and the page's markdown where no block stays."""
    block = "struct<title:string,snippet:string,body:string,text:string,answer:string>"
    part = f"struct<text_blocks:array<{block}>,text:string,answer:string,snippet:string>"
    r = F.from_json(
        results,
        f"struct<ai_mode:{part},ai_overview:{part},text_blocks:array<{block}>,text:string,answer:string,snippet:string,reconstructed_markdown:string>"
    )
    blank = lambda c: F.nullif(c, F.lit(""))
    whole = F.coalesce(
        *[blank(r[p][f]) for p in ("ai_mode", "ai_overview") for f in ("text", "answer", "snippet")],
        *[blank(r[f]) for f in ("text", "answer", "snippet")]
    )
    blocks = F.coalesce(
        *[
            F.when(F.size(b) > 0, b) for b in (
                r["ai_mode"]["text_blocks"], r["ai_overview"]["text_blocks"], r["text_blocks"]
            )
        ]
    )
    entry = lambda i, t, b: F.struct(i.cast("int").alias("block_index"), t.alias("title"), F.trim(b).alias("body"))
    none = F.lit(None).cast("string")
    listed = F.transform(
        blocks,
        lambda b, i: entry(
            i, b["title"],
            F.coalesce(blank(b["snippet"]), blank(b["body"]), blank(b["text"]), blank(b["answer"]), F.lit(""))
        )
    )
    listed = F.coalesce(listed, F.array(entry(F.lit(0), none, F.coalesce(whole, F.lit("")))))
    good = lambda x: (F.length(x["body"]) >= least) & ~x["body"].rlike("(?i)" + "|".join(JUNK))
    kept = F.filter(listed, good)
    markdown = F.filter(
        F.array(
            entry(F.lit(0), none, F.regexp_replace(F.coalesce(r["reconstructed_markdown"], F.lit("")), r"\\(.)", "$1"))
        ),
        good
    )
    return F.when(F.size(kept) > 0, kept).otherwise(markdown)


def is_stale(df: DataFrame | None, col: str, as_of: str, days: int = 7) -> bool:
    """True if there is no table, no row, or the newest is more than ``days`` old."""
    newest = None if df is None else df.agg(F.max(col)).first()[0]
    if newest is None:
        return True
    from datetime import date

    newest = newest.date() if hasattr(newest, "date") else newest
    return (date.fromisoformat(as_of) - newest).days > days


def has_new_rows(new: DataFrame, stored: DataFrame, keys: list[str]) -> bool:
    """Whether ``new`` has a key that ``stored`` lacks; stops at the first."""
    return not new.join(stored.select(*keys), keys, "left_anti").isEmpty()
