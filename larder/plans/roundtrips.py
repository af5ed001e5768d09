"""Queries of sources, sinks and wiring: a table is written in some form, read back through the operator, and compared."""

from __future__ import annotations

import os
import shutil
import tempfile
import zipfile
from urllib.parse import urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.config import Config
from larder.functions import text as X
from larder.functions.numeric import finite, steady_round, steady_sql
from larder.operators import quality as Q
from larder.operators.quantiles import exact_quantiles
from larder.operators.tagging import tag_rows
from larder.pipeline import APP_TABLES, build_once, load_app_table, run_if_new
from larder.plans.cleaning import RECIPES, interactions, recipes
from larder.plans.registry import Registry, table
from larder.session import file_system, materialize, scratch_path
from larder.sources import readers as IO
from larder.sources import tables as VT
from larder.sources import writers as O

R = Registry()

# ------------------------------------------------------------------------------------------------------------ sources


def _csv(df: DataFrame, name: str) -> str:
    path = scratch_path(df.sparkSession, name)
    df.write.option("header", True).option("escape", '"').csv(path)
    return path


@R.add("csv_recipes", f"""WITH {RECIPES} SELECT id, nullif(name, '') AS name, minutes, len(ingredients_canonical_list)::INTEGER n_ingredients FROM r""")
def csv_recipes(spark: SparkSession, sf: str) -> DataFrame:
    """Raw recipes in a CSV file with further columns: seven columns by header, typed; lists as literals."""
    raw = recipes(spark, sf).select(
        F.lit("x").alias("further"), "name", "id", "minutes", F.to_json("ingredients_canonical_list").alias("ingredients"),
        F.lit("[]").alias("tags"), F.lit("[1, 2, 3, 4, 5, 6, 7]").alias("nutrition"), F.lit("['a, b', 'c']").alias("steps"),
    )
    got = IO.read_csv(spark, _csv(raw, "recipes"), IO.RECIPES)
    n = F.size(X.list_literal(F.col("ingredients")))
    return got.select("id", "name", "minutes", F.when(F.col("ingredients").isNotNull(), n).alias("n_ingredients"))


@R.add(
    "csv_interactions",
    """SELECT user_id, recipe_id, full_date AS day, rating, count(*) n FROM fact_interactions LEFT JOIN dim_date USING (date_id) GROUP BY ALL"""
)
def csv_interactions(spark: SparkSession, sf: str) -> DataFrame:
    """Raw reviews in a CSV file, typed, with dates parsed; texts hold quotes and line breaks."""
    raw = interactions(spark, sf).select(
        "user_id", "recipe_id", F.col("date").cast("string"), "rating", F.concat(F.lit('said "so",\nand '), F.col("source")).alias("review"), "event_type"
    )
    got = IO.read_csv(spark, _csv(raw, "reviews"), IO.INTERACTIONS)
    day = F.col("date").cast("date").alias("day")
    return got.groupBy("user_id", "recipe_id", day, F.col("rating").cast("int").alias("rating")).agg(F.count(F.lit(1)).alias("n"))


@R.add("pruned_scan", "SELECT recipe_id, name, avg_cook_minutes FROM dim_recipe")
def pruned_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The wanted columns that the file has: of four, three."""
    return IO.read_parquet(spark, f"{sf}/dim_recipe.parquet", ["recipe_id", "name", "no_such_column", "avg_cook_minutes"])


@R.add(
    "foods_scan",
    "SELECT recipe_id, CASE WHEN recipe_id % 2 = 0 THEN 'Foundation' ELSE 'Branded' END kind, protein, sodium FROM dim_recipe WHERE protein IS NOT NULL AND sodium IS NOT NULL"
)
def foods_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Bulk food files, each with its foods under a key of its own, nested and flat entries; a missing file is left out."""
    t = table(spark, sf, "dim_recipe").filter("protein is not null and sodium is not null")
    nested = F.array(
        *[F.struct(F.struct(F.lit(n).alias("name"), F.lit(u).alias("unitName")).alias("nutrient"), F.col(c).alias("amount"))
          for n, u, c in (("Protein", "G", "protein"), ("Sodium, Na", "MG", "sodium"))]
    )
    flat = F.array(
        *[F.struct(F.lit(n).alias("nutrientName"), F.lit(u).alias("unitName"), F.col(c).alias("value"))
          for n, u, c in (("Sodium, Na", "mg", "sodium"), ("Protein", "g", "protein"))]
    )
    files = [("no-such-file", "Gone")]
    for rest, kind, key, entries in ((0, "Foundation", "FoundationFoods", nested), (1, "Branded", "BrandedFoods", flat)):
        food = F.struct(F.col("recipe_id").cast("string").alias("description"), F.lit(kind).alias("dataType"), entries.alias("foodNutrients"))
        # a file is one JSON object, so the foods are spread over files of about 500
        mine = t.filter(F.pmod("recipe_id", F.lit(2)) == rest)
        n = max(1, mine.count() // 500)
        whole = mine.groupBy(F.pmod(F.xxhash64("recipe_id"), F.lit(n)).alias("k")).agg(F.collect_list(food).alias(key))
        path = scratch_path(spark, "foods")
        whole.select(F.to_json(F.struct(key))).write.option("maxRecordsPerFile", 1).text(path)
        files.append((path, key))
    foods = IO.read_foods(spark, files)
    amount = lambda n, u: IO.nutrient_amount(F.col("foodNutrients"), [n], [u])
    return foods.select(
        F.col("description").cast("bigint").alias("recipe_id"), F.col("dataType").alias("kind"),
        amount("protein", "g").alias("protein"), amount("sodium", "mg").alias("sodium"),
    )


@R.add("archive_scan", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def archive_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A CSV member of an archive, found by its file name in a folder of the archive; 25 rows by nature."""
    rows = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey").toPandas()
    folder = scratch_path(spark, "archive")
    local = urlparse(folder).path if folder.startswith("file:") else tempfile.mkdtemp()
    os.makedirs(local, exist_ok=True)
    with zipfile.ZipFile(f"{local}/data.zip", "w") as z:
        z.writestr("deep/nation.csv", rows.to_csv(index=False))
    member = IO.extract_member(f"{local}/data.zip", "nation.csv", local)
    schema = T.StructType().add("n_nationkey", "integer").add("n_name", "string").add("n_regionkey", "integer")
    return IO.read_csv(spark, f"file://{member}", schema)


def _database(rows: DataFrame, table_name: str, types: list[str]) -> tuple[str, str]:
    """URL and driver of an embedded database (it comes with Spark) that holds the few rows of a table; all executors can
    open it.

    Only one JVM may open such a database while it can be changed, and one in memory exists in one JVM alone. So the driver
    fills it, shuts it down and packs it into an archive in the shared folder: from there it is read-only, for any JVM.
    """
    spark, driver = rows.sparkSession, "org.apache.derby.jdbc.EmbeddedDriver"
    fs, folder = file_system(spark, scratch_path(spark, "database"))
    at = fs.makeQualified(folder).toUri()
    if at.getScheme() != "file":
        raise RuntimeError("the database is a file: spark.checkpoint.dir must be a folder that all executors have mounted")
    jvm, packed = spark.sparkContext._jvm, f"{at.getPath()}/db.zip"
    open_at = lambda url: jvm.org.apache.derby.jdbc.EmbeddedDriver().connect(url, jvm.java.util.Properties())
    with tempfile.TemporaryDirectory() as own:
        con = open_at(f"jdbc:derby:{own}/db;create=true")
        columns = ", ".join(f"{c} {t}" for c, t in zip(rows.columns, types, strict=True))
        con.createStatement().execute(f"CREATE TABLE {table_name} ({columns})")
        insert = con.prepareStatement(f"INSERT INTO {table_name} VALUES ({', '.join('?' * len(types))})")
        for row in rows.collect():
            for k, v in enumerate(row, 1):
                insert.setObject(k, v)
            insert.executeUpdate()
        con.close()
        try:
            open_at(f"jdbc:derby:{own}/db;shutdown=true")
        except Py4JJavaError as e:  # a shutdown that went well is reported in this way
            if e.java_exception.getSQLState() != "08006":
                raise
        os.makedirs(os.path.dirname(packed), exist_ok=True)
        shutil.make_archive(packed.removesuffix(".zip"), "zip", own)
    return f"jdbc:derby:jar:({packed})db", driver


@R.add("database_scan", "SELECT n_nationkey, n_name FROM nation")
def database_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A database table read in ranges of its key by the executors; 25 rows by nature."""
    url, driver = _database(table(spark, sf, "nation").select("n_nationkey", "n_name"), "nation", ["INTEGER", "CLOB"])
    got = IO.read_jdbc(spark, url, "nation", "n_nationkey", (0, 25), 4, driver=driver)
    return materialize(got.select(F.col("N_NATIONKEY").alias("n_nationkey"), F.col("N_NAME").alias("n_name")), "database")


@R.add("fallback_scan", "SELECT s_suppkey, s_name FROM supplier")
def fallback_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The first source that gives a table: one is missing, one fails, the third has it."""
    schema = table(spark, sf, "supplier").schema
    got = IO.first_available(
        [lambda: IO.read_if_there(spark, f"{sf}/no_such.parquet"), lambda: 1 / 0, lambda: table(spark, sf, "supplier")], schema, spark
    )
    return got.select("s_suppkey", "s_name")


@R.add("build_once", "SELECT 1 AS n_built, count(*) n FROM supplier")
def build_once_query(spark: SparkSession, sf: str) -> DataFrame:
    """A table asked for twice and made once."""
    path, made = scratch_path(spark, "once"), []
    for _ in range(2):
        out = build_once(spark, path, lambda: made.append(1) or table(spark, sf, "supplier"))
    return out.agg(F.lit(len(made)).alias("n_built"), F.count(F.lit(1)).alias("n"))


# -------------------------------------------------------------------------------------------------------------- sinks


@R.add("replaced_table", "SELECT user_id, review_count + 1 AS review_count FROM dim_user WHERE review_count > 3")
def replaced_table(spark: SparkSession, sf: str) -> DataFrame:
    """A table written, then replaced by rows read from itself."""
    path = scratch_path(spark, "replaced")
    O.replace_parquet(table(spark, sf, "dim_user").select("user_id", "review_count"), path)
    old = VT.read_table(spark, path)
    O.replace_parquet(old.filter("review_count > 3").withColumn("review_count", F.col("review_count") + 1), path)
    return VT.read_table(spark, path)


@R.add(
    "keyed_table",
    """SELECT recipe_id, name, CASE WHEN recipe_id % 3 = 0 THEN 99 ELSE coalesce(review_count, 0) END review_count FROM dim_recipe"""
)
def keyed_table(spark: SparkSession, sf: str) -> DataFrame:
    """A stored table with two loads: the second brings a third of the keys; its counts are taken, its names are not."""
    path = scratch_path(spark, "keyed")
    t = table(spark, sf, "dim_recipe").select("recipe_id", "name", F.coalesce("review_count", F.lit(0)).alias("review_count"))
    O.write_upsert(t, path, ["recipe_id"], ["review_count"])
    new = t.filter("recipe_id % 3 = 0").select("recipe_id", F.lit("new").alias("name"), F.lit(99).alias("review_count"))
    O.write_upsert(new, path, ["recipe_id"], ["review_count"])
    O.write_new_only(new, path, ["recipe_id"])
    return VT.read_table(spark, path)


@R.add("metadata", "SELECT r_name AS key, CAST(r_regionkey + 1 AS VARCHAR) AS value FROM region")
def metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Key-value pairs saved twice; the second values stay."""
    path = scratch_path(spark, "metadata")
    rows = {r["r_name"]: r["r_regionkey"] for r in table(spark, sf, "region").collect()}  # five by nature
    for more in (0, 1):
        O.save_metadata(spark, path, {k: str(v + more) for k, v in rows.items()})
    return VT.read_table(spark, path)


@R.add(
    "json_profiles",
    f"SELECT cluster_id::INTEGER cluster_id, count(*) n_users, {steady_sql('avg(review_count)')} AS mean_reviews FROM dim_user WHERE cluster_id IS NOT NULL GROUP BY 1"
)
def json_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Segment profiles written as JSON and read back."""
    t = table(spark, sf, "dim_user").filter("cluster_id is not null").groupBy(F.col("cluster_id").cast("int").alias("cluster_id"))
    path = scratch_path(spark, "profiles")
    O.write_json(t.agg(F.count(F.lit(1)).alias("n_users"), steady_round(F.avg("review_count")).alias("mean_reviews")), path)
    return spark.read.schema("cluster_id int, n_users bigint, mean_reviews double").json(path)


@R.add("text_lines", "SELECT DISTINCT primary_tag AS line FROM recipes_clean WHERE primary_tag IS NOT NULL")
def text_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct tags as a text file, one per line."""
    path = scratch_path(spark, "lines")
    O.write_lines(table(spark, sf, "recipes_clean"), F.col("primary_tag"), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def _two_loads(spark: SparkSession, name: str, first: DataFrame, second: DataFrame) -> DataFrame:
    """The app table after two loads of rows unique by its keys."""
    c = Config(output_dir=scratch_path(spark, "app"))
    load_app_table(spark, c, name, first)
    return load_app_table(spark, c, name, second)


@R.add(
    "load_nutrients",
    """SELECT d.name AS canonical_ingredient, max(d.protein) + 1 AS protein_g_per_100g, NULL::DOUBLE AS fat_g_per_100g
    FROM (SELECT lower(trim(name)) AS name, protein FROM dim_recipe WHERE name IS NOT NULL AND protein IS NOT NULL) d GROUP BY 1"""
)
def load_nutrients(spark: SparkSession, sf: str) -> DataFrame:
    """The nutrient dimension after two loads; columns that a load lacks are null."""
    t = table(spark, sf, "dim_recipe").filter("name is not null and protein is not null")
    one = t.groupBy(F.lower(F.trim("name")).alias("canonical_ingredient")).agg(F.max("protein").alias("protein_g_per_100g"))
    two = one.withColumn("protein_g_per_100g", F.col("protein_g_per_100g") + 1)
    out = _two_loads(spark, "dim_canonical_ingredient_nutrients", one, two)
    return out.select("canonical_ingredient", "protein_g_per_100g", "fat_g_per_100g")


@R.add(
    "load_substitutions",
    """WITH s AS (SELECT candidate_ingredient, substitute_ingredient, CASE WHEN isnan(recommendation_score) THEN NULL ELSE recommendation_score END score, updated_at
      FROM serving_substitution_recommendations WHERE candidate_ingredient IS NOT NULL AND substitute_ingredient IS NOT NULL)
    SELECT candidate_ingredient, substitute_ingredient, max(updated_at) updated_at, arg_max(coalesce(score, -1e9), (updated_at, coalesce(score, -1e9))) recommendation_score
    FROM s GROUP BY ALL"""
)
def load_substitutions(spark: SparkSession, sf: str) -> DataFrame:
    """The substitution fact: older rows first, then the latest row of every pair over them."""
    score = F.coalesce(finite(F.col("recommendation_score")), F.lit(-1e9)).alias("recommendation_score")
    t = table(spark, sf, "serving_substitution_recommendations").select(
        "candidate_ingredient", "substitute_ingredient", score, "updated_at"
    ).dropna(subset=["candidate_ingredient", "substitute_ingredient"])
    keys = ["candidate_ingredient", "substitute_ingredient"]
    at = F.struct("updated_at", "recommendation_score")
    first = t.groupBy(*keys).agg(F.min(at).alias("m")).select(*keys, "m.*")
    last = t.groupBy(*keys).agg(F.max(at).alias("m")).select(*keys, "m.*")
    return _two_loads(spark, "fact_substitution_recommendations", first, last).select(*keys, "updated_at", "recommendation_score")


def _signals(spark: SparkSession, sf: str) -> DataFrame:
    """(term, day, n): how often a source had a document on a day, as rows of a search signal."""
    t = table(spark, sf, "documents").filter("source is not null and fetched_date is not null")
    return t.groupBy(F.col("source").alias("term"), F.col("fetched_date").alias("day")).agg(F.count(F.lit(1)).alias("n"))


_SIGNALS = "g AS (SELECT source term, fetched_date AS day, count(*) n FROM documents WHERE source IS NOT NULL AND fetched_date IS NOT NULL GROUP BY ALL)"


@R.add(
    "load_signals",
    f"""WITH {_SIGNALS} SELECT 'google_trends_raw' AS table_name, term, day, n + 1 AS v FROM g UNION ALL SELECT 'google_trends_normalised', term, day, n + 1 FROM g
    UNION ALL SELECT 'ai_mode_raw', term, day, n + 1 FROM g UNION ALL SELECT 'ai_mode_term_scores', term, day, n + 1 FROM g UNION ALL SELECT 'gap_analysis', term, day, n + 1 FROM g"""
)
def load_signals(spark: SparkSession, sf: str) -> DataFrame:
    """The tables of search signals by their own keys, each after two loads."""
    g = materialize(_signals(spark, sf), "signals")
    more = g.withColumn("n", F.col("n") + 1)
    seed = lambda d: d.select(
        F.col("term").alias("seed_query"), F.col("term").alias("related_query"), F.lit("top").alias("query_type"),
        F.col("day").alias("fetched_date"), F.col("n").alias("raw_value"), F.col("n").cast("double").alias("normalised_score"),
    )
    body = lambda d: d.select(F.col("term").alias("seed_query"), F.lit(1).alias("block_index"), F.col("day").alias("fetched_date"), F.col("n").cast("string").alias("body"))
    score = lambda d: d.select("term", F.col("day").alias("fetched_date"), F.col("n").alias("raw_frequency"), F.lit(0.5).alias("normalised_score"))
    gap = lambda d: d.select("term", F.col("day").alias("computed_date"), F.col("n").cast("double").alias("gap_score"))
    parts = []
    for name, make, term, day, v in (
        ("google_trends_raw", seed, "seed_query", "fetched_date", "raw_value"),
        ("google_trends_normalised", seed, "seed_query", "fetched_date", "normalised_score"),
        ("ai_mode_raw", body, "seed_query", "fetched_date", "body"),
        ("ai_mode_term_scores", score, "term", "fetched_date", "raw_frequency"),
        ("gap_analysis", gap, "term", "computed_date", "gap_score"),
    ):
        out = _two_loads(spark, name, make(g), make(more))
        parts.append(out.select(F.lit(name).alias("table_name"), F.col(term).alias("term"), F.col(day).alias("day"), F.col(v).cast("bigint").alias("v")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@R.add(
    "load_tags",
    f"WITH {RECIPES} SELECT count(*) n, count(DISTINCT id) n_recipes FROM (SELECT DISTINCT id, unnest(ingredients_canonical_list) tag FROM r)"
)
def load_tags(spark: SparkSession, sf: str) -> DataFrame:
    """The tag table after the same rows were appended twice: its key keeps them from doubling."""
    tags = recipes(spark, sf).select(F.col("id").alias("recipe_id"), F.explode("ingredients_canonical_list").alias("tag")).filter("tag is not null").distinct()
    tags = tags.withColumns({"matched_term": F.col("tag"), "canonical_term": F.col("tag"), "source": F.lit("recipe")})
    tags = materialize(tags, "tags")
    out = _two_loads(spark, "recipe_tags", tags, tags)
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("recipe_id").alias("n_recipes"))


# ------------------------------------------------------------------------------------------------------------- wiring

_RAW = """raw AS (SELECT user_id, recipe_id, full_date AS day, rating FROM fact_interactions LEFT JOIN dim_date USING (date_id)),
    k AS (SELECT user_id, recipe_id, day, min(rating) rating FROM raw WHERE user_id IS NOT NULL AND recipe_id IS NOT NULL AND day IS NOT NULL AND rating BETWEEN 1 AND 5 GROUP BY ALL),
    b AS (SELECT DISTINCT user_id FROM (SELECT user_id, day FROM k GROUP BY ALL HAVING count(*) > 50)),
    c AS (SELECT * FROM k WHERE user_id NOT IN (SELECT user_id FROM b))"""


@R.add(
    "pipeline_run",
    f"""WITH {_RAW} SELECT 'fact_interactions' table_name, count(*) n, sum(rating)::BIGINT total FROM c
    UNION ALL SELECT 'dim_user', count(DISTINCT user_id), count(*)::BIGINT FROM c UNION ALL SELECT 'dim_date', count(DISTINCT day), 0::BIGINT FROM c"""
)
def pipeline_run(spark: SparkSession, sf: str) -> DataFrame:
    """The wired stages from raw reviews and recipes to the warehouse; a second run adds nothing; an empty input keeps all."""
    raw = interactions(spark, sf).select("user_id", "recipe_id", F.col("date").cast("timestamp").alias("date"), F.col("rating").cast("tinyint").alias("rating"), F.lit(None).cast("string").alias("review"))
    dishes = recipes(spark, sf).select(
        "id", "name", "minutes", F.lit(None).cast("string").alias("tags"), F.lit(None).cast("string").alias("nutrition"),
        F.lit(None).cast("string").alias("steps"), F.to_json("ingredients_canonical_list").alias("ingredients"),
    )
    c = Config(output_dir=scratch_path(spark, "warehouse"))
    run_if_new(spark, c, raw, dishes)
    if run_if_new(spark, c, raw, dishes, block=True) is not None or run_if_new(spark, c, raw.limit(0), dishes) is not None:
        raise AssertionError("a run without new rows was not held back")
    read = lambda n: VT.read_table(spark, f"{c.output_dir}/{n}")
    n = F.count(F.lit(1)).alias("n")
    one = read("fact_interactions").agg(F.lit("fact_interactions").alias("table_name"), n, F.sum("rating").alias("total"))
    two = read("dim_user").agg(F.lit("dim_user").alias("table_name"), n, F.sum("review_count").alias("total"))
    three = read("dim_date").agg(F.lit("dim_date").alias("table_name"), n, F.lit(0).cast("bigint").alias("total"))
    return one.unionByName(two).unionByName(three)


@R.add("empty_inputs", "SELECT 'tags' AS name, 0::BIGINT n UNION ALL SELECT 'interactions', 0::BIGINT")
def empty_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Stages on empty tables give empty tables of their schema."""
    none = recipes(spark, sf).limit(0)
    tags = tag_rows(none, F.col("name"), ["id"])
    rows = Q.drop_users(interactions(spark, sf).limit(0), Q.busy_users(interactions(spark, sf), "user_id", F.col("date")), "user_id")
    count = lambda df, name: df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
    return count(tags, "tags").unionByName(count(rows, "interactions"))


@R.add(
    "missing_columns",
    "SELECT c.column_name FROM (SELECT unnest(['recipe_id', 'name', 'tags', 'steps', 'photo']) column_name) c WHERE column_name NOT IN (SELECT column_name FROM (DESCRIBE dim_recipe))"
)
def missing_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Required columns that a table lacks."""
    lacking = Q.lacking_columns(table(spark, sf, "dim_recipe"), ["recipe_id", "name", "tags", "steps", "photo"])
    return spark.createDataFrame([(c,) for c in lacking], "column_name string")


@R.add("settings", "SELECT * FROM (VALUES ('bot_rows_per_day', '50'), ('output_dir', 'elsewhere'), ('pseudo_count', '10.0'), ('rebuild', 'True')) t(name, value)")
def settings(spark: SparkSession, sf: str) -> DataFrame:
    """Settings from the environment over the defaults."""
    c = Config.from_mapping({"LARDER_OUTPUT_DIR": "elsewhere", "LARDER_REBUILD": "yes", "OTHER": "1"})
    names = ("bot_rows_per_day", "output_dir", "pseudo_count", "rebuild")
    return spark.createDataFrame([(n, str(getattr(c, n))) for n in names], "name string, value string")


@R.add(
    "distribution_summary",
    " UNION ALL ".join(
        f"SELECT '{c}' column_name, count({c}) n, {steady_sql(f'avg({c})')} AS mean, {steady_sql(f'stddev_samp({c})')} AS deviation, median({c})::DOUBLE median, max({c})::DOUBLE highest FROM dim_user"
        for c in ("review_count", "avg_rating_given", "recipe_diversity")
    ),
)
def distribution_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Mean, deviation, median and maximum of columns, as a run reports them."""
    names = ["review_count", "avg_rating_given", "recipe_diversity"]
    t = table(spark, sf, "dim_user")
    middle = exact_quantiles(t, names, [0.5])
    rows = F.array(
        *[F.struct(
            F.lit(c).alias("column_name"), F.count(c).alias("n"), steady_round(F.avg(c)).alias("mean"), steady_round(F.stddev(c)).alias("deviation"),
            F.lit(middle[c, 0.5]).cast("double").alias("median"), F.max(c).cast("double").alias("highest"),
        ) for c in names]
    )
    return t.agg(rows.alias("x")).select(F.explode("x").alias("x")).select("x.*")


for _name in ("csv_interactions", "load_signals"):
    R.plain(_name, dates=("day",))
R.plain("load_substitutions", micros=("updated_at",))
assert set(APP_TABLES) >= {"recipe_tags", "signal_tags", "recipe_gap_analysis", "recipe_term_clusters"}
