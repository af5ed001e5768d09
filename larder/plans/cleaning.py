"""Queries of the cleaning and text operators over the recipe warehouse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions import text as X
from larder.functions import vocabulary as V
from larder.functions.numeric import finite, steady_round, steady_sql
from larder.operators import quality as Q
from larder.plans.registry import Registry, table
from larder.session import broadcast_if_small

R = Registry()


def sql_list(words: list[str] | tuple[str, ...]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def interactions(spark: SparkSession, sf: str) -> DataFrame:
    """Facts with the date of their date_id (null where that day was not loaded)."""
    days = table(spark, sf, "dim_date").select("date_id", F.col("full_date").alias("date"))
    return table(spark, sf, "fact_interactions").join(broadcast_if_small(days), "date_id", "left")


INTERACTIONS = "i AS (SELECT f.*, d.full_date AS date FROM fact_interactions f LEFT JOIN dim_date d USING (date_id))"
#: Copies of an interaction differ in their load time only.
KEEP_FIRST = """once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, recipe_id, date
    ORDER BY interaction_id NULLS FIRST, loaded_at NULLS FIRST) rn FROM i WHERE user_id IS NOT NULL AND recipe_id IS NOT NULL AND date IS NOT NULL) WHERE rn = 1)"""


def clean_interactions(spark: SparkSession, sf: str) -> DataFrame:
    """Rules in order: dates known, keys not null, first of each (user, recipe, date), rating 1 to 5."""
    rows = interactions(spark, sf).dropna(subset=["user_id", "recipe_id", "date"])
    rows = Q.keep_first(rows, ["user_id", "recipe_id", "date"], ["interaction_id", "loaded_at"])
    return Q.valid_ratings(rows)


CLEAN = f"{INTERACTIONS}, {KEEP_FIRST}, c AS (SELECT * FROM once WHERE rating BETWEEN 1 AND 5)"

# ------------------------------------------------------------------------------------------------------ interactions


@R.add("valid_ratings", """SELECT o_custkey user_id, l_partkey recipe_id, o_orderdate AS date, l_linenumber rating, count(*) n
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber BETWEEN 1 AND 5 GROUP BY ALL""")  # fmt: skip
def valid_ratings(spark: SparkSession, sf: str) -> DataFrame:
    j = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = j.select(
        F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("recipe_id"), F.col("o_orderdate").alias("date"),
        F.col("l_linenumber").alias("rating")
    )
    return Q.valid_ratings(rows).groupBy("user_id", "recipe_id", "date", "rating").agg(F.count(F.lit(1)).alias("n"))


@R.add(
    "dedupe_interactions",
    f"WITH {INTERACTIONS}, {KEEP_FIRST} SELECT interaction_id, user_id, recipe_id, date FROM once"
)
def dedupe_interactions(spark: SparkSession, sf: str) -> DataFrame:
    rows = interactions(spark, sf).dropna(subset=["user_id", "recipe_id", "date"])
    return Q.keep_first(
        rows, ["user_id", "recipe_id", "date"], ["interaction_id", "loaded_at"]
    ).select("interaction_id", "user_id", "recipe_id", "date")


@R.add("date_parts", f"""WITH {INTERACTIONS} SELECT interaction_id, loaded_at, year(date)::INTEGER AS year, month(date)::INTEGER AS month,
    dayname(date) day_of_week, quarter(date)::INTEGER AS quarter FROM i WHERE date IS NOT NULL""")  # fmt: skip
def date_parts(spark: SparkSession, sf: str) -> DataFrame:
    return Q.date_parts(interactions(spark, sf).filter("date is not null")).select(
        "interaction_id", "loaded_at", "year", "month", "day_of_week", "quarter"
    )


@R.add(
    "parse_dates",
    "SELECT o_orderkey, try_cast(CASE WHEN o_orderkey % 7 = 0 THEN 'no date' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP) AS date FROM orders WHERE o_orderkey % 7 <> 0"
)
def parse_dates(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 7 == 0, "no date").otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    )
    return Q.parse_dates(table(spark, sf, "orders").select("o_orderkey", text.alias("date")), "date")


@R.add(
    "not_after",
    "SELECT interaction_id, loaded_at FROM fact_interactions WHERE loaded_at <= TIMESTAMPTZ '2023-01-01 00:00:00+00'"
)
def not_after(spark: SparkSession, sf: str) -> DataFrame:
    return Q.not_after(
        table(spark, sf, "fact_interactions"), "loaded_at", "2023-01-01 00:00:00"
    ).select("interaction_id", "loaded_at")


@R.add("coerce_rating", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN r BETWEEN 1 AND 5 THEN r::INTEGER END rating FROM (
    SELECT *, round_even(try_cast(CASE WHEN l_returnflag = 'N' THEN 'n/a' ELSE (l_quantity / 8)::VARCHAR END AS DOUBLE), 0) r FROM lineitem)""")  # fmt: skip
def coerce_rating(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "lineitem")
    raw = F.when(F.col("l_returnflag") == "N", "n/a").otherwise((F.col("l_quantity") / 8).cast("string"))
    return t.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", Q.coerce_rating(raw).alias("rating"))


@R.add(
    "null_keys",
    "SELECT interaction_id, loaded_at FROM fact_interactions WHERE user_id IS NOT NULL AND recipe_id IS NOT NULL AND date_id IS NOT NULL"
)
def null_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "fact_interactions").dropna(
        subset=["user_id", "recipe_id", "date_id"]
    ).select("interaction_id", "loaded_at")


_BUSY = f"{INTERACTIONS}, busy AS (SELECT DISTINCT user_id FROM (SELECT user_id, date, count(*) n FROM i WHERE user_id IS NOT NULL GROUP BY ALL HAVING count(*) > 5))"


@R.add("bot_users", f"WITH {_BUSY} SELECT user_id FROM busy")
def bot_users(spark: SparkSession, sf: str) -> DataFrame:
    return Q.busy_users(interactions(spark, sf), "user_id", F.col("date"), 5)


@R.add(
    "drop_bots",
    f"WITH {_BUSY} SELECT interaction_id, user_id, loaded_at FROM i WHERE user_id IS NULL OR user_id NOT IN (SELECT user_id FROM busy)"
)
def drop_bots(spark: SparkSession, sf: str) -> DataFrame:
    rows = interactions(spark, sf)
    return Q.drop_users(
        rows, Q.busy_users(rows, "user_id", F.col("date"), 5), "user_id"
    ).select("interaction_id", "user_id", "loaded_at")


@R.add("null_profile", "SELECT column_name, n_rows, n_rows - n AS n_null FROM (SELECT count(*) n_rows, " + ", ".join(
    f"count({c}) AS {c}" for c in ("interaction_id", "user_id", "recipe_id", "date_id", "rating", "sentiment_score", "source", "event_type")) + " FROM fact_interactions) UNPIVOT (n FOR column_name IN (interaction_id, user_id, recipe_id, date_id, rating, sentiment_score, source, event_type))")
def null_profile(spark: SparkSession, sf: str) -> DataFrame:
    cols = ["interaction_id", "user_id", "recipe_id", "date_id", "rating", "sentiment_score", "source", "event_type"]
    return Q.null_profile(table(spark, sf, "fact_interactions").select(*cols))


@R.add("validation_counts", """SELECT count(*) n_rows, count_if(interaction_id IS NULL) null_ids, count_if(user_id IS NULL OR recipe_id IS NULL) null_keys,
    count_if(rating NOT BETWEEN 1 AND 5) bad_ratings, count_if(sentiment_score NOT BETWEEN -1 AND 1) bad_scores FROM fact_interactions""")  # fmt: skip
def validation_counts(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "fact_interactions")
    Q.require_columns(df, ["interaction_id", "user_id", "recipe_id", "rating"])
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("interaction_id").isNull()).alias("null_ids"),
        F.count_if(F.col("user_id").isNull() | F.col("recipe_id").isNull()).alias("null_keys"),
        F.count_if(~F.col("rating").between(1, 5)).alias("bad_ratings"), F.count_if(
            ~F.col("sentiment_score").between(-1, 1)
        ).alias("bad_scores"),
    )


# ----------------------------------------------------------------------------------------------------------- recipes

_NUT = ", ".join(f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END {c}" for c in Q.NUTRITION)
RECIPES = "r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY extract_date DESC NULLS LAST) rn FROM recipes_clean WHERE id IS NOT NULL) WHERE rn = 1)"


def recipes(spark: SparkSession, sf: str) -> DataFrame:
    """Each recipe once, as last extracted."""
    return Q.keep_first(
        table(spark, sf, "recipes_clean").filter("id is not null"), ["id"], [F.col("extract_date").desc_nulls_last()]
    )


@R.add("dedupe_recipes", f"WITH {RECIPES} SELECT id, name, minutes, extract_date FROM r")
def dedupe_recipes(spark: SparkSession, sf: str) -> DataFrame:
    return recipes(spark, sf).select("id", "name", "minutes", "extract_date")


@R.add(
    "minutes_cap",
    "SELECT p_partkey, CASE WHEN p_size * 100 - 300 > 0 THEN least(p_size * 100 - 300, 4320) END AS minutes FROM part"
)
def minutes_cap(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", Q.clean_minutes(F.col("p_size") * 100 - 300).alias("minutes"))


@R.add("nutrition_parse", f"""SELECT id, extract_date, {', '.join(f"CASE WHEN n = 7 THEN {c} END {c}" for c in Q.NUTRITION)} FROM (
    SELECT *, CASE WHEN id % 5 = 0 THEN 6 WHEN {' AND '.join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in Q.NUTRITION)} THEN 7 ELSE 0 END n FROM recipes_clean)""")  # fmt: skip
def nutrition_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Nutrition literals as a source gives them: every fifth is one value short, those with gaps are no list."""
    t = table(spark, sf, "recipes_clean")
    values = [finite(F.col(c)).cast("string") for c in Q.NUTRITION]
    full = F.concat(F.lit("["), F.array_join(F.array(*values), ", "), F.lit("]"))
    short = F.concat(F.lit("["), F.array_join(F.array(*values[:6]), ", "), F.lit("]"))
    whole = F.size(F.array_compact(F.array(*values))) == 7
    text = F.when(F.col("id") % 5 == 0, short).when(whole, full)
    return t.select("id", "extract_date", *Q.parse_nutrition(text))


@R.add("negative_null", "SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END balance FROM customer")
def negative_null(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", Q.negative_as_null(F.col("c_acctbal")).alias("balance"))


@R.add(
    "calorie_cap",
    "SELECT id, extract_date, CASE WHEN calories_pdv IS NOT NULL THEN least(calories_pdv, 500) END calories_pdv FROM recipes_clean"
)
def calorie_cap(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "recipes_clean").select(
        "id", "extract_date", Q.cap(F.col("calories_pdv"), 500.0).alias("calories_pdv")
    )


@R.add("clean_names", """SELECT recipe_id, CASE WHEN regexp_matches(n, '[a-zA-Z0-9]') THEN n END AS name FROM (
    SELECT recipe_id, substr(trim(regexp_replace(name, '\\s+', ' ', 'g')), 1, 20) n FROM dim_recipe)""")  # fmt: skip
def clean_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "dim_recipe").select("recipe_id", Q.clean_name(F.col("name"), 20).alias("name"))


_FENCES = f"v AS (SELECT id, {_NUT} FROM r), q AS (SELECT {', '.join(f'quantile_cont({c}, 0.95) q_{c}' for c in Q.NUTRITION)} FROM v)"


@R.add(
    "outlier_flag",
    f"WITH {RECIPES}, {_FENCES} SELECT id, {' OR '.join(f'coalesce({c} > q_{c}, false)' for c in Q.NUTRITION)} AS is_outlier FROM v, q"
)
def outlier_flag(spark: SparkSession, sf: str) -> DataFrame:
    return Q.flag_outliers(recipes(spark, sf)).select("id", "is_outlier")


def _n(c: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN greatest(least({c} / q_{c}, 1), 0) END"


_SCORE = f"0.4 * {_n('protein_pdv')} - 0.25 * {_n('saturated_fat_pdv')} - 0.2 * {_n('sugar_pdv')} - 0.15 * {_n('sodium_pdv')}"


@R.add(
    "balance_score",
    f"WITH {RECIPES}, {_FENCES}, s AS (SELECT id, {_SCORE} s FROM v, q) SELECT id, {steady_sql('CASE WHEN s IS NOT NULL THEN greatest(least(s, 1), -1) END')} AS balance_score FROM s"
)
def balance_score(spark: SparkSession, sf: str) -> DataFrame:
    r = recipes(spark, sf)
    return r.select("id", steady_round(Q.balance_score(r)).alias("balance_score"))


@R.add(
    "ingredient_explode",
    f"WITH {RECIPES} SELECT id, ingredient, count(*) n FROM (SELECT id, unnest(ingredients_canonical_list) ingredient FROM r) GROUP BY ALL"
)
def ingredient_explode(spark: SparkSession, sf: str) -> DataFrame:
    return recipes(spark, sf).select(
        "id", F.explode("ingredients_canonical_list").alias("ingredient")
    ).groupBy("id", "ingredient").agg(F.count(F.lit(1)).alias("n"))


_MAPPING = """map AS (SELECT DISTINCT candidate_ingredient AS raw, regexp_replace(candidate_ingredient, '^(red|white|young|dried|smoked|roasted) ', '') canonical
    FROM serving_substitution_recommendations WHERE candidate_ingredient IS NOT NULL)"""


@R.add("ingredient_canonical_map", f"""WITH {RECIPES}, {_MAPPING},
    e AS (SELECT id, unnest(ingredients_canonical_list) x, generate_subscripts(ingredients_canonical_list, 1) p FROM r)
    SELECT id, string_agg(coalesce(canonical, x), '|' ORDER BY p) joined, count(*)::INTEGER n FROM e LEFT JOIN map ON raw = x GROUP BY id""")  # fmt: skip
def ingredient_canonical_map(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("candidate_ingredient")
    mapping = table(spark, sf, "serving_substitution_recommendations").select(
        c.alias("raw"), F.regexp_replace(c, "^(red|white|young|dried|smoked|roasted) ", "").alias("canonical")
    ).filter("raw is not null").distinct()
    return Q.canonical_ingredients(
        recipes(spark, sf), "id", "ingredients_canonical_list", mapping
    ).select("id", "joined", "n")


@R.add("list_literal_parse", "SELECT id, extract_date, ingredients_canonical_list AS items FROM recipes_clean")
def list_literal_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Lists written as literals and read again."""
    items = F.col("ingredients_canonical_list")
    text = F.when(
        items.isNotNull(),
        F.concat(
            F.lit("["),
            F.array_join(
                F.transform(items, lambda x: F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("\\'")), F.lit("'"))),
                ", "
            ),
            F.lit("]")
        )
    )
    return table(spark, sf, "recipes_clean").select("id", "extract_date", X.list_literal(text).alias("items"))


@R.add(
    "fill_description",
    "SELECT recipe_id, coalesce(nullif(tags, ''), concat_ws(' ', name, top_ingredients)) description FROM dim_recipe WHERE avg_cook_minutes <> 0 AND ingredient_count <> 0"
)
def fill_description(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "dim_recipe").filter("avg_cook_minutes <> 0 and ingredient_count <> 0")
    return t.select(
        "recipe_id",
        F.coalesce(F.nullif("tags", F.lit("")), F.concat_ws(" ", "name", "top_ingredients")).alias("description")
    )


# -------------------------------------------------------------------------------------------------------------- text

def sql_normalize(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[/-]', ' ', 'g'), '[^\\w\\s]', '', 'g'), '\\s+', ' ', 'g'))"


def sql_strict(x: str) -> str:
    t = f"trim(regexp_replace(regexp_replace({sql_normalize(x)}, '\\b({'|'.join(V.RECIPE_WORDS)})\\b', '', 'g'), '\\s+', ' ', 'g'))"
    drop = sql_list([w for w in V.MODIFIERS if w not in V.COOKING])
    return f"trim(array_to_string(list_filter(string_split({t}, ' '), lambda w: w NOT IN ({drop})), ' '))"


def sql_for_tags(x: str) -> str:
    t = f"trim(lower(coalesce({x}, '')))"
    for p in V.DELETED:
        t = f"regexp_replace({t}, '{p}', '', 'g')"
    return f"trim(regexp_replace(regexp_replace({t}, '[^\\w\\s/-]', ' ', 'g'), '\\s+', ' ', 'g'))"


def sql_edges(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'), ' -/')"


def sql_term(x: str) -> str:
    return sql_edges(f"regexp_replace({sql_for_tags(x)}, '\\b(and|with|style)\\b', ' ', 'g')")


def sql_loose(x: str) -> str:
    return sql_edges(f"regexp_replace({sql_term(x)}, '\\b(dinner|lunch|breakfast|meal|ideas|idea)\\b', ' ', 'g')")


def sql_tokens(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[a-z]+'), lambda w: length(w) > 1 AND w NOT IN ({sql_list(V.MATCH_STOPWORDS)}))"


# Spark and DuckDB share ASCII word classes, so whole texts compare.
@R.add("normalize_text", f"SELECT doc_id, {sql_normalize('text')} t FROM documents")
def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.normalize_text(F.col("text")).alias("t"))


@R.add("canonical_strict", f"SELECT recipe_id, {sql_strict('name')} term FROM dim_recipe")
def canonical_strict(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "dim_recipe").select("recipe_id", X.canonical_strict(F.col("name")).alias("term"))


@R.add("canonical_loose", f"SELECT recipe_id, {sql_loose('name')} term FROM dim_recipe")
def canonical_loose(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "dim_recipe").select("recipe_id", X.canonical_loose(F.col("name")).alias("term"))


@R.add("clean_reviews", r"""SELECT doc_id, CASE WHEN length(t) >= 2 THEN t END review FROM (
    SELECT doc_id, nfc_normalize(trim(regexp_replace(regexp_replace(replace(coalesce(text, ''), chr(0), ''), '<[^>]+', ' ', 'g'), '\s+', ' ', 'g'))) t FROM documents)""")  # fmt: skip
def clean_reviews(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id", X.short_as_null(X.nfc(X.clean_review(F.col("text")))).alias("review")
    )


@R.add("html_strip", r"SELECT doc_id, regexp_replace(text, '<[^>]+>', ' ', 'g') t FROM documents")
def html_strip(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.strip_html(F.col("text"), strict=True).alias("t"))


@R.add(
    "ingredient_text",
    r"SELECT recipe_id, trim(regexp_replace(regexp_replace(lower(coalesce(top_ingredients, '')), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) t FROM dim_recipe"
)
def ingredient_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "dim_recipe").select("recipe_id", X.ingredient_text(F.col("top_ingredients")).alias("t"))


@R.add("tokenize", f"SELECT doc_id, {sql_tokens('text')} tokens FROM documents")
def tokenize(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.match_tokens(F.col("text")).alias("tokens"))


@R.add(
    "split_alnum",
    "SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: length(w) >= 2) tokens FROM documents"
)
def split_alnum(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.split_alnum(F.col("text")).alias("tokens"))


@R.add("possessive", r"""SELECT doc_id, regexp_replace(regexp_replace(t, '\b([a-zA-Z]{2,}) s ([a-zA-Z])', '\1''s \2', 'g'), '\b([a-zA-Z]{2,}) s$', '\1''s') t
    FROM (SELECT doc_id, replace(text, '''', ' ') t FROM documents)""")  # fmt: skip
def possessive(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id", X.restore_possessive(F.replace(F.col("text"), F.lit("'"), F.lit(" "))).alias("t")
    )


@R.add("exclamations", "SELECT doc_id, len(regexp_extract_all(text, '!'))::INTEGER n FROM documents")
def exclamations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.regexp_count("text", F.lit("!")).alias("n"))


@R.add("useful_tags", f"""WITH t AS (SELECT DISTINCT trim(x) tag FROM (SELECT unnest(string_split_regex(tags, '[|,;]')) x FROM dim_recipe))
    SELECT tag FROM t WHERE tag <> '' AND NOT (tag IN ({sql_list(V.TAG_BLOCKLIST)}) OR tag LIKE 'for-%' OR tag LIKE '%-servings%' OR regexp_matches(tag, '^\\d+$'))""")  # fmt: skip
def useful_tags(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "dim_recipe").select(
        F.explode(F.split("tags", "[|,;]")).alias("x")
    ).select(F.trim("x").alias("tag")).distinct()
    return t.filter((F.col("tag") != "") & X.is_useful_tag(F.col("tag")))


@R.add(
    "interaction_hash",
    "SELECT DISTINCT user_id, recipe_id, date_id, ('0x' || substr(sha256(user_id || '_' || recipe_id || '_' || date_id), 1, 15))::BIGINT h FROM fact_interactions WHERE user_id IS NOT NULL AND recipe_id IS NOT NULL AND date_id IS NOT NULL"
)
def interaction_hash(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["user_id", "recipe_id", "date_id"]
    t = table(spark, sf, "fact_interactions").dropna(subset=keys).select(*keys).distinct()
    text = F.concat_ws("_", *[F.col(k).cast("string") for k in keys])
    return t.select(*keys, F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint").alias("h"))


@R.add(
    "serving_grams",
    r"SELECT doc_id, try_cast(nullif(regexp_extract(text, '(\d+) gram', 1), '') AS DOUBLE) grams FROM documents"
)
def serving_grams(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id", F.nullif(F.regexp_extract("text", r"(\d+) gram", 1), F.lit("")).try_cast("double").alias("grams")
    )


R.plain("valid_ratings", dates=("date",))
R.plain("parse_dates", dates=("date",))
for _name in ("date_parts", "not_after", "null_keys", "drop_bots"):
    R.plain(_name, micros=("loaded_at",))
R.plain("dedupe_interactions", dates=("date",))
for _name in ("dedupe_recipes", "nutrition_parse", "calorie_cap"):
    R.plain(_name, dates=("extract_date",))
R.plain("list_literal_parse", dates=("extract_date",), lists=("items",))
for _name in ("tokenize", "split_alnum"):
    R.plain(_name, lists=("tokens",))
