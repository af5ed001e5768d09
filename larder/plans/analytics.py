"""Queries of ratings, users, warehouse builds and serving reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.functions.numeric import finite, steady_round, steady_sql
from larder.functions.vocabulary import CATEGORIES
from larder.operators import ratings as A
from larder.operators import warehouse as W
from larder.operators.matching import total_rank
from larder.operators.quality import busy_users, keep_first
from larder.operators.quantiles import exact_quantiles
from larder.operators.serving import filter_recipes
from larder.operators.skew import split_join
from larder.plans.cleaning import CLEAN, INTERACTIONS, RECIPES, clean_interactions, interactions, recipes
from larder.plans.registry import Registry, table

R = Registry()

# ----------------------------------------------------------------------------------------------------------- ratings


@R.add("bayes_recipe_rating", f"""WITH {CLEAN}, s AS (SELECT * FROM c WHERE sentiment_score IS NOT NULL),
    u AS (SELECT user_id, count(*) n FROM s GROUP BY 1), m AS (SELECT avg(sentiment_score) c FROM s)
    SELECT recipe_id, {steady_sql('(sum(sentiment_score / n) + 10 * any_value(m.c)) / (sum(1.0::DOUBLE / n) + 10)')} AS rating,
    {steady_sql('sum(1.0::DOUBLE / n)')} AS weight, count(*) n FROM s JOIN u USING (user_id), m GROUP BY recipe_id""")  # fmt: skip
def bayes_recipe_rating(spark: SparkSession, sf: str) -> DataFrame:
    """Recipes by shrunken sentiment; every user weighs one in total."""
    return A.bayes_rating(clean_interactions(spark, sf), "recipe_id", "user_id", "sentiment_score")


@R.add("user_stats", f"""WITH {CLEAN}, x AS (SELECT *, (rating - 3) / 2.0::DOUBLE - sentiment_score g FROM c)
    SELECT user_id, count(rating) review_count, {steady_sql('avg(rating)')} AS avg_rating_given, {steady_sql('coalesce(stddev_samp(rating), 0)')} AS std_rating_given,
    count(DISTINCT recipe_id) recipe_diversity, {steady_sql('coalesce(avg(sentiment_score), 0)')} AS avg_sentiment_score,
    {steady_sql('coalesce(avg(g), 0)')} AS avg_rating_gap, {steady_sql('coalesce(avg(CASE WHEN sentiment_score > 0 THEN 1.0 WHEN sentiment_score IS NOT NULL THEN 0 END), 0)')} AS pct_positive_sentiment,
    date_diff('day', min(date), max(date))::INTEGER active_days, min(date) first_review_date, max(date) last_review_date FROM x GROUP BY user_id""")  # fmt: skip
def user_stats(spark: SparkSession, sf: str) -> DataFrame:
    return A.user_stats(clean_interactions(spark, sf))


def _cat_sql(x: str) -> str:
    return " UNION ALL ".join(
        f"SELECT DISTINCT id, '{c}' category FROM (SELECT id, unnest(ingredients_canonical_list) i FROM r) WHERE {' OR '.join(f"contains(i, '{w}')" for w in ws)}" for c, ws in CATEGORIES.items()
    )


_PIVOT = f"""{CLEAN}, {RECIPES}, k AS ({_cat_sql('r')}),
    m AS (SELECT user_id, category, avg(rating) m FROM c JOIN k ON k.id = c.recipe_id GROUP BY ALL),
    p AS (SELECT user_id, {', '.join(f"max(m) FILTER (category = '{c}') {c}" for c in CATEGORIES)} FROM m GROUP BY user_id),
    a AS (SELECT {', '.join(f'avg({c}) a_{c}' for c in CATEGORIES)} FROM p)"""


@R.add(
    "user_category_pivot",
    f"WITH {_PIVOT} SELECT user_id, {', '.join(steady_sql(f'coalesce({c}, a_{c})') + f' AS avg_rating_{c}' for c in CATEGORIES)} FROM p, a"
)
def user_category_pivot(spark: SparkSession, sf: str) -> DataFrame:
    cats = A.recipe_categories(recipes(spark, sf), "id", "ingredients_canonical_list")
    return A.category_profile(clean_interactions(spark, sf), cats, "user_id", "recipe_id", list(CATEGORIES))


@R.add("ingredient_features", f"""WITH {CLEAN}, {RECIPES}, m AS (SELECT recipe_id, avg(rating) m FROM c GROUP BY 1),
    e AS (SELECT id, unnest(ingredients_canonical_list) ingredient FROM r)
    SELECT ingredient, count(DISTINCT id) recipe_count, {steady_sql('avg(m)')} AS avg_rating FROM e LEFT JOIN m ON m.recipe_id = e.id GROUP BY ingredient""")  # fmt: skip
def ingredient_features(spark: SparkSession, sf: str) -> DataFrame:
    return A.ingredient_features(clean_interactions(spark, sf), recipes(spark, sf), "id", "ingredients_canonical_list")


_PROFILE = ("calories_pdv", "protein_pdv", "total_fat_pdv")


@R.add("ingredient_nutrition", f"""WITH {RECIPES}, e AS (SELECT unnest(ingredients_canonical_list) ingredient, {', '.join(f'CASE WHEN isnan({c}) THEN NULL ELSE {c} END {c}' for c in _PROFILE)} FROM r)
    SELECT ingredient, count(*) n_listed, {', '.join(f'{steady_sql(f"avg({c})")} AS avg_{c}' for c in _PROFILE)} FROM e GROUP BY ingredient""")  # fmt: skip
def ingredient_nutrition(spark: SparkSession, sf: str) -> DataFrame:
    e = recipes(spark, sf).select(
        F.explode("ingredients_canonical_list").alias("ingredient"), *[finite(F.col(c)).alias(c) for c in _PROFILE]
    )
    return e.groupBy("ingredient").agg(
        F.count(F.lit(1)).alias("n_listed"), *[steady_round(F.avg(c)).alias(f"avg_{c}") for c in _PROFILE]
    )


@R.add("nutrient_enrichment", f"""WITH {RECIPES}, e AS (SELECT id, unnest(ingredients_canonical_list) ingredient FROM r),
    n AS (SELECT candidate_ingredient ingredient, avg(protein_delta) protein, avg(CASE WHEN isnan(sodium_delta) THEN NULL ELSE sodium_delta END) sodium
          FROM serving_substitution_recommendations WHERE NOT coalesce(isnan(protein_delta), false) GROUP BY 1),
    a AS (SELECT id, {steady_sql('avg(protein)')} AS protein, {steady_sql('avg(sodium)')} AS sodium, count(protein) matched FROM e LEFT JOIN n USING (ingredient) GROUP BY id)
    SELECT r.id, protein, sodium, coalesce(matched, 0) matched, {steady_sql('coalesce(matched / nullif(r.ingredient_count, 0), 0)')} AS coverage FROM r LEFT JOIN a USING (id)""")  # fmt: skip
def nutrient_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    """Mean nutrient values over a recipe's ingredients, and the share of ingredients that have any."""
    s = table(spark, sf, "serving_substitution_recommendations")
    n = s.filter(~F.coalesce(F.isnan("protein_delta"), F.lit(False))).groupBy(F.col("candidate_ingredient").alias("ingredient")).agg(
        F.avg("protein_delta").alias("protein"), F.avg(finite(F.col("sodium_delta"))).alias("sodium")
    )
    r = recipes(spark, sf).select("id", "ingredients_canonical_list", "ingredient_count")
    e = split_join(
        r.select("id", F.explode("ingredients_canonical_list").alias("ingredient")), n, ["ingredient"], "left"
    )
    a = e.groupBy("id").agg(
        steady_round(F.avg("protein")).alias("protein"), steady_round(F.avg("sodium")).alias("sodium"),
        F.count("protein").alias("matched")
    )
    share = F.coalesce(F.col("matched") / F.nullif("ingredient_count", F.lit(0)), F.lit(0.0))
    return r.join(a, "id", "left").select(
        "id", "protein", "sodium", F.coalesce("matched", F.lit(0)).alias("matched"),
        steady_round(share).alias("coverage")
    )


@R.add(
    "rating_gap",
    f"SELECT interaction_id, loaded_at, (rating - 3) / 2.0::DOUBLE rating_normalized, {steady_sql('(rating - 3) / 2.0::DOUBLE - sentiment_score')} AS gap FROM fact_interactions"
)
def rating_gap(spark: SparkSession, sf: str) -> DataFrame:
    norm = (F.col("rating") - 3) / 2.0
    return table(spark, sf, "fact_interactions").select(
        "interaction_id", "loaded_at", norm.alias("rating_normalized"),
        steady_round(norm - F.col("sentiment_score")).alias("gap")
    )


@R.add("blended_rating", f"""WITH b AS (SELECT interaction_id, loaded_at, rating, sentiment_score s, CASE WHEN sentiment_score IS NULL THEN NULL WHEN sentiment_score >= 0.6 THEN 5
       WHEN sentiment_score >= 0.2 THEN 4 WHEN sentiment_score >= -0.2 THEN 3 WHEN sentiment_score >= -0.6 THEN 2 ELSE 1 END band FROM fact_interactions)
    SELECT interaction_id, loaded_at, {steady_sql('''CASE WHEN band IS NULL THEN rating WHEN rating IS NULL THEN band WHEN abs(rating - band) >= 3 THEN 0.3 * rating + 0.7 * band ELSE 0.6 * rating + 0.4 * band END''')} AS blended FROM b""")  # fmt: skip
def blended_rating(spark: SparkSession, sf: str) -> DataFrame:
    """Rating and sentiment band in one; where they disagree by three bands, the text weighs more."""
    s, r = F.col("sentiment_score"), F.col("rating")
    band = F.when(s >= 0.6, 5).when(s >= 0.2, 4).when(s >= -0.2, 3).when(s >= -0.6, 2).when(s.isNotNull(), 1)
    mixed = F.when(band.isNull(), r.cast("double")).when(r.isNull(), band.cast("double")).when(
        F.abs(r - band) >= 3, 0.3 * r + 0.7 * band
    ).otherwise(0.6 * r + 0.4 * band)
    return table(spark, sf, "fact_interactions").select(
        "interaction_id", "loaded_at", steady_round(mixed).alias("blended")
    )


@R.add(
    "recipe_ratings",
    f"WITH {CLEAN} SELECT recipe_id, {steady_sql('avg(rating)')} AS avg_rating, count(*) review_count FROM c GROUP BY recipe_id"
)
def recipe_ratings(spark: SparkSession, sf: str) -> DataFrame:
    return clean_interactions(spark, sf).groupBy("recipe_id").agg(
        steady_round(F.avg("rating")).alias("avg_rating"), F.count(F.lit(1)).alias("review_count")
    )


@R.add("peak_month", f"""WITH {INTERACTIONS}, m AS (SELECT event_type, month(date)::INTEGER AS month, count(*) n FROM i WHERE event_type IS NOT NULL AND date IS NOT NULL GROUP BY ALL)
    SELECT event_type, month, n FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, month) k FROM m) WHERE k = 1""")  # fmt: skip
def peak_month(spark: SparkSession, sf: str) -> DataFrame:
    rows = interactions(spark, sf).filter("event_type is not null").withColumn("month", F.month("date"))
    return A.mode_of(rows, "event_type", "month")


@R.add(
    "user_row_counts",
    "SELECT interaction_id, loaded_at, user_id, count(*) OVER (PARTITION BY user_id) n_of_key FROM fact_interactions WHERE user_id IS NOT NULL"
)
def user_row_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "fact_interactions").select(
        "interaction_id", "loaded_at", "user_id"
    ).filter("user_id is not null")
    return A.running_counts(rows, "user_id").select("interaction_id", "loaded_at", "user_id", "n_of_key")


@R.add("shared_recipes", f"""WITH {RECIPES}, e AS (SELECT DISTINCT id, unnest(ingredients_canonical_list) i FROM r), s AS (SELECT i, count(*) n FROM e GROUP BY i)
    SELECT i ingredient, n n_recipes FROM s""")  # fmt: skip
def shared_recipes(spark: SparkSession, sf: str) -> DataFrame:
    """The number of different recipes of every ingredient (the set itself stays distributed)."""
    e = recipes(spark, sf).select("id", F.explode("ingredients_canonical_list").alias("ingredient")).distinct()
    return e.groupBy("ingredient").agg(F.count(F.lit(1)).alias("n_recipes"))


@R.add("substitute_exposure", f"""WITH {CLEAN}, {RECIPES}, s AS (SELECT DISTINCT substitute_ingredient i FROM serving_substitution_recommendations WHERE substitute_ingredient IS NOT NULL AND updated_at >= TIMESTAMPTZ '2023-07-20 00:00:00+00'),
    x AS (SELECT DISTINCT id FROM (SELECT id, unnest(ingredients_canonical_list) i FROM r) JOIN s USING (i)),
    p AS (SELECT DISTINCT user_id, recipe_id FROM c WHERE recipe_id IN (SELECT id FROM r))
    SELECT user_id, count(*) n_recipes, {steady_sql('avg(CASE WHEN x.id IS NULL THEN 0 ELSE 1 END)')} AS exposure FROM p LEFT JOIN x ON x.id = p.recipe_id GROUP BY user_id""")  # fmt: skip
def substitute_exposure(spark: SparkSession, sf: str) -> DataFrame:
    """Share of a user's reviewed recipes with an ingredient in a substitution scored since a day."""
    since = F.col("updated_at") >= F.lit("2023-07-20 00:00:00").cast("timestamp")
    names = table(
        spark, sf, "serving_substitution_recommendations"
    ).filter(since).select(F.col("substitute_ingredient").alias("i")).filter("i is not null").distinct()
    r = recipes(spark, sf)
    has = split_join(
        r.select("id", F.explode("ingredients_canonical_list").alias("i")), names, ["i"], "left_semi"
    ).select("id").distinct().withColumn("has", F.lit(1))
    known = r.select(F.col("id").alias("recipe_id")).join(has.withColumnRenamed("id", "recipe_id"), "recipe_id", "left")
    pairs = clean_interactions(spark, sf).select("user_id", "recipe_id").distinct().join(known, "recipe_id")
    return pairs.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_recipes"), steady_round(F.avg(F.coalesce("has", F.lit(0)))).alias("exposure")
    )


@R.add("segment_profile", f"""WITH {CLEAN}, j AS (SELECT c.*, u.cluster_id, u.cluster_label FROM c JOIN dim_user u USING (user_id) WHERE cluster_id IS NOT NULL),
    t AS (SELECT count(*) n FROM dim_user WHERE cluster_id IS NOT NULL), z AS (SELECT cluster_id, count(*) n_users, {steady_sql('avg(review_count)')} AS mean_reviews,
          {steady_sql('stddev_samp(review_count)')} AS std_reviews, min(review_count) min_reviews, max(review_count) max_reviews FROM dim_user WHERE cluster_id IS NOT NULL GROUP BY 1)
    SELECT cluster_id, any_value(n_users) n_users, any_value({steady_sql('n_users / t.n')}) AS user_share, any_value(mean_reviews) mean_reviews, any_value(std_reviews) std_reviews,
      any_value(min_reviews) min_reviews, any_value(max_reviews) max_reviews, count(*) n_ratings, {steady_sql('avg((rating - 3) / 2.0::DOUBLE - sentiment_score)')} AS mean_gap,
      {', '.join(f"{steady_sql(f'avg(CASE WHEN rating = {k} THEN 1.0 ELSE 0 END)')} AS share_{k}" for k in range(1, 6))} FROM j JOIN z USING (cluster_id), t GROUP BY cluster_id""")  # fmt: skip
def segment_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Size, activity, rating distribution and gap of every user segment."""
    users = table(spark, sf, "dim_user").select(
        "user_id", "cluster_id", "review_count"
    ).filter("cluster_id is not null")
    total = users.count()
    z = users.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("n_users"), steady_round(
            F.count(F.lit(1)) / F.lit(max(total, 1))
        ).alias("user_share"), steady_round(F.avg("review_count")).alias("mean_reviews"),
        steady_round(F.stddev("review_count")).alias("std_reviews"), F.min("review_count").alias("min_reviews"), F.max("review_count").alias("max_reviews"),
    )
    rows = split_join(
        clean_interactions(spark, sf).select("user_id", "rating", "sentiment_score"),
        users.select("user_id", "cluster_id"), ["user_id"]
    )
    gap = (F.col("rating") - 3) / 2.0 - F.col("sentiment_score")
    j = rows.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("n_ratings"), steady_round(F.avg(gap)).alias("mean_gap"),
        *[
            steady_round(
                F.avg(F.when(F.col("rating") == k, 1.0).otherwise(0.0))
            ).alias(f"share_{k}") for k in range(1, 6)
        ],
    )
    return z.join(j, "cluster_id")


@R.add("segment_top_ingredients", f"""WITH {CLEAN}, {RECIPES}, p AS (SELECT DISTINCT cluster_id, recipe_id FROM c JOIN dim_user USING (user_id) WHERE cluster_id IS NOT NULL),
    n AS (SELECT cluster_id, i ingredient, count(*) n FROM p JOIN (SELECT id, unnest(ingredients_canonical_list) i FROM r) e ON e.id = p.recipe_id GROUP BY ALL)
    SELECT cluster_id, ingredient, n, k::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, ingredient) k FROM n) WHERE k <= 5""")  # fmt: skip
def segment_top_ingredients(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    # both joins are shuffled: Spark takes lists and narrow rows for a small part of what they are and would broadcast them
    users = table(spark, sf, "dim_user").select("user_id", "cluster_id").filter("cluster_id is not null").hint("merge")
    seen = clean_interactions(spark, sf).select("user_id", "recipe_id").distinct().join(users, "user_id").select(
        "cluster_id", F.col("recipe_id").alias("id")
    ).distinct()
    lists = recipes(spark, sf).select("id", "ingredients_canonical_list").hint("merge")
    e = seen.join(lists, "id").select("cluster_id", F.explode("ingredients_canonical_list").alias("ingredient"))
    n = e.groupBy("cluster_id", "ingredient").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("cluster_id").orderBy(F.col("n").desc(), "ingredient")
    return n.withColumn("place", F.row_number().over(w)).filter("place <= 5")


# --------------------------------------------------------------------------------------------------------- warehouse


@R.add("dim_date", f"""SELECT dense_rank() OVER (ORDER BY d)::INTEGER date_id, d full_date, year(d)::INTEGER AS year, month(d)::INTEGER AS month, dayname(d) day_of_week, quarter(d)::INTEGER AS quarter
    FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) d FROM orders)""")  # fmt: skip
def dim_date(spark: SparkSession, sf: str) -> DataFrame:
    return W.date_dimension(table(spark, sf, "orders"), "o_orderdate")


@R.add("dim_recipe", f"""WITH {CLEAN}, {RECIPES}, a AS (SELECT recipe_id, avg(rating) m, count(*) n FROM c GROUP BY 1),
    s AS (SELECT recipe_id, avg(sentiment_score) s FROM c GROUP BY 1)
    SELECT r.id recipe_id, r.name, {steady_sql('m')} AS avg_rating, coalesce(n, 0) review_count, {steady_sql('s')} AS sentiment_rating, r.minutes::DOUBLE avg_cook_minutes,
      array_to_string(list_slice(r.ingredients_canonical_list, 1, 10), '|') top_ingredients, len(r.ingredients_canonical_list)::INTEGER ingredient_count
    FROM r LEFT JOIN a ON a.recipe_id = r.id LEFT JOIN s ON s.recipe_id = r.id""")  # fmt: skip
def dim_recipe(spark: SparkSession, sf: str) -> DataFrame:
    """Recipes with ratings and sentiment: both come from one aggregation before the join."""
    a = clean_interactions(spark, sf).groupBy(F.col("recipe_id").alias("id")).agg(
        F.avg("rating").alias("m"), F.count(F.lit(1)).alias("n"), F.avg("sentiment_score").alias("s")
    )
    items = F.col("ingredients_canonical_list")
    return recipes(spark, sf).join(a, "id", "left").select(
        F.col("id").alias("recipe_id"), "name", steady_round(F.col("m")).alias("avg_rating"), F.coalesce("n", F.lit(0)).alias("review_count"),
        steady_round(F.col("s")).alias("sentiment_rating"), F.col("minutes").cast("double").alias("avg_cook_minutes"),
        F.array_join(F.slice(items, 1, 10), "|").alias("top_ingredients"), F.when(
            items.isNotNull(), F.size(items)
        ).alias("ingredient_count"),
    )


@R.add("dim_user", f"""WITH {CLEAN}, s AS (SELECT user_id, count(*) review_count, {steady_sql('avg(rating)')} AS avg_rating_given FROM c GROUP BY 1)
    SELECT s.user_id, s.review_count, s.avg_rating_given, u.cluster_id, u.cluster_label FROM s LEFT JOIN dim_user u USING (user_id)""")  # fmt: skip
def dim_user(spark: SparkSession, sf: str) -> DataFrame:
    s = clean_interactions(spark, sf).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("review_count"), steady_round(F.avg("rating")).alias("avg_rating_given")
    )
    return s.join(table(spark, sf, "dim_user").select("user_id", "cluster_id", "cluster_label"), "user_id", "left")


@R.add("fact_interactions", f"""WITH {CLEAN} SELECT ('0x' || substr(sha256(user_id || '_' || recipe_id || '_' || strftime(c.date, '%Y-%m-%d')), 1, 15))::BIGINT interaction_id, user_id, recipe_id, date_id, rating,
    sentiment_score, (rating - 3) / 2.0::DOUBLE rating_normalized, {steady_sql('(rating - 3) / 2.0::DOUBLE - sentiment_score')} AS rating_sentiment_gap, 'batch' AS source FROM c""")  # fmt: skip
def fact_interactions(spark: SparkSession, sf: str) -> DataFrame:
    rows = clean_interactions(spark, sf).select("user_id", "recipe_id", "date", "rating", "sentiment_score")
    return W.fact_interactions(rows, table(spark, sf, "dim_date")).withColumn(
        "rating_sentiment_gap", steady_round(F.col("rating_sentiment_gap"))
    )


_SIDES = """o AS (SELECT user_id, review_count, first_review_date, cluster_label FROM dim_user WHERE user_id % 3 <> 0),
    n AS (SELECT user_id, review_count + 1 review_count, first_review_date + 1 first_review_date, upper(cluster_label) cluster_label FROM dim_user WHERE user_id % 3 <> 1)"""


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    u = table(spark, sf, "dim_user").select("user_id", "review_count", "first_review_date", "cluster_label")
    new = u.filter("user_id % 3 <> 1").select(
        "user_id", (F.col("review_count") + 1).alias("review_count"),
        F.date_add("first_review_date", 1).alias("first_review_date"), F.upper("cluster_label").alias("cluster_label")
    )
    return u.filter("user_id % 3 <> 0"), new


@R.add("merge_upsert", f"""WITH {_SIDES} SELECT coalesce(n.user_id, o.user_id) user_id, CASE WHEN n.user_id IS NOT NULL THEN n.review_count ELSE o.review_count END review_count,
    CASE WHEN o.user_id IS NOT NULL THEN o.first_review_date ELSE n.first_review_date END first_review_date,
    CASE WHEN n.user_id IS NOT NULL THEN n.cluster_label ELSE o.cluster_label END cluster_label FROM o FULL OUTER JOIN n USING (user_id)""")  # fmt: skip
def merge_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """A batch of users that overlaps the stored ones: listed columns are updated, the others kept."""
    old, new = _sides(spark, sf)
    return W.upsert(old, new, ["user_id"], ["review_count", "cluster_label"])


@R.add(
    "insert_ignore",
    f"WITH {_SIDES} SELECT * FROM o UNION ALL SELECT * FROM n WHERE user_id NOT IN (SELECT user_id FROM o)"
)
def insert_ignore(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _sides(spark, sf)
    return W.insert_ignore(old, new, ["user_id"])


@R.add("serving_view", """WITH f AS (SELECT DISTINCT interaction_id, user_id, recipe_id, rating, source FROM fact_interactions)
    SELECT * FROM f WHERE source = 'batch' UNION ALL SELECT * FROM f WHERE source = 'stream' AND interaction_id NOT IN (SELECT interaction_id FROM f WHERE source = 'batch')""")  # fmt: skip
def serving_view(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "fact_interactions").select(
        "interaction_id", "user_id", "recipe_id", "rating", "source"
    ).distinct()
    return W.serving_view(f.filter("source = 'batch'"), f.filter("source = 'stream'"), "interaction_id")


@R.add(
    "conform_schema",
    "SELECT recipe_id::BIGINT recipe_id, name, ingredient_count::DOUBLE ingredient_count, CAST(NULL AS VARCHAR) note FROM dim_recipe"
)
def conform_schema(spark: SparkSession, sf: str) -> DataFrame:
    schema = T.StructType(
        [
            T.StructField("recipe_id", T.LongType()), T.StructField("name", T.StringType()),
            T.StructField("ingredient_count", T.DoubleType()), T.StructField("note", T.StringType())
        ]
    )
    return W.conform(table(spark, sf, "dim_recipe"), schema)


@R.add(
    "row_counts",
    " UNION ALL ".join(
        f"SELECT '{t}' table_name, count(*) n FROM {t}" for t in (
            "dim_date", "dim_recipe", "dim_user", "fact_interactions"
        )
    )
)
def row_counts(spark: SparkSession, sf: str) -> DataFrame:
    names = ("dim_date", "dim_recipe", "dim_user", "fact_interactions")
    parts = [
        table(spark, sf, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table_name"), "n") for t in names
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ----------------------------------------------------------------------------------------------------------- serving


@R.add("recipe_search", """SELECT recipe_id, name, coalesce(sentiment_rating, avg_rating) display_rating FROM dim_recipe
    WHERE (regexp_matches(name, '(?i)onion') OR regexp_matches(top_ingredients, '(?i)onion')) AND coalesce(avg_cook_minutes, 0) <= 60
      AND coalesce(coalesce(sentiment_rating, avg_rating), 0) >= 3.5 AND (contains(lower(tags), 'vegetarian') OR contains(lower(tags), 'spicy'))""")  # fmt: skip
def recipe_search(spark: SparkSession, sf: str) -> DataFrame:
    """Text in name or ingredients, time, rating and any of several tags."""
    t = table(spark, sf, "dim_recipe").withColumn("display_rating", F.coalesce("sentiment_rating", "avg_rating"))
    return filter_recipes(t, "onion", 60, 3.5, ("vegetarian", "spicy")).select("recipe_id", "name", "display_rating")


@R.add(
    "recipe_page",
    "SELECT recipe_id, name, sentiment_rating FROM dim_recipe ORDER BY sentiment_rating DESC NULLS LAST, recipe_id LIMIT 10 OFFSET 20"
)
def recipe_page(spark: SparkSession, sf: str) -> DataFrame:
    """The third page of ten (a page is the feature)."""
    return table(spark, sf, "dim_recipe").orderBy(
        F.col("sentiment_rating").desc_nulls_last(), "recipe_id"
    ).offset(20).limit(10).select("recipe_id", "name", "sentiment_rating")


@R.add(
    "recipe_ranks",
    "SELECT recipe_id, CASE WHEN sentiment_rating IS NOT NULL THEN row_number() OVER (ORDER BY sentiment_rating DESC NULLS LAST, recipe_id) END AS place FROM dim_recipe"
)
def recipe_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """The display number of every recipe, without bringing all rows to one task."""
    t = table(spark, sf, "dim_recipe").select("recipe_id", "sentiment_rating")
    return total_rank(
        t, F.col("sentiment_rating").isNotNull(), [("sentiment_rating", False), ("recipe_id", True)], "place"
    ).select("recipe_id", "place")


@R.add("substitution_view", """SELECT candidate_ingredient, substitute_ingredient, max(recommendation_score) best, count(*) n FROM serving_substitution_recommendations
    WHERE NOT coalesce(isnan(recommendation_score), false) GROUP BY ALL""")  # fmt: skip
def substitution_view(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "serving_substitution_recommendations").filter(
        ~F.coalesce(F.isnan("recommendation_score"), F.lit(False))
    )
    return t.groupBy("candidate_ingredient", "substitute_ingredient").agg(
        F.max("recommendation_score").alias("best"), F.count(F.lit(1)).alias("n")
    )


@R.add("swappable_recipes", f"""WITH {RECIPES}, s AS (SELECT DISTINCT substitute_ingredient i FROM serving_substitution_recommendations)
    SELECT id, count(DISTINCT i) n_swappable FROM (SELECT id, unnest(ingredients_canonical_list) i FROM r) JOIN s USING (i) GROUP BY id""")  # fmt: skip
def swappable_recipes(spark: SparkSession, sf: str) -> DataFrame:
    """Recipes with an ingredient that takes part in a substitution, and how many."""
    names = table(
        spark, sf, "serving_substitution_recommendations"
    ).select(F.col("substitute_ingredient").alias("i")).distinct()
    e = recipes(spark, sf).select("id", F.explode("ingredients_canonical_list").alias("i")).distinct()
    return split_join(e, names, ["i"], "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("n_swappable"))


_DELTAS = (
    "rating_delta", "sentiment_delta", "protein_delta", "saturated_fat_delta", "sugar_delta", "sodium_delta",
    "calories_delta", "health_delta"
)
_LAST = """last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY candidate_ingredient, substitute_ingredient ORDER BY updated_at DESC,
    coalesce(CASE WHEN isnan(recommendation_score) THEN NULL ELSE recommendation_score END, -1e9) DESC) rn FROM serving_substitution_recommendations) WHERE rn = 1)"""


@R.add("swap_totals", f"""WITH {_LAST}, b AS (SELECT *, row_number() OVER (PARTITION BY substitute_ingredient ORDER BY recommendation_score DESC, candidate_ingredient) k FROM last
      WHERE recommendation_score IS NOT NULL AND NOT isnan(recommendation_score)), {RECIPES},
    e AS (SELECT DISTINCT id, unnest(ingredients_canonical_list) i FROM r)
    SELECT id, count(*) n_swaps, {', '.join(f"{steady_sql(f'coalesce(sum(CASE WHEN isnan({d}) THEN NULL ELSE {d} END), 0)')} AS {d}" for d in _DELTAS)}
    FROM e JOIN b ON k = 1 AND b.substitute_ingredient = e.i GROUP BY id""")  # fmt: skip
def swap_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Summed deltas of the best pair of every ingredient of a recipe that is a substitute of another."""
    t = table(spark, sf, "serving_substitution_recommendations").withColumn("s", finite(F.col("recommendation_score")))
    last = keep_first(
        t, ["candidate_ingredient", "substitute_ingredient"],
        [F.col("updated_at").desc(), F.coalesce("s", F.lit(-1e9)).desc()]
    ).filter("s is not null")
    best = keep_first(last, ["substitute_ingredient"], [F.col("s").desc(), "candidate_ingredient"])
    e = recipes(spark, sf).select(
        "id", F.explode("ingredients_canonical_list").alias("substitute_ingredient")
    ).distinct()
    j = split_join(e, best.select("substitute_ingredient", *_DELTAS), ["substitute_ingredient"])
    return j.groupBy("id").agg(
        F.count(F.lit(1)).alias("n_swaps"),
        *[steady_round(F.coalesce(F.sum(finite(F.col(d))), F.lit(0.0))).alias(d) for d in _DELTAS]
    )


@R.add("coverage", """SELECT count(*) n, round_even(avg(CASE WHEN sentiment_score IS NOT NULL THEN 1.0 ELSE 0 END) * 1e4, 0) / 1e4 AS sentiment, round_even(avg(CASE WHEN rating IS NOT NULL THEN 1.0 ELSE 0 END) * 1e4, 0) / 1e4 AS rating,
    count(DISTINCT user_id) n_users, count_if(source = 'stream') n_stream FROM fact_interactions""")  # fmt: skip
def coverage(spark: SparkSession, sf: str) -> DataFrame:
    share = lambda c: F.rint(F.avg(F.col(c).isNotNull().cast("double")) * 1e4) / 1e4
    return table(spark, sf, "fact_interactions").agg(
        F.count(F.lit(1)).alias("n"), share("sentiment_score").alias("sentiment"), share("rating").alias("rating"), F.count_distinct("user_id").alias("n_users"), F.count_if(F.col("source") == "stream").alias("n_stream")
    )


@R.add(
    "row_loss",
    f"""WITH {CLEAN} SELECT (SELECT count(*) FROM fact_interactions) n_raw, (SELECT count(*) FROM once) n_unique, (SELECT count(*) FROM c) n_clean"""
)
def row_loss(spark: SparkSession, sf: str) -> DataFrame:
    """Rows left after each stage of cleaning, in one pass over the unique rows."""
    rows = interactions(spark, sf)
    raw = table(spark, sf, "fact_interactions").count()
    unique = keep_first(
        rows.dropna(subset=["user_id", "recipe_id", "date"]), ["user_id", "recipe_id", "date"],
        ["interaction_id", "loaded_at"]
    )
    return unique.agg(
        F.lit(raw).cast("bigint").alias("n_raw"), F.count(F.lit(1)).alias("n_unique"),
        F.count_if(F.col("rating").between(1, 5)).alias("n_clean")
    )


@R.add(
    "freshness",
    "SELECT source, max(fetched_date) fetched_date, date_diff('day', max(fetched_date), DATE '2024-06-30')::INTEGER age_days, date_diff('day', max(fetched_date), DATE '2024-06-30') > 7 AS is_stale FROM documents GROUP BY source"
)
def freshness(spark: SparkSession, sf: str) -> DataFrame:
    age = F.date_diff(F.lit("2024-06-30").cast("date"), F.max("fetched_date"))
    return table(spark, sf, "documents").groupBy("source").agg(
        F.max("fetched_date").alias("fetched_date"), age.alias("age_days"), (age > 7).alias("is_stale")
    )


@R.add("count_by_source", "SELECT source, doc_kind, count(*) n FROM documents GROUP BY ALL")
def count_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("source", "doc_kind").agg(F.count(F.lit(1)).alias("n"))


@R.add(
    "missing_recipes",
    "SELECT DISTINCT recipe_id FROM fact_interactions WHERE recipe_id IS NOT NULL EXCEPT SELECT recipe_id FROM dim_recipe"
)
def missing_recipes(spark: SparkSession, sf: str) -> DataFrame:
    """Set difference of ids."""
    ids = table(spark, sf, "fact_interactions").select("recipe_id").filter("recipe_id is not null").distinct()
    return ids.join(table(spark, sf, "dim_recipe").select("recipe_id"), "recipe_id", "left_anti")


@R.add(
    "recipe_medians",
    "SELECT median(protein) protein, median(fat) fat, median(carbs) carbs, median(sugar) sugar, median(sodium) sodium FROM dim_recipe"
)
def recipe_medians(spark: SparkSession, sf: str) -> DataFrame:
    """The median of each nutrient, for the overlay of a recipe's profile."""
    names = ["protein", "fat", "carbs", "sugar", "sodium"]
    m = exact_quantiles(table(spark, sf, "dim_recipe"), names, [0.5])
    return spark.createDataFrame([tuple(m[c, 0.5] for c in names)], ", ".join(f"{c} double" for c in names))


@R.add(
    "suspect_days",
    f"WITH {INTERACTIONS} SELECT user_id, date, count(*) n FROM i WHERE user_id IN (SELECT user_id FROM (SELECT user_id, date FROM i GROUP BY ALL HAVING count(*) > 5)) AND date IS NOT NULL GROUP BY ALL"
)
def suspect_days(spark: SparkSession, sf: str) -> DataFrame:
    rows = interactions(spark, sf)
    users = busy_users(rows, "user_id", F.col("date"), 5)
    return rows.filter("date is not null").groupBy("user_id", "date").agg(F.count(F.lit(1)).alias("n")).join(
        users, "user_id", "left_semi"
    )


R.plain("user_stats", dates=("first_review_date", "last_review_date"))
for _name in ("rating_gap", "blended_rating", "user_row_counts"):
    R.plain(_name, micros=("loaded_at",))
R.plain("dim_date", dates=("full_date",))
for _name in ("merge_upsert", "insert_ignore"):
    R.plain(_name, dates=("first_review_date",))
R.plain("freshness", dates=("fetched_date",))
R.plain("suspect_days", dates=("date",))
