"""Queries of the remaining serving reads: details, facets, what-if, segments, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.numeric import steady_round, steady_sql
from larder.functions.vocabulary import PSEUDO_COUNT
from larder.operators import matching as M
from larder.operators import vectors as N
from larder.operators.quality import clip, keep_first
from larder.operators.skew import split_join
from larder.plans.cleaning import CLEAN, RECIPES, clean_interactions, recipes
from larder.plans.registry import Registry, table

R = Registry()


@R.add("recipe_detail", """SELECT d.recipe_id, d.name, x.doc_id, regexp_extract_all(x.text, '[^\\n]+') steps FROM dim_recipe d JOIN documents x USING (recipe_id)
    WHERE x.doc_kind = 'steps' AND d.recipe_id = (SELECT min(recipe_id) FROM documents JOIN dim_recipe USING (recipe_id) WHERE doc_kind = 'steps')""")  # fmt: skip
def recipe_detail(spark: SparkSession, sf: str) -> DataFrame:
    """The steps of one recipe: a point look-up that reaches the scan of the recipes."""
    docs = table(spark, sf, "documents").filter(
        "doc_kind = 'steps' and recipe_id is not null"
    ).select("recipe_id", "doc_id", "text")
    names = table(spark, sf, "dim_recipe").select("recipe_id", "name")
    one = docs.join(names, "recipe_id", "left_semi").agg(F.min("recipe_id")).first()[0]
    hit = names.filter(F.col("recipe_id") == F.lit(one)).join(
        docs.filter(F.col("recipe_id") == F.lit(one)), "recipe_id"
    )
    return hit.select(
        "recipe_id", "name", "doc_id", F.regexp_extract_all("text", F.lit("[^\\n]+"), F.lit(0)).alias("steps")
    )


@R.add(
    "tag_facets",
    "SELECT tag, count(*) n FROM (SELECT DISTINCT recipe_id, trim(x) tag FROM (SELECT recipe_id, unnest(string_split_regex(tags, '[|,;\\n\\t]')) x FROM dim_recipe)) WHERE tag <> '' GROUP BY tag"
)
def tag_facets(spark: SparkSession, sf: str) -> DataFrame:
    """Raw tag strings with their number of recipes."""
    t = table(spark, sf, "dim_recipe").select(
        "recipe_id", F.explode(F.split("tags", "[|,;\\n\\t]")).alias("x")
    ).select("recipe_id", F.trim("x").alias("tag"))
    return t.filter("tag <> ''").distinct().groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@R.add(
    "query_set",
    """SELECT list_sort(list_distinct(list_transform(string_split(lower(source), '_'), lambda x: trim(x)))) terms, count(*) n FROM documents WHERE source IS NOT NULL GROUP BY 1"""
)
def query_set(spark: SparkSession, sf: str) -> DataFrame:
    """A set of search words from a delimited list: split, trimmed, lower case, distinct."""
    terms = F.array_sort(F.array_distinct(F.transform(F.split(F.lower("source"), "_"), F.trim)))
    return table(spark, sf, "documents").filter("source is not null").groupBy(terms.alias("terms")).agg(F.count(F.lit(1)).alias("n"))


@R.add(
    "decision_table",
    """SELECT recipe_id, CASE WHEN length(name) > 15 THEN substr(name, 1, 15) || '...' ELSE name END label, repeat('#', least(greatest(coalesce(avg_rating, 0)::INTEGER, 0), 10)) bar FROM dim_recipe"""
)
def decision_table(spark: SparkSession, sf: str) -> DataFrame:
    """Shortened names and text bars."""
    bar = F.expr("repeat('#', least(greatest(cast(rint(coalesce(avg_rating, 0)) as int), 0), 10))")
    label = F.when(F.length("name") > 15, F.concat(F.substring("name", 1, 15), F.lit("..."))).otherwise(F.col("name"))
    return table(spark, sf, "dim_recipe").select("recipe_id", label.alias("label"), bar.alias("bar"))


@R.add(
    "segment_kpis",
    "SELECT count(*) n_users, count(DISTINCT cluster_label) n_segments, count(*) FILTER (cluster_label IN ('Sunday Braiser', 'Quick Skillet Cook')) n_selected FROM dim_user WHERE cluster_id IS NOT NULL"
)
def segment_kpis(spark: SparkSession, sf: str) -> DataFrame:
    u = table(spark, sf, "dim_user").filter("cluster_id is not null")
    return u.agg(
        F.count(F.lit(1)).alias("n_users"), F.count_distinct("cluster_label").alias("n_segments"),
        F.count_if(F.col("cluster_label").isin("Sunday Braiser", "Quick Skillet Cook")).alias("n_selected")
    )


_STAR = "CASE WHEN s BETWEEN -1 AND 1 THEN greatest(least(2 * s + 3, 5), 1) ELSE greatest(least(s, 5), 0) END"


@R.add(
    "star_rating",
    f"SELECT recipe_id, {steady_sql(_STAR)} AS stars FROM (SELECT recipe_id, coalesce(sentiment_rating, avg_rating) s FROM dim_recipe)"
)
def star_rating(spark: SparkSession, sf: str) -> DataFrame:
    """Sentiment of -1..1 as stars of 1..5; other scales are cut to 0..5."""
    s = F.coalesce("sentiment_rating", "avg_rating")
    stars = F.when(s.between(-1, 1), clip(2 * s + 3, 1.0, 5.0)).otherwise(clip(s, 0.0, 5.0))
    return table(spark, sf, "dim_recipe").select("recipe_id", steady_round(stars).alias("stars"))


_BEST = """last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY candidate_ingredient, substitute_ingredient ORDER BY updated_at DESC,
      coalesce(CASE WHEN isnan(recommendation_score) THEN NULL ELSE recommendation_score END, -1e9) DESC) rn FROM serving_substitution_recommendations) WHERE rn = 1),
    best AS (SELECT * FROM (SELECT substitute_ingredient i, sentiment_delta d, row_number() OVER (PARTITION BY substitute_ingredient ORDER BY recommendation_score DESC, candidate_ingredient) k FROM last
      WHERE recommendation_score IS NOT NULL AND NOT isnan(recommendation_score)) WHERE k = 1)"""


@R.add("swap_what_if", f"""WITH {_BEST}, {RECIPES}, g AS (SELECT avg(sentiment_score) c FROM fact_interactions),
    b AS (SELECT recipe_id, (avg_rating - 3) / 2 base, coalesce(weighted_review_count, 0) w FROM dim_recipe WHERE avg_rating IS NOT NULL),
    e AS (SELECT DISTINCT id, unnest(ingredients_canonical_list) i FROM r),
    s AS (SELECT recipe_id, count(*) n, sum(greatest(least(base + d, 1), -1)) s FROM b JOIN e ON e.id = recipe_id JOIN best USING (i) WHERE d IS NOT NULL AND NOT isnan(d) GROUP BY 1)
    SELECT recipe_id, n n_swaps, {steady_sql('base')} AS before, {steady_sql('(base * (w + 10) - 10 * c + s + 10 * c) / (w + n + 10)')} AS after FROM s JOIN b USING (recipe_id), g""")  # fmt: skip
def swap_what_if(spark: SparkSession, sf: str) -> DataFrame:
    """The shrunken sentiment of a recipe if the swaps of its ingredients counted as reviews of their own."""
    t = table(
        spark, sf, "serving_substitution_recommendations"
    ).withColumn("s", F.nanvl("recommendation_score", F.lit(None)))
    last = keep_first(
        t, ["candidate_ingredient", "substitute_ingredient"],
        [F.col("updated_at").desc(), F.coalesce("s", F.lit(-1e9)).desc()]
    ).filter("s is not null")
    best = keep_first(last, ["substitute_ingredient"], [F.col("s").desc(), "candidate_ingredient"])
    best = best.select(
        F.col("substitute_ingredient").alias("i"), F.nanvl("sentiment_delta", F.lit(None)).alias("d")
    ).filter("d is not null")
    c = table(spark, sf, "fact_interactions").agg(F.avg("sentiment_score")).first()[0]
    b = table(spark, sf, "dim_recipe").filter("avg_rating is not null").select(
        F.col("recipe_id").alias("id"), ((F.col("avg_rating") - 3) / 2).alias("base"), F.coalesce(
            "weighted_review_count", F.lit(0.0)
        ).alias("w")
    )
    e = recipes(spark, sf).select("id", F.explode("ingredients_canonical_list").alias("i")).distinct()
    d = split_join(e, best, ["i"]).join(b, "id")
    s = d.groupBy("id", "base", "w").agg(
        F.count(F.lit(1)).alias("n_swaps"), F.sum(clip(F.col("base") + F.col("d"), -1.0, 1.0)).alias("s")
    )
    m, g = PSEUDO_COUNT, F.lit(c)
    after = (F.col("base") * (F.col("w") + m) - m * g + F.col("s") + m * g) / (F.col("w") + F.col("n_swaps") + m)
    return s.select(
        F.col("id").alias("recipe_id"), "n_swaps", steady_round(F.col("base")).alias("before"),
        steady_round(after).alias("after")
    )


_BAKING = ("bake", "baking", "cookie", "cake", "dessert", "bread", "pastry")


@R.add("baking_context", f"""WITH {RECIPES}, k AS (SELECT recipe_id, regexp_matches(tags, '{'|'.join(_BAKING)}') bakes FROM dim_recipe),
    e AS (SELECT id, unnest(ingredients_canonical_list) ingredient FROM r)
    SELECT ingredient, {steady_sql('avg(CASE WHEN bakes THEN 1.0 ELSE 0 END)')} AS rate, avg(CASE WHEN bakes THEN 1.0 ELSE 0 END) >= 0.5 AS is_baking FROM e JOIN k ON k.recipe_id = e.id GROUP BY ingredient""")  # fmt: skip
def baking_context(spark: SparkSession, sf: str) -> DataFrame:
    """How often an ingredient is listed in recipes tagged for baking."""
    k = table(spark, sf, "dim_recipe").select(
        F.col("recipe_id").alias("id"), F.coalesce(F.col("tags").rlike("|".join(_BAKING)), F.lit(False)).alias("bakes")
    )
    e = recipes(spark, sf).select("id", F.explode("ingredients_canonical_list").alias("ingredient")).join(k, "id")
    rate = F.avg(F.col("bakes").cast("double"))
    return e.groupBy("ingredient").agg(steady_round(rate).alias("rate"), (rate >= 0.5).alias("is_baking"))


@R.add(
    "global_sentiment",
    f"SELECT {steady_sql('avg(sentiment_score)')} AS mean_sentiment, count(sentiment_score) n FROM fact_interactions"
)
def global_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "fact_interactions").agg(
        steady_round(F.avg("sentiment_score")).alias("mean_sentiment"), F.count("sentiment_score").alias("n")
    )


@R.add(
    "term_counts",
    "SELECT primary_tag, count(*) n FROM recipes_clean WHERE primary_tag IS NOT NULL GROUP BY 1 ORDER BY n DESC, primary_tag LIMIT 20"
)
def term_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty most frequent tags (the top list is the feature)."""
    n = table(spark, sf, "recipes_clean").filter("primary_tag is not null").groupBy("primary_tag").agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.col("n").desc(), "primary_tag").limit(20)


@R.add("hash_sample")
def hash_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A hundred users picked by a seeded hash: the same ones on any cluster (sampling is the feature)."""
    return table(spark, sf, "dim_user").select("user_id").orderBy(
        F.xxhash64("user_id", F.lit(42)), "user_id"
    ).limit(100)


@R.add(
    "latest_runs",
    "SELECT candidate_ingredient, max(updated_at) updated_at, count(*) n FROM serving_substitution_recommendations WHERE candidate_ingredient IS NOT NULL GROUP BY 1"
)
def latest_runs(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "serving_substitution_recommendations").filter("candidate_ingredient is not null")
    return t.groupBy("candidate_ingredient").agg(F.max("updated_at").alias("updated_at"), F.count(F.lit(1)).alias("n"))


@R.add("text_templates", f"""WITH {RECIPES} SELECT id, 'How to cook ' || coalesce(name, '?') || ' in ' || minutes || ' minutes: 20 dish names' prompt, array_to_string(list_slice(ingredients_canonical_list, 1, 8), ', ') shown,
    coalesce(len(ingredients_canonical_list) - 8, 0)::INTEGER n_more FROM r WHERE minutes IS NOT NULL AND len(ingredients_canonical_list) > 8""")  # fmt: skip
def text_templates(spark: SparkSession, sf: str) -> DataFrame:
    """Prompts from a template, and the first eight ingredients with the number of the rest."""
    items = F.col("ingredients_canonical_list")
    prompt = F.concat(
        F.lit("How to cook "), F.coalesce("name", F.lit("?")), F.lit(" in "), F.col("minutes").cast("string"),
        F.lit(" minutes: 20 dish names")
    )
    r = recipes(spark, sf).filter(F.col("minutes").isNotNull() & (F.size(items) > 8))
    return r.select(
        "id", prompt.alias("prompt"), F.array_join(F.slice(items, 1, 8), ", ").alias("shown"),
        (F.size(items) - 8).alias("n_more")
    )


@R.add("nearest_one", """WITH k AS (SELECT a.vec_id query_id, b.vec_id id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) s FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
    SELECT query_id, id, round(s, 5) similarity, CASE WHEN s >= 0.8 THEN 'strong_match' WHEN s >= 0.6 THEN 'weak_match' ELSE 'gap' END match_status FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) p FROM k) WHERE p = 1""")  # fmt: skip
def nearest_one(spark: SparkSession, sf: str) -> DataFrame:
    """The best vector of every query vector (id divisible by 50) with its status."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    n = N.nearest(v.filter("id % 50 = 0"), v, 1)
    return n.select(
        "query_id", "id", F.round("similarity", 5).alias("similarity"),
        M.match_status(F.col("similarity")).alias("match_status")
    )


@R.add("vector_classes")
def vector_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector with the class it is merged into (a cosine of at least 0.7 links; all pairs are compared)."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return M.components(v.select("id"), N.linked_vectors(v, 0.7))


@R.add(
    "user_segment_ratings",
    f"""WITH {CLEAN} SELECT cluster_label, rating::INTEGER rating, count(*) n FROM c LEFT JOIN dim_user USING (user_id) GROUP BY ALL"""
)
def user_segment_ratings(spark: SparkSession, sf: str) -> DataFrame:
    """Ratings by segment; the join of a hot user's rows is split off."""
    u = table(spark, sf, "dim_user").select("user_id", "cluster_label")
    rows = split_join(clean_interactions(spark, sf).select("user_id", "rating"), u, ["user_id"], "left")
    return rows.groupBy("cluster_label", F.col("rating").cast("int").alias("rating")).agg(F.count(F.lit(1)).alias("n"))



@R.add(
    "rising_queries",
    """SELECT source k, list_sort(list(name))[1:5] names, count(*) n FROM (SELECT CASE WHEN recipe_id % 2 = 0 THEN 'rising' ELSE 'top' END source, lower(trim(name)) name FROM dim_recipe WHERE name IS NOT NULL) GROUP BY source"""
)
def rising_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Per kind, the first five names in order and the number of all; only five a kind leave a task."""
    from pyspark.sql import Window

    t = table(spark, sf, "dim_recipe").filter("name is not null")
    t = t.select(
        F.when(F.col("recipe_id") % 2 == 0, "rising").otherwise("top").alias("k"),
        F.lower(F.trim("name")).alias("name"), "recipe_id"
    )
    first = t.withColumn(
        "p", F.row_number().over(Window.partitionBy("k").orderBy("name", "recipe_id"))
    ).filter("p <= 5")
    lists = first.groupBy("k").agg(F.array_sort(F.collect_list("name")).alias("names"))
    return lists.join(t.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "k")


R.plain("recipe_detail", lists=("steps",))
R.plain("query_set", lists=("terms",))
R.plain("latest_runs", micros=("updated_at",))
R.plain("rising_queries", lists=("names",))
