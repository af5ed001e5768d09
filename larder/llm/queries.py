"""Queries of the training-data operators (problems 1, 2, 5, 8, 9 and 10) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.numeric import steady_round, steady_sql
from larder.llm.cooccurrence import cooccurrence
from larder.llm.language import document_languages, doubtful_labels, label_segments, labelled_sample, train
from larder.llm.leakage import find_leaks
from larder.llm.packing import count_tokens, pack
from larder.llm.percentiles import keyed_values, merge_summaries, radix_percentiles, summary, summary_percentiles
from larder.llm.top_items import latest_scores, top_n
from larder.plans.events_and_references import PACKED_SQL, packed_values
from larder.plans.registry import Registry, table
from larder.session import materialize

R = Registry()

# ---------------------------------------------------------------------------------------------------------------- p1

_BASKETS = f"""
{PACKED_SQL},
b AS (SELECT DISTINCT 'ingredients_canonical_list' field_name, id basket, unnest(ingredients_canonical_list) item FROM recipes_clean
      UNION ALL SELECT DISTINCT 'tags', recipe_id, item_value FROM packed WHERE field_name = 'tags'),
c AS (SELECT * FROM b WHERE item IS NOT NULL AND basket IS NOT NULL),
tot AS (SELECT field_name, count(DISTINCT basket) n_baskets FROM c GROUP BY ALL),
one AS (SELECT field_name, item, count(*) n FROM c GROUP BY ALL),
two AS (SELECT x.field_name, x.item item_a, y.item item_b, count(*) n_ab
        FROM c x JOIN c y ON x.field_name = y.field_name AND x.basket = y.basket AND x.item < y.item GROUP BY ALL),
pairs AS (SELECT two.*, a.n n_a, z.n n_b, n_baskets FROM two JOIN one a ON a.field_name = two.field_name AND a.item = item_a
          JOIN one z ON z.field_name = two.field_name AND z.item = item_b JOIN tot ON tot.field_name = two.field_name
          WHERE n_ab >= 5 AND 200 * n_ab >= n_baskets)
"""


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    lists = table(spark, sf, "recipes_clean").select(
        F.lit("ingredients_canonical_list").alias("field_name"), F.col("id").alias("basket"), F.explode("ingredients_canonical_list").alias("item")
    )
    tags = packed_values(spark, sf, ("tags",)).select(
        "field_name", F.col("recipe_id").alias("basket"), F.col("item_value").alias("item")
    )
    return cooccurrence(lists.unionByName(tags), min_pairs=5, min_share=1 / 200, chunk_items=12)


@R.add(
    "p1_found",
    f"WITH {_BASKETS} SELECT field_name, item_a, item_b FROM pairs WHERE n_ab::HUGEINT * n_baskets >= 3 * n_a::HUGEINT * n_b"
)
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of ingredients and of tags that occur together at least three times as often as chance explains."""
    d = lambda c: F.col(c).cast("decimal(18,0)")
    strong = d("n_ab") * d("n_baskets") >= d("n_a") * d("n_b") * F.lit(3)
    return _pairs(spark, sf).filter(strong).select("field_name", "item_a", "item_b")


@R.add(
    "p1_pair_scores",
    f"""WITH {_BASKETS} SELECT field_name, item_a, item_b, n_ab, n_a, n_b, n_baskets,
    {steady_sql("n_ab::DOUBLE * n_baskets / n_a / n_b")} AS lift FROM pairs""",
)
def p1_pair_scores(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs that are frequent enough, with their counts and lift."""
    return _pairs(spark, sf).select(
        "field_name", "item_a", "item_b", "n_ab", "n_a", "n_b", "n_baskets", steady_round(F.col("lift")).alias("lift")
    )


@R.add(
    "p1_recipes_of_users",
    f"""WITH c AS (SELECT DISTINCT user_id basket, recipe_id::VARCHAR item FROM fact_interactions WHERE user_id IS NOT NULL AND recipe_id IS NOT NULL),
    tot AS (SELECT count(DISTINCT basket) n_baskets FROM c), one AS (SELECT item, count(*) n FROM c GROUP BY ALL),
    k AS (SELECT c.* FROM c JOIN one USING (item), tot WHERE n >= 5 AND 1000 * n >= n_baskets),
    two AS (SELECT x.item item_a, y.item item_b, count(*) n_ab FROM k x JOIN k y ON x.basket = y.basket AND x.item < y.item GROUP BY ALL)
    SELECT item_a, item_b, n_ab, a.n n_a, z.n n_b, {steady_sql("n_ab::DOUBLE * n_baskets / a.n / z.n")} AS lift
    FROM two JOIN one a ON a.item = item_a JOIN one z ON z.item = item_b, tot WHERE n_ab >= 5 AND 1000 * n_ab >= n_baskets""",
)
def p1_recipes_of_users(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of recipes that the same users reviewed. One user's basket holds most recipes and is cut into many chunks."""
    rows = table(spark, sf, "fact_interactions").select(
        F.lit("recipe_id").alias("field_name"), F.col("user_id").alias("basket"), F.col("recipe_id").cast("string").alias("item")
    )
    out = cooccurrence(rows, min_pairs=5, min_share=1 / 1000, chunk_items=64)
    return out.select("item_a", "item_b", "n_ab", "n_a", "n_b", steady_round(F.col("lift")).alias("lift"))


# ---------------------------------------------------------------------------------------------------------------- p2

_RANKED = """
WITH last AS (SELECT candidate_ingredient, substitute_ingredient, recommendation_score AS s, row_number() OVER (
        PARTITION BY candidate_ingredient, substitute_ingredient
        ORDER BY updated_at DESC NULLS LAST, CASE WHEN isnan(recommendation_score) THEN NULL ELSE recommendation_score END DESC NULLS LAST) rn
      FROM serving_substitution_recommendations WHERE candidate_ingredient IS NOT NULL AND substitute_ingredient IS NOT NULL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY candidate_ingredient ORDER BY s DESC, substitute_ingredient) AS INTEGER) place
      FROM last WHERE rn = 1 AND s IS NOT NULL AND NOT isnan(s))
"""


def _best(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "serving_substitution_recommendations")
    rows = latest_scores(df, "candidate_ingredient", "substitute_ingredient", "recommendation_score", "updated_at")
    return top_n(materialize(rows, "scores"), 5)


@R.add("p2_found", f"{_RANKED} SELECT candidate_ingredient, substitute_ingredient FROM r WHERE place <= 5")
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """The five best substitutes of every ingredient."""
    return _best(spark, sf).select(
        F.col("grp").alias("candidate_ingredient"), F.col("item").alias("substitute_ingredient")
    )


@R.add(
    "p2_ranking",
    f"{_RANKED} SELECT candidate_ingredient, substitute_ingredient, s score, place FROM r WHERE place <= 5"
)
def p2_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """The five best substitutes with score and place."""
    return _best(spark, sf).select(
        F.col("grp").alias("candidate_ingredient"), F.col("item").alias("substitute_ingredient"), "score", F.col("rank").alias("place")
    )


# ---------------------------------------------------------------------------------------------------------------- p5

_VALUES = """
WITH once AS (SELECT id, min(primary_tag) primary_tag, min(calories_pdv) calories_pdv, min(sodium_pdv) sodium_pdv, min(sugar_pdv) sugar_pdv
              FROM recipes_clean WHERE id IS NOT NULL GROUP BY id),
l AS (SELECT primary_tag, unnest(['calories_pdv', 'sodium_pdv', 'sugar_pdv']) field_name, unnest([calories_pdv, sodium_pdv, sugar_pdv]) v FROM once),
v AS (SELECT * FROM l WHERE v IS NOT NULL AND NOT isnan(v)),
g AS (SELECT 1 scope, primary_tag, field_name, v FROM v WHERE primary_tag IS NOT NULL UNION ALL SELECT 0, NULL, field_name, v FROM v),
n AS (SELECT *, row_number() OVER (PARTITION BY scope, primary_tag, field_name ORDER BY v) k,
             count(*) OVER (PARTITION BY scope, primary_tag, field_name) n FROM g),
p AS (SELECT scope, primary_tag, field_name, pct, v AS value, n FROM n, (SELECT unnest([10, 25, 50, 75, 90, 99])::INTEGER pct) q
      WHERE k = greatest(1, (n * pct + 99) // 100))
"""
PDV = ["calories_pdv", "sodium_pdv", "sugar_pdv"]


def _percentiles(spark: SparkSession, sf: str, pcts: list[int]) -> DataFrame:
    """(field_name, primary_tag, pct, value, n); the whole has a null tag."""
    df = table(spark, sf, "recipes_clean").filter("id is not null")
    once = df.groupBy("id").agg(F.min(F.struct("primary_tag", *PDV)).alias("r")).select("r.*")
    # a tag gets a mark before it, so that the whole (no mark) differs from every tag
    scopes = F.array(F.lit(""), F.concat(F.lit("="), F.col("primary_tag")))
    rows = once.withColumn("scope", F.explode(scopes)).filter("scope is not null")
    values = materialize(keyed_values(rows, "scope", PDV), "values")
    out = radix_percentiles(values, pcts)
    return out.withColumn("primary_tag", F.when(F.col("grp") != "", F.expr("substring(grp, 2)"))).drop("grp")


@R.add(
    "p5_found",
    f"""{_VALUES} SELECT a.primary_tag, a.field_name, a.pct FROM p a JOIN p w ON w.scope = 0 AND w.field_name = a.field_name AND w.pct = a.pct
    WHERE a.scope = 1 AND a.pct IN (50, 90) AND a.value >= 1.5::DOUBLE * w.value""",
)
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Tags whose median or 90th percentile is at least 1.5 times that of all recipes."""
    p = _percentiles(spark, sf, [50, 90])
    whole = p.filter("primary_tag is null").select("field_name", "pct", F.col("value").alias("w"))
    tags = p.filter("primary_tag is not null")
    hit = tags.join(F.broadcast(whole), ["field_name", "pct"]).filter(F.col("value") >= 1.5 * F.col("w"))  # six rows
    return hit.select("primary_tag", "field_name", F.col("pct").cast("int").alias("pct"))


@R.add("p5_percentiles", f"{_VALUES} SELECT primary_tag, field_name, pct, value, n FROM p")
def p5_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Six percentiles of every tag and of the whole (null tag)."""
    return _percentiles(spark, sf, [10, 25, 50, 75, 90, 99]).select(
        "primary_tag", "field_name", F.col("pct").cast("int").alias("pct"), "value", "n"
    )


_LEAD = "power(2::DOUBLE, floor(log2(abs(value))) - 4)"


@R.add(
    "p5_daily_bounds",
    f"""{_VALUES} SELECT primary_tag, field_name, pct, {steady_sql(f"CASE WHEN value > 0 THEN floor(value / {_LEAD}) * {_LEAD} ELSE value END")} AS low,
    n, true AS holds FROM p WHERE scope = 1""",
)
def p5_daily_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles of every tag from the summaries of single days added up, and whether the exact value lies in the bounds.

    A recipe counts on the first day it was extracted; ``low`` is the lower bound, the upper one is at most 1/16 above.
    """
    df = table(spark, sf, "recipes_clean").filter("id is not null")
    once = df.groupBy("id").agg(F.min("extract_date").alias("day"), F.min(F.struct("primary_tag", *PDV)).alias("r"))
    rows = materialize(once.select("day", "r.*").filter("primary_tag is not null"), "once")
    days = rows.select(F.concat_ws("|", F.coalesce(F.col("day").cast("string"), F.lit("")), "primary_tag").alias("grp"), *PDV)
    daily = materialize(summary(keyed_values(days, "grp", PDV)), "daily")  # one summary per day and tag
    merged = merge_summaries(daily.withColumn("grp", F.expr("substring(grp, instr(grp, '|') + 1)")))
    pcts = [10, 25, 50, 75, 90, 99]
    near = summary_percentiles(merged, pcts)
    exact = radix_percentiles(materialize(keyed_values(rows, "primary_tag", PDV), "values"), pcts)
    both = exact.join(near.drop("value"), ["field_name", "grp", "pct"])
    v, low, high = F.col("value"), F.col("low"), F.col("high")
    holds = (low <= v) & (v <= high) & ((v == 0) | (high - low <= F.abs(v) / 16 + 1e-9))
    return both.select(
        F.col("grp").alias("primary_tag"), "field_name", F.col("pct").cast("int").alias("pct"),
        steady_round(low).alias("low"), "n", holds.alias("holds"),
    )


# ---------------------------------------------------------------------------------------------------------------- p8

CAPACITY = 512
_W = r"\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_WX = _W.replace(" ", "", 1)
TOKENS_SQL = rf"""
(len(regexp_extract_all(text, '''s|''t|''re|''ve|''m|''ll|''d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_W}\p{{L}}\p{{N}}]+'))
 + len(regexp_extract_all(text, '[{_W}]+$')) + len(regexp_extract_all(text, '[{_W}]{{2,}}')) - len(regexp_extract_all(text, '[{_W}]{{2,}}$'))
 + len(regexp_extract_all(text, '[{_WX}][^{_W}]')))
"""


def _packed(spark: SparkSession, sf: str) -> DataFrame:
    return pack(
        table(spark, sf, "documents").filter("doc_id is not null"), "doc_id", count_tokens(F.col("text")), CAPACITY
    )


@R.add("p8_found", f"SELECT doc_id FROM documents WHERE {TOKENS_SQL} > {CAPACITY}")
def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that had to be split: those that the plan put into more than one container."""
    per = _packed(spark, sf).filter("container_id is not null").groupBy("item").agg(
        F.min("container_id").alias("a"), F.max("container_id").alias("z")
    )
    return per.filter("a < z").select(F.col("item").alias("doc_id"))


@R.add(
    "p8_placements",
    f"""SELECT doc_id, n n_tokens, greatest(1, ceil(n / {CAPACITY}))::BIGINT n_pieces, ceil(n / {CAPACITY})::BIGINT n_containers
    FROM (SELECT doc_id, coalesce({TOKENS_SQL}, 0)::BIGINT n FROM documents)""",
)
def p8_placements(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens, pieces and containers of every document as placed."""
    return _packed(spark, sf).groupBy(F.col("item").alias("doc_id")).agg(
        F.sum("size").alias("n_tokens"), F.count(F.lit(1)).alias("n_pieces"), F.count_distinct("container_id").alias("n_containers")
    )


@R.add(
    "p8_faults",
    f"SELECT sum(coalesce({TOKENS_SQL}, 0))::BIGINT n_tokens, 0::BIGINT n_overfull, 0::BIGINT n_same_place, 0::BIGINT n_gaps FROM documents",
)
def p8_faults(spark: SparkSession, sf: str) -> DataFrame:
    """What must not be: containers over capacity, places held twice, gaps in the places of a container or in the numbers of
    containers; with all tokens placed."""
    rows = materialize(_packed(spark, sf).filter("container_id is not null").select("container_id", "place", "size"), "placed")
    per = rows.groupBy("container_id").agg(
        F.sum("size").alias("used"), F.count(F.lit(1)).alias("n"), F.max("place").alias("last"), F.min("place").alias("first")
    )
    twice = rows.groupBy("container_id", "place").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("n_same_place"))
    n = F.count(F.lit(1))
    gaps = F.count_if((F.col("first") != 1) | (F.col("last") != F.col("n"))) + F.coalesce(F.max("container_id") + 1 - n, F.lit(0))
    one = per.agg(
        F.coalesce(F.sum("used"), F.lit(0)).alias("n_tokens"), F.count_if(F.col("used") > CAPACITY).alias("n_overfull"), gaps.alias("n_gaps")
    )
    # two tables of one row each
    return one.withColumn("_k", F.lit(1)).join(twice.withColumn("_k", F.lit(1)), "_k").select(
        "n_tokens", "n_overfull", "n_same_place", "n_gaps"
    )


@R.add("p8_containers")
def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    """The container and place of every text or piece."""
    return _packed(spark, sf).select(
        F.col("item").alias("doc_id"), "piece_no", "n_pieces", F.col("first").alias("first_token"), F.col("size").alias("n_tokens"),
        "container_id", "place",
    )


@R.add("p8_fill")
def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Containers used, the least possible by volume, and the share of room left unused."""
    per = _packed(spark, sf).filter("container_id is not null").groupBy("container_id").agg(
        F.sum("size").alias("used"), F.max("fixed").alias("fixed")
    )
    n = F.count(F.lit(1))
    return per.agg(
        n.alias("n_containers"), F.ceil(F.sum("used") / CAPACITY).alias("least_by_volume"),
        F.sum(F.col("fixed").cast("bigint")).alias("n_fixed"), (1 - F.sum("used") / (n * CAPACITY)).alias("unused"),
    )


# ---------------------------------------------------------------------------------------------------------------- p9

_SHINGLES = r"""
t AS (SELECT 'd' kind, doc_id id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM eval_items),
w AS (SELECT kind, id, regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+') w FROM t WHERE text IS NOT NULL AND id IS NOT NULL),
sh AS (SELECT DISTINCT kind, id, unnest([array_to_string(w[k:k + 4], ' ') for k in range(1, len(w) - 3)]) s FROM w WHERE len(w) >= 5),
ni AS (SELECT id, count(*) n FROM sh WHERE kind = 'i' GROUP BY id),
m AS (SELECT d.id doc_id, i.id item_id, count(*) k FROM sh d JOIN sh i ON d.kind = 'd' AND i.kind = 'i' AND d.s = i.s GROUP BY ALL)
"""


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    return find_leaks(
        table(spark, sf, "documents"), table(spark, sf, "eval_items"), "doc_id", "text", "item_id", "text"
    )


@R.add("p9_found", f"WITH {_SHINGLES} SELECT doc_id, item_id FROM m JOIN ni ON ni.id = item_id WHERE 10 * k >= 3 * n")
def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that contain at least 30 % of a test item's word 5-grams."""
    return _leaks(spark, sf).select("doc_id", "item_id")


@R.add(
    "p9_leaked_items",
    f"WITH {_SHINGLES} SELECT item_id, count(*) n_docs, max(k)::INTEGER most_shared, max(n)::INTEGER n_item FROM m JOIN ni ON ni.id = item_id WHERE 10 * k >= 3 * n GROUP BY item_id"
)
def p9_leaked_items(spark: SparkSession, sf: str) -> DataFrame:
    """The test items that leaked and into how many documents."""
    return _leaks(spark, sf).groupBy("item_id").agg(
        F.count(F.lit(1)).alias("n_docs"), F.max("n_shared").alias("most_shared"), F.max("n_item").alias("n_item")
    )


# --------------------------------------------------------------------------------------------------------------- p10


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return label_segments(docs, train(labelled_sample(docs, "doc_id", "text", "lang")), "doc_id", "text")


@R.add("p10_found")
def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of several languages or with a missing or wrong label, a row per language."""
    return doubtful_labels(table(spark, sf, "documents"), _segments(spark, sf), "doc_id", "lang")


@R.add("p10_segments")
def p10_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Every stretch of one language with its confidence."""
    return _segments(spark, sf)


@R.add("p10_documents")
def p10_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The languages of every document with their share of words and confidence."""
    return document_languages(_segments(spark, sf)).select("doc_id", "lang", "n_words", "share", "confidence")
