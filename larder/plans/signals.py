"""Queries of sentiment, tagging, demand signals, matching, vectors and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions import text as X
from larder.functions import vocabulary as V
from larder.functions.numeric import steady_round, steady_sql
from larder.operators import matching as M
from larder.operators import sentiment as S
from larder.operators import serving as serve
from larder.operators import tagging as G
from larder.operators import vectors as N
from larder.operators.ratings import category_profile, recipe_categories
from larder.operators.ratings import user_stats as stats_of_users
from larder.plans.cleaning import clean_interactions, recipes, sql_list, sql_loose, sql_strict, sql_for_tags, sql_term, sql_tokens, RECIPES
from larder.plans.registry import Registry, table
from larder.session import materialize, scratch_path
from larder.sources import readers as IO
from larder.streaming import jobs

R = Registry()

# --------------------------------------------------------------------------------------------------------- sentiment

_LEX = "MAP {" + ", ".join(f"'{w}': {v}::DOUBLE" for w, v in S.LEXICON.items()) + "}"
_BOOST = "MAP {" + ", ".join(f"'{w}': {v}::DOUBLE" for w, v in S.BOOSTERS.items()) + "}"


@R.add("lexicon_sentiment", f"""WITH w AS (SELECT doc_id, text, regexp_extract_all(lower(replace(text, '''', '')), '[a-z]+') w FROM documents),
    t AS (SELECT doc_id, unnest(w) tok, generate_subscripts(w, 1) i, w FROM w),
    v AS (SELECT doc_id, v + sign(v) * CASE WHEN i > 1 THEN coalesce(({_BOOST})[w[i - 1]], 0) ELSE 0 END v,
            coalesce(i > 1 AND w[i - 1] IN ({sql_list(S.NEGATIONS)}), false) OR coalesce(i > 2 AND w[i - 2] IN ({sql_list(S.NEGATIONS)}), false) OR coalesce(i > 3 AND w[i - 3] IN ({sql_list(S.NEGATIONS)}), false) neg
          FROM (SELECT *, ({_LEX})[tok] v FROM t) WHERE v IS NOT NULL),
    s AS (SELECT doc_id, sum(CASE WHEN neg THEN v * {S.NEGATE} ELSE v END) s FROM v GROUP BY doc_id),
    e AS (SELECT d.doc_id, d.text, coalesce(s, 0) + sign(round(coalesce(s, 0), 9)) * least(len(regexp_extract_all(text, '!')), {S.MOST_EXCLAIM}) * {S.EXCLAIM} s FROM documents d LEFT JOIN s USING (doc_id))
    SELECT doc_id, {steady_sql(f"CASE WHEN trim(text) <> '' THEN s / sqrt(s * s + {S.ALPHA}) END")} AS compound FROM e""")  # fmt: skip
def lexicon_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id", steady_round(S.lexicon_score(F.col("text"))).alias("compound")
    )


# ------------------------------------------------------------------------------------------------------------ tagging


def _alias_case(t: str, keys: list[str]) -> str:
    return "coalesce(" + ", ".join(
        f"CASE WHEN regexp_matches({t}, '\\b{k}\\b') THEN '{k}' END" for k in keys
    ) + ", NULL)"


def _tags_sql(source: str, key: str, text: str) -> str:
    """Tags of ``text`` in ``source`` by keyword, as one union of the taxonomy's tags."""
    parts = [
        f"SELECT {key}, '{tag}' tag, '{dim}' dimension, {_alias_case('t', keys)} kw FROM n" for tag, dim,
        keys in V.TAXONOMY
    ]
    return f"""WITH n AS (SELECT {key}, {sql_for_tags(text)} t FROM {source}), x AS ({' UNION ALL '.join(parts)})
    SELECT {key}, tag, dimension, {sql_term('kw')} matched_term FROM x WHERE kw IS NOT NULL"""


def _recipe_tags(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat_ws(" ", "name", F.array_join("ingredients_canonical_list", " "))
    return G.tag_rows(recipes(spark, sf), text, ["id"])


_RECIPE_TEXT = "concat_ws(' ', name, array_to_string(ingredients_canonical_list, ' '))"
_RECIPE_TAGS = _tags_sql(
    "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY extract_date DESC NULLS LAST) rn FROM recipes_clean WHERE id IS NOT NULL) WHERE rn = 1)",
    "id", _RECIPE_TEXT
)


@R.add("taxonomy_tags", _RECIPE_TAGS)
def taxonomy_tags(spark: SparkSession, sf: str) -> DataFrame:
    return _recipe_tags(spark, sf)


@R.add("weakly_tagged", f"""WITH tags AS ({_RECIPE_TAGS}), {RECIPES}
    SELECT r.id, count(DISTINCT tag) n_tags FROM r LEFT JOIN tags ON tags.id = r.id GROUP BY r.id HAVING count(DISTINCT tag) <= 1""")  # fmt: skip
def weakly_tagged(spark: SparkSession, sf: str) -> DataFrame:
    return G.weakly_tagged(recipes(spark, sf), _recipe_tags(spark, sf), "id")


@R.add("tag_supply", f"WITH tags AS ({_RECIPE_TAGS}) SELECT tag, count(*) recipe_count FROM tags GROUP BY tag")
def tag_supply(spark: SparkSession, sf: str) -> DataFrame:
    return _recipe_tags(spark, sf).groupBy("tag").agg(F.count(F.lit(1)).alias("recipe_count"))


@R.add("term_index", f"""WITH tags AS ({_RECIPE_TAGS}), {RECIPES}, g AS (SELECT id, string_agg(DISTINCT tag, '|' ORDER BY tag) tags, string_agg(DISTINCT dimension, '|' ORDER BY dimension) tag_dimensions FROM tags GROUP BY id)
    SELECT r.id, name recipe_name, {sql_strict('name')} canonical_term, {sql_loose('name')} loose_term, array_to_string(list_slice(ingredients_canonical_list, 1, 5), ', ') ingredients_summary, tags, tag_dimensions
    FROM r LEFT JOIN g ON g.id = r.id""")  # fmt: skip
def term_index(spark: SparkSession, sf: str) -> DataFrame:
    return G.term_index(recipes(spark, sf), _recipe_tags(spark, sf), "id", "name", "ingredients_canonical_list")


@R.add("distinct_tags", f"WITH tags AS ({_RECIPE_TAGS}) SELECT DISTINCT tag, dimension FROM tags")
def distinct_tags(spark: SparkSession, sf: str) -> DataFrame:
    return _recipe_tags(spark, sf).select("tag", "dimension").distinct()


# ------------------------------------------------------------------------------------------------------------- demand

_JUNK = "(?i)" + "|".join(V.JUNK).replace("'", "''")
_PHRASES = f"""p AS (SELECT unnest(string_split_regex(text, '[,\\n;|•]')) x FROM documents WHERE length(text) >= 5 AND NOT regexp_matches(text, '{_JUNK}')),
    q AS (SELECT trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(regexp_replace(x, '^\\s+|\\s+$', '', 'g'))), '^\\s*([0-9]+[.)]\\s*|[-•*]\\s*)', ''), '[“”"'']', '', 'g'), '\\s+', ' ', 'g'), ' ,;:-') term FROM p),
    ok AS (SELECT term FROM q WHERE length(term) >= 3 AND term NOT IN ({sql_list(V.GENERIC_PHRASES)}) AND length(regexp_replace(term, '[^a-z]', '', 'g')) >= 3
       AND len(list_filter(string_split(term, ' '), lambda w: length(w) > 2 AND w NOT IN ({sql_list(V.PHRASE_STOPWORDS)}))) >= 2
       AND len(list_filter(string_split(term, ' '), lambda w: w NOT IN ({sql_list(V.GENERIC_WORDS)}))) > 0),
    n AS (SELECT term, count(*) raw_frequency FROM ok GROUP BY term), z AS (SELECT avg(raw_frequency) m, stddev_samp(raw_frequency) s FROM n)"""


@R.add(
    "phrase_scores",
    f"WITH {_PHRASES} SELECT term, raw_frequency, {steady_sql('(raw_frequency - m) / s', 6)} AS normalised_score FROM n, z"
)
def phrase_scores(spark: SparkSession, sf: str) -> DataFrame:
    return G.phrase_scores(table(spark, sf, "documents"), "text")


@R.add("group_zscore", f"""WITH e AS (SELECT event_type, user_id, sum(value) v FROM events GROUP BY ALL), s AS (SELECT event_type, avg(v) m, stddev_samp(v) s FROM e GROUP BY 1)
    SELECT event_type, user_id, {steady_sql('CASE WHEN coalesce(s, 0) = 0 THEN 0 ELSE (v - m) / s END', 6)} AS z FROM e JOIN s USING (event_type)""")  # fmt: skip
def group_zscore(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.sum("value").alias("v"))
    return G.group_z(e, ["event_type"], "v", "z").select("event_type", "user_id", "z")


_ASKED = "CASE WHEN recipe_id % 3 = 2 THEN regexp_replace(lower(trim(name)), '^\\S+ ', '') ELSE lower(trim(name)) END"
_SEARCHES = f"""t AS (SELECT source, {_ASKED} || CASE WHEN recipe_id % 3 = 0 THEN ' recipe' WHEN recipe_id % 3 = 1 THEN ' car insurance' ELSE '' END raw_term, source_score
    FROM (SELECT name, recipe_id, avg_rating source_score, CASE WHEN recipe_id % 2 = 0 THEN 'trends' ELSE 'ai_mode' END source FROM dim_recipe WHERE name IS NOT NULL))"""


def _asked() -> Column:
    """A name as people search it: every third without its first word."""
    name = F.lower(F.trim("name"))
    return F.when(F.col("recipe_id") % 3 == 2, F.regexp_replace(name, r"^\S+ ", "")).otherwise(name)


def _searches(spark: SparkSession, sf: str) -> DataFrame:
    """Recipe names as search terms: a third ask for the recipe, a third about something else."""
    k = F.col("recipe_id") % 3
    raw = F.concat(_asked(), F.when(k == 0, " recipe").when(k == 1, " car insurance").otherwise(""))
    t = table(spark, sf, "dim_recipe").filter("name is not null")
    return t.select(
        F.when(F.col("recipe_id") % 2 == 0, "trends").otherwise("ai_mode").alias("source"), raw.alias("raw_term"),
        F.col("avg_rating").alias("source_score")
    )


_KEYS = "|".join(k for _, _, ks in V.TAXONOMY for k in ks)
_EXTERNAL = f"""{_SEARCHES},
    ok AS (SELECT *, {sql_strict('raw_term')} canonical_term FROM t WHERE length(raw_term) BETWEEN 3 AND 60 AND NOT regexp_matches(raw_term, '(?i){'|'.join(V.RESIDUE)}')
      AND length(regexp_replace(raw_term, '[^a-zA-Z]', '', 'g')) >= 0.6 * length(raw_term) AND NOT regexp_matches(raw_term, '(?i)\\b({V.BLOCKED_TOPICS})\\b')
      AND (regexp_matches(raw_term, '(?i)\\brecipes?\\b') OR regexp_matches(lower(raw_term), '\\b({_KEYS})\\b'))),
    best AS (SELECT source, raw_term, canonical_term, source_score FROM (SELECT *, row_number() OVER (PARTITION BY source, canonical_term ORDER BY source_score DESC NULLS LAST, raw_term) k FROM ok WHERE canonical_term <> '') WHERE k = 1)"""


def _external(spark: SparkSession, sf: str) -> DataFrame:
    rows = _searches(spark, sf)
    tags = G.tag_rows(rows.select("raw_term").distinct(), F.col("raw_term"), ["raw_term"])
    return G.external_terms(rows, tags)


@R.add("external_terms", f"WITH {_EXTERNAL} SELECT * FROM best")
def external_terms(spark: SparkSession, sf: str) -> DataFrame:
    return _external(spark, sf).select("source", "raw_term", "canonical_term", "source_score")


@R.add(
    "signal_tags",
    "SELECT DISTINCT * FROM (" + _tags_sql(
        f"(WITH {_SEARCHES} SELECT source, raw_term FROM t)", "source, raw_term", "raw_term"
    ) + ")"
)
def signal_tags(spark: SparkSession, sf: str) -> DataFrame:
    rows = _searches(spark, sf).select("source", "raw_term").distinct()
    return G.tag_rows(rows, F.col("raw_term"), ["source", "raw_term"]).distinct()


@R.add("seed_filter", f"""SELECT DISTINCT raw_term, trim(regexp_replace(lower(trim(raw_term)), '\\brecipes?\\s*$', '')) term FROM (WITH {_SEARCHES} SELECT * FROM t)
    WHERE regexp_matches(raw_term, '(?i)\\brecipes?\\b')""")  # fmt: skip
def seed_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Queries that name a recipe, without the trailing seed word."""
    rows = _searches(spark, sf).filter(F.col("raw_term").rlike(r"(?i)\brecipes?\b"))
    return rows.select("raw_term", X.strip_trailing_recipe(F.col("raw_term")).alias("term")).distinct()


@R.add("monthly_interest", f"""WITH m AS (SELECT source k, last_day(fetched_date) month_end, avg(n_chars) v FROM documents WHERE fetched_date IS NOT NULL AND source IS NOT NULL GROUP BY ALL),
    s AS (SELECT k, unnest(generate_series(date_trunc('month', min(month_end))::TIMESTAMP, date_trunc('month', max(month_end))::TIMESTAMP, INTERVAL 1 MONTH)) d FROM m GROUP BY k)
    SELECT s.k AS source, last_day(d::DATE) month_end, {steady_sql('v', 2)} AS interest FROM s LEFT JOIN m ON m.k = s.k AND m.month_end = last_day(s.d::DATE)""")  # fmt: skip
def monthly_interest(spark: SparkSession, sf: str) -> DataFrame:
    return G.monthly_interest(
        table(spark, sf, "documents").filter("fetched_date is not null and source is not null"), "source",
        "fetched_date", "n_chars"
    )


@R.add(
    "nutrient_pick",
    """SELECT recipe_id, protein amount_protein, sodium / 1000 amount_sodium_g, NULL::DOUBLE amount_unknown FROM dim_recipe"""
)
def nutrient_pick(spark: SparkSession, sf: str) -> DataFrame:
    """Nutrients picked from nested and flat JSON entries by name and unit."""
    t = table(spark, sf, "dim_recipe")
    c = lambda x: F.to_json(F.struct(F.col(x).alias("v")))
    num = lambda x: F.coalesce(F.regexp_extract(c(x), r":(.*)\}", 1), F.lit("null"))
    val = lambda x: F.when(F.col(x).isNull(), "null").otherwise(num(x))
    doc = F.concat(
        F.lit('[{"nutrient":{"name":"Protein","unitName":"G"},"amount":'), val("protein"),
        F.lit('},{"nutrientName":"Sodium, Na","unitName":"MG","value":'), val("sodium"),
        F.lit('},{"nutrientName":"Fiber","unitName":"G","amount":"n/a"}]')
    )
    n = F.from_json(doc, f"array<{IO.NUTRIENT}>")
    return t.select(
        "recipe_id", IO.nutrient_amount(n, ["protein"]).alias("amount_protein"), (
            IO.nutrient_amount(n, ["sodium"], ["mg"]) / 1000
        ).alias("amount_sodium_g"),
        IO.nutrient_amount(n, ["fiber"]).alias("amount_unknown"),
    )


@R.add(
    "timeline_scan",
    "SELECT o_custkey, o_orderkey, date_trunc('second', o_orderdate) AS point_at, o_orderstatus keyword, (o_totalprice / 10000)::INTEGER AS value FROM orders"
)
def timeline_scan(spark: SparkSession, sf: str) -> DataFrame:
    """An interest timeline as JSON, scanned into points."""
    t = table(spark, sf, "orders")
    at = F.unix_timestamp(F.date_trunc("second", F.col("o_orderdate").cast("timestamp"))).cast("string")
    point = F.struct(
        at.alias("timestamp"),
        F.array(
            F.struct(
                F.col("o_orderstatus").alias("query"),
                F.rint(F.col("o_totalprice") / 10000).cast("int").alias("extracted_value")
            )
        ).alias("values")
    )
    doc = F.to_json(F.struct(F.struct(F.array(point).alias("timeline_data")).alias("interest_over_time")))
    p = t.select("o_custkey", "o_orderkey", F.explode(IO.timeline_points(doc)).alias("p"))
    return p.select("o_custkey", "o_orderkey", F.col("p.at").alias("point_at"), "p.keyword", "p.value")


@R.add("related_queries", """SELECT recipe_id, unnest(['rising', 'top']) query_type, lower(name) || ' recipe' related_query, unnest([CASE WHEN recipe_id % 2 = 0 THEN 5000 ELSE 0 END, review_count]) raw_value FROM dim_recipe WHERE name IS NOT NULL""")
def related_queries(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "dim_recipe").filter("name is not null")
    q = F.concat(F.lower("name"), F.lit(" recipe"))
    item = lambda v: F.array(F.struct(q.alias("query"), v.cast("string").alias("value")), F.struct(F.lit("car repair").alias("query"), F.lit("9").alias("value")))
    rise = F.when(F.col("recipe_id") % 2 == 0, "Breakout").otherwise("unknown")
    doc = F.to_json(
        F.struct(
            F.struct(item(rise).alias("rising"), item(F.col("review_count")).alias("top")).alias("related_queries")
        )
    )
    rows = t.select("recipe_id", "review_count", F.explode(IO.related_queries(doc)).alias("r"))
    value = F.when(
        (F.col("r.query_type") == "top") & F.col("review_count").isNull(), None
    ).otherwise(F.col("r.raw_value"))
    return rows.select("recipe_id", "r.query_type", "r.related_query", value.alias("raw_value"))


@R.add(
    "answer_blocks",
    f"""SELECT doc_id, 0::INTEGER block_index, trim(text) body FROM documents WHERE text IS NOT NULL AND length(trim(text)) >= 5 AND NOT regexp_matches(text, '{_JUNK}')"""
)
def answer_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Answer pages of several shapes as JSON, scanned into text blocks."""
    t = table(spark, sf, "documents").filter("text is not null")
    k = F.col("doc_id") % 3
    block = F.to_json(
        F.struct(F.struct(F.array(F.struct(F.col("text").alias("snippet"))).alias("text_blocks")).alias("ai_mode"))
    )
    plain = F.to_json(F.struct(F.struct(F.col("text").alias("answer")).alias("ai_overview")))
    mark = F.to_json(F.struct(F.replace(F.col("text"), F.lit("\\"), F.lit("\\\\")).alias("reconstructed_markdown")))
    doc = F.when(k == 0, block).when(k == 1, plain).otherwise(mark)
    b = t.select("doc_id", F.explode(IO.answer_blocks(doc)).alias("b"))
    return b.select("doc_id", "b.block_index", F.trim("b.body").alias("body"))


@R.add("supply_demand_gap", f"""WITH tags AS ({_RECIPE_TAGS}), s AS (SELECT tag term, count(*) recipe_count FROM tags GROUP BY 1), z AS (SELECT avg(recipe_count) m, stddev_samp(recipe_count) s FROM s),
    d AS (SELECT primary_tag term, {steady_sql('avg(CASE WHEN isnan(calories_pdv) THEN NULL ELSE calories_pdv END) / 100')} AS combined_score FROM recipes_clean WHERE primary_tag IS NOT NULL GROUP BY 1
          UNION ALL SELECT tag, 0.5 FROM tags WHERE dimension = 'cuisine' GROUP BY 1),
    j AS (SELECT coalesce(d.term, s.term) term, combined_score, recipe_count, {steady_sql("CASE WHEN recipe_count IS NULL THEN combined_score ELSE coalesce(combined_score, 0) - round_even((recipe_count - m) / z.s * 1e6 + 1e-6, 0) / 1e6 END")} AS gap_score
          FROM d FULL OUTER JOIN s ON s.term = d.term, z)
    SELECT *, CASE WHEN gap_score > {V.TIER_HIGH} THEN 'high' WHEN gap_score > {V.TIER_MEDIUM} THEN 'medium' ELSE 'low' END opportunity_tier FROM j""")  # fmt: skip
def supply_demand_gap(spark: SparkSession, sf: str) -> DataFrame:
    tags = materialize(_recipe_tags(spark, sf), "tags")
    supply = tags.groupBy(F.col("tag").alias("term")).agg(F.count(F.lit(1)).alias("recipe_count"))
    score = steady_round(F.avg(F.nanvl("calories_pdv", F.lit(None))) / 100)
    demand = table(spark, sf, "recipes_clean").filter("primary_tag is not null").groupBy(
        F.col("primary_tag").alias("term")
    ).agg(score.alias("combined_score"))
    demand = demand.unionByName(
        tags.filter("dimension = 'cuisine'").select(F.col("tag").alias("term")).distinct().withColumn("combined_score", F.lit(0.5))
    )
    return G.supply_demand_gap(demand, supply)


# ----------------------------------------------------------------------------------------------------------- matching

_FOOD_KEY = """(CASE WHEN contains(d, q) THEN 1 ELSE 0 END, hits / n, (recipe_id % 4)::INTEGER, ingredient_count, -length(d), -recipe_id)"""


@R.add("food_match", f"""WITH q AS (SELECT DISTINCT i q, list_filter(string_split_regex(i, '[^a-z0-9]+'), lambda w: length(w) >= 2) t FROM (SELECT unnest(ingredients_canonical_list) i FROM recipes_clean) WHERE i IS NOT NULL),
    f AS (SELECT recipe_id, lower(name) d, coalesce(ingredient_count, 0) ingredient_count FROM dim_recipe WHERE name IS NOT NULL),
    j AS (SELECT *, len(t)::DOUBLE n, len(list_filter(t, lambda w: contains(d, w)))::DOUBLE hits FROM q, f),
    r AS (SELECT q, recipe_id, row_number() OVER (PARTITION BY q ORDER BY CASE WHEN contains(d, q) THEN 1 ELSE 0 END DESC, hits / n DESC, recipe_id % 4 DESC, ingredient_count DESC, length(d), recipe_id) k FROM j WHERE hits > 0)
    SELECT q ingredient, recipe_id food_id FROM r WHERE k = 1""")  # fmt: skip
def food_match(spark: SparkSession, sf: str) -> DataFrame:
    """The best food description of every ingredient: phrase, share of words, kind, richness, brevity.

    A word stands in a description only inside one of its runs of letters, so words and runs meet on parts of two to four
    letters and are then compared; no ingredient is compared with all descriptions.
    """
    q = table(spark, sf, "recipes_clean").select(
        F.explode("ingredients_canonical_list").alias("q")
    ).filter("q is not null").distinct()
    q = q.withColumn("t", X.split_alnum(F.col("q"))).filter(F.size("t") > 0)
    f = table(spark, sf, "dim_recipe").filter("name is not null").select(
        "recipe_id", F.lower("name").alias("d"), F.coalesce("ingredient_count", F.lit(0)).alias("rich")
    )
    # a word of up to four letters is its own key, a longer one meets runs on its first four
    words = q.select(F.explode("t").alias("w")).distinct().withColumn("g", F.substring("w", 1, 4))
    runs = f.select(F.explode(F.split("d", "[^a-z0-9]+")).alias("r")).filter(F.length("r") >= 2).distinct()
    starts = F.sequence(F.lit(1), F.length("r") - 1)
    grams = F.array_distinct(
        F.flatten(F.transform(starts, lambda i: F.array(*[F.substring(F.col("r"), i, F.lit(n)) for n in (2, 3, 4)])))
    )
    meet = words.join(
        runs.withColumn("g", F.explode(grams)), "g"
    ).filter(F.contains("r", "w")).select("w", "r").distinct()
    fr = f.select("recipe_id", F.explode(F.array_distinct(F.split("d", "[^a-z0-9]+"))).alias("r"))
    hits = meet.join(fr, "r").select("w", "recipe_id").distinct()
    pairs = q.select("q", F.explode("t").alias("w")).join(hits, "w").groupBy("q", "recipe_id").agg(
        F.count(F.lit(1)).alias("hits")
    )
    full = pairs.join(q, "q").join(f, "recipe_id")
    key = F.struct(
        F.contains("d", "q").cast("int").alias("phrase"), (F.col("hits") / F.size("t")).alias("rate"), (F.col("recipe_id") % 4).alias("kind"),
        F.col("rich"), (-F.length("d")).alias("short"), (-F.col("recipe_id")).alias("first"),
    )
    return full.groupBy(F.col("q").alias("ingredient")).agg(F.max_by("recipe_id", key).alias("food_id"))


def _sorted_sql(x: str) -> str:
    return f"array_to_string(list_sort(string_split({x}, ' ')), ' ')"


def _ratio_sql(a: str, b: str) -> str:
    a, b = _sorted_sql(a), _sorted_sql(b)
    return f"(1 - levenshtein({a}, {b}) / greatest(length({a}), length({b}), 1)::DOUBLE)"


_TERMS = f"""terms AS (SELECT DISTINCT term, list_distinct({sql_tokens('term')}) tt FROM (SELECT {sql_strict('name')} term FROM recipes_clean) WHERE term <> ''),
    qs AS (SELECT DISTINCT query, list_distinct({sql_tokens('query')}) qt FROM (SELECT {sql_strict(_ASKED)} AS query FROM dim_recipe WHERE name IS NOT NULL))"""
_MATCHES = f"""{_TERMS},
    j AS (SELECT query, term, {steady_sql(f"greatest(len(list_intersect(qt, tt)) / (len(qt) + len(tt) - len(list_intersect(qt, tt)))::DOUBLE, {_ratio_sql('query', 'term')})")} AS sim
          FROM qs, terms WHERE query NOT IN (SELECT term FROM terms) AND list_has_any(qt, tt)),
    b AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, term) k FROM j),
    matches AS (SELECT query, term best_term, 1.0::DOUBLE similarity, 'exact' AS method FROM qs JOIN terms ON query = term UNION ALL SELECT query, term, sim, 'fuzzy' FROM b WHERE k = 1
      UNION ALL SELECT query, NULL, 0.0, CASE WHEN trim(query) = '' THEN 'empty_query' ELSE 'no_token_overlap' END FROM qs WHERE query NOT IN (SELECT term FROM terms) AND query NOT IN (SELECT query FROM j))"""


def _matches(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "dim_recipe").filter("name is not null").select(X.canonical_strict(_asked()).alias("query"))
    t = table(spark, sf, "recipes_clean").select(X.canonical_strict(F.col("name")).alias("term"))
    return M.lexical_match(q, t)


@R.add("lexical_match", f"WITH {_MATCHES} SELECT * FROM matches")
def lexical_match(spark: SparkSession, sf: str) -> DataFrame:
    return _matches(spark, sf)


_GAPS = f"""{_MATCHES}, {_EXTERNAL},
    g AS (SELECT source, raw_term, canonical_term, source_score, best_term, similarity, CASE WHEN similarity >= {V.STRONG_MATCH} THEN 'strong_match' WHEN similarity >= {V.WEAK_MATCH} THEN 'weak_match' ELSE 'gap' END match_status,
        {steady_sql('source_score * (1 - similarity)')} AS gap_score FROM best JOIN matches ON query = canonical_term),
    gaps AS (SELECT *, CASE WHEN match_status = 'strong_match' THEN NULL WHEN gap_score >= {V.HIGH_PRIORITY} THEN 'high_priority' WHEN gap_score >= {V.MEDIUM_PRIORITY} THEN 'medium_priority' ELSE 'low_priority' END opportunity_label,
        CASE WHEN match_status <> 'strong_match' THEN row_number() OVER (PARTITION BY match_status = 'strong_match' ORDER BY gap_score DESC NULLS LAST, source, canonical_term) END top_gap_rank FROM g)"""


def _gaps(spark: SparkSession, sf: str) -> DataFrame:
    ext = _external(spark, sf).select("source", "raw_term", "canonical_term", "source_score")
    return M.gap_table(ext, _matches(spark, sf).drop("method"))


@R.add("gap_table", f"WITH {_GAPS} SELECT * FROM gaps")
def gap_table(spark: SparkSession, sf: str) -> DataFrame:
    return _gaps(spark, sf)


@R.add(
    "top_gaps",
    f"WITH {_GAPS} SELECT source, canonical_term, gap_score FROM gaps WHERE match_status <> 'strong_match' ORDER BY gap_score DESC NULLS LAST, source, canonical_term LIMIT 3"
)
def top_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """The three largest gaps (a top list is the feature)."""
    return serve.top_gaps(_gaps(spark, sf)).select("source", "canonical_term", "gap_score")


@R.add(
    "gap_status_shares",
    f"WITH {_GAPS} SELECT match_status, count(*) n, {steady_sql('avg(gap_score)')} AS mean_gap FROM gaps GROUP BY 1"
)
def gap_status_shares(spark: SparkSession, sf: str) -> DataFrame:
    return _gaps(spark, sf).groupBy("match_status").agg(
        F.count(F.lit(1)).alias("n"), steady_round(F.avg("gap_score")).alias("mean_gap")
    )


_SIMILAR = f"""n AS (SELECT DISTINCT {sql_strict('name')} node FROM dim_recipe WHERE name IS NOT NULL), nodes AS (SELECT node, {_sorted_sql('node')} s FROM n WHERE node <> ''),
    edges AS (SELECT a.node a, b.node b, 1 - levenshtein(a.s, b.s) / greatest(length(a.s), length(b.s))::DOUBLE r FROM nodes a JOIN nodes b ON a.node < b.node
      AND abs(length(a.s) - length(b.s)) <= 0.15 * greatest(length(a.s), length(b.s)) + 1e-9)"""


def _terms(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "dim_recipe").filter("name is not null").select(
        X.canonical_strict(F.col("name")).alias("node")
    )
    return t.filter("node <> ''").distinct()


@R.add(
    "similar_terms", f"WITH {_SIMILAR} SELECT a, b, {steady_sql('r')} AS similarity FROM edges WHERE r >= {V.SAME_TERM}"
)
def similar_terms(spark: SparkSession, sf: str) -> DataFrame:
    return M.similar_terms(_terms(spark, sf))


_COMPONENTS = f"""{_SIMILAR}, e AS (SELECT a u, b v FROM edges WHERE r >= {V.SAME_TERM} UNION ALL SELECT b, a FROM edges WHERE r >= {V.SAME_TERM}),
    walk AS (SELECT node, node AS component FROM nodes UNION SELECT e.v, walk.component FROM walk JOIN e ON e.u = walk.node WHERE walk.component < e.v),
    members AS (SELECT node, min(component) component FROM walk GROUP BY node)"""


@R.add("term_components", f"WITH RECURSIVE {_COMPONENTS} SELECT node, component FROM members")
def term_components(spark: SparkSession, sf: str) -> DataFrame:
    terms = _terms(spark, sf)
    return M.components(terms, M.similar_terms(terms).select("a", "b"))


@R.add("cluster_rollup", f"""WITH RECURSIVE {_COMPONENTS}, {_GAPS},
    x AS (SELECT component, node, length(node) l, len(string_split(node, ' ')) w, gap_score, match_status, similarity, best_term, g.canonical_term FROM members LEFT JOIN gaps g ON g.canonical_term = node),
    r AS (SELECT component, count(DISTINCT node) n_terms, {steady_sql('avg(gap_score)')} AS mean_gap, max(gap_score) max_gap, count(*) FILTER (match_status = 'strong_match') n_strong FROM x GROUP BY 1),
    p AS (SELECT component, node representative_term FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY w, l, node) k FROM x) WHERE k = 1)
    SELECT representative_term, n_terms, mean_gap, max_gap, n_strong, row_number() OVER (ORDER BY n_terms DESC, representative_term) - 1 AS cluster_no FROM r JOIN p USING (component)""")  # fmt: skip
def cluster_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return M.cluster_rollup(term_components(spark, sf), _gaps(spark, sf)).drop("best_term")


# ------------------------------------------------------------------------------------------------------------ vectors


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


_KNN = """k AS (SELECT a.vec_id query_id, b.vec_id id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) s FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
    knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) place FROM k) WHERE place <= 5)"""


@R.add("cosine_knn", f"WITH {_KNN} SELECT query_id, id, round(s, 5) similarity, place::INTEGER AS rank FROM knn")
def cosine_knn(spark: SparkSession, sf: str) -> DataFrame:
    """The five nearest of every vector whose id is divisible by 50, among all vectors, exactly."""
    v = _vectors(spark, sf)
    return N.nearest(v.filter("id % 50 = 0"), v, 5).withColumn("similarity", F.round("similarity", 5))


_FEATURES = "SELECT p_partkey id, p_size / 10.0::DOUBLE rating, p_retailprice / 2000 - 0.5 sentiment, p_size::DOUBLE protein, p_retailprice / 100 saturated_fat, p_size % 7.0::DOUBLE sugar, p_partkey % 11.0::DOUBLE sodium FROM part"
_HEALTH = "0.4 * (b.protein - a.protein) - 0.25 * (b.saturated_fat - a.saturated_fat) - 0.2 * (b.sugar - a.sugar) - 0.15 * (b.sodium - a.sodium)"


@R.add("substitutions", f"""WITH {_KNN}, f AS ({_FEATURES}) SELECT query_id candidate_id, knn.id substitute_id, {steady_sql('s')} AS similarity, {', '.join(f"{steady_sql(f'b.{c} - a.{c}')} AS {c}_delta" for c in ('rating', 'sentiment', 'protein', 'saturated_fat', 'sugar', 'sodium'))},
    {steady_sql(_HEALTH)} AS health_delta, {steady_sql(f'0.6 * s + 0.2 * (b.rating - a.rating) + 0.1 * (b.sentiment - a.sentiment) + 0.1 * ({_HEALTH})')} AS recommendation_score
    FROM knn JOIN f a ON a.id = query_id JOIN f b ON b.id = knn.id""")  # fmt: skip
def substitutions(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours scored by similarity and the differences of their features (features of parts stand in)."""
    v = _vectors(spark, sf)
    size, price, key = F.col("p_size"), F.col("p_retailprice"), F.col("p_partkey")
    f = table(spark, sf, "part").select(
        key.alias("id"), (size / 10.0).alias("rating"), (price / 2000 - 0.5).alias("sentiment"), size.cast("double").alias("protein"),
        (price / 100).alias("saturated_fat"), (size % 7).cast("double").alias("sugar"), (key % 11).cast("double").alias("sodium"),
    )
    return N.substitution_scores(N.nearest(v.filter("id % 50 = 0"), v, 5), f)


@R.add("hybrid_embedding", f"""WITH x AS (SELECT vec_id, embedding, p_size::DOUBLE a, p_retailprice b FROM embeddings JOIN part ON vec_id = p_partkey),
    s AS (SELECT avg(a) ma, stddev_pop(a) sa, avg(b) mb, stddev_pop(b) sb FROM x),
    e AS (SELECT vec_id, list_concat(list_transform(embedding, lambda v: v::DOUBLE * 0.7), [(a - ma) / sa * 0.3, (b - mb) / sb * 0.3]) e FROM x, s)
    SELECT vec_id, len(e)::INTEGER dims, {steady_sql('e[1] / sqrt(list_dot_product(e, e))')} AS first_value, {steady_sql('e[-1] / sqrt(list_dot_product(e, e))')} AS last_value FROM e""")  # fmt: skip
def hybrid_embedding(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b")
    )
    e = N.hybrid_embedding(_vectors(spark, sf).join(part, "id"), "id", "embedding", ["a", "b"])
    return e.select(
        F.col("id").alias("vec_id"), F.size("embedding").alias("dims"),
        steady_round(F.element_at("embedding", 1)).alias("first_value"),
        steady_round(F.element_at("embedding", -1)).alias("last_value")
    )


@R.add("user_segments")
def user_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Users in K-Means segments with names (rows only: starts and silhouette are not expressible in SQL)."""
    rows = materialize(
        clean_interactions(spark, sf).select("user_id", "recipe_id", "date", "rating", "sentiment_score"), "rows"
    )
    cats = recipe_categories(recipes(spark, sf), "id", "ingredients_canonical_list")
    taste = category_profile(rows, cats, "user_id", "recipe_id", list(V.CATEGORIES))
    table_ = materialize(stats_of_users(rows).join(taste, "user_id"), "users")
    features = [f"avg_rating_{c}" for c in V.CATEGORIES] + ["review_count", "recipe_diversity", "avg_sentiment_score"]
    return N.segment_users(table_, "user_id", features).select("user_id", "cluster_id", "cluster_label")


# ------------------------------------------------------------------------------------------------------------- stream


def _ingested(spark: SparkSession, sf: str) -> str:
    sink = scratch_path(spark, "stream")
    rows = jobs.clean_stream(jobs.read_events(spark, f"{sf}/fact_interactions.parquet"), as_of="2024-12-31 00:00:00")
    jobs.start_ingest(rows, sink, scratch_path(spark, "stream-state")).awaitTermination()
    return sink


_LIVE = """live AS (SELECT interaction_id, any_value(user_id) user_id, any_value(recipe_id) recipe_id, any_value(rating) rating FROM fact_interactions
    WHERE interaction_id IS NOT NULL AND user_id IS NOT NULL AND recipe_id IS NOT NULL AND rating BETWEEN 1 AND 5 AND loaded_at <= TIMESTAMPTZ '2024-12-31 00:00:00+00' GROUP BY interaction_id)"""


@R.add("stream_ingest", f"WITH {_LIVE} SELECT * FROM live")
def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """All facts streamed into the keyed sink."""
    return spark.read.parquet(_ingested(spark, sf)).select("interaction_id", "user_id", "recipe_id", "rating")


@R.add("stream_serving", f"""WITH {_LIVE}, b AS (SELECT DISTINCT interaction_id, user_id, recipe_id, rating FROM fact_interactions WHERE source = 'batch' AND interaction_id IS NOT NULL)
    SELECT * FROM b UNION ALL SELECT * FROM live WHERE interaction_id NOT IN (SELECT interaction_id FROM b)""")  # fmt: skip
def stream_serving(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "fact_interactions").filter("source = 'batch' and interaction_id is not null").select(
        "interaction_id", "user_id", "recipe_id", "rating"
    ).distinct()
    return jobs.serve(b, _ingested(spark, sf))


@R.add(
    "stream_daily_counts",
    "SELECT CAST(loaded_at AS DATE) AS day, user_id, count(*) n FROM fact_interactions WHERE user_id IS NOT NULL AND loaded_at IS NOT NULL GROUP BY ALL"
)
def stream_daily_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows per user and day as a stream in several micro-batches: the facts arrive as many files, a few a batch."""
    files, sink = scratch_path(spark, "arrivals"), scratch_path(spark, "daily")
    facts = table(spark, sf, "fact_interactions")
    facts.select(*[f.split()[0] for f in jobs.EVENT.split(", ")]).repartition(6, "interaction_id").write.parquet(files)
    events = jobs.read_events(spark, files, files_per_batch=2)
    jobs.start_partial_counts(events, sink, scratch_path(spark, "daily-state")).awaitTermination()
    return jobs.summed(spark, sink)


R.plain("monthly_interest", dates=("month_end",))
R.plain("timeline_scan", micros=("point_at",))
R.plain("stream_daily_counts", dates=("day",))
