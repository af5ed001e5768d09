"""Queries of the market reads: gap texts and filters, top lists, clusters in detail, matching by vectors, segments, swaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions import text as X
from larder.functions import vocabulary as V
from larder.functions.numeric import steady_round, steady_sql
from larder.operators import matching as M
from larder.operators import serving as serve
from larder.operators.vectors import segment_labels
from larder.plans import analytics as A
from larder.plans import signals as S
from larder.plans.cleaning import RECIPES, recipes
from larder.plans.registry import Registry, table
from larder.session import materialize

R = Registry()

# --------------------------------------------------------------------------------------------------------------- gaps


def title_sql(x: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({x}, '\\p{{L}}+|\\P{{L}}+'), lambda w: upper(w[1]) || lower(w[2:])), '')"


def _two(x: str) -> str:
    return f"printf('%.2f', {steady_sql(x, 2)})"


_Q = "'''' || coalesce({}, '') || ''''"
_SOURCE = title_sql("replace(source, '_', ' ')")
_TEXTS = f"""texts AS (SELECT source, canonical_term, 'raw=' || {_Q.format('raw_term')} || ' | canonical=' || {_Q.format('canonical_term')} || ' | best_match=' || {_Q.format('g.best_term')}
    || ' | similarity=' || {_two('g.similarity')} || ' | threshold=' || CASE match_status WHEN 'strong_match' THEN '>=0.80' WHEN 'weak_match' THEN '>=0.60' ELSE '<0.60' END
    || ' | status=' || match_status || ' | method=' || m.method AS gap_reason,
    CASE match_status WHEN 'strong_match' THEN {_Q.format('raw_term')} || ' is well covered (best match: ' || {_Q.format('g.best_term')} || ', similarity=' || {_two('g.similarity')} || ').'
      WHEN 'weak_match' THEN {_Q.format('raw_term')} || ' has a partial match (' || {_Q.format('g.best_term')} || ', similarity=' || {_two('g.similarity')} || '); ' || replace(opportunity_label, '_', ' ') || ' opportunity per ' || {_SOURCE} || '.'
      ELSE {_Q.format('raw_term')} || ' has no strong match (similarity=' || {_two('g.similarity')} || '); ' || replace(opportunity_label, '_', ' ') || ' opportunity based on ' || {_SOURCE} || ' signal (source score=' || {_two('coalesce(source_score, 1.0)')} || ').' END AS insight_summary
    FROM gaps g JOIN matches m ON m.query = g.canonical_term)"""


@R.add("gap_texts", f"WITH {S._GAPS}, {_TEXTS} SELECT * FROM texts")
def gap_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Reason and card text of every search term's match."""
    m = materialize(S._matches(spark, sf), "matches")
    ext = S._external(spark, sf).select("source", "raw_term", "canonical_term", "source_score")
    gaps = M.gap_table(ext, m.drop("method")).join(m.select(F.col("query").alias("canonical_term"), "method"), "canonical_term")
    return M.gap_texts(gaps).select("source", "canonical_term", "gap_reason", "insight_summary")


@R.add(
    "gap_filter",
    f"WITH {S._GAPS} SELECT source, canonical_term, match_status, gap_score FROM gaps WHERE match_status IN ('gap', 'weak_match') AND gap_score >= 0.5 AND gap_score <= 1.5 AND source IN ('trends')"
)
def gap_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Gap rows by status, explicit score bounds and source."""
    out = serve.filter_gaps(S._gaps(spark, sf), ("gap", "weak_match"), 0.5, 1.5, (), ("trends",))
    return out.select("source", "canonical_term", "match_status", "gap_score")


_LISTS = (("ai_mode", 15), ("trends", 20))


@R.add(
    "top_lists",
    f"""WITH {S._GAPS}, l AS (
      SELECT source AS list, canonical_term term, source_score score, row_number() OVER (PARTITION BY source ORDER BY source_score DESC NULLS LAST, canonical_term) place FROM best
      UNION ALL SELECT 'opportunities', term, score, row_number() OVER (ORDER BY score DESC NULLS LAST, term) FROM (SELECT canonical_term term, max(gap_score) score FROM gaps WHERE match_status <> 'strong_match' GROUP BY 1))
    SELECT list, place, term, score FROM l WHERE place <= CASE list WHEN 'ai_mode' THEN 15 WHEN 'trends' THEN 20 ELSE 30 END"""
)
def top_lists(spark: SparkSession, sf: str) -> DataFrame:
    """The 15 and 20 highest terms of the two sources and the 30 largest opportunities (top lists are the feature)."""
    terms = S._external(spark, sf).select("source", F.col("canonical_term").alias("term"), F.col("source_score").alias("score"))
    gaps = S._gaps(spark, sf).filter("match_status <> 'strong_match'").groupBy(F.col("canonical_term").alias("term")).agg(F.max("gap_score").alias("score"))
    order = [F.col("score").desc_nulls_last(), F.col("term")]

    def top(df: DataFrame, name: str, n: int) -> DataFrame:
        best = materialize(df.orderBy(*order).limit(n), "top")  # at most n rows
        return M.total_rank(best, F.lit(True), [("score", False), ("term", True)], "place").select(
            F.lit(name).alias("list"), "place", "term", "score"
        )

    out = top(gaps.select("term", "score"), "opportunities", 30)
    for name, n in _LISTS:
        out = out.unionByName(top(terms.filter(F.col("source") == name).select("term", "score"), name, n))
    return out


_TIERS = S.R.sql["supply_demand_gap"]


@R.add(
    "tier_rows",
    f"SELECT opportunity_tier, row_number() OVER (PARTITION BY opportunity_tier ORDER BY gap_score DESC NULLS LAST, term)::INTEGER place, term, gap_score FROM ({_TIERS})"
)
def tier_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The terms of each opportunity tier in order of their gap."""
    t = materialize(S.supply_demand_gap(spark, sf).select("opportunity_tier", "term", "gap_score"), "tiers")
    return serve.placed_by(t, "opportunity_tier", "gap_score", "term").select("opportunity_tier", "place", "term", "gap_score")


@R.add(
    "run_summary",
    f"""WITH {S._GAPS}, tags AS ({S._RECIPE_TAGS}), {RECIPES} SELECT (SELECT count(*) FROM r) n_recipes, (SELECT count(DISTINCT id) FROM tags) n_tagged, (SELECT count(*) FROM tags) n_tags,
    (SELECT count(*) FROM best WHERE source = 'ai_mode') n_ai, (SELECT count(*) FROM best WHERE source = 'trends') n_trends,
    count(*) n_gap_rows, count(*) FILTER (match_status = 'strong_match') n_strong, count(*) FILTER (match_status = 'weak_match') n_weak, count(*) FILTER (match_status = 'gap') n_gap,
    {steady_sql('avg(similarity)')} AS mean_similarity, max(gap_score) max_gap FROM gaps"""
)
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    """One row over all stages of a run: recipes, tags, terms by source, status of the matches."""
    tags, ext = materialize(S._recipe_tags(spark, sf), "tags"), materialize(S._external(spark, sf), "terms")
    one = lambda df, *cols: df.agg(*cols).withColumn("_k", F.lit(1))
    n = F.count(F.lit(1))
    of = lambda s: F.count_if(F.col("match_status") == s)
    parts = [
        one(recipes(spark, sf), n.alias("n_recipes")),
        one(tags, F.count_distinct("id").alias("n_tagged"), n.alias("n_tags")),
        one(ext, F.count_if(F.col("source") == "ai_mode").alias("n_ai"), F.count_if(F.col("source") == "trends").alias("n_trends")),
        one(
            S._gaps(spark, sf), n.alias("n_gap_rows"), of("strong_match").alias("n_strong"), of("weak_match").alias("n_weak"), of("gap").alias("n_gap"),
            steady_round(F.avg("similarity")).alias("mean_similarity"), F.max("gap_score").alias("max_gap"),
        ),
    ]
    out = parts[0]
    for p in parts[1:]:  # tables of one row
        out = out.join(p, "_k")
    return out.drop("_k")


# ----------------------------------------------------------------------------------------------------------- clusters

_RAW_TAGS = f"({S._tags_sql(f'(WITH {S._SEARCHES} SELECT DISTINCT raw_term FROM t)', 'raw_term', 'raw_term')})"


@R.add("cluster_details", f"""WITH RECURSIVE {S._COMPONENTS}, {S._GAPS}, tg AS (SELECT DISTINCT raw_term, tag FROM {_RAW_TAGS}),
    own AS (SELECT component, source, raw_term FROM members JOIN best ON canonical_term = node),
    rw AS (SELECT component, count(DISTINCT raw_term) n_raw, string_agg(DISTINCT source, ', ' ORDER BY source) sources FROM own GROUP BY 1),
    tc AS (SELECT component, tag, count(*) n FROM own JOIN tg USING (raw_term) GROUP BY ALL),
    tt AS (SELECT component, string_agg(tag, '|' ORDER BY k) top_tags FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY n DESC, tag) k FROM tc) WHERE k <= 5 GROUP BY 1),
    per AS (SELECT component, best_term, similarity, match_status FROM members JOIN gaps ON canonical_term = node),
    sc AS (SELECT component, match_status, count(*) n FROM per GROUP BY ALL),
    st AS (SELECT component, match_status AS status FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY n DESC, match_status) k FROM sc) WHERE k = 1),
    bt AS (SELECT component, best_term, similarity FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY similarity DESC, best_term NULLS FIRST) k FROM per) WHERE k = 1),
    lb AS (SELECT component, {title_sql('node')} cluster_label FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY len(string_split(node, ' ')), length(node), node) k FROM members) WHERE k = 1)
    SELECT component, cluster_label, n_raw, sources, top_tags, status, 'Cluster ''' || cluster_label || ''' groups ' || n_raw || ' term(s) from ' || sources || '. Best match: ' || coalesce(best_term, 'none')
      || ' (similarity=' || {_two('coalesce(similarity, 0.0)')} || '). Status: ' || coalesce(status, 'unknown') || '. Tags: ' || coalesce(top_tags, 'none') || '.' AS explanation
    FROM lb JOIN rw USING (component) LEFT JOIN tt USING (component) LEFT JOIN st USING (component) LEFT JOIN bt USING (component)""")  # fmt: skip
def cluster_details(spark: SparkSession, sf: str) -> DataFrame:
    """Sources, frequent tags, most frequent status and explanation of every cluster of terms."""
    members = materialize(S.term_components(spark, sf), "members")
    ext = materialize(S._external(spark, sf), "terms")
    gaps = S._gaps(spark, sf).select("canonical_term", "best_term", "similarity", "match_status")
    return M.cluster_details(members, ext, materialize(gaps, "gaps"))


_SAME = 0.7


@R.add("merged_groups", f"""WITH RECURSIVE n AS (SELECT vec_id node, vec_id - vec_id % 4 AS component FROM embeddings),
    e AS (SELECT a.vec_id u, b.vec_id v FROM embeddings a JOIN embeddings b ON a.vec_id % 4 = 0 AND b.vec_id % 4 = 0 AND a.vec_id <> b.vec_id
      WHERE round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) >= {_SAME}),
    w AS (SELECT DISTINCT component AS node, component AS root FROM n UNION SELECT e.v, w.root FROM w JOIN e ON e.u = w.node WHERE w.root < e.v),
    m AS (SELECT node, min(root) root FROM w GROUP BY node)
    SELECT n.node, root AS component FROM n JOIN m ON m.node = n.component""")  # fmt: skip
def merged_groups(spark: SparkSession, sf: str) -> DataFrame:
    """The second stage of grouping: groups of four whose representatives are alike become one (at a cosine of 0.7)."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    members = v.select(F.col("id").alias("node"), (F.col("id") - F.col("id") % 4).alias("component"))
    return M.merge_groups(members, v, _SAME)


_GRAMS = f"""pad AS (SELECT kind, s, '  ' || s || ' ' p FROM (SELECT DISTINCT 'q' kind, query s FROM qs UNION ALL SELECT DISTINCT 't', term FROM terms) WHERE trim(s) <> ''),
    g AS (SELECT kind, s, (unicode(p[i]) * 961 + unicode(p[i + 1]) * 31 + unicode(p[i + 2])) % {M.TRIGRAM_DIMS} AS b, count(*)::DOUBLE c
      FROM (SELECT kind, s, p, unnest(generate_series(1, length(p) - 2)) i FROM pad) GROUP BY ALL),
    len AS (SELECT kind, s, sqrt(sum(c * c)) l FROM g GROUP BY ALL),
    dot AS (SELECT a.s AS query, b.s term, sum(a.c * b.c) d FROM g a JOIN g b ON a.kind = 'q' AND b.kind = 't' AND a.b = b.b GROUP BY ALL),
    cos AS (SELECT query, term, round(d / x.l / y.l, 9) c FROM dot JOIN len x ON x.kind = 'q' AND x.s = query JOIN len y ON y.kind = 't' AND y.s = term),
    em AS (SELECT query, term, c, row_number() OVER (PARTITION BY query ORDER BY c DESC, term) k FROM cos)"""


@R.add("embedding_match", f"""WITH {S._TERMS}, {_GRAMS} SELECT query, term best_term, {steady_sql('c')} AS similarity, 'embedding' AS method FROM em WHERE k = 1
    UNION ALL SELECT DISTINCT query, NULL, 0.0, 'empty_query' FROM qs WHERE trim(query) = ''""")  # fmt: skip
def embedding_match(spark: SparkSession, sf: str) -> DataFrame:
    """The best term of every asked query by vectors of character trigrams."""
    return M.match_terms(*_asked(spark, sf))


def _asked(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    q = table(spark, sf, "dim_recipe").filter("name is not null").select(X.canonical_strict(S._asked()).alias("query"))
    return q, table(spark, sf, "recipes_clean").select(X.canonical_strict(F.col("name")).alias("term"))


def _no_encoder(_):
    raise RuntimeError("no encoder here")


@R.add("fallback_match", f"WITH {S._MATCHES} SELECT * FROM matches")
def fallback_match(spark: SparkSession, sf: str) -> DataFrame:
    """The lexical match in place of a vector match whose encoder fails."""
    return M.match_terms(*_asked(spark, sf), _no_encoder)


#: The longest common subsequence of x and y, a row of lengths per character of y.
_LCS = """list_last(list_reduce(list_concat([list_transform(generate_series(0, length(x)), lambda i: 0)], list_transform(string_split(y, ''), lambda c: [unicode(c)::BIGINT])),
    lambda row, c: list_transform(generate_series(1, len(row)), lambda i: CASE WHEN i = 1 THEN 0 ELSE greatest(row[i], list_max(list_transform(generate_series(2, i), lambda j: CASE WHEN unicode(x[j - 1]) = c[1] THEN row[j - 1] + 1 ELSE 0 END))) END)))"""


@R.add("token_sort_scores", f"""WITH {S._MATCHES}, s AS (SELECT query, best_term, {S._sorted_sql('query')} x, {S._sorted_sql('best_term')} y FROM matches WHERE method = 'fuzzy')
    SELECT query, best_term, {steady_sql(f'2 * {_LCS}::DOUBLE / (length(x) + length(y))')} AS token_sort FROM s""")  # fmt: skip
def token_sort_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The token-sort ratio of every fuzzy match: insert/delete similarity of the sorted words."""
    pairs = S._matches(spark, sf).filter("method = 'fuzzy'").select("query", "best_term")
    return M.token_sort_scores(pairs, "query", "best_term")


# ----------------------------------------------------------------------------------------------------------- segments

_CATS = list(V.CATEGORIES)


@R.add(
    "category_radar",
    f"WITH {A._PIVOT} SELECT cluster_label, {', '.join(steady_sql(f"avg({steady_sql(f'coalesce({c}, a_{c})')})") + f' AS {c}' for c in _CATS)} FROM p JOIN dim_user USING (user_id), a WHERE cluster_label IS NOT NULL GROUP BY 1"
)
def category_radar(spark: SparkSession, sf: str) -> DataFrame:
    """The five category means of every segment."""
    cats = A.A.recipe_categories(recipes(spark, sf), "id", "ingredients_canonical_list")
    p = A.A.category_profile(A.clean_interactions(spark, sf), cats, "user_id", "recipe_id", _CATS)
    u = table(spark, sf, "dim_user").select("user_id", "cluster_label").filter("cluster_label is not null")
    return p.join(u, "user_id").groupBy("cluster_label").agg(*[steady_round(F.avg(f"avg_rating_{c}")).alias(c) for c in _CATS])


@R.add(
    "selected_segments",
    f"SELECT cluster_label, count(*) n_users, {steady_sql('avg(avg_rating_given)')} AS mean_rating FROM dim_user WHERE cluster_label IN ('Sunday Braiser', 'Quick Skillet Cook') GROUP BY 1"
)
def selected_segments(spark: SparkSession, sf: str) -> DataFrame:
    """The profile rows of the chosen segment labels."""
    chosen = F.col("cluster_label").isin("Sunday Braiser", "Quick Skillet Cook")
    return table(spark, sf, "dim_user").filter(chosen).groupBy("cluster_label").agg(
        F.count(F.lit(1)).alias("n_users"), steady_round(F.avg("avg_rating_given")).alias("mean_rating")
    )


_NAMED = ["avg_rating_given", "recipe_diversity", "pct_positive_sentiment", "active_days"]
_LABELS = [name for _, name in V.SEGMENT_RULES]


@R.add(
    "segment_names",
    f"WITH c AS (SELECT cluster_id, {', '.join(f'round(avg({f}), 9) {f}' for f in _NAMED)} FROM dim_user WHERE cluster_id IS NOT NULL GROUP BY 1)"
    + "".join(
        f", s{k} AS (SELECT cluster_id, '{_LABELS[k]}' AS label FROM c {'WHERE ' + ' AND '.join(f'cluster_id NOT IN (SELECT cluster_id FROM s{j})' for j in range(k)) if k else ''} ORDER BY {f} DESC, cluster_id LIMIT 1)"
        for k, f in enumerate(_NAMED)
    )
    + f" SELECT cluster_id::INTEGER cluster_id, coalesce(label, '{V.SEGMENT_REST}') AS label FROM c LEFT JOIN ({' UNION ALL '.join(f'SELECT * FROM s{k}' for k in range(len(_NAMED)))}) USING (cluster_id)",
)
def segment_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names of the stored segments: each rule takes the unused segment with the highest mean of its feature."""
    t = table(spark, sf, "dim_user").filter("cluster_id is not null").groupBy("cluster_id")
    means = {r["cluster_id"]: r for r in t.agg(*[F.round(F.avg(f), 9).alias(f) for f in _NAMED]).collect()}  # a row per segment
    names = segment_labels(means, tuple(zip(_NAMED, _LABELS, strict=True)))
    return spark.createDataFrame(sorted(names.items()), "cluster_id int, label string")


@R.add("segment_checks", f"WITH {A._PIVOT} SELECT count(*) n_users, 0::BIGINT n_repeated, true AS k_in_range, 0::BIGINT n_shared_labels FROM p")
def segment_checks(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of the fitted segments: every user once, four to six of them, no name of a rule used twice."""
    out = materialize(S.user_segments(spark, sf), "segments")
    labels = out.select("cluster_id", "cluster_label").distinct().filter(F.col("cluster_label") != V.SEGMENT_REST)
    shared = labels.count() - labels.select("cluster_label").distinct().count()
    k = F.count_distinct("cluster_id")
    return out.agg(
        F.count_distinct("user_id").alias("n_users"), (F.count(F.lit(1)) - F.count_distinct("user_id")).alias("n_repeated"),
        k.between(4, 6).alias("k_in_range"), F.lit(shared).cast("bigint").alias("n_shared_labels"),
    )


# -------------------------------------------------------------------------------------------------------- other reads


@R.add(
    "swap_map",
    """WITH s AS (SELECT candidate_ingredient c, substitute_ingredient s, updated_at t FROM serving_substitution_recommendations WHERE candidate_ingredient IS NOT NULL AND substitute_ingredient IS NOT NULL),
    active AS (SELECT c, min(s) s FROM s GROUP BY c), d AS (SELECT c, CASE WHEN s LIKE '%a%' THEN s END s, t FROM s WHERE s LIKE '%e%'),
    last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY t DESC NULLS LAST, s DESC NULLS LAST) k FROM d) WHERE k = 1)
    SELECT c candidate, s substitute FROM active WHERE c NOT IN (SELECT c FROM last) UNION ALL SELECT c, s FROM last WHERE s IS NOT NULL"""
)
def swap_map(spark: SparkSession, sf: str) -> DataFrame:
    """The active swaps after a series of changes: the last change of a candidate sets its substitute or removes it."""
    t = table(spark, sf, "serving_substitution_recommendations").select(
        F.col("candidate_ingredient").alias("candidate"), F.col("substitute_ingredient").alias("substitute"), F.col("updated_at").alias("at")
    ).dropna(subset=["candidate", "substitute"])
    active = t.groupBy("candidate").agg(F.min("substitute").alias("substitute"))
    changes = t.filter(F.col("substitute").contains("e")).withColumn("substitute", F.when(F.col("substitute").contains("a"), F.col("substitute")))
    return serve.apply_swaps(active, changes)


@R.add(
    "picker_batches",
    f"""WITH {RECIPES}, n AS (SELECT DISTINCT substitute_ingredient i FROM serving_substitution_recommendations WHERE substitute_ingredient IS NOT NULL),
    o AS (SELECT id, (row_number() OVER (ORDER BY id) - 1) // 100 AS batch, len(ingredients_canonical_list) >= 9 hit FROM r),
    c AS (SELECT batch, count(*) n FROM o WHERE hit AND batch < 4 GROUP BY 1),
    k AS (SELECT batch FROM (SELECT batch, coalesce(sum(n) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) had FROM c) WHERE had < 120)
    SELECT id, batch::INTEGER batch FROM o WHERE hit AND batch IN (SELECT batch FROM k)"""
)
def picker_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Recipes with nine ingredients or more from the first batches of a hundred, until 120 are found or four are read (this
    accumulation is the feature)."""
    r = recipes(spark, sf).select("id", F.size("ingredients_canonical_list").alias("n"))
    out = serve.first_batches(r, [("id", True)], F.coalesce(F.col("n") >= 9, F.lit(False)), 100, 120, 4)
    return out.select("id", "batch")


@R.add(
    "interest_rows",
    f"""WITH i AS ({S.R.sql['monthly_interest']}), v AS (SELECT source, lower(trim(lang)) q, count(*) n FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL AND fetched_date IS NOT NULL GROUP BY ALL),
    r AS (SELECT source, string_agg(q, '|' ORDER BY n DESC, q) rising FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, q) k FROM v) WHERE k <= 5 GROUP BY 1)
    SELECT i.source, count(*) n_months, {steady_sql('avg(interest)', 2)} AS mean_interest, max(month_end) last_month, any_value(rising) rising FROM i LEFT JOIN r USING (source) GROUP BY i.source"""
)
def interest_rows(spark: SparkSession, sf: str) -> DataFrame:
    """One row per keyword: its months of interest with at most five rising queries (sources and labels of documents stand in)."""
    months = S.R.queries["monthly_interest"](spark, sf)
    docs = table(spark, sf, "documents").filter("source is not null and lang is not null and fetched_date is not null")
    n = docs.groupBy("source", F.lower(F.trim("lang")).alias("q")).agg(F.count(F.lit(1)).alias("n"))
    return serve.with_rising(months, n, "source", "q", "n", 5).groupBy("source").agg(
        F.count(F.lit(1)).alias("n_months"), steady_round(F.avg("interest"), 2).alias("mean_interest"), F.max("month_end").alias("last_month"),
        F.first("rising").alias("rising"),
    )


@R.add(
    "stage_rows",
    "SELECT 'unique' AS prefix, 'unique interactions' AS label, (SELECT count(*) FROM (SELECT DISTINCT interaction_id FROM fact_interactions)) n_rows"
)
def stage_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The row count of the first stage whose label starts with a prefix."""
    facts = table(spark, sf, "fact_interactions")
    stages = [("raw interactions", facts.count()), ("unique interactions", facts.select("interaction_id").distinct().count()), ("unique users", facts.select("user_id").distinct().count())]
    hit = serve.first_stage(stages, "unique")
    return spark.createDataFrame([("unique", *hit)], "prefix string, label string, n_rows bigint")


R.plain("interest_rows", dates=("last_month",))
