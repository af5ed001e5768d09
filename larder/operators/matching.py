"""Matching of terms: token-blocked lexical match, exact edit-distance join, connected components, cluster rollup."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions import text as X
from larder.functions.numeric import steady_round
from larder.functions.vocabulary import (
    HIGH_PRIORITY,
    MEDIUM_PRIORITY,
    SAME_TERM,
    SAME_VECTOR,
    STRONG_MATCH,
    WEAK_MATCH,
)
from larder.operators.vectors import linked_vectors, nearest
from larder.session import materialize, release


def lexical_match(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """(query, best_term, similarity, method) for each distinct query; ``queries`` has query, ``terms`` has term.

    Equal terms match at once. The rest is blocked by shared tokens; of the terms that share one, the best by the
    larger of token Jaccard and edit ratio wins, the smaller term on ties. No cap is put on candidates; every pair is
    scored once, in the task where it meets, and only the best of a query per task is shuffled.
    """
    q = queries.select("query").filter("query is not null").distinct().withColumn(
        "_qt", F.array_distinct(X.match_tokens(F.col("query")))
    )
    t = terms.select("term").filter("term is not null and term <> ''").distinct().withColumn(
        "_tt", F.array_distinct(X.match_tokens(F.col("term")))
    )
    exact = q.join(t, q["query"] == t["term"]).select(
        "query", F.col("term").alias("best_term"), F.lit(1.0).alias("similarity"), F.lit("exact").alias("method")
    )
    rest = q.join(t.select(F.col("term").alias("query")), "query", "left_anti")
    qx = rest.select("query", "_qt", F.explode("_qt").alias("tok"))
    tx = t.select("term", "_tt", F.explode("_tt").alias("tok"))
    # a pair is scored where its first shared token meets, and the best of a query is kept in every task before the shuffle
    once = F.col("tok") == F.array_min(F.array_intersect("_qt", "_tt"))
    score = F.greatest(X.token_jaccard(F.col("_qt"), F.col("_tt")), X.edit_ratio(F.col("query"), F.col("term")))
    scored = qx.join(tx, "tok").filter(once).select("query", "term", steady_round(score).alias("similarity"))
    best = scored.groupBy("query").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "term")).alias("b"))
    fuzzy = best.select(
        "query", F.col("b.term").alias("best_term"), (-F.col("b.s")).alias("similarity"), F.lit("fuzzy").alias("method")
    )
    none = rest.join(best.select("query"), "query", "left_anti").select(
        "query", F.lit(None).cast("string").alias("best_term"), F.lit(0.0).alias("similarity"),
        F.when(F.trim("query") == "", "empty_query").otherwise("no_token_overlap").alias("method"),
    )
    return exact.unionByName(fuzzy).unionByName(none)


def match_status(s: Column) -> Column:
    return F.when(s >= STRONG_MATCH, "strong_match").when(s >= WEAK_MATCH, "weak_match").otherwise("gap")


def gap_table(terms: DataFrame, matches: DataFrame) -> DataFrame:
    """Search terms with their best match: status, gap score = source score x (1 - similarity), label, rank of the gaps.

    The rank is over all rows that are no strong match, by gap score, then source, then term.
    """
    rows = terms.join(matches, terms["canonical_term"] == matches["query"]).drop("query")
    rows = rows.withColumn("match_status", match_status(F.col("similarity")))
    rows = rows.withColumn("gap_score", steady_round(F.col("source_score") * (1 - F.col("similarity"))))
    label = F.when(F.col("match_status") == "strong_match", None).when(
        F.col("gap_score") >= HIGH_PRIORITY, "high_priority"
    )
    label = label.when(F.col("gap_score") >= MEDIUM_PRIORITY, "medium_priority").otherwise("low_priority")
    rows = rows.withColumn("opportunity_label", label)
    return total_rank(
        rows, F.col("match_status") != "strong_match",
        [("gap_score", False), ("source", True), ("canonical_term", True)], "top_gap_rank"
    )


def total_rank(df: DataFrame, which: Column, order: list[tuple[str, bool]], name: str) -> DataFrame:
    """Adds a rank over all rows of ``which`` (null elsewhere) without a window over the whole table: rows are
    range-partitioned by the order, numbered in their partition, and shifted by the sizes of the partitions before."""
    cols = [F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in order]
    inside = materialize(
        df.filter(which).repartitionByRange(*cols).withColumn("_part", F.spark_partition_id()), "ranges"
    )
    local = inside.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(*cols)))
    sizes = inside.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row per partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    ranked = local.join(F.broadcast(offsets), "_part").withColumn(name, (F.col("_off") + F.col("_in")).cast("bigint"))
    rest = df.filter(~F.coalesce(which, F.lit(False))).withColumn(name, F.lit(None).cast("bigint"))
    return ranked.select(*df.columns, name).unionByName(rest)


def similar_terms(terms: DataFrame, least: float = SAME_TERM) -> DataFrame:
    """(a, b, similarity), a < b: all pairs of distinct terms whose edit ratio is at least ``least``, none lost.

    A pair of sorted-word forms of up to n characters differs by at most d = (1 - least) n edits, so of d + 1 segments
    of the shorter one at least one stands unchanged in the other, shifted by at most d. Pairs meet only on such a
    segment; no group is compared all with all.
    """
    t = terms.select(F.col(terms.columns[0]).alias("term")).filter("term is not null and term <> ''").distinct()
    t = materialize(
        t.withColumn("s", F.array_join(F.array_sort(F.split("term", " ")), " ")).withColumn("n", F.length("s")), "terms"
    )
    loss = 1 - least

    def cuts(n: Column) -> Column:
        """Edits that a partner of at most n / least characters may be away."""
        return F.floor(n / least * loss + 1e-9).cast("int")

    d = cuts(F.col("n"))
    k = F.least(d + 1, F.col("n"))
    segment = lambda i: F.struct(
        i.alias("i"), F.col("s").substr(
            F.floor(i * F.col("n") / k).cast("int") + 1,
            (F.floor((i + 1) * F.col("n") / k) - F.floor(i * F.col("n") / k)).cast("int")
        ).alias("seg"),
        F.floor(i * F.col("n") / k).cast("int").alias("at"),
    )
    index = t.select(
        "term", "s", "n", F.explode(F.transform(F.sequence(F.lit(0), k - 1), segment)).alias("x")
    ).select("term", "s", "n", d.alias("d"), "x.*")
    # the longer partner looks for the segments of each shorter length it may meet
    short = F.sequence(F.greatest(F.lit(1), F.ceil(F.col("n") * least - 1e-9).cast("int")), F.col("n"))
    probe = t.select("term", "s", "n", F.explode(short).alias("m"))
    dm = cuts(F.col("m"))
    km = F.least(dm + 1, F.col("m"))
    probe = probe.withColumn("dm", dm).withColumn("km", km).withColumn(
        "i", F.explode(F.sequence(F.lit(0), F.col("km") - 1))
    )
    lo, hi = F.floor(F.col("i") * F.col("m") / F.col("km")).cast("int"), F.floor(
        (F.col("i") + 1) * F.col("m") / F.col("km")
    ).cast("int")
    shifts = F.sequence(F.greatest(F.lit(0), lo - F.col("dm")), F.least(F.col("n") - (hi - lo), lo + F.col("dm")))
    probe = probe.filter(F.least(F.col("n") - (hi - lo), lo + F.col("dm")) >= F.greatest(F.lit(0), lo - F.col("dm")))
    probe = probe.select(
        "term", "s", "n", "m", "i", F.explode(F.transform(shifts, lambda p: F.col("s").substr(p + 1, hi - lo))).alias("seg")
    ).distinct()
    near = index.select(
        F.col("term").alias("x"), F.col("s").alias("xs"), F.col("n").alias("m"), "i", "seg"
    ).join(probe.withColumnsRenamed({"term": "y", "s": "ys"}), ["m", "i", "seg"])
    # candidates are judged where they meet, so that only similar pairs are shuffled, however many share a segment
    edits = F.expr(f"levenshtein(xs, ys, cast(floor(n * {loss!r} + 1e-9) as int))")
    pairs = near.filter((F.col("x") != F.col("y")) & (edits >= 0)).select(
        F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")
    ).distinct()
    r = X.edit_ratio(F.col("a"), F.col("b"))
    return pairs.withColumn("similarity", steady_round(r)).filter(r >= least)


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component): the smallest node of each connected component; ``nodes`` has node, ``edges`` a and b.

    Alternates hooking every node's larger neighbours to its smallest, and smaller ones likewise, which halves paths
    in each round; each round is a written table, and rounds end when nothing changes. A node with a third of all
    edges is combined before the shuffle (minimum per node), never collected.
    """
    e = materialize(
        edges.select(
            F.col("a").alias("u"), F.col("b").alias("v")
        ).filter("u is not null and v is not null and u <> v").distinct(),
        "edges"
    )

    def hook(e: DataFrame, larger: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        if not larger:
            both = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        j = both.join(low, "u")
        out = j.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not larger:
            out = j.select(
                F.col("v").alias("u"), F.col("m").alias("v")
            ).unionByName(low.select("u", F.col("m").alias("v")))
        return out.filter("u <> v").distinct()

    mark = None
    for _ in range(rounds):
        old, e = e, materialize(hook(hook(e, True), False), "edges")
        release(old)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.groupBy("u").agg(F.min("v").alias("component"))
    n = nodes.select(F.col(nodes.columns[0]).alias("node")).filter("node is not null").distinct()
    return n.join(roots, n["node"] == roots["u"], "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )


def cluster_rollup(members: DataFrame, gaps: DataFrame) -> DataFrame:
    """One row per component: representative (fewest words, then shortest), size, gap statistics, best match, number.

    ``members`` has node, component; ``gaps`` has canonical_term, gap_score, similarity, best_term, match_status.
    Numbers go by size from 0.
    """
    per = gaps.groupBy("canonical_term").agg(
        F.count(F.lit(1)).alias("k"), F.sum("gap_score").alias("gs"), F.max("gap_score").alias("gm"),
        F.sum((F.col("match_status") == "strong_match").cast("int")).alias("st"),
        F.max_by("best_term", F.struct("similarity", "best_term")).alias("bt"), F.max("similarity").alias("bs"),
    )
    rows = members.join(per, members["node"] == per["canonical_term"], "left")
    shape = F.struct(F.size(F.split("node", " ")).alias("w"), F.length("node").alias("l"), "node")
    out = rows.groupBy("component").agg(
        F.min(shape).alias("r"), F.count(F.lit(1)).alias("n_terms"),
        steady_round(F.sum("gs") / F.nullif(F.sum("k"), F.lit(0))).alias("mean_gap"), F.max("gm").alias("max_gap"),
        F.coalesce(F.sum("st"), F.lit(0)).alias("n_strong"),
        F.max_by("bt", F.struct("bs", "bt")).alias("best_term"),
    ).select(F.col("r.node").alias("representative_term"), "n_terms", "mean_gap", "max_gap", "n_strong", "best_term")
    ranked = total_rank(out, F.lit(True), [("n_terms", False), ("representative_term", True)], "_r")
    return ranked.withColumn("cluster_no", F.col("_r") - 1).drop("_r")


def gap_texts(gaps: DataFrame) -> DataFrame:
    """Adds ``gap_reason``, the figures behind a row's status, and ``insight_summary``, a sentence for its card.

    ``gaps`` has the columns of ``gap_table`` and method. Numbers have two digits; a missing source score counts as 1.
    """
    two = lambda c: F.format_string("%.2f", steady_round(c, 2))
    q = lambda c: F.concat(F.lit("'"), F.coalesce(F.col(c), F.lit("")), F.lit("'"))
    status, sim = F.col("match_status"), two(F.col("similarity"))
    bound = F.when(status == "strong_match", f">={STRONG_MATCH:.2f}").when(status == "weak_match", f">={WEAK_MATCH:.2f}")
    reason = F.concat_ws(
        " | ", F.concat(F.lit("raw="), q("raw_term")), F.concat(F.lit("canonical="), q("canonical_term")),
        F.concat(F.lit("best_match="), q("best_term")), F.concat(F.lit("similarity="), sim),
        F.concat(F.lit("threshold="), bound.otherwise(f"<{WEAK_MATCH:.2f}")), F.concat(F.lit("status="), status),
        F.concat(F.lit("method="), F.col("method")),
    )
    of = X.title_case(F.regexp_replace("source", "_", " "))
    chance = F.regexp_replace("opportunity_label", "_", " ")
    strong = F.concat(q("raw_term"), F.lit(" is well covered (best match: "), q("best_term"), F.lit(", similarity="), sim, F.lit(")."))
    weak = F.concat(
        q("raw_term"), F.lit(" has a partial match ("), q("best_term"), F.lit(", similarity="), sim, F.lit("); "), chance, F.lit(" opportunity per "), of, F.lit(".")
    )
    none = F.concat(
        q("raw_term"), F.lit(" has no strong match (similarity="), sim, F.lit("); "), chance, F.lit(" opportunity based on "), of,
        F.lit(" signal (source score="), two(F.coalesce("source_score", F.lit(1.0))), F.lit(")."),
    )
    text = F.when(status == "strong_match", strong).when(status == "weak_match", weak).otherwise(none)
    return gaps.withColumns({"gap_reason": reason, "insight_summary": text})


def merge_groups(members: DataFrame, vectors: DataFrame, least: float = SAME_VECTOR) -> DataFrame:
    """(node, component): groups whose representatives have a cosine of at least ``least``, joined to the smallest of their
    components.

    ``members`` has node and component; ``vectors`` has id and embedding of the representatives, id being the component's
    smallest node. A group whose representative has no vector stays as it is.
    """
    reps = members.select(F.col("component").alias("node")).distinct()
    known = vectors.join(reps, vectors["id"] == reps["node"], "left_semi")
    merged = components(reps, linked_vectors(known, least)).select(
        F.col("node").alias("component"), F.col("component").alias("_to")
    )
    return members.join(merged, "component").select("node", F.col("_to").alias("component"))


#: Length of the vectors of ``trigram_vector``.
TRIGRAM_DIMS = 64


def trigram_vector(x: Column, dims: int = TRIGRAM_DIMS) -> Column:
    """Counts of the character trigrams of a blank-padded text, hashed to ``dims`` places: an encoder that needs no model."""
    s = F.concat(F.lit("  "), x, F.lit(" "))
    at = lambda i, k: F.ascii(F.substring(s, i + k, F.lit(1))).cast("bigint")
    place = lambda i: F.pmod(at(i, 0) * 961 + at(i, 1) * 31 + at(i, 2), F.lit(dims))
    places = F.transform(F.sequence(F.lit(1), F.length(s) - 2), place)
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda b: F.size(F.filter(places, lambda p: p == b)).cast("float"))


def embedding_match(queries: DataFrame, terms: DataFrame, encode: Callable[[Column], Column] = trigram_vector) -> DataFrame:
    """(query, best_term, similarity, method) for each distinct query: the term of highest cosine between encoded texts.

    ``queries`` has query, ``terms`` has term. The queries are a stated set, held against all terms in blocks; ties go to
    the smaller term. An empty query matches nothing.
    """
    q = queries.select("query").filter("query is not null").distinct()
    t = terms.select("term").filter("term is not null and trim(term) <> ''").distinct()
    named = materialize(total_rank(t, F.lit(True), [("term", True)], "id"), "terms")
    asked = materialize(total_rank(q.filter("trim(query) <> ''"), F.lit(True), [("query", True)], "id"), "queries")
    vectors = lambda df, c, sign: df.select((F.col("id") * sign).alias("id"), encode(F.col(c)).alias("embedding"))
    best = nearest(vectors(asked, "query", -1), vectors(named, "term", 1), 1)
    found = best.select((-F.col("query_id")).alias("id"), F.col("id").alias("_t"), "similarity")
    hit = asked.join(found, "id", "left").drop("id").join(named.withColumnRenamed("id", "_t"), "_t", "left").select(
        "query", F.col("term").alias("best_term"), steady_round(F.coalesce("similarity", F.lit(0.0))).alias("similarity"),
        F.lit("embedding").alias("method"),
    )
    blank = q.filter("trim(query) = ''").select(
        "query", F.lit(None).cast("string").alias("best_term"), F.lit(0.0).alias("similarity"), F.lit("empty_query").alias("method")
    )
    return hit.unionByName(blank)


def match_terms(queries: DataFrame, terms: DataFrame, encode: Callable[[Column], Column] | None = trigram_vector) -> DataFrame:
    """The embedding match where there is an encoder that works, else the lexical one."""
    if encode is not None:
        try:
            return embedding_match(queries, terms, encode)
        except Exception as e:  # an encoder may be missing on the cluster
            logging.getLogger(__name__).warning("no embedding match (%s), falling back to the lexical one", e)
    return lexical_match(queries, terms)


def token_sort_scores(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Adds ``token_sort``: insert/delete similarity over sorted words, the published token-sort ratio."""
    return pairs.withColumn("token_sort", steady_round(X.indel_ratio(F.col(a), F.col(b))))


def cluster_details(members: DataFrame, terms: DataFrame, gaps: DataFrame) -> DataFrame:
    """One row per component: label, sources, raw terms, the five most frequent tags, the most frequent status, explanation.

    ``members`` has node, component; ``terms`` has source, raw_term, canonical_term, tags (joined by bars); ``gaps`` has
    canonical_term, best_term, similarity, match_status. Counts per value come before anything is put into a list.
    """
    own = members.join(terms, members["node"] == terms["canonical_term"]).select("component", "source", "raw_term", "tags")
    base = own.groupBy("component").agg(F.count_distinct("raw_term").alias("n_raw"))
    sources = own.select("component", "source").distinct().groupBy("component").agg(
        F.array_join(F.array_sort(F.collect_list("source")), ", ").alias("sources")
    )
    tags = own.select("component", F.explode(F.split("tags", "[|]")).alias("tag")).filter("tag <> ''")
    tags = tags.groupBy("component", "tag").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("component").orderBy(F.col("n").desc(), "tag")
    top = tags.withColumn("k", F.row_number().over(w)).filter("k <= 5").groupBy("component").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "tag"))), lambda s: s["tag"]), "|").alias("top_tags")
    )
    per = members.join(gaps, members["node"] == gaps["canonical_term"])
    status = per.groupBy("component", "match_status").agg(F.count(F.lit(1)).alias("n")).groupBy("component").agg(
        F.min_by("match_status", F.struct(-F.col("n"), "match_status")).alias("status")
    )
    best = per.groupBy("component").agg(
        F.max("similarity").alias("similarity"), F.min_by("best_term", F.struct(-F.col("similarity"), "best_term")).alias("best_term")
    )
    shape = F.struct(F.size(F.split("node", " ")).alias("w"), F.length("node").alias("l"), "node")
    label = members.groupBy("component").agg(X.title_case(F.min(shape)["node"]).alias("cluster_label"))
    out = label.join(base, "component").join(sources, "component")
    for df in (top, status, best):
        out = out.join(df, "component", "left")
    text = F.concat(
        F.lit("Cluster '"), F.col("cluster_label"), F.lit("' groups "), F.col("n_raw").cast("string"), F.lit(" term(s) from "), F.col("sources"),
        F.lit(". Best match: "), F.coalesce("best_term", F.lit("none")), F.lit(" (similarity="),
        F.format_string("%.2f", steady_round(F.coalesce("similarity", F.lit(0.0)), 2)), F.lit("). Status: "), F.coalesce("status", F.lit("unknown")),
        F.lit(". Tags: "), F.coalesce("top_tags", F.lit("none")), F.lit("."),
    )
    return out.select("component", "cluster_label", "n_raw", "sources", "top_tags", "status", text.alias("explanation"))
