"""Operators of the market reads on small made-up tables."""

from pyspark.sql import functions as F

from larder.operators import matching as M
from larder.operators import serving as S


def test_gap_texts_of_every_status(spark):
    rows = [
        ("google_ai", "apple pie recipe", "apple pie", 1.2, "apple pie", 1.0, "strong_match", None, "exact"),
        ("trends", "pear pie", "pear pie", None, "apple pie", 0.625, "weak_match", "low_priority", "fuzzy"),
        ("trends", "x", "x", None, None, 0.0, "gap", "high_priority", "no_token_overlap"),
    ]
    schema = "source string, raw_term string, canonical_term string, source_score double, best_term string, similarity double, match_status string, opportunity_label string, method string"
    got = {r["canonical_term"]: r for r in M.gap_texts(spark.createDataFrame(rows, schema)).collect()}
    assert got["apple pie"]["insight_summary"] == "'apple pie recipe' is well covered (best match: 'apple pie', similarity=1.00)."
    assert "threshold=>=0.60 | status=weak_match | method=fuzzy" in got["pear pie"]["gap_reason"]
    assert got["pear pie"]["insight_summary"].endswith("low priority opportunity per Trends.")
    assert got["x"]["insight_summary"].endswith("high priority opportunity based on Trends signal (source score=1.00).")


def test_groups_merge_by_their_representatives(spark):
    vec = [(1, [1.0, 0.0]), (5, [0.99, 0.05]), (9, [0.0, 1.0])]
    vectors = spark.createDataFrame(vec, "id bigint, embedding array<float>")
    members = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5), (9, 9), (20, 20)], "node bigint, component bigint")
    got = {r["node"]: r["component"] for r in M.merge_groups(members, vectors).collect()}
    assert got == {1: 1, 2: 1, 5: 1, 6: 1, 9: 9, 20: 20}


def test_matching_by_vectors_and_its_fallback(spark):
    q = spark.createDataFrame([("garlic chiken",), ("feta pasta",), ("",), (None,)], "query string")
    t = spark.createDataFrame([("garlic chicken",), ("pasta feta",), ("birria tacos",), ("",), (None,)], "term string")
    got = {r["query"]: (r["best_term"], r["method"]) for r in M.match_terms(q, t).collect()}
    assert got == {"garlic chiken": ("garlic chicken", "embedding"), "feta pasta": ("pasta feta", "embedding"), "": (None, "empty_query")}

    def broken(_):
        raise ImportError("no model")

    methods = {r["query"]: r["method"] for r in M.match_terms(q, t, broken).collect()}
    assert methods["feta pasta"] == "fuzzy" and methods[""] == "empty_query"
    assert M.match_terms(q.limit(0), t).count() == 0


def test_swaps_are_set_and_removed(spark, rows):
    active = spark.createDataFrame([("a", "x"), ("b", "y")], "candidate string, substitute string")
    changes = spark.createDataFrame([("a", "z", 1), ("a", None, 2), ("c", "w", 1)], "candidate string, substitute string, at int")
    assert rows(S.apply_swaps(active, changes)) == [("b", "y"), ("c", "w")]
    assert rows(S.apply_swaps(active, changes.limit(0))) == [("a", "x"), ("b", "y")]


def test_batches_until_enough(spark):
    df = spark.range(100)
    take = lambda wanted, most: sorted(r["id"] for r in S.first_batches(df, [("id", True)], F.col("id") % 2 == 0, 10, wanted, most).collect())
    assert take(6, 9) == list(range(0, 20, 2)) and take(1000, 3) == list(range(0, 30, 2)) and take(1, 9) == list(range(0, 10, 2))
    assert S.first_stage([("raw", 5), ("raw x", 4)], "raw") == ("raw", 5) and S.first_stage([], "r") == (None, None)


def test_terms_that_share_a_hot_segment(spark):
    """Many terms with one word in common: only the similar ones come out."""
    terms = [f"chicken {chr(97 + i % 26)}{chr(97 + i // 26)}{i:04}" for i in range(300)] + ["chicken soup", "chicken soups"]
    got = {(r["a"], r["b"]) for r in M.similar_terms(spark.createDataFrame([(t,) for t in terms], "t string")).collect()}
    ratio = lambda a, b: 1 - edits(" ".join(sorted(a.split())), " ".join(sorted(b.split()))) / max(len(a), len(b))
    want = {(a, b) for a in terms for b in terms if a < b and ratio(a, b) >= 0.85 - 1e-12}
    assert got == want and ("chicken soup", "chicken soups") in got


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]
