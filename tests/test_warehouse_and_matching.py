import itertools
import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.operators import matching as M
from larder.operators import vectors as N
from larder.operators import warehouse as W
from larder.operators.tagging import group_z, monthly_interest, phrase_scores, supply_demand_gap


def test_upsert_updates_listed_columns_only_and_repeats_without_effect(spark, rows):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (None, "n", 0)], "id int, name string, n int")
    new = spark.createDataFrame([(2, "B", 20), (3, "c", 30)], "id int, name string, n int")
    once = W.upsert(old, new, ["id"], ["n"])
    want = [(1, "a", 1), (2, "b", 20), (3, "c", 30), (None, "n", 0)]
    assert rows(once) == want and rows(W.upsert(once, new, ["id"], ["n"])) == want
    nulls = spark.createDataFrame([(1, None, None)], "id int, name string, n int")
    assert rows(W.upsert(old, nulls, ["id"], ["name", "n"]).filter("id = 1")) == [(1, None, None)]
    assert rows(W.insert_ignore(old, new, ["id"])) == [(1, "a", 1), (2, "b", 2), (3, "c", 30), (None, "n", 0)]


def test_schema_dates_and_ids(spark, rows):
    df = spark.createDataFrame([("1", 2)], "a string, b int")
    schema = T.StructType(
        [T.StructField("b", T.DoubleType()), T.StructField("a", T.LongType()), T.StructField("c", T.StringType())]
    )
    assert rows(W.conform(df, schema)) == [(2.0, 1, None)]
    days = spark.createDataFrame([("2020-01-02",), ("2020-01-01",), ("2020-01-02",), (None,)], "d string")
    assert [r[0] for r in W.date_dimension(days, "d").orderBy("full_date").collect()] == [1, 2]
    ids = spark.createDataFrame([(1, 2, "2020-01-01")], "u int, r int, d string").select(
        W.interaction_id(F.col("u"), F.col("r"), F.col("d"))
    )
    import hashlib

    assert ids.first()[0] == int(hashlib.sha256(b"1_2_2020-01-01").hexdigest()[:15], 16)
    batch, stream = spark.createDataFrame([(1, "b")], "k int, s string"), spark.createDataFrame(
        [(1, "s"), (2, "s")], "k int, s string"
    )
    assert rows(W.serving_view(batch, stream, "k")) == [(1, "b"), (2, "s")]


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_similar_terms_lose_no_pair(spark, rows):
    r = random.Random(2)
    words = ["garlic", "garlik", "chicken", "chiken", "soup", "soups", "bread", "banana", "bananas", "pie"]
    terms = sorted({" ".join(r.sample(words, r.randint(1, 4))) for _ in range(150)} | {"a", "b", ""})
    df = spark.createDataFrame([(t,) for t in terms] + [(None,)], "term string")
    key = lambda t: " ".join(sorted(t.split(" ")))
    for least in (0.85, 0.7):
        want = set()
        for a, b in itertools.combinations([t for t in terms if t], 2):
            n = max(len(key(a)), len(key(b)))
            if 1 - lev(key(a), key(b)) / n >= least - 1e-12:
                want.add((a, b))
        assert {(x["a"], x["b"]) for x in M.similar_terms(df, least).collect()} == want


def test_components_do_not_hang_on_row_order(spark, rows):
    edges = [(i, i + 1) for i in range(40) if i % 9] + [(100, i) for i in range(101, 160)] + [(None, 1), (5, 5)]
    nodes = [(i,) for i in range(42)] + [(i,) for i in range(100, 160)] + [(None,)]
    parent = {n[0]: n[0] for n in nodes if n[0] is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    want = sorted((n, find(n)) for n in parent)
    for seed in (1, 2):
        random.Random(seed).shuffle(edges)
        got = M.components(spark.createDataFrame(nodes, "node int"), spark.createDataFrame(edges, "a int, b int"))
        assert sorted(tuple(x) for x in got.collect()) == want
    empty = M.components(spark.createDataFrame([(1,)], "node int"), spark.createDataFrame([], "a int, b int"))
    assert rows(empty) == [(1, 1)]


def test_lexical_match_and_gaps(spark, rows):
    q = spark.createDataFrame(
        [("banana bread",), ("garlic soup",), ("",), ("zzz",), (None,), ("banana bread",)], "query string"
    )
    t = spark.createDataFrame([("banana bread",), ("garlic chicken soup",), ("garlic",), (None,)], "term string")
    got = {r["query"]: (r["best_term"], r["method"]) for r in M.lexical_match(q, t).collect()}
    assert got == {
        "banana bread": ("banana bread", "exact"), "garlic soup": ("garlic chicken soup", "fuzzy"),
        "": (None, "empty_query"), "zzz": (None, "no_token_overlap")
    }
    ranked = M.total_rank(
        spark.range(100).withColumn("x", F.col("id") % 7), F.col("id") > 4, [("x", False), ("id", True)], "r"
    ).orderBy("r").filter("r is not null").collect()
    assert [r["r"] for r in ranked] == list(range(1, 96)) and [
        (-r["x"], r["id"]) for r in ranked
    ] == sorted((-r["x"], r["id"]) for r in ranked)


def test_neighbours_equal_brute_force(spark):
    import numpy as np

    r = np.random.default_rng(1)
    v = r.normal(size=(200, 8))
    data = [(i, [float(x) for x in v[i]]) for i in range(200)] + [(900, [0.0] * 8), (901, None)]
    df = spark.createDataFrame(data, "id bigint, embedding array<float>").repartition(5)
    got = N.nearest(df.filter("id % 50 = 0"), df, 3, block=2).collect()
    u = v.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    for q in (0, 50, 100, 150):
        s = u @ u[q]
        s[q] = -9
        assert [
            x["id"] for x in sorted((g for g in got if g["query_id"] == q), key=lambda g: g["rank"])
        ] == list(np.argsort(-s)[:3])
    assert N.nearest(df.limit(0), df, 3).count() == 0


def test_signals(spark, rows):
    blocks = spark.createDataFrame(
        [
            ("Garlic Chicken Soup, banana bread loaf\n1. garlic chicken soup",), ("would you like soup bread",),
            (None,), ("",)
        ],
        "body string"
    )
    assert [
        tuple(r)[:2] for r in phrase_scores(blocks, "body").orderBy("term").collect()
    ] == [("banana bread loaf", 1), ("garlic chicken soup", 2)]
    z = group_z(spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "g string, v double"), ["g"], "v", "z")
    assert rows(z) == [("a", 1.0, -0.707107), ("a", 3.0, 0.707107), ("b", 5.0, 0.0)]
    m = monthly_interest(
        spark.createDataFrame([("a", "2020-01-05", 2), ("a", "2020-03-01", 4)], "k string, d string, v int"), "k", "d",
        "v"
    )
    assert [
        (str(r["month_end"]), r["interest"]) for r in m.orderBy("month_end").collect()
    ] == [("2020-01-31", 2.0), ("2020-02-29", None), ("2020-03-31", 4.0)]
    gap = supply_demand_gap(
        spark.createDataFrame([("x", 2.0), ("y", 0.1)], "term string, combined_score double"),
        spark.createDataFrame([("x", 1), ("z", 3)], "term string, recipe_count int")
    )
    assert rows(gap.select("term", "gap_score", "opportunity_tier")) == [
        ("x", 2.7071, "high"), ("y", 0.1, "low"), ("z", -0.7071, "low")
    ]
