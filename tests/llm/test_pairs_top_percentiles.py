import itertools
import math
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from larder.llm import cooccurrence as C
from larder.llm import percentiles as P
from larder.llm import top_items as T

BASKETS = "field_name string, basket bigint, item string, size int, n int"


def brute_pairs(data, min_pairs, min_share):
    by = defaultdict(set)
    for f, b, i, *_ in data:
        if b is not None and i is not None:
            by[f, b].add(i)
    n, one, two = Counter(), Counter(), Counter()
    for (f, _), items in by.items():
        n[f] += 1
        one.update((f, i) for i in items)
        two.update((f, a, b) for a, b in itertools.combinations(sorted(items, key=lambda s: s.encode()), 2))
    return {
        (f, a, b): (k, one[f, a], one[f, b], n[f]) for (f, a, b),
        k in two.items() if k >= min_pairs and k >= min_share * n[f]
    }


def test_pairs_equal_brute_force_with_huge_baskets(spark):
    r = random.Random(4)
    data = []
    for b in range(120):
        for i in r.sample(range(60), 45 if b < 6 else r.randint(0, 6)):
            data += [("x", b, f"é{i}" if i % 2 else f"i{i}", 1, 1)] * r.choice([1, 1, 2])
    data += [
        ("y", 1, "a", 0, 0), ("y", 1, "b", 0, 0), ("y", None, "a", 0, 0), ("y", 2, None, 0, 0), ("y", 3, "only", 0, 0)
    ]
    df = spark.createDataFrame(data, BASKETS)
    for min_pairs, share, chunk, limit in ((1, 0.0, 10, 0), (3, 0.03, 7, 10**9), (1, 0.0, 500, 10**9)):
        want = brute_pairs(data, min_pairs, share)
        got = C.cooccurrence(df, min_pairs, share, chunk, limit).collect()
        assert {
            (x["field_name"], x["item_a"], x["item_b"]): (x["n_ab"], x["n_a"], x["n_b"], x["n_baskets"]) for x in got
        } == want
        assert len(got) == len(want)
        for x in got:
            assert math.isclose(
                x["lift"], x["n_ab"] * x["n_baskets"] / x["n_a"] / x["n_b"]
            ) and -1.0001 <= x["npmi"] <= 1.0001


def test_no_pairs(spark):
    assert C.cooccurrence(spark.createDataFrame([], BASKETS)).count() == 0
    assert C.cooccurrence(spark.createDataFrame([("x", 1, "a", 0, 0)], BASKETS), 1).count() == 0


SCORES = "c string, s string, score double, at timestamp, grp string, rank int, band int"


def test_top_items_with_ties_repeats_and_a_hot_group(spark):
    r = random.Random(7)
    t0 = datetime(2020, 1, 1)
    data = []
    for _ in range(3000):
        g = "hot" if r.random() < 0.4 else f"g{r.randint(0, 200)}"
        data.append(
            (
                g, f"s{r.randint(0, 300)}", r.choice([None, float("nan"), 0.5, round(r.random(), 2)]),
                t0 + timedelta(days=r.randint(0, 50)), "z", 0, 0
            )
        )
    data += data[:200] + [
        (None, "a", 1.0, t0, "", 0, 0), ("n", None, 1.0, t0, "", 0, 0), ("n", "late", None, None, "", 0, 0),
        ("n", "x", 0.1, None, "", 0, 0)
    ]
    last = {}
    for g, s, v, at, *_ in data:
        if g is not None and s is not None:
            v = None if v is None or v != v else v
            k = (at is not None, at or t0, v is not None, v or 0)
            if (g, s) not in last or k > last[g, s][0]:
                last[g, s] = (k, v)
    by = defaultdict(list)
    for (g, s), (_, v) in last.items():
        if v is not None:
            by[g].append((-v, s))
    want = {(g, s, k + 1) for g, x in by.items() for k, (_, s) in enumerate(sorted(x)[:5])}
    rows = T.latest_scores(spark.createDataFrame(data, SCORES), "c", "s", "score", "at")
    for kw in ({}, {"limit": 0}, {"bands": 100, "limit": 0}, {"bands": 2}):
        got = T.top_n(rows, 5, **kw).collect()
        assert {(x["grp"], x["item"], x["rank"]) for x in got} == want and len(got) == len(want)


def test_runs_of_bands_follow_the_open_places():
    assert T._run([10] * 10, 0, 5) == 1 and T._run([10] * 10, 0, 1000) == 6 and T._run([10] * 10, 8, 1000) == 10
    at, ends = 0, []
    while at < 20:
        at = T._run([100] * 20, at, 10**9)
        ends.append(at)
    assert ends == [12, 16, 20]


def test_chunk_pairs_hold_no_more_than_two_chunks(spark):
    rows = spark.createDataFrame([("x", 1, f"i{k:04}", 0, 0) for k in range(2000)], BASKETS).select("field_name", "basket", "item")
    got = C._chunk_pairs(rows, 100, 10**9).select("lo", "hi", "n_left", F.size("items").alias("n")).collect()
    assert len(got) == 20 * 21 // 2 and max(x["n"] for x in got) < 300
    inside = sum(x["n"] * (x["n"] - 1) // 2 for x in got if x["lo"] == x["hi"])
    assert inside + sum(x["n_left"] * (x["n"] - x["n_left"]) for x in got if x["lo"] < x["hi"]) == 2000 * 1999 // 2


def test_top_items_of_one_score_and_of_nothing(spark):
    flat = spark.createDataFrame([("g", f"s{i:03}", 1.0) for i in range(500)], "grp string, item string, score double")
    assert sorted(x["item"] for x in T.top_n(flat, 3).collect()) == ["s000", "s001", "s002"]
    assert T.top_n(flat.limit(0), 3).count() == 0


VALUES = "tag string, a double, b double, key bigint, prefix int"


def nearest_rank(v, p):
    v = sorted(v)
    return v[max(1, -(-p * len(v) // 100)) - 1]


def test_percentiles_equal_nearest_rank(spark):
    r = random.Random(9)
    number = lambda: r.choice([None, float("nan"), 0.0, -0.0, -3.5, 1e300, -1e-300, r.gauss(0, 10), float(r.randint(0, 5))])
    data = [
        (r.choice(["x", "y", None, "hot", "hot"]), number(), number(), 1, 1) for _ in range(800)
    ] + [("inf", float("inf"), -float("inf"), 1, 1), ("one", 4.0, None, 0, 0)]
    df = spark.createDataFrame(data, VALUES)
    pcts = [1, 10, 50, 90, 100]
    by = defaultdict(list)
    for t, a, b, *_ in data:
        for f, v in (("a", a), ("b", b)):
            if v is not None and v == v:
                by[f, t].append(v)
    values = P.keyed_values(df, "tag", ["a", "b"])
    for bits in (16, 8):
        got = {
            (x["field_name"], x["grp"], x["pct"]): x["value"] for x in P.radix_percentiles(values, pcts, bits).collect()
        }
        assert got == {(f, t, p): nearest_rank(v, p) for (f, t), v in by.items() for p in pcts}


def test_summaries_of_days_add_up_within_their_bound(spark):
    r = random.Random(1)
    parts = [
        spark.createDataFrame([("g", r.lognormvariate(0, 2), 0.0, 0, 0) for _ in range(300)], VALUES) for _ in range(3)
    ]
    whole = P.keyed_values(parts[0].union(parts[1]).union(parts[2]), "tag", ["a"])
    merged = P.merge_summaries(*[P.summary(P.keyed_values(p, "tag", ["a"])) for p in parts])
    assert sorted(merged.collect()) == sorted(P.summary(whole).collect())
    exact = {x["pct"]: x["value"] for x in P.radix_percentiles(whole, [50, 90]).collect()}
    for x in P.summary_percentiles(merged, [50, 90]).collect():
        assert x["low"] <= exact[x["pct"]] <= x["high"] and x["high"] / x["low"] <= 1 + 2**-4 + 1e-9


def test_no_values(spark):
    empty = spark.createDataFrame([("x", None, float("nan"), 0, 0)], VALUES)
    assert P.radix_percentiles(P.keyed_values(empty, "tag", ["a", "b"]), [50]).count() == 0
    keys = spark.createDataFrame(
        [(v,) for v in (-float("inf"), -2.0, -1.0, 0.0, 1.0, 2.0)], "v double"
    ).select("v", P.ordered_key("v").alias("k"))
    got = keys.orderBy(F.expr("shiftrightunsigned(k, 1)")).select("v", P.key_value("k")).collect()
    assert [x[0] for x in got] == [x[1] for x in got] == [-float("inf"), -2.0, -1.0, 0.0, 1.0, 2.0]
