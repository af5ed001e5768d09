import random
from collections import Counter, defaultdict
from functools import lru_cache

import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larder.llm import packing as K

DOCS = "doc_id bigint, text string, size int, item int, first int"
TEXTS = [
    None, "", " ", "  \n", "Hello world", "it's  we've\n\n a\tb", "x" * 3000, "a b " * 2000, "1.5 + 2.25 = é!  ", "  a 　", "naïve 日本語 テスト 123٣",
    "trailing   ", "\t\tlead", "don't I'll you'd they're 's", "é combining", "\x85\x0b\x1c z", "😀 😀😀", "a​b",
]


def test_tokens_equal_the_published_pattern(spark):
    df = spark.createDataFrame([(i, t, 0, 0, 0) for i, t in enumerate(TEXTS)], DOCS)
    got = {r["doc_id"]: r["n"] for r in df.select("doc_id", K.count_tokens(F.col("text")).alias("n")).collect()}
    assert got == {i: len(regex.findall(K.GPT2_PATTERN, t or "")) for i, t in enumerate(TEXTS)}


def check(rows, sizes, capacity):
    per, seen = defaultdict(list), defaultdict(list)
    for r in rows:
        seen[r["item"]].append((r["piece_no"], r["first"], r["size"]))
        if sizes[r["item"]]:
            per[r["container_id"]].append((r["place"], r["size"]))
        else:
            assert r["container_id"] is None
    for x in per.values():
        assert sum(s for _, s in x) <= capacity and sorted(p for p, _ in x) == list(range(1, len(x) + 1))
    assert sorted(per) == list(range(len(per)))
    for item, pieces in seen.items():
        pieces.sort()
        assert sum(s for *_, s in pieces) == sizes[item] and len(pieces) == max(1, -(-sizes[item] // capacity))
        assert [f for _, f, _ in pieces] == [k * capacity for k in range(len(pieces))]
    assert set(seen) == set(sizes)
    return len(per)


def test_every_item_has_its_place(spark):
    r = random.Random(3)
    sizes = {
        i: r.choice([0, 1, 7, 100, 256, 512, 513, 2000, r.randint(1, 600), r.randint(1, 60)]) for i in range(700)
    } | {10_000 + i: 100 for i in range(400)}
    df = spark.createDataFrame([(i, None, s, 0, 0) for i, s in sizes.items()], DOCS)
    n = check(K.pack(df, "doc_id", F.col("size"), 512).collect(), sizes, 512)
    assert n <= sum(sizes.values()) / 512 * 1.02 + 1
    again = K.pack(df.repartition(7), "doc_id", F.col("size"), 512)
    assert sorted(map(tuple, again.collect()), key=str) == sorted(
        map(tuple, K.pack(df, "doc_id", F.col("size"), 512).collect()), key=str
    )


def test_empty_and_null_sizes(spark):
    df = spark.createDataFrame([(1, None, None, 0, 0), (2, "", 0, 0, 0)], DOCS)
    check(K.pack(df, "doc_id", F.col("size"), 8).collect(), {1: 0, 2: 0}, 8)
    assert K.pack(df.limit(0), "doc_id", F.col("size"), 8).count() == 0


def optimum(sizes, capacity):
    sizes = tuple(sorted(sizes, reverse=True))

    @lru_cache(None)
    def left(rest):
        if not rest:
            return 0
        best = len(rest)
        head, tail = rest[0], rest[1:]

        def fill(k, room, kept):
            nonlocal best
            if k == len(tail):
                best = min(best, 1 + left(kept))
                return
            if tail[k] <= room:
                fill(k + 1, room - tail[k], kept)
            fill(k + 1, room, (*kept, tail[k]))

        fill(0, capacity - head, ())
        return best

    return left(sizes)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9), st.integers(10, 20))
def test_fixed_sets_lose_no_container(sizes, capacity):
    sizes = [min(s, capacity) for s in sizes]
    free = Counter(sizes)
    fixed = K.reduce_instance(free, capacity)
    rest = list(free.elements())
    used = [s for f, n in fixed for s in f * n]
    assert Counter(used) + Counter(rest) == Counter(sizes) and all(sum(f) <= capacity for f, _ in fixed)
    assert sum(n for _, n in fixed) + (optimum(rest, capacity) if rest else 0) == optimum(sizes, capacity)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80))
def test_best_fit_equals_item_by_item(sizes):
    bins = []
    for s in sorted(sizes, reverse=True):
        fit = [b for b in bins if sum(b) + s <= 40]
        if fit:
            max(fit, key=sum).append(s)
        else:
            bins.append([s])
    got = Counter()
    for f, n in K.best_fit(Counter(sizes), 40):
        got[tuple(f)] += n
    assert sum(got.values()) == len(bins) and sum(
        (Counter({s: n * k for s, k in Counter(f).items()}) for f, n in got.items()), Counter()
    ) == Counter(sizes)
