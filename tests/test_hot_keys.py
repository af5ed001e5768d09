import math
import random

from pyspark.sql import functions as F

from larder.operators.hot_keys import located, number_rows, per_key_stats, value_changes
from larder.operators.numbering import number_in_groups
from larder.operators.skew import heavy_keys, sized_join, split_join

SCHEMA = "u bigint, r bigint, x int, s double, field_name string, n_rows int"


def make(n=3000, seed=3):
    r = random.Random(seed)
    pick = lambda: None if r.random() < 0.05 else 7 if r.random() < 0.35 else r.randint(1, 400)
    return [(pick(), pick(), r.choice([None, 1, 5]), r.choice([None, float("nan"), 0.25]), "a", 1) for _ in range(n)]


def test_chunked_results_equal_brute_force(spark, rows):
    data = make()
    df = spark.createDataFrame(data, SCHEMA).repartition(7)
    path = "file:///tmp/larder-hot-keys"
    df.write.mode("overwrite").parquet(path)
    got = {
        (r[0], r[1]): r for r in per_key_stats(
            spark.read.parquet(path), ["u", "r"], ["x", "s"], chunk_rows=100
        ).collect()
    }
    want = {}
    for k, f in enumerate(["u", "r"]):
        for d in data:
            if d[k] is not None:
                w = want.setdefault((f, d[k]), [0, [], []])
                w[0] += 1
                if d[2] is not None:
                    w[1].append(d[2])
                if d[3] is not None and d[3] == d[3]:
                    w[2].append(d[3])
    assert set(got) == set(want)
    mean = lambda v: sum(v) / len(v) if v else None
    for k, (n, x, s) in want.items():
        assert (got[k]["n_rows"], got[k]["mean_x"], got[k]["mean_s"]) == (n, mean(x), mean(s))
    size = min(100, math.ceil(0.01 * sum(w[0] for (f, _), w in want.items() if f == "u")))
    assert got[("u", 7)]["n_chunks"] == -(-want[("u", 7)][0] // size) > 20


def test_numbers_are_exact(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id").repartition(5).sortWithinPartitions("id")
    path = "file:///tmp/larder-numbers"
    df.write.mode("overwrite").parquet(path)
    got = number_rows(located(spark.read.parquet(path)), ["k"]).groupBy("k").agg(
        F.sort_array(F.collect_list("_number")).alias("n")
    ).collect()
    for r in got:
        assert r["n"] == list(range(1, len(r["n"]) + 1))


def test_numbering_by_salt_does_not_hang_on_partitions(spark, rows):
    df = spark.range(500).select((F.col("id") % 2).alias("k"), "id")
    a = number_in_groups(df.repartition(3), ["k"], ["id"])
    b = number_in_groups(df.repartition(8), ["k"], ["id"])
    assert rows(a) == rows(b)
    assert [
        r["n"] for r in a.groupBy("k").agg(F.sort_array(F.collect_list("number")).alias("n")).collect()
    ] == [list(range(250))] * 2


def test_empty_and_all_null(spark):
    assert per_key_stats(spark.createDataFrame([], SCHEMA), ["u", "r"], ["x"]).count() == 0
    assert per_key_stats(spark.createDataFrame([(None, None, 1, 0.1, "a", 1)], SCHEMA), ["u"], ["x"]).count() == 0


def test_heavy_keys_and_split_join(spark, rows):
    df = spark.createDataFrame(
        [(1, i) for i in range(300)] + [(i, i) for i in range(2, 300)] + [(None, 0)], "k int, v int"
    )
    assert [r[0] for r in heavy_keys(df, ["k"], 0.2).collect()] == [1]
    right = spark.createDataFrame([(1, "a"), (5, "b")], "k int, w string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = df.join(right, "k", how)
        assert rows(split_join(df, right, ["k"], how, 0.2).select(*want.columns)) == (
            rows(want) if how in ("inner", "left_semi") else rows(want.filter("k is not null")) + rows(want.filter("k is null"))
        )


def test_ordered_merge_of_chunks(spark):
    data = make(2000, 8)
    path = "file:///tmp/larder-changes"
    spark.createDataFrame(
        [(*d, i) for i, d in enumerate(data)], SCHEMA + ", i int"
    ).coalesce(1).sortWithinPartitions("i").write.mode("overwrite").parquet(path)
    runs = {}
    for d in data:
        for f, k in (("u", d[0]), ("r", d[1])):
            if k is not None:
                runs.setdefault((f, k), []).append(d[2])
    want = {k: (len(v), sum(a != b for a, b in zip(v, v[1:], strict=False)), v[0], v[-1]) for k, v in runs.items()}
    for chunk in (7, 100, 10_000):
        got = {
            (r[0], r[1]): tuple(r[2:]) for r in value_changes(
                spark.read.parquet(path), ["u", "r"], "x", chunk_rows=chunk
            ).collect()
        }
        assert got == want
    mixed = spark.read.parquet(path).repartition(5, "r")
    got = {(r[0], r[1]): tuple(r[2:]) for r in value_changes(mixed, ["u", "r"], "x", ["i"]).collect()}
    assert got == want


def test_every_hot_key_is_chunked_at_any_size(spark):
    for n in (200, 2000):
        rows = [(7 if i % 3 == 0 else i, i, 1, 0.5, "a", 1) for i in range(n)]
        got = {r["key_id"]: r["n_chunks"] for r in per_key_stats(spark.createDataFrame(rows, SCHEMA), ["u"], ["x"]).collect()}
        assert got[7] == math.ceil(sum(1 for r in rows if r[0] == 7) / math.ceil(0.01 * n))


def test_sized_join_is_the_same_with_and_without_broadcast(spark, rows):
    df = spark.createDataFrame([(1, i) for i in range(300)] + [(i, i) for i in range(2, 90)], "k int, v int")
    right = spark.createDataFrame([(1, "a"), (5, "b")], "k int, w string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        a, b = (rows(sized_join(df, right, ["k"], how, limit)) for limit in (0, 10**12))
        assert a == b
