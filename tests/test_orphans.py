import random
from datetime import datetime, timedelta

from larder.operators.orphans import OrphanTracker, parent_rows, references, track
from larder.session import scratch_path

T0 = datetime(2020, 1, 1)
FACT = "interaction_id bigint, user_id bigint, recipe_id bigint, loaded_at timestamp, key int, ref_field string"
DIM = "recipe_id bigint, loaded_at timestamp, deleted_at timestamp, born int, gone int"


def at(d):
    return T0 + timedelta(days=d)


def test_replayed_history_equals_brute_force(spark, rows):
    r = random.Random(5)
    dim = []
    for k in range(60):
        born = r.randint(0, 300)
        dim.append((k, at(born), at(born + r.randint(1, 100)) if r.random() < 0.4 else None, 0, 0))
    facts = [
        (
            i % 700, 1, 3 if r.random() < 0.3 else r.choice([None, r.randint(0, 80)]), at(r.randint(0, 365)), 0, "x"
        ) for i in range(1000)
    ]
    refs = references(spark.createDataFrame(facts, FACT), "interaction_id", "loaded_at", ["recipe_id"])
    parents = parent_rows(spark.createDataFrame(dim, DIM), "recipe_id", "recipe_id", "loaded_at", "deleted_at")
    lives = {d[0]: d for d in dim}

    def live(k, t):
        d = lives.get(k)
        return d is not None and d[1] <= t and (d[2] is None or d[2] > t)

    want = {(f[0], f[2], f[3]) for f in facts if f[2] is not None and not live(f[2], f[3])}
    for periods in (1, 3):
        t = track(refs, parents, periods)
        got = {(x["interaction_id"], x["key"], x["ref_at"]) for x in t.found().collect()}
        assert got == want
        last = sorted((tuple(x) for x in t.snapshot().collect()), key=lambda x: x[1])[-1]
        end = max(f[3] for f in facts)
        assert last[-1] == sum(1 for f in facts if f[2] is not None and not live(f[2], end))
        new = sum(x["n_new"] for x in t.snapshot().collect())
        assert new == sum(1 for f in facts if f[2] is not None and not live(f[2], f[3]))


def test_arrival_resolves_and_deletion_reopens(spark):
    tracker = OrphanTracker(spark)
    ref = lambda *x: spark.createDataFrame(list(x), "ref_field string, key bigint, interaction_id bigint, ref_at timestamp")
    par = lambda *x: spark.createDataFrame(list(x), "ref_field string, key bigint, born timestamp, gone timestamp")
    tracker.apply(ref(("r", 1, 10, at(1)), ("r", 2, 11, at(1))), par(("r", 2, at(0), None)), at(2))
    tracker.apply(ref(), par(("r", 1, at(3), None)), at(4))
    tracker.apply(ref(), par(("r", 2, at(0), at(5))), at(6))
    got = {
        r["until"]: (r["n_new"], r["n_resolved"], r["n_reopened"], r["n_waiting"]) for r in tracker.snapshot().collect()
    }
    assert got[at(2)] == (1, 0, 0, 1)
    assert got[at(4)] == (0, 1, 0, 0)
    assert got[at(6)] == (0, 0, 1, 1)
    assert [r["interaction_id"] for r in tracker.found().collect()] == [10]


def test_empty_tables_and_nulls(spark):
    none = spark.createDataFrame([], FACT)
    parents = parent_rows(spark.createDataFrame([], DIM), "recipe_id", "recipe_id", "loaded_at", "deleted_at")
    t = track(references(none, "interaction_id", "loaded_at", ["recipe_id"]), parents)
    assert t.found().count() == 0 and t.snapshot().count() == 0
    some = spark.createDataFrame([(1, 1, 5, at(1), 0, ""), (2, 1, None, at(1), 0, ""), (3, 1, 6, None, 0, "")], FACT)
    t = track(references(some, "interaction_id", "loaded_at", ["recipe_id"]), parents)
    assert [(r["interaction_id"], r["key"]) for r in t.found().collect()] == [(1, 5)]


def both(spark):
    ref = lambda *x: spark.createDataFrame(list(x), "ref_field string, key bigint, interaction_id bigint, ref_at timestamp")
    par = lambda *x: spark.createDataFrame(list(x), "ref_field string, key bigint, born timestamp, gone timestamp")
    return ref, par


def test_life_spans_of_equal_birth_stay_apart(spark):
    """A row that is gone says nothing about another row of the same key and birth that is still there."""
    ref, par = both(spark)
    spans = par(("r", 1, at(1), at(3)), ("r", 1, at(1), None))
    tracker = OrphanTracker(spark)
    tracker.apply(ref(("r", 1, 10, at(10))), spans, at(12))
    assert tracker.found().count() == 0 and tracker.pending().count() == 0
    for periods in (1, 2, 3):
        t = track(ref(("r", 1, 10, at(10)), ("r", 1, 11, at(0)), ("r", 1, 12, at(2))), spans, periods)
        assert [r["interaction_id"] for r in t.found().collect()] == [11]
        assert t.pending().count() == 0


def test_state_outlives_its_tracker_and_folds(spark):
    ref, par = both(spark)
    folder = scratch_path(spark, "state")
    one = OrphanTracker(spark, folder)
    one.apply(ref(("r", 1, 10, at(1)), ("r", 2, 11, at(1))), par(("r", 2, at(0), None)), at(2))
    one.compact()
    two = OrphanTracker(spark, folder, limit=0)
    two.apply(ref(("r", 1, 12, at(3))), par(("r", 2, at(0), at(3))), at(4))
    assert sorted(tuple(r) for r in two.pending().collect()) == [("r", 1, 2, 2), ("r", 2, 1, 1)]
    two.compact()
    three = OrphanTracker(spark, folder)
    three.apply(ref(), par(("r", 1, at(5), None)), at(6))
    assert sorted(tuple(r) for r in three.pending().collect()) == [("r", 2, 1, 1)]
    assert sorted(r["interaction_id"] for r in three.found().collect()) == [10, 12]
    got = {r["until"]: (r["n_new"], r["n_resolved"], r["n_reopened"], r["n_waiting"]) for r in three.snapshot().collect()}
    assert got == {at(2): (1, 0, 0, 1), at(4): (1, 0, 1, 3), at(6): (0, 2, 0, 1)}


def test_any_limit_gives_the_same(spark):
    r = random.Random(8)
    ref, par = both(spark)
    refs = ref(*[("r", 3 if r.random() < 0.4 else r.randint(0, 50), i, at(r.randint(0, 99))) for i in range(600)])
    parents = par(*[("r", k, at(r.randint(0, 60)), at(r.randint(61, 90)) if k % 3 == 0 else None) for k in range(40)])
    got = []
    for limit in (0, 10**9):
        t = OrphanTracker(spark, limit=limit)
        t.apply(refs, parents, at(100))
        got.append(sorted(x["interaction_id"] for x in t.found().collect()))
    assert got[0] == got[1] and got[0]
