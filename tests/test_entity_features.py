import random
from collections import defaultdict
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from larder.operators.entity_features import EntityFeatures, EventColumns
from larder.session import scratch_path

SCHEMA = "interaction_id bigint, user_id bigint, event_type string, full_date date, rating int, sentiment_score double, loaded_at int, n int, bucket string"


def make(n, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        user = 1 if r.random() < 0.4 else r.randint(2, 30)
        day = None if r.random() < 0.05 else date(2020, 1, 1) + timedelta(days=r.randint(0, 400))
        score = r.choice([None, float("nan"), round(r.uniform(-1, 1), 3)])
        row = (i, user, r.choice(["view", "save", None]), day, r.choice([None, 1, 3, 5]), score)
        out += [(*row, k, 0, "x") for k in range(r.choice([1, 1, 2]))]
    return out


def brute(rows, lo=None, hi=None):
    seen, acc = set(), defaultdict(lambda: {"n": 0, "rated": 0, "s": [], "last": None, "types": defaultdict(int)})
    for i, user, kind, day, rating, score, *_ in rows:
        if i in seen or i is None or user is None:
            continue
        if (lo or hi) and (day is None or not lo <= day <= hi):
            continue
        seen.add(i)
        a = acc[user]
        a["n"] += 1
        a["rated"] += rating is not None
        if score is not None and score == score:
            a["s"].append(score)
        if day and (a["last"] is None or day > a["last"]):
            a["last"] = day
        if kind:
            a["types"][kind] += 1
    return acc


def check(features, rows, lo=None, hi=None):
    want = brute(rows, lo, hi)
    got = {r["entity"]: r for r in features.collect()}
    assert set(got) == set(want)
    for k, a in want.items():
        g = got[k]
        assert (g["n_events"], g["review_count"], g["last_day"]) == (a["n"], a["rated"], a["last"])
        assert (g["avg_score"] is None) == (not a["s"])
        if a["s"]:
            assert abs(g["avg_score"] - sum(a["s"]) / len(a["s"])) < 1e-9
        assert {t: v["n"] for t, v in g["by_type"].items()} == dict(a["types"])


def test_against_brute_force_and_ranges(spark):
    rows = make(600)
    df = spark.createDataFrame(rows, SCHEMA)
    state = EntityFeatures(spark, scratch_path(spark, "t"), bucket_days=30)
    state.refresh(df)
    check(state.features(), rows)
    lo, hi = date(2020, 2, 10), date(2020, 9, 3)
    check(state.features(str(lo), str(hi), df), rows, lo, hi)


def test_only_changed_buckets_are_computed_again(spark):
    rows = make(300)
    state = EntityFeatures(spark, scratch_path(spark, "t"), bucket_days=30)
    first = state.refresh(spark.createDataFrame(rows, SCHEMA))
    assert len(first) > 5
    assert state.refresh(spark.createDataFrame(rows, SCHEMA)) == []
    more = [*rows, (10_000, 1, "view", date(2020, 1, 15), 5, 0.5, 0, 0, "x")]
    again = state.refresh(spark.createDataFrame(more, SCHEMA))
    assert len(again) == 1
    check(state.features(), more)
    fewer = [r for r in more if r[3] is None or r[3].month != 3]
    state.refresh(spark.createDataFrame(fewer, SCHEMA))
    check(state.features(), fewer)


def test_empty_table_and_null_keys(spark):
    state = EntityFeatures(spark, scratch_path(spark, "t"))
    assert state.refresh(spark.createDataFrame([], SCHEMA)) == []
    assert state.features().count() == 0
    other = EntityFeatures(spark, scratch_path(spark, "t"))
    other.refresh(
        spark.createDataFrame(
            [
                (None, 1, "a", None, 1, 0.1, 0, 0, ""), (1, None, "a", None, 1, 0.1, 0, 0, ""),
                (2, 5, None, None, None, None, 0, 0, "")
            ],
            SCHEMA
        )
    )
    got = other.features().select("entity", "n_events", F.size("by_type")).collect()
    assert [tuple(r) for r in got] == [(5, 1, 0)]


def test_a_bucket_that_lost_its_events_is_empty(spark):
    """The last event of a bucket loses its entity: the stored aggregate must not stay."""
    rows = [(1, 7, "view", date(2020, 1, 5), 5, 0.5, 0, 0, "x"), (2, 8, "view", date(2020, 6, 5), 4, 0.1, 0, 0, "x")]
    state = EntityFeatures(spark, scratch_path(spark, "t"), bucket_days=30)
    state.refresh(spark.createDataFrame(rows, SCHEMA))
    rows[0] = (1, None, *rows[0][2:])
    assert len(state.refresh(spark.createDataFrame(rows, SCHEMA))) == 1
    assert [r["entity"] for r in state.features().collect()] == [8]
    state.vacuum()
    assert [r["entity"] for r in state.features().collect()] == [8]


def test_refresh_by_load_time_sees_new_rows_only(spark):
    schema = SCHEMA.replace("loaded_at int", "loaded_at timestamp")
    t = lambda d: datetime(2021, 1, d)
    rows = [(i, i % 3, "view", date(2020, 1 + i % 6, 5), 5, 0.5, t(1), 0, "x") for i in range(30)]
    columns = EventColumns(loaded="loaded_at")
    state = EntityFeatures(spark, scratch_path(spark, "t"), columns, bucket_days=30)
    first = state.refresh(spark.createDataFrame(rows, schema))
    rows += [(100, 1, "save", date(2020, 3, 6), 1, 0.2, t(2), 0, "x"), (0, 0, "view", date(2020, 1, 5), 5, 0.5, t(3), 0, "x")]
    again = state.refresh(spark.createDataFrame(rows, schema))
    assert len(again) == 2 < len(first)
    check(state.features(), rows)
    assert state.refresh(spark.createDataFrame(rows, schema)) == []
    rows = rows[1:]  # deleted in place: only a full comparison sees it
    rows = [r for r in rows if r[0] != 0]
    assert state.refresh(spark.createDataFrame(rows, schema)) == []
    assert len(state.refresh(spark.createDataFrame(rows, schema), verify=True)) >= 1
    check(state.features(), rows)


def test_days_before_1970_are_no_missing_dates(spark):
    rows = [(1, 7, "view", date(1969, 12, 30), 5, 0.5, 0, 0, "x"), (2, 7, "view", None, 5, 0.5, 0, 0, "x")]
    state = EntityFeatures(spark, scratch_path(spark, "t"), bucket_days=30)
    state.refresh(spark.createDataFrame(rows, SCHEMA))
    assert state.features("1960-01-01", "1979-12-31").first()["n_events"] == 1
    check(state.features(), rows)
