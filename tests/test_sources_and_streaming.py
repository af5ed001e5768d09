import json
import zipfile
from collections import Counter
from datetime import datetime

from pyspark.sql import functions as F

from larder.sources import readers as R
from larder.sources import tables as T
from larder.sources import writers as O
from larder.streaming import jobs


def test_csv_with_extra_columns_and_line_breaks(spark, tmp_path, rows):
    p = tmp_path / "i.csv"
    p.write_text('other,review,user_id,recipe_id,date,rating\nx,"two\nlines, ""q""",1,2,2020-01-02,5\ny,,z,3,bad,9\n')
    got = rows(
        R.read_csv(spark, str(p), R.INTERACTIONS).select(
            "user_id", "recipe_id", F.col("date").cast("string"), "rating", "review"
        )
    )
    assert got == [(1, 2, "2020-01-02 00:00:00", 5, 'two\nlines, "q"'), (None, 3, None, 9, None)]


def test_archives_and_missing_sources(spark, tmp_path):
    z = tmp_path / "a.zip"
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("dir/x.csv", "a\n1\n")
    assert R.extract_member(
        str(z), "x.csv", str(tmp_path)
    ).endswith("dir/x.csv") and R.extract_member(str(z), "y.csv", str(tmp_path)) is None
    bad = tmp_path / "b.zip"
    bad.write_text("no zip")
    assert R.extract_member(str(bad), "x", str(tmp_path)) is None and not bad.exists()
    assert R.read_if_there(spark, str(tmp_path / "none")) is None
    got = R.first_available(
        [lambda: R.read_if_there(spark, str(tmp_path / "none")), lambda: 1 / 0, lambda: spark.range(2)], R.RECIPES,
        spark
    )
    assert got.count() == 2 and R.first_available([], R.RECIPES, spark).columns == R.RECIPES.fieldNames()


def test_foods_and_nutrients(spark, tmp_path, rows):
    nested = {
        "description": "Butter", "dataType": "Foundation",
        "foodNutrients": [{"nutrient": {"name": "Protein", "unitName": "g"}, "amount": 1.5}]
    }
    flat = {
        "description": "Salt",
        "foodNutrients": [
            {"nutrientName": "Sodium, Na", "unitName": "MG", "value": 12}, {"nutrientName": "Protein", "value": "n/a"}
        ]
    }
    (tmp_path / "a.json").write_text(json.dumps({"A": [nested]}))
    (tmp_path / "b.json").write_text(json.dumps({"B": [flat]}))
    foods = R.read_foods(
        spark, [(str(tmp_path / "a.json"), "A"), (str(tmp_path / "b.json"), "B"), (str(tmp_path / "c.json"), "C")]
    )
    got = foods.select(
        "description", R.nutrient_amount(F.col("foodNutrients"), ["protein"]),
        R.nutrient_amount(F.col("foodNutrients"), ["sodium"], ["mg"])
    )
    assert rows(got) == [("Butter", 1.5, None), ("Salt", None, 12.0)]
    assert R.read_foods(spark, []).count() == 0


def test_answer_shapes(spark):
    docs = [
        {
            "ai_mode": {
                "text_blocks": [
                    {"title": "t", "snippet": "soup and bread"}, {"text": "ok"}, {"text": "Would you like more"}
                ]
            }
        },
        {"answer": "plain answer"}, {
            "reconstructed_markdown": "1\\. garlic soup", "text_blocks": [{"text": ""}]
        }, {}, {"ai_mode": {"text_blocks": []}, "text": "fallback text"},
    ]
    df = spark.createDataFrame([(json.dumps(d),) for d in docs], "j string").coalesce(1)
    got = [
        [
            (b["block_index"], b["title"], b["body"]) for b in r[0]
        ] for r in df.select(R.answer_blocks(F.col("j"))).collect()
    ]
    assert got == [
        [(0, "t", "soup and bread")], [(0, None, "plain answer")], [(0, None, "1. garlic soup")], [],
        [(0, None, "fallback text")]
    ]


def test_writers(spark, tmp_path, rows):
    p = str(tmp_path / "t")
    O.write_upsert(spark.createDataFrame([(1, "a")], "id int, v string"), p, ["id"], ["v"])
    O.write_upsert(spark.createDataFrame([(1, "b"), (2, "c")], "id int, v string"), p, ["id"], ["v"])
    O.write_upsert(spark.createDataFrame([], "id int, v string"), p, ["id"], ["v"])
    O.write_new_only(spark.createDataFrame([(2, "x"), (3, "d")], "id int, v string"), p, ["id"])
    assert rows(T.read_table(spark, p)) == [(1, "b"), (2, "c"), (3, "d")]
    O.save_metadata(spark, str(tmp_path / "m"), {"k": "1"})
    O.save_metadata(spark, str(tmp_path / "m"), {"k": "2", "l": "3"})
    assert rows(T.read_table(spark, str(tmp_path / "m"))) == [("k", "2"), ("l", "3")]
    O.write_lines(spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "t string"), F.col("t"), str(tmp_path / "l"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "l")).collect()] == ["a", "b"]
    O.write_json(spark.createDataFrame([(1,)], "a int"), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first()["a"] == 1


def test_staleness_and_guard(spark):
    df = spark.createDataFrame([("2020-01-01",)], "d string").select(F.col("d").cast("date").alias("d"))
    assert R.is_stale(df, "d", "2020-01-09") and not R.is_stale(df, "d", "2020-01-08") and R.is_stale(None, "d", "2020-01-01")
    a, b = spark.range(3), spark.range(2)
    assert R.has_new_rows(a, b, ["id"]) and not R.has_new_rows(b, a, ["id"])


def test_stream_is_appended_once(spark, tmp_path, rows):
    src, sink, state = (str(tmp_path / x) for x in ("src", "sink", "state"))
    make = lambda *ids: spark.createDataFrame([(i, 1, 2, 3, 5 if i else 9, 0.5, "x", None) for i in ids], jobs.EVENT)
    make(1, 2, 2, 0).write.parquet(src)
    run = lambda: jobs.start_ingest(jobs.clean_stream(jobs.read_events(spark, src)), sink, state).awaitTermination()
    run()
    make(2, 3).write.mode("append").parquet(src)
    run()
    run()
    got = spark.read.parquet(sink)
    assert rows(got.select("interaction_id", "source", "rating_normalized")) == [(i, "stream", 1.0) for i in (1, 2, 3)]
    batch = got.filter("interaction_id = 1").select("interaction_id", F.lit("batch").alias("source"))
    assert rows(jobs.serve(batch, sink)) == [(1, "batch"), (2, "stream"), (3, "stream")]


def test_counts_hold_over_several_micro_batches(spark, tmp_path, rows):
    day = lambda d: datetime(2024, 1, d, 5)
    data = [(i, i % 3, 2, 3, 5, 0.5, "x", day(1 + i % 4)) for i in range(60)] + [(99, None, 2, 3, 5, 0.5, "x", day(1))]
    src = str(tmp_path / "src")
    spark.createDataFrame(data, jobs.EVENT).repartition(6).write.parquet(src)
    want = sorted(((str(d.date()), u), n) for (d, u), n in Counter((x[7], x[1]) for x in data if x[1] is not None).items())
    read = lambda: jobs.read_events(spark, src, files_per_batch=2)
    sinks = [str(tmp_path / x) for x in ("sums", "latest", "s1", "s2")]
    jobs.start_partial_counts(read(), sinks[0], sinks[2]).awaitTermination()
    jobs.start_latest(jobs.daily_counts(read(), "30 days"), sinks[1], sinks[3]).awaitTermination()
    for df in (jobs.summed(spark, sinks[0]), jobs.latest(spark, sinks[1], ["day", "user_id"])):
        assert sorted(((str(r["day"]), r["user_id"]), r["n"]) for r in df.collect()) == want


def test_a_broken_write_leaves_the_last_version(spark, tmp_path, rows):
    """Rows of the stored table stay, whatever an interrupted write left behind."""
    p = str(tmp_path / "t")
    make = lambda *x: spark.createDataFrame(list(x), "id int, v string")
    O.write_upsert(make((1, "a"), (2, "b")), p, ["id"], ["v"])
    make((9, "junk")).write.parquet(f"{p}/data/v-2/_part=0")  # data without its version file
    assert rows(R.read_if_there(spark, p)) == [(1, "a"), (2, "b")]
    O.write_upsert(make((3, "c")), p, ["id"], ["v"])
    assert rows(T.read_table(spark, p)) == [(1, "a"), (2, "b"), (3, "c")]
    O.replace_parquet(T.read_table(spark, p).filter("id > 1"), p)
    assert rows(T.read_table(spark, p)) == [(2, "b"), (3, "c")]


def test_only_touched_parts_are_written_again(spark, tmp_path, rows):
    p, by = str(tmp_path / "t"), F.floor(F.col("id") / 10)
    make = lambda *x: spark.createDataFrame(list(x), "id int, v string")
    O.write_upsert(make(*[(i, "a") for i in range(40)]), p, ["id"], ["v"], by)
    assert O.write_upsert(make((11, "b"), (12, "b")), p, ["id"], ["v"], by) == ["_part=1"]
    assert O.write_new_only(make((40, "c"), (40, "d"), (1, "z")), p, ["id"], by) == ["_part=0", "_part=4"]
    want = sorted((i, "b" if i in (11, 12) else "a") for i in range(40)) + [(40, "c")]
    assert sorted(tuple(r) for r in T.read_table(spark, p).collect()) == want
    T.vacuum(spark, p, 1)
    assert sorted(tuple(r) for r in T.read_table(spark, p).collect()) == want
