import math
import random
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from larder.functions import text as X
from larder.functions.vocabulary import TAXONOMY
from larder.operators import quality as Q
from larder.operators.quantiles import exact_quantiles
from larder.operators.sentiment import lexicon_score, model_score, read_lexicon
from larder.operators.tagging import tag_rows, weakly_tagged


def one(spark, expr, *values):
    df = spark.createDataFrame([(v,) for v in values], "t string").coalesce(1)
    return [r[0] for r in df.select(expr(F.col("t"))).collect()]


def test_canonical_terms(spark):
    pairs = {
        "best garlic chicken recipe": "garlic chicken", "easy weeknight pasta recipes": "pasta", "one-pot creamy garlic chicken": "garlic chicken",
        "sheet pan gnocchi with vegetables": "gnocchi vegetables", "banana bread recipe": "banana bread", "30 minute chili": "30 chili",
        "gluten free pizza": "gluten free pizza", "grilled hot chicken": "grilled chicken", "": "", None: "",
    }
    assert one(spark, X.canonical_strict, *pairs) == list(pairs.values())
    assert one(
        spark, X.canonical_loose, "quick chicken and rice dinner ideas", "30-minute pasta"
    ) == ["chicken rice", "pasta"]


def test_html_and_reviews(spark):
    assert one(spark, X.strip_html, "a<b>c") == ["a >c"]
    assert one(spark, lambda t: X.strip_html(t, True), "a<b>c") == ["a c"]
    assert one(
        spark, lambda t: X.short_as_null(X.nfc(X.clean_review(t))), "  x \n y ", None, "z", "été"
    ) == ["x y", None, None, "été"]


def test_filters_of_terms(spark):
    drop = ["how to learn python", "car insurance quotes", "cheap flights", "stock market news"]
    keep = ["banana bread recipe", "ramen recipes", "chicken recipes", "gluten free pizza crust recipe"]
    ok = lambda t: ~X.is_blocked_topic(t) & X.has_food_intent(t)
    assert one(spark, ok, *drop) == [False] * 4 and one(spark, ok, *keep) == [True] * 4
    assert one(spark, X.is_useful_tag, "course", "meat", "for-large-groups", "1-2-servings", "60") == [False] * 5
    assert one(spark, X.is_useful_tag, "italian", "30-minutes-or-less", "affordable-for-groups") == [True] * 3
    assert one(
        spark, X.is_dish_phrase, "garlic butter chicken", "easy meals", "the dish", "ab"
    ) == [True, False, False, False]
    assert one(
        spark, X.is_external_term, "garlic chicken", "would you like more", "12345678a", "x" * 61
    ) == [True, False, False, False]


def test_small_text_functions(spark):
    assert one(spark, X.restore_possessive, "mom s pie", "grandma s", "a s b") == ["mom's pie", "grandma's", "a s b"]
    assert one(spark, X.unescape_markdown, r"1\. a\*b") == ["1. a*b"]
    assert one(
        spark, X.list_literal, "['a', \"b's\"]", "[None, 'x']", "no list", None
    ) == [["a", "b's"], [None, "x"], None, None]
    assert one(spark, X.clean_phrase, " 1. “Garlic  Chicken”, ", "• Soup -") == ["garlic chicken", "soup"]
    df = spark.createDataFrame([("a b", "b a"), ("kitten", "sitting"), ("", "")], "a string, b string")
    assert [
        tuple(round(x, 4) for x in r) for r in df.select(
            X.edit_ratio(F.col("a"), F.col("b")), X.indel_ratio("a", "b")
        ).collect()
    ] == [(1.0, 1.0), (0.5714, 0.6154), (1.0, 1.0)]


def test_taxonomy_and_tags(spark, rows):
    assert len(TAXONOMY) == 29
    df = spark.createDataFrame(
        [(1, "Quick chicken thighs with fried rice"), (2, "sheet pan gnocchi"), (3, None), (4, "water")],
        "id int, name string"
    )
    got = rows(tag_rows(df, F.col("name"), ["id"]))
    assert got == [
        (1, "chicken", "protein_base", "chicken"), (1, "rice", "dish_format", "rice"),
        (2, "pasta", "dish_format", "gnocchi")
    ]
    assert rows(weakly_tagged(df, tag_rows(df, F.col("name"), ["id"]), "id")) == [(2, 1), (3, 0), (4, 0)]


def test_interaction_rules(spark, rows):
    df = spark.createDataFrame(
        [(1, 1, "2020-01-01", 5), (1, 1, "2020-01-01", 4), (2, None, "bad", 7), (3, 3, "2030-01-01", 3)],
        "user_id int, recipe_id int, date string, rating int"
    )
    parsed = Q.parse_dates(df, "date")
    assert parsed.count() == 3
    assert rows(
        Q.keep_first(parsed, ["user_id", "recipe_id", "date"], ["rating"]).select("user_id", "rating")
    ) == [(1, 4), (3, 3)]
    assert Q.not_after(parsed, "date", "2025-01-01").count() == 2 and Q.valid_ratings(df).count() == 3
    assert one(spark, Q.coerce_rating, "2.5", "3.5", "9", "x", None) == [2, 4, None, None, None]
    assert rows(Q.busy_users(parsed, "user_id", F.col("date"), 1)) == [(1,)]
    with pytest.raises(ValueError):
        Q.require_keys(df, ["recipe_id"])
    with pytest.raises(ValueError):
        Q.require_columns(df, ["nothing"])
    assert rows(Q.null_profile(df)) == [("date", 4, 0), ("rating", 4, 0), ("recipe_id", 4, 1), ("user_id", 4, 0)]
    assert rows(Q.date_parts(parsed.filter("user_id = 3"))) == [(3, 3, datetime(2030, 1, 1), 3, 2030, 1, "Tuesday", 1)]


def test_recipe_rules(spark, rows):
    assert [
        tuple(r) for r in spark.createDataFrame(
            [("[1, 2, 3, 4, 5, 6, 7]",), ("[1]",), (None,), ("x",)], "t string"
        ).select(*Q.parse_nutrition(F.col("t"))).collect()
    ] == [(1, 2, 3, 4, 5, 6, 7)] + [(None,) * 7] * 3
    assert one(spark, lambda t: Q.clean_minutes(t.cast("int")), "0", "10", "9999", None) == [None, 10, 4320, None]
    assert one(spark, lambda t: Q.clean_name(t, 5), " a \n b ", "!!!", "abcdefgh", None) == ["a b", None, "abcde", None]
    df = spark.createDataFrame(
        [(i, *[float(i)] * 7) for i in range(100)] + [(100, *[None] * 7), (101, *[float("nan")] * 7)],
        "id int, " + ", ".join(f"{c} double" for c in Q.NUTRITION)
    )
    assert rows(Q.flag_outliers(df).filter("is_outlier").select("id")) == [(i,) for i in range(95, 100)]
    assert df.select(Q.balance_score(df).alias("s")).filter("s is null").count() == 2
    lists = spark.createDataFrame([(1, [" Red  Onion", "salt", "salt"]), (2, []), (3, None)], "id int, l array<string>")
    mapping = spark.createDataFrame([("red onion", "onion")], "raw string, canonical string")
    assert rows(Q.canonical_ingredients(lists, "id", "l", mapping)) == [
        (1, ["onion", "salt", "salt"], "onion|salt|salt", 3)
    ]


def test_sentiment(spark):
    good, no, loud, none, blank, null = one(
        spark, lexicon_score, "a great pie", "not a great pie", "a great pie!!", "pie", " ", None
    )
    assert abs(
        good - 3.1 / (3.1**2 + 15) ** 0.5
    ) < 1e-9 and no < 0 < good < loud and none == 0 and blank is None and null is None
    assert one(
        spark, lambda t: model_score(t, lambda xs: [float(len(x)) for x in xs]), "abc", " ", None
    ) == [3.0, None, None]
    assert len(one(spark, lexicon_score, "good " * 50_000)) == 1


def test_exact_quantiles_interpolate_as_pandas(spark):
    r = random.Random(3)
    data = [(r.choice([None, float("nan"), 0.0, -0.0, 1.5, r.gauss(0, 9)]), float(r.randint(0, 3)), None) for _ in range(500)]
    df = spark.createDataFrame(data, "a double, b double, c double").repartition(5)
    got = exact_quantiles(df, ["a", "b", "c"], [0.0, 0.25, 0.5, 0.95, 1.0])
    p = pd.DataFrame(data, columns=["a", "b", "c"]).astype("float64")
    for (c, q), v in got.items():
        assert v is None if c == "c" else math.isclose(v, p[c].quantile(q), abs_tol=1e-12)
    assert exact_quantiles(df.limit(0), ["a"], [0.5]) == {("a", 0.5): None}


def test_indel_ratio_equals_the_longest_common_subsequence():
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            prev = row
            row = [0]
            for j, y in enumerate(b):
                row.append(prev[j] + 1 if x == y else max(prev[j + 1], row[j]))
        return row[-1]

    r = random.Random(4)
    for _ in range(300):
        a, b = ("".join(r.choice("abc d") for _ in range(r.randint(0, 12))) for _ in range(2))
        want = 1.0 if not a and not b else 2 * lcs(a, b) / (len(a) + len(b))
        assert X._indel(a, b) == want


def test_title_case_and_lexicon_file(spark, tmp_path):
    df = spark.createDataFrame([("30chili o'brien b-c é",), (None,)], "x string")
    assert [r[0] for r in df.select(X.title_case(F.col("x"))).collect()] == ["30Chili O'Brien B-C É", None]
    (tmp_path / "l.txt").write_text("good\t1.9\t0.9\t[1]\n:)\t2.0\t1\t[2]\nBad\t-2.5\t0.6\t[3]\n")
    assert read_lexicon(str(tmp_path / "l.txt")) == {"good": 1.9, "bad": -2.5}
