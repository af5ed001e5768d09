import pytest
from pyspark.sql import functions as F

from larder.operators.serving import filter_gaps, filter_recipes, page, page_count, top_gaps


@pytest.fixture
def recipes(spark):
    return spark.createDataFrame(
        [
            ("Garlic Chicken", "chicken|garlic", 20.0, 4.5, "Italian,dinner"),
            ("Slow stew", "beef|pasta", 90.0, None, None), ("Salad", None, None, 3.0, "vegan")
        ],
        "name string, top_ingredients string, avg_cook_minutes double, display_rating double, tags string",
    )


def test_recipe_filters(recipes):
    n = lambda **kw: filter_recipes(recipes, **kw).count()
    assert n() == 3 and n(search="CHICKEN") == 1 and n(search="pasta") == 1 and n(search="nothing") == 0
    assert n(max_minutes=20) == 2 and n(min_rating=4.5) == 1 and n(min_rating=0) == 3
    assert n(tags=("italian",)) == 1 and n(tags=("italian", "vegan")) == 2
    assert filter_recipes(recipes.limit(0), "x", 1, 1, ("a",)).count() == 0


def test_gap_filters_and_pages(spark, recipes):
    g = spark.createDataFrame(
        [
            ("gap", 0.9, "a|b", "x", "p"), ("weak_match", -0.2, None, "y", "q"), ("strong_match", 2.0, "b", "x", "r"),
            ("gap", None, "c", "x", "s")
        ],
        "match_status string, gap_score double, tags string, source string, canonical_term string"
    )
    assert filter_gaps(g).count() == 4 and filter_gaps(g, ("gap",)).count() == 2 and filter_gaps(g, low=0.0).count() == 2
    assert filter_gaps(g, tags=("b",)).count() == 2 and filter_gaps(g, sources=("y",)).count() == 1 and filter_gaps(g, high=1.0).count() == 2
    assert [r["canonical_term"] for r in top_gaps(g, 2).collect()] == ["p", "q"]
    df = spark.range(25)
    ids = lambda k: [r[0] for r in page(df, [F.col("id")], k).collect()]
    assert ids(1) == list(range(10)) and ids(3) == ids(99) == list(range(20, 25)) and ids(0) == ids(1)
    assert page_count(0) == 1 and page_count(20) == 2 and page(recipes.limit(0), [F.col("name")], 5).count() == 0
