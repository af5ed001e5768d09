from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from larder.config import Config
from larder.operators.matching import components
from larder.operators.vectors import segment_labels, similar_vectors
from larder.pipeline import build_once, run_if_new, warehouse_pipeline
from larder.sources.readers import INTERACTIONS, RECIPES
from larder.sources.tables import read_table


def inputs(spark, more=()):
    d = lambda k: datetime(2020, 1, k)
    rows = [
        (1, 10, d(1), 5, "a great pie"), (1, 10, d(1), 5, "a great pie"), (1, 11, d(2), 4, "bland <b>"),
        (2, 10, d(3), 9, "x"), (2, 11, d(3), 1, None), (3, None, d(3), 3, "y"), *more
    ]
    recipes = [
        (10, " Apple  pie ", 9000, "[]", "[1, 2, 3, 4, 5, 6, -7]", "[]", "['Apple', \"baker's sugar\"]"),
        (11, "???", 5, None, None, None, None), (None, "x", 1, None, None, None, None)
    ]
    return spark.createDataFrame(rows, INTERACTIONS), spark.createDataFrame(recipes, RECIPES)


def test_raw_tables_to_warehouse(spark, tmp_path, rows):
    c = Config(output_dir=str(tmp_path / "w"))
    i, r = inputs(spark)
    out = run_if_new(spark, c, i, r)
    assert rows(
        out["fact_interactions"].select("user_id", "recipe_id", "rating")
    ) == [(1, 10, 5), (1, 11, 4), (2, 11, 1)]
    assert rows(
        out["dim_recipe"].select("id", "name", "minutes", "ingredient_count", "carbs_pdv", "review_count")
    ) == [(10, "Apple pie", 4320, 2, None, 1)]
    assert rows(out["dim_user"].select("user_id", "review_count")) == [(1, 2), (2, 1)]
    assert run_if_new(spark, c, i, r, block=True) is None and run_if_new(spark, c, i.limit(0), r) is None
    i2, r2 = inputs(spark, [(5, 10, datetime(2019, 2, 1), 2, "salty")])
    again = run_if_new(spark, c, i2, r2, block=True)
    assert again["fact_interactions"].count() == 4 and sorted(
        map(tuple, again["dim_date"].select("date_id", F.year("full_date")).collect())
    ) == [(1, 2020), (2, 2020), (3, 2020), (4, 2019)]
    assert len(warehouse_pipeline(spark, c).stages) == 12


def test_config_and_build_once(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("LARDER_BOT_ROWS_PER_DAY", "7")
    monkeypatch.setenv("LARDER_REBUILD", "yes")
    c = Config.from_environment()
    assert (c.bot_rows_per_day, c.rebuild, c.pseudo_count) == (7, True, 10.0)
    p, made = str(tmp_path / "t"), []
    for rebuild in (False, False, True):
        build_once(spark, p, lambda: made.append(1) or spark.range(len(made)), rebuild)
    assert len(made) == 2 and read_table(spark, p).count() == 2


def test_similar_vectors_recall_and_classes(spark):
    r = np.random.default_rng(0)
    centres = r.normal(size=(25, 32))
    x = np.concatenate(
        [c + 0.12 * r.normal(size=(12, 32)) for c in centres] + [r.normal(size=(60, 32))]
    ).astype(np.float32)
    data = [(i, [float(v) for v in e]) for i, e in enumerate(x)] + [
        (900, data_copy) for data_copy in [[float(v) for v in x[0]]]
    ] + [(901, None), (902, [0.0] * 32)]
    df = spark.createDataFrame(data, "id bigint, embedding array<float>").repartition(4)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    want = {(i, j) for i in range(len(u)) for j in range(i + 1, len(u)) if u[i] @ u[j] >= 0.92}
    got = {(p["a"], p["b"]) for p in similar_vectors(df, 0.92).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)
    classes = {
        c["node"]: c["component"] for c in components(
            df.select("id"), similar_vectors(df, 0.92).select("a", "b")
        ).collect()
    }
    assert sum(classes[i] == classes[j] for i, j in want) >= 0.99 * len(want)


def test_segment_names(spark):
    row = spark.createDataFrame(
        [(0, 1.0, 2.0), (1, 5.0, 1.0), (2, 3.0, 9.0)],
        "cluster_id int, avg_rating_baking double, avg_rating_protein double"
    )
    c = {r["cluster_id"]: r for r in row.select("cluster_id", "avg_rating_baking", "avg_rating_protein").collect()}
    assert segment_labels(c) == {0: "General Cook", 1: "Indulgent Baker", 2: "Protein-Forward Cook"}
