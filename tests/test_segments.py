from pyspark.sql import functions as F

from larder.operators.vectors import segment_users


def test_segments_are_fitted_to_all_users(spark):
    """A small group far off, none of it in the sample of the silhouette, is a segment of its own."""
    ids = [r["id"] for r in spark.range(400).orderBy(F.xxhash64("id"), "id").collect()]
    far = set(ids[-8:])
    data = [(i, 100.0 + i % 2, 50.0) if i in far else (i, i % 3 * 10.0 + i % 5 / 10, i % 7 / 10) for i in ids]
    df = spark.createDataFrame(data, "id bigint, x double, y double").repartition(3)
    got = {r["id"]: r["cluster_id"] for r in segment_users(df, "id", ["x", "y"], ks=(4,), sample=50).collect()}
    assert len(got) == 400 and len({got[i] for i in far}) == 1
    assert {i for i in ids if got[i] == got[min(far)]} == far
