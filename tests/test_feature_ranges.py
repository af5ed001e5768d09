from datetime import date

import pytest

from larder.operators.entity_features import EntityFeatures
from larder.session import scratch_path
from test_entity_features import SCHEMA


def test_a_range_that_cuts_a_bucket_needs_the_events(spark):
    df = spark.createDataFrame([(i, 1, "view", date(2020, 1, i), 5, 0.5, 0, 0, "x") for i in range(1, 31)], SCHEMA)
    state = EntityFeatures(spark, scratch_path(spark, "t"), bucket_days=30)
    state.refresh(df)
    with pytest.raises(ValueError):
        state.features("2020-01-02", "2020-01-29")
    assert state.features("2019-12-01", "2020-03-31").first()["n_events"] == 30
