"""Features are dealt by transcript once, to tasks of bounded size."""

import pytest
from pyspark.sql import functions as F

from locusflow import store
from locusflow.plans import bindings as B
from locusflow.plans import catalog
from tests.conftest import SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["custom_feature", "feature_order_5to3", "feature_first_last", "utr_split", "relative_axis"])
def test_features_are_dealt_once(spark, monkeypatch, name):
    monkeypatch.setattr(store, "TASK_ROWS", 50)
    n = B.table(spark, SMALL, "lineitem").count()
    assert B.features(spark, SMALL).rdd.getNumPartitions() >= n // 50
    most = B.features(spark, SMALL).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < 50 * 4
    assert "ENSURE_REQUIREMENTS" not in plan(catalog.QUERIES[name](spark, SMALL))
