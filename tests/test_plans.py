"""Plan shapes: exchanges, pushed filters, read columns."""

import re

from pyspark.sql import functions as F

from beatlake.operators import beats as B
from beatlake.operators import events as V
from beatlake.plans import q_beats, registry

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"^[\s:+*|-]*(?:\(\d+\) )?Exchange ", plan(df), re.M))


def test_features_share_one_exchange(spark):
    x = B.seizure_features(q_beats.intervals(spark, SF), q_beats.USER, q_beats.ORDER)
    assert exchanges(x) == 1
    assert "Python" not in plan(x) and "Pandas" not in plan(x)


def test_islands_share_one_exchange(spark):
    x = V.event_list(registry.events_table(spark, SF), ["user_id"], ["event_id"], "t", "value", 20.0)
    assert exchanges(x) == 1


def test_filters_and_columns_reach_the_scan(spark):
    x = registry.table(spark, SF, "events").where(F.col("value") > 20).select("user_id", "value")
    p = plan(x)
    assert "GreaterThan(value,20.0)" in p and "ReadSchema: struct<user_id:bigint,value:double>" in p


def test_no_query_makes_cartesian_products(spark):
    for name in ("window_overlap_strict", "coverage_fraction", "offset_grid_search", "band_match", "scoring_table"):
        p = plan(registry.queries()[name](spark, SF))
        assert "CartesianProduct" not in p and "BroadcastNestedLoop" not in p, name
