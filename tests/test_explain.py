"""What the physical plans must and must not hold."""

import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import metrics, series
from tidemark.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_no_cartesian_products(spark, name):
    text = plan(catalog.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text
    if name in ("signal_weekly", "lead_lag_corr", "spillover_range_join", "detection_lag_range_join", "posts_in_windows"):
        assert "BroadcastNestedLoopJoin" not in text  # range joins are equi-joins on buckets


def test_scans_read_what_is_needed(spark):
    text = plan(catalog.QUERIES["signal_weekly"](spark, SF))
    assert "props" not in text and "user_id" not in text
    text = plan(catalog.table(spark, SF, "events").where("value > 300").groupBy("event_type").count())
    assert re.search(r"PushedFilters: \[[^]]*GreaterThan\(value,300.0\)", text)


def test_text_rules_stay_in_the_jvm(spark):
    for name in ("clean_text", "scrub_pii", "slang_normalize", "phrase_hits", "risk_label", "rule_classify", "ensemble_vote", "ndcg"):
        assert not re.search("Python|Arrow|Pandas", plan(catalog.QUERIES[name](spark, SF)))


def test_samples_and_seeds_are_cut_before_the_shuffle(spark):
    df = spark.range(1000).withColumn("l", F.col("id") % 3)
    assert "WindowGroupLimit" in plan(metrics.stratified_sample(df, label="l", key="id", n=10))
    assert "WindowGroupLimit" in plan(catalog.seeds(spark, SF))
    assert plan(series.latest_mean(catalog.yearly_rates(spark, SF), key="substance")).count("WindowGroupLimit") >= 1


def test_no_task_sorts_all_scores(spark):
    """Windows over scores are cut by bucket, or keep a bounded number of rows of each task."""
    for name in ("auc_ovr", "roc_points"):
        windows = re.findall(r"windowspecdefinition\(([^,]+(?:, [^,]+)*?), (?:score|__b)#", plan(catalog.QUERIES[name](spark, SF)))
        assert windows
    text = plan(catalog.QUERIES["roc_points"](spark, SF))
    assert not re.search(r"Window \[[^\]]*\], \[label#\d+\], \[score", text)
    assert "TakeOrderedAndProject" in plan(catalog.QUERIES["ndcg"](spark, SF))
    for name in ("topic_prevalence", "describe_scores"):
        assert "percentile" not in plan(catalog.QUERIES[name](spark, SF))
