"""The physical plans stay the intended ones."""

from __future__ import annotations

import re

import pytest

from walletlens.operators import aggregates, profile
from walletlens.plans import registry
from walletlens.sources.tables import event_transactions

# Queries that answer in Python by design.
PYTHON = {"generated_text"}


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(plan):
    return len(re.findall(r"Exchange (?:hash|range)partitioning", plan))


@pytest.mark.parametrize("name", ["monthly_stats", "methods_summary", "distinct_users"])
def test_one_shuffle_after_partial_aggregation(spark, sf_dir, name):
    plan = physical(registry.queries()[name](spark, sf_dir))
    assert shuffles(plan) == 1
    assert plan.count("HashAggregate") == 2


def test_profile_scans_once_and_shuffles_twice(spark, sf_dir):
    transactions = event_transactions(spark, sf_dir)
    for operator in (profile.profile_text, profile.nested_profile, aggregates.method_totals):
        plan = physical(operator(transactions))
        assert plan.count("FileScan") == 1
        assert shuffles(plan) == 2
    assert "props" not in plan


def test_requests_read_their_months_and_one_column_of_users(spark, sf_dir):
    asked = spark.createDataFrame([("7", 2024, 1)], "user_id string, year int, month int")
    for operator in (profile.requested_status, profile.requested_profiles):
        plan = physical(operator(event_transactions(spark, sf_dir), asked))
        schemas = re.findall(r"ReadSchema: struct<(.*?)>", plan)
        assert schemas.count("user_id:bigint") == 1
        assert sum("ts:timestamp_ntz" in schema for schema in schemas) == 1
        assert "BroadcastHashJoin" in plan


def test_time_range_reaches_the_scan(spark, sf_dir):
    plan = physical(aggregates.active_users(event_transactions(spark, sf_dir), 2024, 1))
    pushed = re.search(r"PushedFilters: \[(.*?)\]", plan).group(1)
    assert "GreaterThanOrEqual(ts" in pushed and "LessThanOrEqual(ts" in pushed


@pytest.mark.parametrize("name", ["monthly_profile_text", "prompt_render", "generated_text",
                                  "requested_profiles", "approach_override", "report_rows"])
def test_no_products_and_python_only_for_generation(spark, sf_dir, name):
    plan = physical(registry.queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert ("Python" in plan or "MapInPandas" in plan) == (name in PYTHON)


def test_every_query_returns_rows_without_an_oracle(spark, sf_dir):
    without = set(registry.queries()) - set(registry.oracle_sql())
    assert without == {"safety_classifier", "safety_reliability", "text_embedding", "winner_reuse"}


def test_entry(spark):
    import __spark_entry__ as entry_module

    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
