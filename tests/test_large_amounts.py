"""Amounts of any size: sums equal to math.fsum in any order, through every operator that shows one."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from samples import transaction, transactions
from walletlens.operators import aggregates, analysis, profile
from walletlens.operators.large_amounts import corrected, float_sums, has_large

DAY = dt.datetime(2025, 4, 1)


def sums_of(spark, groups):
    rows = [(name, x) for name, values in groups.items() for x in values]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "name string, x double").repartition(5)
    return {r.name: r.s for r in float_sums(df, ["name"], {"s": F.col("x")}).collect()}


def test_sums_equal_fsum(spark):
    rng = random.Random(2)
    groups = {
        "cancel": [1e300, 1.0, -1e300, 1e-300, 5e-324],
        "money": [rng.randrange(-(10**9), 10**9) / 100 for _ in range(3000)],
        "wide": [math.ldexp(rng.uniform(-1, 1), rng.randrange(-1070, 1020)) for _ in range(3000)],
        "edges": [2.0**k for k in range(-1074, 1023, 31)] + [-(2.0**k) for k in range(-1073, 1023, 64)],
        "tie": [1.0, 2.0**-53],
        "above tie": [1.0, 2.0**-53, 2.0**-1074],
        "largest": [1.7976931348623157e308, -1.7976931348623157e308, 3.0],
        "zero": [0.0, -0.0],
        "trillions": [1e15 + 0.125, 0.1, -1e15],
        "tiny": [5e-324] * 7,
    }
    assert sums_of(spark, groups) == {name: math.fsum(values) for name, values in groups.items()}


def test_sums_that_are_no_finite_number(spark):
    found = sums_of(spark, {"up": [1.7e308, 1.7e308], "down": [-1.7e308] * 2, "inf": [math.inf, 1.0], "nan": [math.nan, 1.0], "none": [None, None], "some": [None, 2.0]})
    assert math.isnan(found.pop("nan"))
    assert found == {"up": math.inf, "down": -math.inf, "inf": math.inf, "some": 2.0}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.floats(allow_nan=False, allow_infinity=False), min_size=1, max_size=40), min_size=1, max_size=20))
def test_any_sums_equal_fsum(spark, lists):
    def expected(values):
        try:
            return math.fsum(values)
        except OverflowError:  # on the way or at the end
            exact = sum(int(math.ldexp(m, 53)) << (e + 1100) for m, e in map(math.frexp, values))
            try:
                return exact / (1 << 1153)
            except OverflowError:
                return math.inf if exact > 0 else -math.inf

    groups = {str(k): values for k, values in enumerate(lists)}
    assert sums_of(spark, groups) == {name: expected(values) for name, values in groups.items()}


@pytest.fixture
def mixed(spark):
    rows = [transaction("big", DAY, "SPEND", "QR", x) for x in (1e300, 0.1, -1e300, 0.2)]
    rows += [transaction("big", DAY, "CASH-IN", "SEND MONEY", x) for x in (1e15, 0.25)]
    rows += [transaction("small", DAY, "SPEND", "QR", x) for x in (0.1, 0.2)]
    rows += [transaction("small", DAY, "CASH-IN", "QR", 1.0)]
    return transactions(spark, rows)


def by_user(df):
    return {row.user_id: row for row in df.collect()}


def test_every_total_takes_large_amounts(mixed):
    spend, cash = math.fsum([0.1, 0.2]), 1e15 + 0.25
    stats = by_user(aggregates.monthly_stats(mixed))
    assert (stats["big"].total_spend, stats["big"].spend_count, stats["big"].total_cash_in) == (spend, 4, cash)
    assert (stats["small"].total_spend, stats["small"].total_cash_in) == (0.3, 1.0)
    methods = {(r.user_id, r.transaction_type): r.total_amount for r in aggregates.methods_summary(mixed).collect()}
    assert methods == {("big", "SPEND"): spend, ("big", "CASH-IN"): cash, ("small", "SPEND"): 0.3, ("small", "CASH-IN"): 1.0}
    nested = by_user(profile.nested_profile(mixed))
    assert (nested["big"].total_spend, nested["big"].total_cash_in) == (spend, cash)
    assert [(m.method, m.total_amount, m["count"]) for m in nested["big"].methods_summary] == [("QR", spend, 4), ("SEND MONEY", cash, 2)]
    assert [m.total_amount for m in nested["small"].methods_summary] == [1.0, 0.3]
    assert "Total cash-in is 1000000000000000.25" in by_user(profile.profile_text(mixed))["big"].profile_text
    savings = by_user(analysis.savings_position(mixed))
    assert savings["big"].savings == math.fsum([1e15, 0.25, -0.1, -0.2]) and savings["small"].savings == 0.7
    flow = {(r.user_id, r.transaction_type): r for r in analysis.cash_flow(mixed).collect()}
    assert flow["big", "SPEND"].method_amount == spend and flow["big", "SPEND"].net_cash == savings["big"].savings
    assert flow["big", "CASH-IN"].share_percent == 100.0
    assert by_user(analysis.transaction_behaviour(mixed))["big"].average_spend == spend / 4
    top = by_user(aggregates.top_spending(mixed))
    assert (top["big"].method_amount, top["small"].method_amount) == (spend, 0.3)
    active = by_user(aggregates.active_user_stats(mixed, 2025, 4))
    assert (active["big"].total_spend, active["big"].total_cash_in, active["small"].total_spend) == (spend, cash, 0.3)


def test_plans_without_large_amounts_stay_as_they_are(mixed):
    small = mixed.filter("user_id = 'small'")
    assert has_large(mixed) and not has_large(small)
    stats = aggregates.exact_stats(small)
    assert corrected(stats, small, (["user_id"], aggregates.both_totals())) is stats
