"""Aggregates, profiles and analyses: golden figures and literal rows."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from samples import SAMPLE_USER, sample, transaction, transactions
from walletlens.functions.numbers import exact_sum
from walletlens.operators import aggregates, analysis, profile

DAY = dt.datetime(2025, 4, 1)


def month_of(spark, spend, cash_in):
    """One user's month from {method: (amount, count)} per type; counts split the amount."""
    rows = []
    for kind, methods in (("SPEND", spend), ("CASH-IN", cash_in)):
        for method, (amount, count) in methods.items():
            rows += [transaction("u", DAY, kind, method, amount / count)] * count
    return transactions(spark, rows)


def test_sample_totals_and_ratio(spark):
    row = aggregates.monthly_stats(sample(spark)).first()
    assert (row.total_spend, row.spend_count) == (680.4237, 8)
    assert (row.total_cash_in, row.cash_in_count) == (965.5426, 4)
    assert round(analysis.savings_position(sample(spark)).first().spend_ratio, 6) == 0.704706


def shares(df):
    return {(r.transaction_type, r.transaction_method): round(r.share_percent, 2) for r in df.collect()}


def test_sample_shares(spark):
    assert shares(aggregates.method_share_amount(sample(spark))) == {
        ("SPEND", "SEND MONEY"): 64.40,
        ("SPEND", "QR"): 33.99,
        ("SPEND", "MAYA SHOP"): 1.61,
        ("CASH-IN", "BANK TRANSFER"): 90.42,
        ("CASH-IN", "SEND MONEY"): 9.58,
    }
    assert shares(aggregates.method_share_count(sample(spark))) == {
        ("SPEND", "SEND MONEY"): 50.0,
        ("SPEND", "QR"): 37.5,
        ("SPEND", "MAYA SHOP"): 12.5,
        ("CASH-IN", "BANK TRANSFER"): 75.0,
        ("CASH-IN", "SEND MONEY"): 25.0,
    }


def test_sample_profile_text(spark):
    row = profile.profile_text(sample(spark)).first()
    assert row.has_data
    assert row.profile_text == (
        f"User {SAMPLE_USER} monthly transactions Summary (Timestamp: 2025-04)\n"
        "- Total spend is 680.42 with 8 transactions\n"
        "- Spending methods include maya shop with 1.61%, qr with 33.99%, send money with 64.40%\n"
        "- Total cash-in is 965.54 with 4 transactions\n"
        "- Cash-in methods include bank transfer with 90.42%, send money with 9.58%\n"
        "- User tags: professional hustlers, loan and gaming, prudent planners"
    )


def texts(spark, *rows):
    return {
        r.user_id: r.profile_text for r in profile.profile_text(transactions(spark, list(rows))).collect()
    }


def test_profile_text_without_totals_tags_or_data(spark):
    found = texts(
        spark,
        transaction("free", DAY, "SPEND", "QR", 0.0),
        transaction("fees", DAY, "FEE", "QR", 5.0, "A"),
        transaction("back", DAY, "SPEND", "QR", -5.0, "B_B"),
        transaction("back", DAY, "CASH-IN", "QR", 5.0, "A_A"),
        transaction("back", DAY, "FEE", "CARD", 5.0, ""),
    )
    assert found["fees"] == "User fees (2025-04)\nNo transaction data found for this period."
    assert found["free"] == (
        "User free monthly transactions Summary (Timestamp: 2025-04)\n"
        "- Total spend is 0.00 with 1 transactions\n"
        "- No spending methods recorded or zero total spend.\n"
        "- Total cash-in is 0.00 with 0 transactions\n"
        "- No cash-in methods recorded or zero total cash-in.\n"
        "- User tags: Not available"
    )
    assert found["back"] == (
        "User back monthly transactions Summary (Timestamp: 2025-04)\n"
        "- Total spend is -5.00 with 1 transactions\n"
        "- No spending methods recorded or zero total spend.\n"
        "- Total cash-in is 5.00 with 1 transactions\n"
        "- Cash-in methods include qr with 100.00%\n"
        "- User tags: a a, b b"
    )


def test_nested_profile(spark):
    row = profile.nested_profile(sample(spark)).first()
    methods = [(m.method, m.type, m["count"], m.total_amount) for m in row.methods_summary]
    assert methods == [
        ("BANK TRANSFER", "CASH-IN", 3, 873.0413),
        ("MAYA SHOP", "SPEND", 1, 10.9305),
        ("QR", "SPEND", 3, 231.2798),
        ("SEND MONEY", "CASH-IN", 1, 92.5013),
        ("SEND MONEY", "SPEND", 4, 438.2134),
    ]
    assert row.segments == ["PROFESSIONAL_HUSTLERS, LOAN_AND_GAMING, PRUDENT_PLANNERS"]
    assert (row.spend_count, row.cash_in_count) == (8, 4)


def test_exact_sum(spark):
    source = random.Random(3)
    cases = {
        "money": [source.randrange(-(10**9), 10**9) / 10000 for _ in range(5000)],
        "fine": [0.00000001] * 1000,
        "mixed": [1e11 + 0.25, -1e11, 0.0001, 0.1, 0.2],
        "tenths": [0.1] * 1000,
        "tiny": [1e-9] * 5000,
        "long": [0.1234567891234],
    }
    rows = [(name, x) for name, values in cases.items() for x in values]
    df = spark.createDataFrame(rows, "name string, x double").repartition(7)
    found = df.groupBy("name").agg(exact_sum(F.col("x")).cast("double").alias("s")).collect()
    money = sum(round(x * 10000) for x in cases["money"]) / 10000
    assert {r.name: r.s for r in found} == {
        "money": money, "fine": 0.00001, "mixed": 0.5501, "tenths": 100.0,
        "tiny": 0.000005, "long": 0.12345679,
    }


def test_exact_sum_leaves_large_amounts_out(spark):
    rows = [(x,) for x in (1.5, None, 1e12, -1e300, float("nan"), float("inf"))]
    assert spark.createDataFrame(rows, "x double").agg(exact_sum(F.col("x")).cast("double")).first()[0] == 1.5


def test_active_users(spark):
    rows = [transaction("a", DAY, "SPEND", "QR", 10.0)] * 2 + [transaction("a", DAY, "FEE", "QR", 1.0)]
    rows += [transaction("b", DAY, "CASH-IN", "QR", 5.0)] * 3
    rows += [transaction("c", DAY, "SPEND", "QR", 50.0)] * 2
    rows += [transaction("d", dt.datetime(2025, 5, 1), "SPEND", "QR", 50.0)] * 9
    t = transactions(spark, rows)

    def users(**options):
        return [r.user_id for r in aggregates.active_users(t, 2025, 4, **options).collect()]

    assert users() == ["a", "b"]
    assert users(min_transactions=2) == ["a", "b", "c"]
    assert users(min_transactions=2, min_spend=20) == ["a", "c"]
    assert users(min_cash_in=15) == ["b"]
    assert users(min_transactions=1, max_users=1) == ["a"]
    with pytest.raises(ValueError):
        aggregates.active_users(t, 2025, 13)


def test_requested_users(spark):
    t = transactions(
        spark,
        [
            transaction("a", DAY, "SPEND", "QR", 1.0),
            transaction("a", dt.datetime(2025, 5, 1), "FEE", "QR", 1.0),
        ],
    )
    asked = spark.createDataFrame(
        [("a", 2025, 4), ("a", 2025, 5), ("a", 2025, 6), ("z", 2025, 4), ("a", 2025, 4)],
        "user_id string, year int, month int",
    )
    for threshold in ("10MB", "-1"):  # the requests broadcast, and joined by shuffle
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            rows = profile.requested_profiles(t, asked).collect()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        found = {(r.user_id, r.month): (r.status, r.answer) for r in rows}
        assert len(rows) == 4
        assert found["a", 4][0] == "ok" and found["a", 4][1].startswith("User a monthly")
        none = "\nNo transaction data found for this period."
        assert found["a", 5] == ("no_data", "User a (2025-05)" + none)
        assert found["a", 6] == ("no_data", "User a (2025-06)" + none)
        assert found["z", 4] == ("unknown_user", "Error: User ID z not found in the database.")


def test_cash_flow_figures(spark):
    t = month_of(
        spark,
        {"SEND MONEY": (300.0, 4), "QR": (225.0, 3), "MAYA SHOP": (75.0, 1)},
        {"BANK TRANSFER": (750.0, 1), "SEND MONEY": (250.0, 1)},
    )
    rows = analysis.cash_flow(t).collect()
    assert {r.net_cash for r in rows} == {400.0}
    assert {(r.transaction_type, r.transaction_method): (r.method_amount, r.share_percent) for r in rows} == {
        ("SPEND", "SEND MONEY"): (300.0, 50.0),
        ("SPEND", "QR"): (225.0, 37.5),
        ("SPEND", "MAYA SHOP"): (75.0, 12.5),
        ("CASH-IN", "BANK TRANSFER"): (750.0, 75.0),
        ("CASH-IN", "SEND MONEY"): (250.0, 25.0),
    }


def test_behaviour_figures(spark):
    t = month_of(
        spark,
        {"QR": (480.0, 6), "SEND MONEY": (240.0, 3), "MAYA SHOP": (80.0, 1)},
        {"BANK TRANSFER": (300.0, 1), "SEND MONEY": (300.0, 2)},
    )
    row = analysis.transaction_behaviour(t).first()
    assert (row.total_transactions, row.cash_in_count, row.spend_count) == (13, 3, 10)
    assert row.top_spending == "QR, SEND MONEY, MAYA SHOP"
    assert (row.average_spend, row.transactions_per_day) == (80.0, 13 / 30)
    top = aggregates.top_spending(t, 2).orderBy("rank").collect()
    assert [(r["rank"], r.transaction_method, r.method_amount) for r in top] == [
        (1, "QR", 480.0), (2, "SEND MONEY", 240.0)
    ]


@pytest.mark.parametrize(
    ("spend", "cash_in", "percent", "savings", "rate", "status"),
    [
        (600.0, 1000.0, 60.0, 400.0, 40.0, "meets guideline"),
        (800.0, 600.0, 133.33, -200.0, -33.33, "overspent"),
        (27096.75, 33000.67, 82.11, 5903.92, 17.89, "below guideline"),
    ],
)
def test_savings_figures(spark, spend, cash_in, percent, savings, rate, status):
    t = month_of(spark, {"QR": (spend, 1)}, {"QR": (cash_in, 1)})
    row = analysis.savings_position(t).first()
    assert (round(row.spend_percent, 2), row.savings) == (percent, savings)
    assert (round(row.savings_percent, 2), row.savings_status) == (rate, status)


def test_no_income(spark):
    row = analysis.savings_position(month_of(spark, {"QR": (5.0, 1)}, {})).first()
    assert (row.spend_ratio, row.spend_percent, row.savings_percent) == (None, None, None)
    assert row.savings_status == "no income"


@pytest.mark.parametrize("chunk_size", [1, 3, 7, 1000])
def test_amount_lists_against_brute_force(spark, chunk_size):
    """A hot user with many equal rows, ties in time, and users with a row or two."""
    source = random.Random(chunk_size)
    rows = [transaction("hot", DAY, "SPEND", "QR", 2.5)] * 40
    for _ in range(120):
        user = source.choice(["hot", "hot", "b", "c"])
        moment = dt.datetime(2025, 4, source.randrange(1, 4))
        kind = source.choice(["SPEND", "CASH-IN", "FEE"])
        rows.append(transaction(user, moment, kind, "QR", source.randrange(-50, 200) / 8))
    rows.append(transaction("single", DAY, "SPEND", "QR", None))
    lists = {}
    for row in sorted(rows, key=lambda r: (r[1], r[4] or 0.0)):
        if row[2] != "FEE":
            lists.setdefault((row[0], row[2]), []).append(f"{row[4] or 0.0:.2f}")
    expected = {
        (user, kind, number): ", ".join(values[number * chunk_size : (number + 1) * chunk_size])
        for (user, kind), values in lists.items()
        for number in range(-(-len(values) // chunk_size))
    }
    found = analysis.amount_lists(transactions(spark, rows).repartition(5), chunk_size).collect()
    assert len(found) == len(expected)
    assert {(r.user_id, r.transaction_type, r.chunk): r.amounts for r in found} == expected
    assert all(r.n_amounts == len(r.amounts.split(", ")) for r in found)


def test_shares_add_up(spark, sf_dir):
    from walletlens.sources.tables import event_transactions

    share = aggregates.method_share_amount(event_transactions(spark, sf_dir))
    sums = share.groupBy("user_id", "year", "month", "transaction_type").agg(
        F.sum("share_percent").alias("total")
    )
    assert sums.filter(F.abs(F.col("total") - 100) > 1e-9).count() == 0
