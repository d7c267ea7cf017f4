"""The user index and the stats that are kept up to date with the batches of a fact table."""

from __future__ import annotations

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from samples import transaction, transactions
from walletlens.operators.aggregates import monthly_stats
from walletlens.operators.profile import requested_profiles, requested_status
from walletlens.sources import stats_table, user_index
from walletlens.sources.fact_table import load_batch, read_batches, remove_batch

REQUESTS = "user_id string, year int, month int"


def rows_of(seed, count=60):
    rng = random.Random(seed)
    return [
        transaction(f"u{rng.randrange(9)}", dt.datetime(2024, rng.randrange(1, 7), 3), rng.choice(["SPEND", "CASH-IN", "FEE"]), "QR", rng.randrange(10**6) / 100)
        for _ in range(count)
    ]


def scans(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"FileScan parquet.*?PartitionFilters: \[(.*?)\], PushedFilters: \[(.*?)\], ReadSchema", plan, re.S)


def test_known_users_of_short_and_long_lists(spark, tmp_path, monkeypatch):
    index = str(tmp_path / "users")
    assert user_index.known_users(user_index.read_users(spark, index), spark.createDataFrame([("u1",)], "user_id string")).collect() == []
    user_index.write_users(transactions(spark, rows_of(1)), index, "a")
    user_index.write_users(transactions(spark, [transaction("solo", dt.datetime(2024, 1, 1), "SPEND", "QR", 1.0)]), index, "b")
    wanted = spark.createDataFrame([("u1",), ("u1",), ("solo",), ("nobody",), (None,)], "user_id string")
    for short in (200, 0):
        monkeypatch.setattr(user_index, "SHORT", short)
        users = user_index.read_users(spark, index)
        assert sorted(r.user_id for r in user_index.known_users(users, wanted).collect()) == ["solo", "u1"]
    user_index.write_users(transactions(spark, []), index, "b")
    assert [r.user_id for r in user_index.known_users(user_index.read_users(spark, index), wanted).collect()] == ["u1"]


def test_one_request_prunes_every_scan(spark, tmp_path):
    facts, index = str(tmp_path / "facts"), str(tmp_path / "users")
    rows = [*rows_of(1), transaction("u1", dt.datetime(2024, 2, 1), "SPEND", "QR", 1.0)]
    load_batch(transactions(spark, rows), facts, "a")
    user_index.write_users(transactions(spark, rows), index, "a")
    one = spark.createDataFrame([("u1", 2024, 2), ("u1", 2030, 1), ("x", 2024, 2)], REQUESTS)
    t, users = read_batches(spark, facts), user_index.read_users(spark, index)
    status = requested_status(t, one, users)
    tables = [filters for filters, _ in scans(status) if filters]
    assert len(tables) == 2
    assert any("bucket" in filters for filters in tables) and any("year" in filters and "month" in filters for filters in tables)
    assert any("In(user_id" in pushed or "EqualTo(user_id" in pushed for _, pushed in scans(status))
    expected = {tuple(r) for r in requested_status(t, one).collect()}
    assert {tuple(r) for r in status.collect()} == expected
    assert {r.status for r in status.collect()} == {"ok", "no_data", "unknown_user"}
    profiles = {tuple(r) for r in requested_profiles(t, one, users).collect()}
    assert profiles == {tuple(r) for r in requested_profiles(t, one).collect()}


def whole(spark, facts):
    return sorted(map(tuple, monthly_stats(read_batches(spark, facts)).collect()))


def test_stats_follow_added_replaced_and_removed_batches(spark, tmp_path):
    facts, root = str(tmp_path / "facts"), str(tmp_path / "stats")

    def upkept(batch_id):
        months = stats_table.update_stats(spark, facts, root, batch_id)
        assert sorted(map(tuple, stats_table.read_stats(spark, root).collect())) == whole(spark, facts)
        return months

    load_batch(transactions(spark, rows_of(1)), facts, "a")
    assert len(upkept("a")) == 6
    load_batch(transactions(spark, rows_of(2)), facts, "b")
    upkept("b")
    june = [row for row in rows_of(3) if row[1].month == 6] + [transaction("u1", dt.datetime(2024, 9, 1), "SPEND", "QR", 1e300)]
    load_batch(transactions(spark, june), facts, "c")
    assert upkept("c") == [(2024, 6), (2024, 9)]
    load_batch(transactions(spark, june[:-1]), facts, "c")
    assert upkept("c") == [(2024, 6), (2024, 9)]  # September had its only row in this batch
    assert upkept("c") == [(2024, 6)]
    load_batch(transactions(spark, [row for row in rows_of(2) if row[1].month < 3]), facts, "b")
    assert len(upkept("b")) == 6
    for batch_id in "abc":
        remove_batch(spark, facts, batch_id)
        upkept(batch_id)
    assert stats_table.read_stats(spark, root).collect() == []


def test_an_update_that_failed_half_way_is_made_good(spark, tmp_path, monkeypatch):
    facts, root = str(tmp_path / "facts"), str(tmp_path / "stats")
    load_batch(transactions(spark, rows_of(1)), facts, "a")
    stats_table.update_stats(spark, facts, root, "a")
    load_batch(transactions(spark, [row for row in rows_of(1) if row[1].month == 1]), facts, "a")

    def fails(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(stats_table, "_write_months", fails)
        with pytest.raises(RuntimeError):
            stats_table.update_stats(spark, facts, root, "a")
    assert len(stats_table.update_stats(spark, facts, root, "a")) == 6
    assert sorted(map(tuple, stats_table.read_stats(spark, root).collect())) == whole(spark, facts)


def test_a_month_of_the_stats_prunes_folders(spark, tmp_path):
    facts, root = str(tmp_path / "facts"), str(tmp_path / "stats")
    load_batch(transactions(spark, rows_of(1)), facts, "a")
    stats_table.update_stats(spark, facts, root, "a")
    month = stats_table.read_stats(spark, root).filter((F.col("year") == 2024) & (F.col("month") == 2))
    assert "year" in scans(month)[0][0]
    assert month.count() == monthly_stats(read_batches(spark, facts)).filter("month = 2").count()
