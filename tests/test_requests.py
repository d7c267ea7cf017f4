"""Requests, loads and report files that must not go wrong quietly."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from walletlens.functions import dates
from walletlens.operators import cleaning, profile, reports, scoring
from walletlens.operators.generation import summary_writer
from walletlens.sources import fact_table, report_files
from walletlens.sources.tables import event_transactions, order_transactions, table


def asked(spark, *rows):
    return spark.createDataFrame(list(rows), "user_id string, year int, month int")


@pytest.mark.parametrize("month", [0, 13])
def test_an_invalid_month_raises(spark, sf_dir, month):
    t = event_transactions(spark, sf_dir)
    with pytest.raises(Exception, match="month must be between 1 and 12"):
        profile.requested_status(t, asked(spark, ("1", 2024, month))).collect()
    with pytest.raises(ValueError):
        cleaning.in_month(t, 2024, month)


def test_a_request_reads_its_month_only(spark, sf_dir, tmp_path):
    root = str(tmp_path / "facts")
    fact_table.append_transactions(order_transactions(spark, sf_dir), root)
    t = fact_table.read_transactions(spark, root)
    user = t.filter("year = 1996 AND month = 3").select("user_id").head()[0]
    answers = profile.requested_profiles(t, asked(spark, (user, 1996, 3), ("nobody", 1996, 3), (user, 2030, 1)))
    plan = answers._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert "dynamicpruning" in plan.lower()
    assert {row.status for row in answers.collect()} == {"ok", "unknown_user", "no_data"}


def test_all_months_can_be_requested_at_once(spark, sf_dir):
    t = order_transactions(spark, sf_dir)
    everything = t.select("user_id", "year", "month").distinct()
    found = profile.requested_status(t, everything)
    assert found.count() == everything.count()
    assert found.filter("status = 'unknown_user'").isEmpty()


@pytest.mark.parametrize("batch_id", ["2025/04", "", "..", "a b", "x=1"])
def test_a_batch_is_a_plain_name(spark, sf_dir, tmp_path, batch_id):
    with pytest.raises(ValueError):
        fact_table.load_batch(event_transactions(spark, sf_dir), str(tmp_path), batch_id)


def test_reports_without_a_run_are_kept(spark, tmp_path):
    line = '{"metadata":{"user_id":"u","year":2024,"month":"May"},"report_components":{"a":"%s"},%s"year":2024,"month":"May"}'
    lines = [line % ("x", ""), line % ("y", "")]
    (tmp_path / "a.json").write_text("\n".join(lines))
    got = report_files.read_reports(spark, str(tmp_path)).collect()
    assert [row.report_components for row in got] == [{"a": "y"}]
    newer = line % ("x", '"run_ts":"2024-06-01T00:00:00",')
    (tmp_path / "b.json").write_text(newer)
    got = report_files.read_reports(spark, str(tmp_path)).collect()
    assert [row.report_components for row in got] == [{"a": "x"}]


def test_iso_text_does_not_depend_on_the_zone(spark):
    moments = [dt.datetime(2024, 3, 10, 2, 30), dt.datetime(2024, 3, 10, 2, 30, 0, 500000)]
    rows = spark.createDataFrame([(m,) for m in moments], "t timestamp_ntz")
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert sorted(row[0] for row in rows.select(dates.iso_text(F.col("t"))).collect()) == [m.isoformat() for m in moments]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_a_report_is_the_same_alone_and_among_all(spark, sf_dir):
    t = event_transactions(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    safety = scoring.fit_safety(table(spark, sf_dir, "documents").join(labels, "doc_id"))
    request = asked(spark, ("1", 2024, 1))
    alone = reports.report_rows(reports.generate_reports(t, summary_writer(), safety, requests=request)).collect()
    among = reports.report_rows(reports.generate_reports(t, summary_writer(), safety)).filter("user_id = '1'").collect()
    assert alone and sorted(map(str, alone)) == sorted(map(str, among))
