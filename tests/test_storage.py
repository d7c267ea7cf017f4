"""CSV files and the fact table."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from samples import SAMPLE_TAG, sample, transaction, transactions
from walletlens.operators.aggregates import monthly_stats
from walletlens.operators.cleaning import (
    coerce_transactions,
    in_month,
    process_raw,
    valid_transactions,
)
from walletlens.sources import csv_files, fact_table


def test_csv_files_end_to_end(spark, tmp_path):
    raw = tmp_path / "raw.csv"
    raw.write_text(
        "id,t1,t2,t3,when,src,kind,how,os,value\n"
        'u1,"A, B",N/A,C,2025-04-01 09:00:00,app,SPEND,QR,ios,12.5\n'
        "u2,,,,2025-04-01,app,CASH-IN,SEND MONEY,ios,NULL\n"
        'u3,"say ""hi""", ,nan,2025-04-03,app,SPEND,QR,ios,1e2\n'
        "NA,A,,,2025-04-03,app,SPEND,QR,ios,1\n"
    )
    out = str(tmp_path / "processed")
    csv_files.write_processed_csv(process_raw(csv_files.read_raw_csv(spark, str(raw))), out)
    read = coerce_transactions(csv_files.read_processed_csv(spark, out))
    rows = sorted(valid_transactions(read).collect())
    assert [(r.user_id, r.timestamp, r.amount, r.segment_tag) for r in rows] == [
        ("u1", dt.datetime(2025, 4, 1), 12.5, "A, B, C"),
        ("u2", dt.datetime(2025, 4, 1), 0.0, ""),
        ("u3", dt.datetime(2025, 4, 3), 100.0, 'say "hi",  '),
    ]
    assert [r.reason for r in read.filter("reason is not null").collect()] == ["missing user_id"]


def test_raw_file_of_another_width_is_an_error(spark, tmp_path):
    (tmp_path / "raw.csv").write_text("a,b,c\n1,2,3\n")
    with pytest.raises(ValueError, match="expected 10 columns"):
        csv_files.read_raw_csv(spark, str(tmp_path / "raw.csv"))


@pytest.mark.parametrize("line", ["u,SPEND,QR", "u,2025-04-01,SPEND,QR,1,000.00,A"])
def test_line_of_another_width_is_an_error(spark, tmp_path, line):
    header = "user_id,timestamp,transaction_type,transaction_method,amount,segment_tag"
    (tmp_path / "p.csv").write_text(f"{header}\nu,2025-04-01,SPEND,QR,1,A\n{line}\n")
    read = csv_files.read_processed_csv(spark, str(tmp_path / "p.csv"))
    with pytest.raises(Exception, match="(?i)malformed"):
        read.select("user_id", "amount").collect()


def test_missing_file_is_an_error(spark, tmp_path):
    with pytest.raises(AnalysisException):
        csv_files.read_processed_csv(spark, str(tmp_path / "nothing.csv"))


def totals(df):
    row = monthly_stats(df).first()
    return row.total_spend, row.spend_count, row.total_cash_in, row.cash_in_count


def test_plain_append_counts_a_file_five_times(spark, tmp_path):
    root = str(tmp_path / "appended")
    for _ in range(5):
        fact_table.append_transactions(sample(spark), root)
    spend, spends, cash_in, cash_ins = totals(fact_table.read_transactions(spark, root))
    assert (f"{spend:.2f}", spends, f"{cash_in:.2f}", cash_ins) == ("3402.12", 40, "4827.71", 20)


def test_replayed_batch_counts_once(spark, tmp_path):
    root = str(tmp_path / "batches")
    for _ in range(5):
        fact_table.load_batch(sample(spark), root, "april")
    assert totals(fact_table.read_batches(spark, root)) == (680.4237, 8, 965.5426, 4)


def test_corrected_batch_leaves_nothing_behind(spark, tmp_path):
    root = str(tmp_path / "batches")
    april = transaction("u", dt.datetime(2025, 4, 1), "SPEND", "QR", 1.0)
    may = transaction("u", dt.datetime(2025, 5, 1), "SPEND", "QR", 2.0)
    fact_table.load_batch(transactions(spark, [april, may]), root, "first")
    fact_table.load_batch(transactions(spark, [may]), root, "second")
    fact_table.load_batch(transactions(spark, [april, april]), root, "first")
    rows = fact_table.read_batches(spark, root).select("batch_id", "month", "amount").collect()
    assert sorted(map(tuple, rows)) == [("first", 4, 1.0), ("first", 4, 1.0), ("second", 5, 2.0)]


def test_empty_append_is_harmless(spark, tmp_path):
    root = str(tmp_path / "appended")
    fact_table.append_transactions(sample(spark), root)
    fact_table.append_transactions(transactions(spark, []), root)
    assert fact_table.read_transactions(spark, root).count() == 12


def test_month_filter_prunes_partitions(spark, tmp_path):
    root = str(tmp_path / "appended")
    fact_table.append_transactions(sample(spark), root)
    scan = in_month(fact_table.read_transactions(spark, root), 2025, 4).filter(
        F.col("user_id") == "u"
    )
    plan = scan._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    assert "EqualTo(user_id,u)" in plan
    assert SAMPLE_TAG not in plan
