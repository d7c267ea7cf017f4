"""Files with lines of another width and quoted line breaks: nothing is lost, and the rest loads."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.errors import AnalysisException

from walletlens.operators.cleaning import coerce_lines, coerce_raw_lines, quarantined, valid_transactions
from walletlens.sources import lenient_csv

HEADER = "user_id,timestamp,transaction_type,transaction_method,amount,segment_tag\n"
RAW_HEADER = "id,t1,t2,t3,when,src,kind,how,os,value\n"


def test_short_long_and_broken_lines(spark, tmp_path):
    (tmp_path / "a b%20c.csv").write_text(
        HEADER
        + "u1,2025-04-01,SPEND,QR,1,A\n"
        + "u2,SPEND,QR\n"
        + "u3,2025-04-01,SPEND,QR,1,000.00,A\n"
        + 'u4,2025-04-02,SPEND,QR,2,"two\nlines, and a ""quote"""\n'
        + "u5,2025-04-03,CASH-IN,QR,3,NA\n"
    )
    (tmp_path / "plain.csv").write_text(HEADER + "u6,2025-04-04,SPEND,QR,4,B\nu7\n\nu8,2025-04-05,SPEND,QR,5,C\n")
    path = str(tmp_path)
    broken = lenient_csv.files_with_line_breaks(spark, path)
    assert len(broken) == 1 and "plain" not in broken[0]
    read = coerce_lines(lenient_csv.read_processed_lenient(spark, path))
    valid = sorted(valid_transactions(read).collect())
    assert [(r.user_id, r.timestamp.day, r.amount, r.segment_tag) for r in valid] == [
        ("u1", 1, 1.0, "A"),
        ("u4", 2, 2.0, 'two\nlines, and a "quote"'),
        ("u5", 3, 3.0, ""),
        ("u6", 4, 4.0, "B"),
        ("u8", 5, 5.0, "C"),
    ]
    bad = sorted(quarantined(read).collect(), key=lambda r: r.source_row)
    assert [(r.source_row, r.reason, r.user_id) for r in bad] == [
        ("u2,SPEND,QR", "malformed line", None),
        ("u3,2025-04-01,SPEND,QR,1,000.00,A", "malformed line", None),
        ("u7", "malformed line", None),
    ]
    assert ["plain.csv" in r.source_file for r in bad] == [False, False, True]


def test_quarantine_keeps_the_source_of_rows_that_do_not_fit(spark, tmp_path):
    (tmp_path / "raw.csv").write_text(
        RAW_HEADER
        + "u1,A,N/A,C,2025-04-01 09:00:00,app,SPEND,QR,ios,12.5\n"
        + "u2,,,,someday,app,SPEND,QR,ios,é1\n"
        + "NA,A,,,2025-04-03,app,SPEND,QR,ios,1\n"
    )
    read = coerce_raw_lines(lenient_csv.read_raw_lenient(spark, str(tmp_path)))
    row = valid_transactions(read).collect()
    assert [(r.user_id, r.timestamp, r.amount, r.segment_tag) for r in row] == [("u1", dt.datetime(2025, 4, 1), 12.5, "A, C")]
    bad = {r.reason: json.loads(r.source_row) for r in quarantined(read).collect()}
    unparsable = bad["missing or unparsable timestamp"]
    assert (unparsable["timestamp"], unparsable["amount"], unparsable["source"]) == ("someday", "é1", "app")
    assert bad["missing user_id"]["user_id"] is None and bad["missing user_id"]["amount"] == "1"


def test_an_open_quote_takes_the_rest_of_its_file_only(spark, tmp_path):
    (tmp_path / "open.csv").write_text(HEADER + 'u1,2025-04-01,SPEND,QR,1,A\nu2,"2025-04-01,SPEND\nu3,2025-04-01,SPEND,QR,1,A\n')
    (tmp_path / "other.csv").write_text(HEADER + "u4,2025-04-01,SPEND,QR,1,A\n")
    read = coerce_lines(lenient_csv.read_processed_lenient(spark, str(tmp_path)))
    assert sorted(r.user_id for r in valid_transactions(read).collect()) == ["u1", "u4"]
    bad = [r.source_row for r in quarantined(read).collect()]
    assert len(bad) == 1 and "u2" in bad[0] and "u3" in bad[0]


def test_empty_and_missing_files(spark, tmp_path):
    (tmp_path / "empty.csv").write_text(HEADER)
    assert lenient_csv.read_processed_lenient(spark, str(tmp_path)).collect() == []
    with pytest.raises(AnalysisException):
        lenient_csv.read_processed_lenient(spark, str(tmp_path / "nothing"))
