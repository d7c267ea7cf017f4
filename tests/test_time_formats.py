"""Formats of times that each file settles by its own rows, or is refused for."""

from __future__ import annotations

import datetime as dt

import pytest

from walletlens.operators.cleaning import coerce_lines, quarantined, valid_transactions
from walletlens.operators.time_formats import AMBIGUOUS, ISO, MIXED, file_formats, with_inferred_times
from walletlens.sources.lenient_csv import read_processed_lenient


def formats(spark, files):
    rows = [(name, text) for name, texts in files.items() for text in texts]
    lines = spark.createDataFrame(rows, "source_file string, timestamp string")
    return {r.source_file: r.time_format or r.time_problem for r in file_formats(lines).collect()}


def test_each_file_settles_its_format(spark):
    found = formats(
        spark,
        {
            "american": ["04/30/2025", "04/01/2025 09:30", "05/06/2025"],
            "british": ["30/04/2025", "01/04/2025 09:30:15"],
            "iso": ["2025-04-30", "2025-04-30T10:11:12.5"],
            "dots": ["30.04.2025", None, "no date", ""],
            "words": ["02 Apr 2025", "30 Apr 2025 08:00"],
            "torn": ["04/05/2025", "06/07/2025"],
            "same": ["04/04/2025", "05/05/2025"],
            "mixed": ["04/30/2025", "30/04/2025"],
            "two": ["30.04.2025", "2025-04-30"],
            "nothing": ["no date", None],
        },
    )
    assert found == {
        "american": "MM/dd/yyyy",
        "british": "dd/MM/yyyy",
        "iso": ISO,
        "dots": "dd.MM.yyyy",
        "words": "dd MMM yyyy",
        "torn": AMBIGUOUS,
        "same": "MM/dd/yyyy",
        "mixed": MIXED,
        "two": MIXED,
    }


@pytest.mark.parametrize("text", ["04/30/2025 08:00", "30/04/2025 08:00:00", "2025-04-30 08:00", "30.04.2025 08:00", "Apr 30, 2025 08:00"])
def test_files_of_any_format_load(spark, tmp_path, text):
    quoted = f'"{text}"'
    header = "user_id,timestamp,transaction_type,transaction_method,amount,segment_tag\n"
    (tmp_path / "a.csv").write_text(header + f"u1,{quoted},SPEND,QR,1,A\nu2,soon,SPEND,QR,2,A\nu3,{quoted},SPEND,QR\n")
    (tmp_path / "torn.csv").write_text(header + "u4,01/02/2025,SPEND,QR,1,A\nu5,later,SPEND,QR,1,A\n")
    read = coerce_lines(with_inferred_times(read_processed_lenient(spark, str(tmp_path))))
    assert [(r.user_id, r.timestamp) for r in valid_transactions(read).collect()] == [("u1", dt.datetime(2025, 4, 30, 8))]
    assert [r.source_row for r in quarantined(read).filter("reason = 'malformed line'").collect()] == [f"u3,{quoted},SPEND,QR"]
    assert {r.user_id: r.reason for r in quarantined(read).filter("user_id IS NOT NULL").collect()} == {
        "u2": "missing or unparsable timestamp",
        "u4": AMBIGUOUS,
        "u5": "missing or unparsable timestamp",
    }
