"""Cleaning operators on literal rows."""

from __future__ import annotations

import datetime as dt

import pytest

from samples import transaction, transactions
from walletlens.operators import cleaning
from walletlens.schema import PROCESSED_SCHEMA, RAW_SCHEMA


def raw(spark, *rows):
    return spark.createDataFrame(list(rows), RAW_SCHEMA)


def test_process_raw(spark):
    df = raw(
        spark,
        ("u", "A", None, "nan", "2025-04-01 10:11:12", "s", "SPEND", "QR", "ios", "1.5"),
        ("u", None, None, None, "2025-04-02T23:59:59.5", "s", "SPEND", "QR", "ios", None),
        ("u", "A", " ", "C", "garbage", "s", "SPEND", "QR", "ios", "x"),
    )
    rows = cleaning.process_raw(df).collect()
    assert [tuple(r) for r in rows] == [
        ("u", dt.date(2025, 4, 1), "SPEND", "QR", "1.5", "A"),
        ("u", dt.date(2025, 4, 2), "SPEND", "QR", None, ""),
        ("u", None, "SPEND", "QR", "x", "A,  , C"),
    ]


def test_other_timestamp_formats(spark):
    df = raw(spark, ("u", "A", None, None, "04/30/2025 08:00", "s", "SPEND", "QR", "ios", "1"))
    assert cleaning.process_raw(df).first().timestamp is None
    parsed = cleaning.process_raw(df, ("MM/dd/yyyy HH:mm",)).first()
    assert parsed.timestamp == dt.date(2025, 4, 30)


def test_wrong_number_of_columns(spark):
    with pytest.raises(ValueError, match="expected 10 columns"):
        cleaning.process_raw(raw(spark).drop("platform"))


def processed(spark):
    rows = [
        ("u1", "2024-02-29", "SPEND", "QR", "12.3456", "A"),
        ("u2", "2024-02-29 23:59:59.5", "CASH-IN", "QR", "abc", None),
        ("u3", "2024-02-30", "SPEND", "QR", "1", "A"),
        (None, "2024-02-01", "SPEND", "QR", "1", "A"),
        ("u5", "2024-02-01", None, "QR", "1", "A"),
        ("u6", "2024-02-01", "SPEND", None, "1", "A"),
        ("u7", "2024-02-01", "SPEND", "QR", "inf", "A"),
        ("u8", "2024-02-01", "SPEND", "QR", "1e300", "A"),
        ("u9", "2024-02-01", "SPEND", "QR", None, "A"),
        ("u9", "2024-02-01", "SPEND", "QR", None, "A"),
        ("u10", "2024-02-01", "FEE", "QR", "-4", "A"),
    ]
    return spark.createDataFrame(rows, PROCESSED_SCHEMA)


def test_valid_rows_are_typed(spark):
    valid = cleaning.valid_transactions(cleaning.coerce_transactions(processed(spark)))
    day = dt.datetime(2024, 2, 1)
    assert [tuple(r) for r in valid.collect()] == [
        ("u1", dt.datetime(2024, 2, 29), "SPEND", "QR", 12.3456, "A", 2024, 2),
        ("u2", dt.datetime(2024, 2, 29, 23, 59, 59, 500000), "CASH-IN", "QR", 0.0, "", 2024, 2),
        ("u8", day, "SPEND", "QR", 1e300, "A", 2024, 2),
        ("u9", day, "SPEND", "QR", 0.0, "A", 2024, 2),
        ("u9", day, "SPEND", "QR", 0.0, "A", 2024, 2),
        ("u10", day, "FEE", "QR", -4.0, "A", 2024, 2),
    ]


def test_other_rows_are_quarantined_with_a_reason(spark):
    rows = cleaning.quarantined(cleaning.coerce_transactions(processed(spark))).collect()
    assert [(r.user_id, r.reason) for r in rows] == [
        ("u3", "missing or unparsable timestamp"),
        (None, "missing user_id"),
        ("u5", "missing transaction_type"),
        ("u6", "missing transaction_method"),
        ("u7", "infinite amount"),
    ]


def test_typed_amounts_are_coerced_too(spark):
    df = spark.createDataFrame(
        [("u", dt.date(2024, 2, 1), "SPEND", "QR", x, "A") for x in (float("nan"), None, 2.5)],
        "user_id string, timestamp date, transaction_type string, transaction_method string, "
        "amount double, segment_tag string",
    )
    assert [r.amount for r in cleaning.coerce_transactions(df).collect()] == [0.0, 0.0, 2.5]


def test_month_filters_differ_in_the_last_second(spark):
    last = dt.datetime(2024, 2, 29, 23, 59, 59)
    t = transactions(
        spark,
        [
            transaction("a", dt.datetime(2024, 2, 1), "SPEND", "QR", 1.0),
            transaction("b", last, "SPEND", "QR", 1.0),
            transaction("c", last.replace(microsecond=500000), "SPEND", "QR", 1.0),
            transaction("d", dt.datetime(2024, 3, 1), "SPEND", "QR", 1.0),
        ],
    )
    assert [r.user_id for r in cleaning.in_month(t, 2024, 2).collect()] == ["a", "b", "c"]
    assert [r.user_id for r in cleaning.in_month_seconds(t, 2024, 2).collect()] == ["a", "b"]
    assert [r.user_id for r in cleaning.for_user_month(t, "b", 2024, 2).collect()] == ["b"]
    with pytest.raises(ValueError):
        cleaning.in_month_seconds(t, 2024, 0)
