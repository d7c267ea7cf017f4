"""Scalar expressions against Python's own formatting and literal rows."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from walletlens.functions import dates, numbers, text
from walletlens.functions.vectors import dot


def both_roundings(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    rows = df.select(
        "x",
        numbers.two_decimals(F.col("x")).alias("text"),
        numbers.round_cents(F.col("x")).alias("value"),
    ).collect()
    return [(r.x, r.text, r.value) for r in rows]


def assert_like_python(spark, values):
    values = [x + 0.0 for x in values]  # a zero has no sign here
    wrong = [
        (x, shown, rounded)
        for x, shown, rounded in both_roundings(spark, values)
        if shown != f"{x:.2f}" or rounded != float(f"{x:.2f}")
    ]
    assert not wrong, wrong[:5]


def test_two_decimals_on_midpoints(spark):
    thousandths = [k / 1000 for k in range(-3000, 3001)]
    fixed = [0.125, 0.375, 1.005, 2.675, 4.295, 0.005, 0.015, 0.0049999, 99.995, -0.001, 0.0, 1e13 + 0.125]
    assert_like_python(spark, thousandths + fixed)


def test_two_decimals_on_shares(spark):
    assert_like_python(spark, [n / total * 100 for total in range(1, 130) for n in range(total + 1)])


def test_two_decimals_on_random_midpoints(spark):
    source = random.Random(7)
    large = [source.randrange(10**9, 10**15) / 1000 for _ in range(20000)]
    small = [(2 * source.randrange(10**6) + 1) / 200 for _ in range(20000)]
    assert_like_python(spark, large + small + [-x for x in small])


def test_two_decimals_of_large_doubles(spark):
    eighths = [9.1e13 + k / 64 for k in range(64)] + [8.9e13 + k / 64 for k in range(64)]
    assert_like_python(spark, eighths + [-x for x in eighths] + [2.0**52 + 0.5, 2.0**53 + 2, 9.2e18, 1e15 + 0.125])


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(min_value=-9.2e18, max_value=9.2e18), min_size=1, max_size=200))
def test_two_decimals_on_any_double(spark, values):
    assert_like_python(spark, values)


@pytest.mark.parametrize(
    ("given_text", "expected"),
    [
        ("12.3456", 12.3456), ("-3", -3.0), (" 7 ", 7.0), ("1e3", 1000.0), (".5", 0.5),
        ("abc", 0.0), ("", 0.0), (None, 0.0), ("nan", 0.0), ("12d", 0.0), ("1_000", 0.0),
        ("inf", float("inf")), ("-Infinity", float("-inf")), ("1e400", float("inf")),
    ],
)
def test_parse_amount(spark, given_text, expected):
    df = spark.createDataFrame([(given_text,)], "a string")
    assert df.select(numbers.parse_amount(F.col("a"))).first()[0] == expected


def test_ratios_need_a_positive_total(spark):
    df = spark.createDataFrame([(1.0, 4.0), (1.0, 0.0), (1.0, -2.0)], "part double, total double")
    part, total = F.col("part"), F.col("total")
    rows = df.select(numbers.share_percent(part, total), numbers.ratio(part, total)).collect()
    assert [tuple(r) for r in rows] == [(25.0, 0.25), (None, None), (None, None)]


def test_tags(spark):
    df = spark.createDataFrame(
        [("A", None, "C"), ("nan", "B", None), (None, None, None), (" ", "nan", "X_Y")],
        "a string, b string, c string",
    )
    combined = df.select(text.combine_tags(F.col("a"), F.col("b"), F.col("c")).alias("tag"))
    assert [r.tag for r in combined.collect()] == ["A, C", "B", "", " , X_Y"]
    shown = combined.select(text.format_tag(F.col("tag")).alias("tag"))
    assert [r.tag for r in shown.collect()] == ["a, c", "b", "", " , x y"]
    missing = spark.range(1).select(text.format_tag(F.lit(None).cast("string")))
    assert missing.first()[0] == "unknown"


def test_null_tokens(spark):
    df = spark.createDataFrame([("NA",), ("null",), ("None",), ("",), (" ",), ("na",)], "a string")
    rows = df.select(text.null_if_token(F.col("a"))).collect()
    assert [r[0] for r in rows] == [None, None, None, None, " ", "na"]


def test_month_functions(spark):
    df = spark.createDataFrame([(2024, 2), (2023, 2), (2025, 4)], "y int, m int")
    y, m = F.col("y"), F.col("m")
    rows = df.select(
        dates.month_start(y, m), dates.month_end(y, m), dates.days_in_month(y, m),
        dates.month_name(y, m), text.year_month_label(y, m),
    ).collect()
    assert [tuple(r) for r in rows] == [
        (dt.datetime(2024, 2, 1), dt.datetime(2024, 2, 29, 23, 59, 59), 29, "February", "2024-02"),
        (dt.datetime(2023, 2, 1), dt.datetime(2023, 2, 28, 23, 59, 59), 28, "February", "2023-02"),
        (dt.datetime(2025, 4, 1), dt.datetime(2025, 4, 30, 23, 59, 59), 30, "April", "2025-04"),
    ]
    assert dates.month_limits(2024, 2) == (dt.datetime(2024, 2, 1), dt.datetime(2024, 2, 29, 23, 59, 59))


def test_bad_month_raises(spark):
    with pytest.raises(ValueError):
        dates.month_limits(2024, 13)
    with pytest.raises(PySparkException):
        spark.range(1).select(dates.month_start(F.lit(2024), F.lit(13))).collect()


def test_iso_text(spark):
    moments = [dt.datetime(2025, 4, 30, 23, 59, 59), dt.datetime(2025, 4, 30, 23, 59, 59, 500000), None]
    df = spark.createDataFrame([(x,) for x in moments], "t timestamp_ntz")
    rows = df.select(dates.iso_text(F.col("t"))).collect()
    assert [r[0] for r in rows] == [x.isoformat() if x else None for x in moments]


def test_dot_is_not_normalised(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0])], "a array<float>, b array<float>")
    assert df.select(dot(F.col("a"), F.col("b"))).first()[0] == 11.0
