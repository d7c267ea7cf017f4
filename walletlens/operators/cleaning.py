"""Cleaning of raw and processed transactions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from walletlens.functions.dates import check_month, month_limits, ntz
from walletlens.functions.numbers import parse_amount
from walletlens.functions.text import combine_tags
from walletlens.schema import CASH_IN, PROCESSED_COLUMNS, RAW_COLUMNS, SPEND, TRANSACTION_SCHEMA

TAG_COLUMNS = ["segment_tag1", "segment_tag2", "segment_tag3"]


def rename_positional(df: DataFrame, names: list[str]) -> DataFrame:
    """New names in order; another number of columns is an error."""
    if len(df.columns) != len(names):
        raise ValueError(f"expected {len(names)} columns, got {len(df.columns)}: {df.columns}")
    return df.toDF(*names)


def parse_timestamp(text: Column, formats: tuple[str, ...] = ()) -> Column:
    """ISO text, or one of the extra formats; null where nothing fits."""
    parsed = [text.try_cast("timestamp_ntz")]
    parsed += [
        F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz") for pattern in formats
    ]
    return F.coalesce(*parsed)


def process_raw(raw: DataFrame, timestamp_formats: tuple[str, ...] = ()) -> DataFrame:
    """Raw columns to the processed ones, with the time cut off and tags combined.

    Spark reads a date that does not parse as null; the loader sorts such rows out (V2).
    """
    named = rename_positional(raw, RAW_COLUMNS).drop("source", "platform")
    return named.select(
        "user_id",
        parse_timestamp(F.col("timestamp"), timestamp_formats).cast("date").alias("timestamp"),
        "transaction_type",
        "transaction_method",
        "amount",
        combine_tags(*[F.col(name) for name in TAG_COLUMNS]).alias("segment_tag"),
    )


def coerce_transactions(
    processed: DataFrame, timestamp_formats: tuple[str, ...] = (), keep: tuple[str, ...] = ()
) -> DataFrame:
    """Typed transaction columns plus ``reason``, null for a valid row, and the columns of ``keep``.

    Missing text stays missing instead of turning into the word "nan" (V1); a missing tag is
    the empty tag. Bad timestamps (V2) and infinite amounts (V8) get a reason.
    """
    kind = dict(processed.dtypes)
    timestamp = F.col("timestamp")
    if kind["timestamp"] == "string":
        timestamp = parse_timestamp(timestamp, timestamp_formats)
    amount = F.col("amount")
    if kind["amount"] == "string":
        amount = parse_amount(amount)
    else:
        amount = F.coalesce(F.nanvl(amount.cast("double"), F.lit(0.0)), F.lit(0.0))
    typed = processed.select(
        F.col("user_id").cast("string").alias("user_id"),
        timestamp.cast("timestamp_ntz").alias("timestamp"),
        F.col("transaction_type").cast("string").alias("transaction_type"),
        F.col("transaction_method").cast("string").alias("transaction_method"),
        amount.alias("amount"),
        F.coalesce(F.col("segment_tag").cast("string"), F.lit("")).alias("segment_tag"),
        *keep,
    )
    reason = (
        F.when(F.col("user_id").isNull(), "missing user_id")
        .when(F.col("timestamp").isNull(), "missing or unparsable timestamp")
        .when(F.col("transaction_type").isNull(), "missing transaction_type")
        .when(F.col("transaction_method").isNull(), "missing transaction_method")
        .when(F.abs("amount") == float("inf"), "infinite amount")
    )
    return typed.select(
        "*",
        F.year("timestamp").cast("int").alias("year"),
        F.month("timestamp").cast("int").alias("month"),
        reason.alias("reason"),
    )


def _coerced_lines(lines: DataFrame, columns: list[str], processed: list[Column], formats: tuple[str, ...]) -> DataFrame:
    whole = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    source_row = F.coalesce("malformed_line", whole).alias("source_row")
    problem = F.when(F.col("malformed_line").isNotNull(), "malformed line")
    if "time_problem" in lines.columns:
        problem = F.coalesce(problem, "time_problem")
    rows = lines.select(*processed, "source_file", source_row, problem.alias("problem"))
    typed = coerce_transactions(rows, formats, ("source_file", "source_row", "problem"))
    return typed.withColumn("reason", F.coalesce("problem", "reason")).drop("problem")


def _line_time(lines: DataFrame, formats: tuple[str, ...]) -> Column:
    """The time of a line: as inferred from its file, where that was done."""
    if "parsed_time" in lines.columns:
        return F.col("parsed_time")
    return parse_timestamp(F.col("timestamp"), formats)


def coerce_raw_lines(lines: DataFrame, timestamp_formats: tuple[str, ...] = ()) -> DataFrame:
    """P1-P9 over the rows of ``lenient_csv.read_raw_lenient``: as ``coerce_transactions``, with the time cut off.

    Every row names its ``source_file`` and keeps what the file held as ``source_row``: the text of a malformed
    line, and a JSON object of all ten columns otherwise, so that the quarantine can be mended and loaded again.
    Times are read as ``time_formats.with_inferred_times`` found, if the lines went through it.
    """
    day = _line_time(lines, timestamp_formats).cast("date").alias("timestamp")
    tags = combine_tags(*[F.col(name) for name in TAG_COLUMNS]).alias("segment_tag")
    columns = ["user_id", day, "transaction_type", "transaction_method", "amount", tags]
    return _coerced_lines(lines, RAW_COLUMNS, columns, ())


def coerce_lines(lines: DataFrame, timestamp_formats: tuple[str, ...] = ()) -> DataFrame:
    """P5-P9 over the rows of ``lenient_csv.read_processed_lenient``, with ``source_file`` and ``source_row``."""
    time = _line_time(lines, timestamp_formats).alias("timestamp")
    columns = [time if name == "timestamp" else F.col(name) for name in PROCESSED_COLUMNS]
    return _coerced_lines(lines, PROCESSED_COLUMNS, columns, ())


def valid_transactions(coerced: DataFrame) -> DataFrame:
    return coerced.filter(F.col("reason").isNull()).select(TRANSACTION_SCHEMA.names)


def quarantined(coerced: DataFrame) -> DataFrame:
    """The rows left out, each with the first reason that applies."""
    return coerced.filter(F.col("reason").isNotNull())


def is_spend() -> Column:
    """P12"""
    return F.col("transaction_type") == SPEND


def is_cash_in() -> Column:
    """P12"""
    return F.col("transaction_type") == CASH_IN


def has_segment() -> Column:
    """P13"""
    return F.col("segment_tag").isNotNull() & (F.col("segment_tag") != "")


def in_month(t: DataFrame, year: int, month: int) -> DataFrame:
    """On the fact table this prunes partitions."""
    check_month(month)
    return t.filter((F.col("year") == year) & (F.col("month") == month))


def for_user_month(t: DataFrame, user_id: str, year: int, month: int) -> DataFrame:
    """P10 for one user."""
    return in_month(t, year, month).filter(F.col("user_id") == user_id)


def between(t: DataFrame, low: dt.datetime, high: dt.datetime) -> DataFrame:
    """Both ends belong to the range."""
    return t.filter(F.col("timestamp").between(ntz(low), ntz(high)))


def in_month_seconds(t: DataFrame, year: int, month: int) -> DataFrame:
    """P11 for a month: up to 23:59:59.000000 of its last day, unlike ``in_month``.

    The month filter adds nothing to the result; it lets the scan skip other partitions.
    """
    return between(in_month(t, year, month), *month_limits(year, month))
