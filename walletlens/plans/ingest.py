"""Registered queries on cleaning and storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from walletlens.functions.dates import iso_text, month_end, month_name, month_start
from walletlens.functions.numbers import exact_sum
from walletlens.functions.text import combine_tags, year_month_label
from walletlens.operators.aggregates import monthly_stats
from walletlens.operators.cleaning import (
    TAG_COLUMNS,
    coerce_raw_lines,
    coerce_transactions,
    for_user_month,
    is_spend,
    process_raw,
    quarantined,
    valid_transactions,
)
from walletlens.operators.large_amounts import corrected
from walletlens.operators.time_formats import with_inferred_times
from walletlens.plans import oracle
from walletlens.schema import KEYS, PROCESSED_COLUMNS
from walletlens.session import scratch_path
from walletlens.sources.csv_files import read_processed_csv, read_raw_csv, write_processed_csv
from walletlens.sources.fact_table import (
    append_transactions,
    load_batch,
    read_batches,
    read_transactions,
    remove_batch,
    write_monthly_stats,
)
from walletlens.sources.lenient_csv import read_raw_lenient
from walletlens.sources.stats_table import read_stats, update_stats
from walletlens.sources.tables import dated_event_lines, event_lines, event_transactions, order_transactions, raw_events, table


def _iso(df: DataFrame) -> DataFrame:
    return df.withColumn("timestamp", iso_text(F.col("timestamp")))


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw_path, processed_path = scratch_path(spark, "raw-csv"), scratch_path(spark, "processed-csv")
    write_processed_csv(raw_events(spark, sf_dir), raw_path)
    write_processed_csv(process_raw(read_raw_csv(spark, raw_path)), processed_path)
    return _iso(valid_transactions(coerce_transactions(read_processed_csv(spark, processed_path))))


def processed_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    processed = process_raw(raw_events(spark, sf_dir))
    return processed.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd"))


def _coerced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw rows with combined tags and their full times."""
    tag = combine_tags(*[F.col(name) for name in TAG_COLUMNS])
    tagged = raw_events(spark, sf_dir).withColumn("segment_tag", tag)
    return coerce_transactions(tagged.select(PROCESSED_COLUMNS))


def coerced_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _iso(valid_transactions(_coerced(spark, sf_dir)))


def quarantined_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quarantined(_coerced(spark, sf_dir)).select(
        "user_id",
        iso_text(F.col("timestamp")).alias("timestamp"),
        "transaction_type",
        "transaction_method",
        "segment_tag",
        "reason",
    )


def malformed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of files with short and long lines and quoted line breaks, loaded or with the text of what was not."""
    root = scratch_path(spark, "lines")
    lines = event_lines(spark, sf_dir)
    for folder, wanted in (("plain", ~F.col("broken")), ("broken", F.col("broken"))):
        lines.filter(wanted).select("line").write.text(f"{root}/{folder}")
    read = coerce_raw_lines(read_raw_lenient(spark, [f"{root}/plain", f"{root}/broken"], header=False))
    bad = F.col("reason").isNotNull()
    return read.select(
        "user_id",
        iso_text(F.col("timestamp")).alias("timestamp"),
        "transaction_type",
        "transaction_method",
        F.when(~bad, F.col("amount")).alias("amount"),
        F.when(~bad, F.col("segment_tag")).alias("segment_tag"),
        "reason",
        F.when(bad, F.col("source_row")).alias("source_row"),
    )


def inferred_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries in formats that their rows settle, or do not: loaded rows and reasons."""
    root = scratch_path(spark, "deliveries")
    dated_event_lines(spark, sf_dir).write.partitionBy("delivery").text(root)
    lines = read_raw_lenient(spark, f"{root}/*", header=False)
    folder = F.regexp_extract("source_file", "delivery=([a-z]+)", 1)
    lines = with_inferred_times(lines.withColumn("delivery", folder), unit="delivery")
    read = coerce_raw_lines(lines)
    return read.select(
        "user_id",
        iso_text(F.col("timestamp")).alias("timestamp"),
        "transaction_type",
        "amount",
        "reason",
        F.regexp_extract("source_file", "delivery=([a-z]+)", 1).alias("delivery"),
    )


def transaction_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "appended")
    transactions = event_transactions(spark, sf_dir)
    append_transactions(transactions, root)
    append_transactions(transactions, root)
    return monthly_stats(read_transactions(spark, root))


def stored_user_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One user's month of the stored table: the first user's first."""
    root = scratch_path(spark, "stored")
    transactions = order_transactions(spark, sf_dir)
    append_transactions(transactions, root)
    wanted = transactions.agg(F.min(F.struct("user_id", "year", "month"))).first()[0]
    found = for_user_month(read_transactions(spark, root), wanted.user_id, wanted.year, wanted.month)
    return _iso(found)


def replay_safe_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "batches")
    transactions = order_transactions(spark, sf_dir)
    loads = {"spend": is_spend(), "other": ~is_spend()}
    for batch_id in ("spend", "other", "spend"):
        load_batch(transactions.filter(loads[batch_id]), root, batch_id)
    loaded = read_batches(spark, root)
    keys = ["batch_id", *KEYS]
    totals = loaded.groupBy(*keys).agg(
        F.count("*").alias("transaction_count"),
        exact_sum(F.col("amount")).cast("double").alias("total_amount"),
    )
    return corrected(totals, loaded, (keys, {"total_amount": F.col("amount")}))


def monthly_stats_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "monthly-stats")
    stats = monthly_stats(order_transactions(spark, sf_dir))
    write_monthly_stats(stats, path)
    return spark.read.schema(stats.schema).parquet(path)


def monthly_stats_upkept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches are added, one is replaced by a part of it and one removed; each change is added up by itself."""
    facts, stats = scratch_path(spark, "facts"), scratch_path(spark, "upkept")
    transactions = order_transactions(spark, sf_dir)
    batch = F.pmod(F.crc32("user_id"), F.lit(3))
    for number in range(3):
        load_batch(transactions.filter(batch == number), facts, f"b{number}")
        update_stats(spark, facts, stats, f"b{number}")
    load_batch(transactions.filter((batch == 1) & (F.col("year") < 1998)), facts, "b1")
    update_stats(spark, facts, stats, "b1")
    remove_batch(spark, facts, "b2")
    update_stats(spark, facts, stats, "b2")
    return read_stats(spark, stats)


def month_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = (
        table(spark, sf_dir, "orders")
        .selectExpr("CAST(year(o_orderdate) AS INT) AS year", "CAST(month(o_orderdate) AS INT) AS month")
        .distinct()
    )
    year, month = F.col("year"), F.col("month")
    return months.select(
        "year",
        "month",
        iso_text(month_start(year, month)).alias("first_second"),
        iso_text(month_end(year, month)).alias("last_second"),
        month_name(year, month).alias("name"),
        year_month_label(year, month).alias("label"),
    )


_STATS_COLUMNS = "user_id, year, month, total_spend, spend_count, total_cash_in, cash_in_count"
_ISO = """strftime(timestamp, '%Y-%m-%dT%H:%M:%S') ||
  CASE WHEN microsecond(timestamp) % 1000000 = 0 THEN '' ELSE strftime(timestamp, '.%f') END"""
_VALID = """SELECT user_id, {timestamp} AS timestamp, transaction_type, transaction_method, amount,
  segment_tag, CAST(year(timestamp) AS INT) AS year, CAST(month(timestamp) AS INT) AS month
  FROM typed WHERE reason IS NULL"""
_DAY = "strftime(timestamp, '%Y-%m-%dT00:00:00')"

_LINE_FIELDS = f"""CAST(user_id AS VARCHAR) || ',' || CASE user_id % 3 WHEN 0 THEN 'PRUDENT_PLANNERS' ELSE '' END || ',,nan,' ||
  strftime(ts, '%Y-%m-%d') || ',app,' || {oracle.EVENT_TYPE} || ',' || {oracle.EVENT_METHOD} || ',,' || CAST(value AS VARCHAR)"""
_LINES = f"""SELECT CASE WHEN ok THEN user_id END AS user_id, CASE WHEN ok THEN strftime(ts, '%Y-%m-%dT00:00:00') END AS timestamp,
  CASE WHEN ok THEN kind END AS transaction_type, CASE WHEN ok THEN method END AS transaction_method,
  CASE WHEN ok THEN value END AS amount,
  CASE WHEN ok THEN concat_ws(', ', CASE WHEN CAST(user_id AS BIGINT) % 3 = 0 THEN 'PRUDENT_PLANNERS' END,
    CASE WHEN event_id % 17 = 0 THEN 'LUSH' || chr(10) || 'DRINKERS' END) END AS segment_tag,
  CASE WHEN NOT ok THEN 'malformed line' END AS reason,
  CASE WHEN ok THEN NULL WHEN event_id % 11 = 0 THEN user_id || ',short' ELSE line || ',one,' || event_id END AS source_row
FROM (SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, ts, value, {oracle.EVENT_TYPE} AS kind, {oracle.EVENT_METHOD} AS method,
  {_LINE_FIELDS} AS line, event_id % 17 = 0 OR (event_id % 11 <> 0 AND event_id % 13 <> 0) AS ok FROM events)"""

_TIMES = f"""SELECT user_id, CASE WHEN reason IS NULL THEN strftime(ts, '%Y-%m-%dT00:00:00') END AS timestamp,
  transaction_type, amount, reason, delivery
FROM (SELECT *, CASE WHEN event_id % 19 = 0 THEN 'missing or unparsable timestamp' WHEN delivery = 'mixed' THEN 'mixed time formats'
    WHEN delivery = 'torn' THEN 'ambiguous time format' END AS reason
  FROM (SELECT event_id, ts, CAST(user_id AS VARCHAR) AS user_id, {oracle.EVENT_TYPE} AS transaction_type, value AS amount,
      CASE user_id % 5 WHEN 0 THEN 'iso' WHEN 1 THEN 'american' WHEN 2 THEN 'british' WHEN 3 THEN 'mixed'
        ELSE CASE WHEN day(ts) BETWEEN 2 AND 12 THEN 'torn' ELSE 'iso' END END AS delivery FROM events))"""

QUERIES = {
    "csv_roundtrip": (csv_roundtrip, f"WITH {oracle.RAW} {_VALID.format(timestamp=_DAY)}"),
    "processed_transactions": (
        processed_transactions,
        f"""WITH {oracle.RAW} SELECT user_id, strftime(timestamp, '%Y-%m-%d') AS timestamp,
        transaction_type, transaction_method, amount_text AS amount, segment_tag FROM raw""",
    ),
    "coerced_transactions": (
        coerced_transactions,
        f"WITH {oracle.RAW} {_VALID.format(timestamp=_ISO)}",
    ),
    "quarantined_rows": (
        quarantined_rows,
        f"""WITH {oracle.RAW} SELECT user_id, {_ISO} AS timestamp, transaction_type,
        transaction_method, segment_tag, reason FROM typed WHERE reason IS NOT NULL""",
    ),
    "malformed_lines": (malformed_lines, _LINES),
    "inferred_times": (inferred_times, _TIMES),
    "transaction_append": (
        transaction_append,
        f"""WITH one AS (WITH {oracle.EVENTS} SELECT * FROM t),
        t AS (SELECT * FROM one UNION ALL SELECT * FROM one), {oracle.STATS}
        SELECT {_STATS_COLUMNS} FROM stats""",
    ),
    "stored_user_month": (
        stored_user_month,
        f"""WITH {oracle.ORDERS} SELECT user_id, {_ISO} AS timestamp, transaction_type,
          transaction_method, amount, segment_tag, year, month
        FROM t WHERE (user_id, year, month) =
          (SELECT (user_id, year, month) FROM t ORDER BY user_id, year, month LIMIT 1)""",
    ),
    "replay_safe_load": (
        replay_safe_load,
        f"""WITH {oracle.ORDERS}
        SELECT CASE WHEN transaction_type = 'SPEND' THEN 'spend' ELSE 'other' END AS batch_id,
          user_id, year, month, count(*) AS transaction_count,
          CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS total_amount
        FROM t GROUP BY 1, 2, 3, 4""",
    ),
    "monthly_stats_table": (
        monthly_stats_table,
        f"WITH {oracle.ORDERS}, {oracle.STATS} SELECT {_STATS_COLUMNS} FROM stats",
    ),
    "monthly_stats_upkept": (
        monthly_stats_upkept,
        f"""WITH whole AS (WITH {oracle.ORDERS} SELECT * FROM t),
        numbered AS (SELECT *, CAST(user_id AS VARCHAR) AS c FROM whole),
        t AS (SELECT * FROM (SELECT *, xor({oracle.CRC32}, 4294967295::BIGINT) % 3 AS batch FROM numbered)
          WHERE batch = 0 OR (batch = 1 AND year < 1998)), {oracle.STATS}
        SELECT {_STATS_COLUMNS} FROM stats""",
    ),
    "month_bounds": (
        month_bounds,
        """SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS year,
          CAST(month(o_orderdate) AS INT) AS month,
          strftime(date_trunc('month', o_orderdate), '%Y-%m-%dT%H:%M:%S') AS first_second,
          strftime(last_day(o_orderdate), '%Y-%m-%dT23:59:59') AS last_second,
          monthname(o_orderdate) AS name, strftime(o_orderdate, '%Y-%m') AS label
        FROM orders""",
    ),
}
