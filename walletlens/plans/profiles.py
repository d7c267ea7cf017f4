"""Registered queries on aggregates, profiles and analyses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from walletlens.operators import aggregates, analysis, profile
from walletlens.plans import oracle
from walletlens.functions.text import format_tag
from walletlens.session import scratch_path
from walletlens.sources.fact_table import load_batch, read_batches
from walletlens.sources.tables import event_transactions, order_transactions, table
from walletlens.sources.user_index import read_users, write_users

Query = Callable[[SparkSession, str], DataFrame]


def _on_events(operator: Callable[..., DataFrame], *args, **options) -> Query:
    return lambda spark, sf_dir: operator(event_transactions(spark, sf_dir), *args, **options)


def _on_orders(operator: Callable[..., DataFrame], *args, **options) -> Query:
    return lambda spark, sf_dir: operator(order_transactions(spark, sf_dir), *args, **options)


def user_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = aggregates.user_segments(event_transactions(spark, sf_dir))
    return segments.select(
        "user_id",
        "year",
        "month",
        F.array_join("segments", "|").alias("segments"),
        F.array_join(F.transform("segments", format_tag), ", ").alias("shown"),
    )


def nested_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested rows, with one row per listed method and the tags joined."""
    nested = profile.nested_profile(event_transactions(spark, sf_dir))
    return nested.select(
        *["user_id", "year", "month", "total_spend", "spend_count", "total_cash_in", "cash_in_count"],
        F.inline("methods_summary"),
        "segments",
    ).withColumn("segments", F.array_join("segments", "|"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A month per customer, and suppliers as users nobody knows."""
    known = table(spark, sf_dir, "customer").selectExpr(
        "CAST(c_custkey AS STRING) AS user_id",
        "CAST(1995 + c_custkey % 7 AS INT) AS year",
        "CAST(1 + c_custkey % 12 AS INT) AS month",
    )
    unknown = table(spark, sf_dir, "supplier").selectExpr(
        "concat('S', s_suppkey) AS user_id", "2024 AS year", "1 AS month"
    )
    return known.union(unknown)


def requested_user_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.requested_status(
        order_transactions(spark, sf_dir), requests(spark, sf_dir)
    ).withColumn("message", F.coalesce("message", F.lit("")))


def requested_status_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same answers from a stored table and its user index, both loaded in batches and one batch twice."""
    root, index = scratch_path(spark, "facts"), scratch_path(spark, "users")
    transactions = order_transactions(spark, sf_dir)
    for batch in (0, 1, 0):
        rows = transactions.filter(F.pmod(F.crc32("user_id"), F.lit(3)).isin([0, 2] if batch else [1]))
        load_batch(rows, root, f"b{batch}")
        write_users(rows, index, f"b{batch}")
    found = profile.requested_status(read_batches(spark, root), requests(spark, sf_dir), read_users(spark, index))
    return found.withColumn("message", F.coalesce("message", F.lit("")))


def requested_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.requested_profiles(order_transactions(spark, sf_dir), requests(spark, sf_dir))


_E, _O = oracle.EVENTS, oracle.ORDERS
_KEYS = "user_id, year, month"
_STATS_COLUMNS = f"{_KEYS}, total_spend, spend_count, total_cash_in, cash_in_count"
_TYPE_TOTAL = "CASE transaction_type WHEN 'SPEND' THEN total_spend ELSE total_cash_in END"
_TYPE_COUNT = "CASE transaction_type WHEN 'SPEND' THEN spend_count ELSE cash_in_count END"
_BOTH = "transaction_type IN ('SPEND', 'CASH-IN')"
_BASE = f"{oracle.STATS}, {oracle.METHODS}"
_JOINED = "methods JOIN stats USING (user_id, year, month)"
_REQUESTS = """requests AS (
  SELECT CAST(c_custkey AS VARCHAR) AS user_id, CAST(1995 + c_custkey % 7 AS INT) AS year,
    CAST(1 + c_custkey % 12 AS INT) AS month FROM customer
  UNION SELECT 'S' || s_suppkey, 2024, 1 FROM supplier)"""
_STATUS = """CASE WHEN r.user_id NOT IN (SELECT user_id FROM t) THEN 'unknown_user'
  WHEN coalesce(has_data, false) THEN 'ok' ELSE 'no_data' END"""
_MESSAGE = """CASE status WHEN 'unknown_user'
    THEN 'Error: User ID ' || user_id || ' not found in the database.'
  WHEN 'no_data' THEN 'User ' || user_id || ' (' || printf('%d-%02d', year, month) || ')' || chr(10)
    || 'No transaction data found for this period.' ELSE {ok} END"""
_ANSWERED = f"""WITH {_O}, {oracle.PROFILE}, {_REQUESTS},
  answered AS (SELECT r.user_id, r.year, r.month, {_STATUS} AS status, profile_text
    FROM requests r LEFT JOIN profiles p
      ON p.user_id = r.user_id AND p.year = r.year AND p.month = r.month)"""
_TOP = f"""top AS (SELECT {_KEYS}, transaction_method, n, amt, CAST(row_number() OVER (
    PARTITION BY {_KEYS} ORDER BY amt DESC, transaction_method) AS INTEGER) AS rank
  FROM methods WHERE transaction_type = 'SPEND')"""
_LIST_CHUNK = 20
#: One of the many months of the orders.
_MONTH = (1997, 5)

QUERIES = {
    "monthly_stats": (
        _on_events(aggregates.monthly_stats),
        f"WITH {_E}, {oracle.STATS} SELECT {_STATS_COLUMNS} FROM stats",
    ),
    "methods_summary": (
        _on_events(aggregates.methods_summary),
        f"""WITH {_E}, {oracle.METHODS} SELECT {_KEYS}, transaction_method, transaction_type,
        n AS count, amt AS total_amount FROM methods""",
    ),
    "user_segments": (
        user_segments,
        f"WITH {_E}, {oracle.SEGMENTS} SELECT {_KEYS}, tags AS segments, shown FROM segments",
    ),
    "nested_profile": (
        nested_profile,
        f"""WITH {_E}, {_BASE}, {oracle.SEGMENTS}
        SELECT {_STATS_COLUMNS}, transaction_method AS method, transaction_type AS type, n AS count,
          amt AS total_amount, coalesce(tags, '') AS segments
        FROM {_JOINED} LEFT JOIN segments USING (user_id, year, month)""",
    ),
    "method_share_amount": (
        _on_events(aggregates.method_share_amount),
        f"""WITH {_E}, {_BASE} SELECT {_KEYS}, transaction_type, transaction_method,
          amt AS method_amount, amt / {_TYPE_TOTAL} * 100 AS share_percent
        FROM {_JOINED} WHERE {_BOTH} AND {_TYPE_TOTAL} > 0""",
    ),
    "method_share_count": (
        _on_events(aggregates.method_share_count),
        f"""WITH {_E}, {_BASE} SELECT {_KEYS}, transaction_type, transaction_method,
          n AS method_count, n / {_TYPE_COUNT} * 100 AS share_percent
        FROM {_JOINED} WHERE {_BOTH}""",
    ),
    "top_spending_categories": (
        _on_orders(aggregates.top_spending, 2),
        f"""WITH {_O}, {oracle.METHODS}, {_TOP} SELECT {_KEYS}, rank, transaction_method,
        n AS method_count, amt AS method_amount FROM top WHERE rank <= 2""",
    ),
    "monthly_profile_text": (
        _on_events(profile.profile_text),
        f"WITH {_E}, {oracle.PROFILE} SELECT {_KEYS}, profile_text, has_data FROM profiles",
    ),
    "monthly_profile_text_orders": (
        _on_orders(profile.profile_text),
        f"WITH {_O}, {oracle.PROFILE} SELECT {_KEYS}, profile_text, has_data FROM profiles",
    ),
    "monthly_transactions": (
        _on_events(aggregates.monthly_transactions, 2024, 1),
        f"""WITH {_E} SELECT user_id, strftime(timestamp, '%Y-%m-%dT%H:%M:%S') ||
          CASE WHEN microsecond(timestamp) % 1000000 = 0 THEN ''
            ELSE strftime(timestamp, '.%f') END AS timestamp,
          transaction_type, transaction_method, coalesce(amount, 0.0) AS amount, segment_tag
        FROM t WHERE year = 2024 AND month = 1""",
    ),
    "active_users": (
        _on_events(aggregates.active_users, 2024, 1, 60, 1000, 800, 600),
        f"""WITH {_E} SELECT * FROM (
          SELECT user_id, count(*) AS transaction_count, {oracle.total('SPEND')} AS total_spend,
            {oracle.total('CASH-IN')} AS total_cash_in
          FROM t WHERE timestamp BETWEEN TIMESTAMP '2024-01-01 00:00:00'
            AND TIMESTAMP '2024-01-31 23:59:59'
          GROUP BY user_id HAVING count(*) >= 60) a
        WHERE total_spend >= 800 AND total_cash_in >= 600 ORDER BY user_id LIMIT 1000""",
    ),
    "monthly_transactions_orders": (
        _on_orders(aggregates.monthly_transactions, *_MONTH),
        f"""WITH {_O} SELECT user_id, strftime(timestamp, '%Y-%m-%dT%H:%M:%S') AS timestamp,
          transaction_type, transaction_method, coalesce(amount, 0.0) AS amount, segment_tag
        FROM t WHERE year = {_MONTH[0]} AND month = {_MONTH[1]}""",
    ),
    "first_active_users": (
        _on_orders(aggregates.active_users, *_MONTH, 1, 5),
        f"""WITH {_O} SELECT user_id, count(*) AS transaction_count, {oracle.total('SPEND')} AS total_spend,
          {oracle.total('CASH-IN')} AS total_cash_in
        FROM t WHERE year = {_MONTH[0]} AND month = {_MONTH[1]}
        GROUP BY user_id ORDER BY user_id LIMIT 5""",
    ),
    "distinct_users": (
        _on_events(aggregates.distinct_users),
        f"WITH {_E} SELECT DISTINCT user_id FROM t",
    ),
    "requested_user_status": (
        requested_user_status,
        f"""{_ANSWERED} SELECT {_KEYS}, status, {_MESSAGE.format(ok="''")} AS message
        FROM answered""",
    ),
    "requested_status_indexed": (
        requested_status_indexed,
        f"""{_ANSWERED} SELECT {_KEYS}, status, {_MESSAGE.format(ok="''")} AS message
        FROM answered""",
    ),
    "requested_profiles": (
        requested_profiles,
        f"""{_ANSWERED} SELECT {_KEYS}, status, {_MESSAGE.format(ok="profile_text")} AS answer
        FROM answered""",
    ),
    "cash_flow": (
        _on_events(analysis.cash_flow),
        f"""WITH {_E}, {_BASE} SELECT {_KEYS}, total_cash_in, total_spend, net AS net_cash,
          transaction_type, transaction_method, amt AS method_amount,
          CASE WHEN {_TYPE_TOTAL} > 0 THEN amt / {_TYPE_TOTAL} * 100 END AS share_percent
        FROM {_JOINED} WHERE {_BOTH}""",
    ),
    "transaction_behaviour": (
        _on_orders(analysis.transaction_behaviour),
        f"""WITH {_O}, {_BASE}, {_TOP}
        SELECT {_KEYS}, spend_count + cash_in_count AS total_transactions, cash_in_count, spend_count,
          CASE WHEN spend_count > 0 THEN total_spend / spend_count END AS average_spend,
          (spend_count + cash_in_count) / day(last_day(make_date(year, month, 1)))
            AS transactions_per_day, coalesce(top_spending, '') AS top_spending
        FROM stats LEFT JOIN (SELECT {_KEYS}, string_agg(transaction_method, ', ' ORDER BY rank)
            AS top_spending FROM top WHERE rank <= 3 GROUP BY {_KEYS}) x
          USING (user_id, year, month)
        WHERE spend_count + cash_in_count > 0""",
    ),
    "savings_position": (
        _on_orders(analysis.savings_position),
        f"""WITH {_O}, {oracle.STATS} SELECT {_KEYS}, total_cash_in, total_spend, net AS savings,
          CASE WHEN total_cash_in > 0 THEN total_spend / total_cash_in END AS spend_ratio,
          CASE WHEN total_cash_in > 0 THEN total_spend / total_cash_in * 100 END AS spend_percent,
          CASE WHEN total_cash_in > 0 THEN net / total_cash_in * 100 END AS savings_percent,
          CASE WHEN total_cash_in <= 0 THEN 'no income' WHEN net < 0 THEN 'overspent'
            WHEN net / total_cash_in * 100 >= 20 THEN 'meets guideline'
            ELSE 'below guideline' END AS savings_status
        FROM stats WHERE spend_count > 0 OR cash_in_count > 0""",
    ),
    "amount_lists": (
        _on_events(analysis.amount_lists, _LIST_CHUNK),
        f"""WITH {_E}, placed AS (
          SELECT {_KEYS}, transaction_type, timestamp, coalesce(amount, 0.0) AS amount,
            row_number() OVER (PARTITION BY {_KEYS}, transaction_type
              ORDER BY timestamp, coalesce(amount, 0.0)) - 1 AS place
          FROM t WHERE {_BOTH})
        SELECT {_KEYS}, transaction_type, place // {_LIST_CHUNK} AS chunk, count(*) AS n_amounts,
          string_agg(printf('%.2f', amount), ', ' ORDER BY place) AS amounts
        FROM placed GROUP BY {_KEYS}, transaction_type, place // {_LIST_CHUNK}""",
    ),
}
