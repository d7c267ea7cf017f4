"""Per-month aggregates over all users.

Raw rows are only ever grouped with aggregates that combine before the shuffle, so a user or
month that holds a large part of all rows arrives as one row per task. Whatever collects or
ranks does so on those reduced rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from walletlens.functions.dates import iso_text
from walletlens.functions.numbers import exact_sum, no_money, share_percent
from walletlens.operators.cleaning import (
    has_segment,
    in_month,
    in_month_seconds,
    is_cash_in,
    is_spend,
)
from walletlens.operators.large_amounts import corrected
from walletlens.schema import CASH_IN, KEYS, SPEND


def both_totals() -> dict[str, Column]:
    """The amounts that the two totals add up."""
    return {
        "total_spend": F.when(is_spend(), F.col("amount")),
        "total_cash_in": F.when(is_cash_in(), F.col("amount")),
    }


def exact_stats(t: DataFrame) -> DataFrame:
    """A1 with exact decimal totals, for what subtracts them."""

    def total(condition: Column) -> Column:
        return F.coalesce(exact_sum(F.when(condition, F.col("amount"))), no_money())

    return t.groupBy(*KEYS).agg(
        total(is_spend()).alias("total_spend"),
        F.count_if(is_spend()).alias("spend_count"),
        total(is_cash_in()).alias("total_cash_in"),
        F.count_if(is_cash_in()).alias("cash_in_count"),
    )


def monthly_stats(t: DataFrame) -> DataFrame:
    """A1: spend and cash-in totals and counts; other types count in neither."""
    stats = exact_stats(t).withColumns({name: F.col(name).cast("double") for name in both_totals()})
    return corrected(stats, t, (KEYS, both_totals()))


def exact_methods(t: DataFrame) -> DataFrame:
    """A2 with exact decimal totals."""
    return t.groupBy(*KEYS, "transaction_method", "transaction_type").agg(
        F.count("*").alias("count"),
        F.coalesce(exact_sum(F.col("amount")), no_money()).alias("total_amount"),
    )


def methods_summary(t: DataFrame) -> DataFrame:
    """A2: count and amount per method and type, all types."""
    methods = exact_methods(t).withColumn("total_amount", F.col("total_amount").cast("double"))
    return corrected(methods, t, ([*KEYS, "transaction_method", "transaction_type"], {"total_amount": F.col("amount")}))


def user_segments(t: DataFrame) -> DataFrame:
    """A3: the distinct combined tags per user-month, in name order (V5)."""
    distinct = t.filter(has_segment()).select(*KEYS, "segment_tag").distinct()
    return distinct.groupBy(*KEYS).agg(
        F.array_sort(F.collect_list("segment_tag")).alias("segments")
    )


def method_totals(t: DataFrame) -> DataFrame:
    """A2 for spend and cash-in, with the user-month's totals beside each method.

    Reduced rows are spread by user-month once; the windows over user-month and type need no
    further shuffle.
    """
    both = t.filter(F.col("transaction_type").isin(SPEND, CASH_IN))
    exact = exact_methods(both).repartition(*KEYS)
    month = Window.partitionBy(*KEYS)

    def total(kind: str, name: str, zero: Column) -> Column:
        part = F.when(F.col("transaction_type") == kind, F.col(name))
        return F.coalesce(F.sum(part).over(month), zero)

    summed = exact.select(
        "*",
        total(SPEND, "total_amount", no_money()).alias("spend"),
        total(CASH_IN, "total_amount", no_money()).alias("cash_in"),
        total(SPEND, "count", F.lit(0)).alias("spend_count"),
        total(CASH_IN, "count", F.lit(0)).alias("cash_in_count"),
    )
    totals = summed.select(
        *KEYS,
        "transaction_type",
        "transaction_method",
        F.col("count").alias("method_count"),
        F.col("total_amount").cast("double").alias("method_amount"),
        F.col("spend").cast("double").alias("total_spend"),
        F.col("cash_in").cast("double").alias("total_cash_in"),
        (F.col("cash_in") - F.col("spend")).cast("double").alias("net_cash"),
        "spend_count",
        "cash_in_count",
    )
    net = F.when(is_cash_in(), F.col("amount")).otherwise(-F.col("amount"))
    of_method = [*KEYS, "transaction_type", "transaction_method"]
    months = (KEYS, {**both_totals(), "net_cash": net})
    return corrected(totals, both, months, (of_method, {"method_amount": F.col("amount")}))


def of_type(spend: str, cash_in: str) -> Column:
    """The spend or the cash-in column, after the row's type."""
    return F.when(is_spend(), F.col(spend)).otherwise(F.col(cash_in))


def method_share_amount(t: DataFrame) -> DataFrame:
    """A method's part of its type's amount in percent; types with no positive total drop."""
    return (
        method_totals(t)
        .select(
            *KEYS,
            "transaction_type",
            "transaction_method",
            "method_amount",
            share_percent(F.col("method_amount"), of_type("total_spend", "total_cash_in")).alias(
                "share_percent"
            ),
        )
        .filter(F.col("share_percent").isNotNull())
    )


def method_share_count(t: DataFrame) -> DataFrame:
    """A method's part of its type's number of transactions in percent."""
    return method_totals(t).select(
        *KEYS,
        "transaction_type",
        "transaction_method",
        "method_count",
        (F.col("method_count") / of_type("spend_count", "cash_in_count") * 100).alias(
            "share_percent"
        ),
    )


def top_spending(t: DataFrame, k: int = 3) -> DataFrame:
    """The k spending methods with the largest amounts; equal amounts in name order."""
    largest = Window.partitionBy(*KEYS).orderBy(F.desc("total_amount"), "transaction_method")
    return (
        methods_summary(t.filter(is_spend()))
        .withColumn("rank", F.row_number().over(largest))
        .filter(F.col("rank") <= k)
        .select(
            *KEYS,
            "rank",
            "transaction_method",
            F.col("count").alias("method_count"),
            F.col("total_amount").alias("method_amount"),
        )
    )


def monthly_transactions(t: DataFrame, year: int, month: int) -> DataFrame:
    """One month's rows of all users in time order; ties in the order of the other columns.

    The order is a range-partitioned sort over the whole key, so a user with many rows spans
    as many tasks as needed.
    """
    rows = in_month(t, year, month).select(
        "user_id",
        "timestamp",
        "transaction_type",
        "transaction_method",
        F.coalesce("amount", F.lit(0.0)).alias("amount"),
        "segment_tag",
    )
    ordered = rows.orderBy(
        "user_id", "timestamp", "transaction_type", "transaction_method", "amount", "segment_tag"
    )
    return ordered.withColumn("timestamp", iso_text(F.col("timestamp")))


def active_user_stats(t: DataFrame, year: int, month: int, min_transactions: int = 3) -> DataFrame:
    """A4: users with enough rows of any type in the month."""

    def total(condition: Column) -> Column:
        exact = exact_sum(F.when(condition, F.col("amount")))
        return F.coalesce(exact.cast("double"), F.lit(0.0))

    rows = in_month_seconds(t, year, month)
    users = (
        rows.groupBy("user_id")
        .agg(
            F.count("*").alias("transaction_count"),
            total(is_spend()).alias("total_spend"),
            total(is_cash_in()).alias("total_cash_in"),
        )
        .filter(F.col("transaction_count") >= min_transactions)
    )
    return corrected(users, rows, (["user_id"], both_totals()))


def active_users(
    t: DataFrame,
    year: int,
    month: int,
    min_transactions: int = 3,
    max_users: int = 1000,
    min_spend: float = 0,
    min_cash_in: float = 0,
) -> DataFrame:
    """A4 + P14 + T2: the first ``max_users`` active users in id order (V5)."""
    active = active_user_stats(t, year, month, min_transactions)
    floors = (F.col("total_spend") >= min_spend) & (F.col("total_cash_in") >= min_cash_in)
    return active.filter(floors).orderBy("user_id").limit(max_users)


def distinct_users(t: DataFrame) -> DataFrame:
    """D1"""
    return t.select("user_id").distinct()
