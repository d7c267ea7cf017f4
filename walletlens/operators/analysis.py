"""Analyses per user-month."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from walletlens.functions.dates import days_in_month
from walletlens.functions.numbers import no_money, ratio, share_percent, two_decimals
from walletlens.operators.aggregates import both_totals, exact_methods, exact_stats, method_totals, of_type
from walletlens.operators.cleaning import is_cash_in, is_spend
from walletlens.operators.large_amounts import corrected
from walletlens.schema import CASH_IN, KEYS, SPEND
from walletlens.session import materialize

SAVINGS_GUIDELINE_PERCENT = 20


def cash_flow(t: DataFrame) -> DataFrame:
    """One row per method with its amount and share, beside totals and the net position."""
    return method_totals(t).select(
        *KEYS,
        "total_cash_in",
        "total_spend",
        "net_cash",
        "transaction_type",
        "transaction_method",
        "method_amount",
        share_percent(F.col("method_amount"), of_type("total_spend", "total_cash_in")).alias(
            "share_percent"
        ),
    )


def transaction_behaviour(t: DataFrame, k: int = 3) -> DataFrame:
    """Volumes, averages and the k top spending methods in one row per user-month.

    The methods of a user-month are reduced rows already, so they are listed and cut after
    one more shuffle of those instead of a second pass over the transactions.
    """
    both = t.filter(F.col("transaction_type").isin(SPEND, CASH_IN))
    spending = F.struct((-F.col("amount")).alias("order"), "transaction_method")
    of_method = [*KEYS, "transaction_method", "transaction_type"]
    methods = exact_methods(both).withColumn("amount", F.col("total_amount").cast("double"))
    months = (
        corrected(methods, both, (of_method, {"amount": F.col("amount")}))
        .groupBy(*KEYS)
        .agg(
            F.coalesce(F.sum(F.when(is_spend(), F.col("total_amount"))), no_money())
            .cast("double")
            .alias("total_spend"),
            F.coalesce(F.sum(F.when(is_spend(), F.col("count"))), F.lit(0)).alias("spend_count"),
            F.coalesce(F.sum(F.when(is_cash_in(), F.col("count"))), F.lit(0)).alias(
                "cash_in_count"
            ),
            F.collect_list(F.when(is_spend(), spending)).alias("methods"),
        )
    )
    months = corrected(months, both, (KEYS, {"total_spend": F.when(is_spend(), F.col("amount"))}))
    total = F.col("spend_count") + F.col("cash_in_count")
    top = F.slice(F.array_sort("methods"), 1, k)["transaction_method"]
    return months.select(
        *KEYS,
        total.alias("total_transactions"),
        "cash_in_count",
        "spend_count",
        ratio(F.col("total_spend"), F.col("spend_count")).alias("average_spend"),
        (total / days_in_month(F.col("year"), F.col("month"))).alias("transactions_per_day"),
        F.array_join(top, ", ").alias("top_spending"),
    )


def savings_position(t: DataFrame) -> DataFrame:
    """N3 + F12: spending against income; rates are null where there is no income."""
    exact = (
        exact_stats(t)
        .filter((F.col("spend_count") > 0) | (F.col("cash_in_count") > 0))
        .select(
            *KEYS,
            F.col("total_cash_in").cast("double").alias("total_cash_in"),
            F.col("total_spend").cast("double").alias("total_spend"),
            (F.col("total_cash_in") - F.col("total_spend")).cast("double").alias("savings"),
        )
    )
    net = F.when(is_cash_in(), F.col("amount")).when(is_spend(), -F.col("amount"))
    exact = corrected(exact, t, (KEYS, {**both_totals(), "savings": net}))
    income, spend, savings = F.col("total_cash_in"), F.col("total_spend"), F.col("savings")
    rate = share_percent(savings, income)
    status = (
        F.when(income <= 0, "no income")
        .when(savings < 0, "overspent")
        .when(rate >= SAVINGS_GUIDELINE_PERCENT, "meets guideline")
        .otherwise("below guideline")
    )
    return exact.select(
        "*",
        ratio(spend, income).alias("spend_ratio"),
        share_percent(spend, income).alias("spend_percent"),
        rate.alias("savings_percent"),
        status.alias("savings_status"),
    )


def amount_lists(t: DataFrame, chunk_size: int = 10_000) -> DataFrame:
    """The amounts of a user-month and type in time order, as joined texts.

    A list is cut into consecutive chunks of ``chunk_size`` amounts; joined in chunk order
    they are the whole list, and a list up to that size is chunk 0 alone. Without the cut a
    user with a large part of all rows would be one text built by one task.

    Equal amounts at one time are counted before the shuffle. The cells are then range
    partitioned in list order, so a long list spans many partitions; a cell's position is what
    earlier partitions hold of its list plus what precedes it in its own.
    """
    which = [*KEYS, "transaction_type"]
    amount = F.coalesce("amount", F.lit(0.0)).alias("amount")
    cells = (
        t.filter(F.col("transaction_type").isin(SPEND, CASH_IN))
        .select(*which, "timestamp", amount)
        .groupBy(*which, "timestamp", "amount")
        .agg(F.count("*").alias("n"))
    )
    # Range bounds are sampled, so partition numbers hold only once they are written down.
    ranged = materialize(
        cells.repartitionByRange(*which, "timestamp", "amount").withColumn(
            "part", F.spark_partition_id()
        ),
        "amount-cells",
    )
    earlier_parts = Window.partitionBy(*which).orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        ranged.groupBy(*which, "part")
        .agg(F.sum("n").alias("held"))
        .select(
            *which, "part", F.coalesce(F.sum("held").over(earlier_parts), F.lit(0)).alias("offset")
        )
    )
    earlier_cells = Window.partitionBy(*which, "part").orderBy("timestamp", "amount").rowsBetween(
        Window.unboundedPreceding, -1
    )
    first = F.col("offset") + F.coalesce(F.sum("n").over(earlier_cells), F.lit(0))
    placed = ranged.join(offsets, [*which, "part"]).select(
        *which, "timestamp", "amount", "n", first.alias("first")
    )
    size = F.lit(chunk_size)
    chunks = F.sequence(
        F.expr(f"first div {chunk_size}"), F.expr(f"(first + n - 1) div {chunk_size}")
    )
    start = F.greatest(F.col("first"), F.col("chunk") * size)
    end = F.least(F.col("first") + F.col("n"), (F.col("chunk") + 1) * size)
    pieces = placed.withColumn("chunk", F.explode(chunks)).select(
        *which,
        "chunk",
        F.struct(
            start.alias("at"),
            (end - start).cast("int").alias("times"),
            two_decimals(F.col("amount")).alias("text"),
        ).alias("piece"),
    )
    texts = F.transform(
        F.array_sort("pieces"), lambda piece: F.array_repeat(piece["text"], piece["times"])
    )
    return (
        pieces.groupBy(*which, "chunk")
        .agg(F.collect_list("piece").alias("pieces"))
        .select(
            *which,
            "chunk",
            F.aggregate(
                "pieces", F.lit(0).cast("bigint"), lambda n, piece: n + piece["times"]
            ).alias("n_amounts"),
            F.array_join(F.flatten(texts), ", ").alias("amounts"),
        )
    )
