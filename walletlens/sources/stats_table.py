"""Monthly stats kept up to date batch by batch (A5).

Each batch has its own partial stats: exact sums and counts per user-month, which add up to those of the
whole table. A batch that is added, replaced or removed changes the stats of the months it had or has, and
only these are added up again, from the partial stats of all batches.

The months to do are noted before anything is replaced and struck out when the stats are written, so an update
that is run again after a failure does all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from walletlens.operators.aggregates import both_totals, exact_stats
from walletlens.operators.large_amounts import corrected
from walletlens.schema import KEYS, MONEY
from walletlens.session import path_exists
from walletlens.sources.fact_table import PARTITIONS, batch_path, read_batches

_COUNTS = ["spend_count", "cash_in_count"]
_TOTALS = ["total_spend", "total_cash_in"]
STATS_SCHEMA = "user_id string, year int, month int, total_spend double, spend_count long, total_cash_in double, cash_in_count long"
PARTS_SCHEMA = STATS_SCHEMA.replace("double", MONEY) + ", batch_id string"
_MONTHS = "year int, month int, batch_id string"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], schema)


def read_stats(spark: SparkSession, root: str) -> DataFrame:
    """The stats of all user-months; filters on year and month prune folders."""
    columns = [part.split()[0] for part in STATS_SCHEMA.split(", ")]
    return _read(spark, f"{root}/stats", STATS_SCHEMA).select(*columns)


def _in_months(df: DataFrame, months: list[tuple[int, int]]) -> DataFrame:
    """Rows of some months, by literals that prune folders."""
    wanted = F.lit(False)
    for year, month in months:
        wanted = wanted | ((F.col("year") == year) & (F.col("month") == month))
    return df.filter(wanted)


def _write_months(stats: DataFrame, path: str) -> None:
    laid_out = stats.hint("rebalance", *[F.col(name) for name in PARTITIONS]).sortWithinPartitions(*PARTITIONS, "user_id")
    laid_out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(path)


def update_stats(spark: SparkSession, facts: str, root: str, batch_id: str) -> list[tuple[int, int]]:
    """Bring the stats below ``root`` up to date with a batch of ``facts`` that was loaded, replaced or removed.

    Returns the months that were added up anew.
    """
    loaded = read_batches(spark, facts)
    batch = loaded.filter(F.col("batch_id") == batch_id)
    parts, pending = f"{root}/parts", f"{root}/pending"
    before = _read(spark, parts, PARTS_SCHEMA).filter(F.col("batch_id") == batch_id).select(*PARTITIONS)
    open_since = _read(spark, pending, _MONTHS).filter(F.col("batch_id") == batch_id).select(*PARTITIONS)
    months = before.union(open_since).union(batch.select(*PARTITIONS)).distinct()
    # As many rows as a batch has months.
    todo = sorted((row.year, row.month) for row in months.collect())
    noted = spark.createDataFrame(todo, "year int, month int")
    noted.write.mode("overwrite").parquet(batch_path(pending, batch_id))

    part = exact_stats(batch).write.mode("overwrite").option("partitionOverwriteMode", "static")
    part.partitionBy(*PARTITIONS).parquet(batch_path(parts, batch_id))
    if todo:
        rows = _in_months(_read(spark, parts, PARTS_SCHEMA), todo)
        sums = [F.sum(name).cast("double").alias(name) for name in _TOTALS] + [F.sum(name).alias(name) for name in _COUNTS]
        stats = rows.groupBy(*KEYS).agg(*sums).select(*KEYS, "total_spend", "spend_count", "total_cash_in", "cash_in_count")
        stats = corrected(stats, _in_months(loaded, todo), (KEYS, both_totals()))
        _write_months(stats, f"{root}/stats")
        left = {(row.year, row.month) for row in rows.select(*PARTITIONS).distinct().collect()}
        for year, month in todo:
            if (year, month) not in left:  # nothing that could replace the folder
                stats.limit(0).drop(*PARTITIONS).write.mode("overwrite").parquet(f"{root}/stats/year={year}/month={month}")
    noted.limit(0).write.mode("overwrite").parquet(batch_path(pending, batch_id))
    return todo
