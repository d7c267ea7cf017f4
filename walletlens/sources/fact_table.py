"""The transactions fact table and its monthly aggregate as parquet.

Layout: partitioned by year and month, files sorted by user. ``rebalance`` splits a month
that holds a large part of all rows over many tasks and files, and joins tiny months, so
neither a hot month nor thousands of small files come out of one load.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from walletlens.schema import TRANSACTION_SCHEMA

PARTITIONS = ["year", "month"]


def _laid_out(df: DataFrame) -> DataFrame:
    months = [F.col(name) for name in PARTITIONS]
    return df.hint("rebalance", *months).sortWithinPartitions(*PARTITIONS, "user_id")


def append_transactions(t: DataFrame, root: str) -> None:
    """Plain append; appending the same rows again counts them again."""
    _laid_out(t).write.mode("append").partitionBy(*PARTITIONS).parquet(root)


def batch_path(root: str, batch_id: str) -> str:
    """The folder of a batch below ``root``."""
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", batch_id):
        raise ValueError(f"batch_id must be a plain name of letters, digits, '.', '_' and '-', got {batch_id!r}")
    return f"{root.rstrip('/')}/batch_id={batch_id}"


def load_batch(t: DataFrame, root: str, batch_id: str) -> None:
    """Replay-safe load. Loading a batch again replaces all of it and nothing else.

    Equal rows within a batch are kept. The overwrite is static on the batch's own folder:
    overwriting only the months present would leave rows of months a corrected batch dropped.
    """
    (
        _laid_out(t)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .partitionBy(*PARTITIONS)
        .parquet(batch_path(root, batch_id))
    )


def remove_batch(spark: SparkSession, root: str, batch_id: str) -> None:
    """Take all rows of a batch out; its folder stays, without rows."""
    load_batch(spark.createDataFrame([], TRANSACTION_SCHEMA), root, batch_id)


def read_transactions(spark: SparkSession, root: str) -> DataFrame:
    """Filters on year and month prune partitions, those on user_id reach the files."""
    return spark.read.schema(TRANSACTION_SCHEMA).parquet(root)


def read_batches(spark: SparkSession, root: str) -> DataFrame:
    """S6 over the layout of ``load_batch``; ``batch_id`` is a column of the result."""
    schema = T.StructType([*TRANSACTION_SCHEMA.fields, T.StructField("batch_id", T.StringType())])
    return spark.read.schema(schema).parquet(root)


def write_monthly_stats(stats: DataFrame, path: str) -> None:
    """A5: the whole aggregate is rebuilt, so the overwrite is static."""
    (
        _laid_out(stats)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .partitionBy(*PARTITIONS)
        .parquet(path)
    )
