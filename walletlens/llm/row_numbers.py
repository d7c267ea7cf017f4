"""Row numbers over a whole table without bringing it into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from walletlens.session import materialize


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with a number from 0 in the given order; rows that the order leaves equal are numbered in any order.

    Ranges of the order are numbered by themselves and moved by the rows of the ranges before. Only the
    number of rows of each range, a row a partition, meets in one task.
    """
    ranged = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    ranged = materialize(ranged, "ranges")
    rows = ranged.groupBy("_range").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_range")) - F.col("_rows")
    starts = rows.select("_range", before.alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order)).cast("long") - 1
    return ranged.withColumn(name, within).join(starts, "_range").withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")
