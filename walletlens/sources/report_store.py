"""Reports kept in generations, so that old versions can be cleared away without a moment of doubt.

A store holds folders ``generation-N`` in the layout of ``report_files`` and an empty file ``current/N`` for
each generation that is whole. Runs append to the greatest such generation and readers read it. Compaction
writes the newest version of each report into the next folder and marks it only when it is whole: until
then everybody goes on with the one before, and a compaction that failed is simply run again over its
remains. One run or compaction at a time may write; readers may read all the while, as folders of earlier
generations stay until ``drop_generations``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from walletlens.schema import REPORT_FILE_SCHEMA
from walletlens.session import path_exists
from walletlens.sources.report_files import REPORT_COLUMNS, normalise_reports, read_reports, write_reports


def _file_system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def generations(spark: SparkSession, store: str) -> list[int]:
    """Numbers of the whole generations, rising; a store without a mark is at generation 0."""
    if not path_exists(spark, f"{store}/current"):
        return [0]
    files, marks = _file_system(spark, f"{store}/current")
    return sorted({0, *(int(mark.getPath().getName()) for mark in files.listStatus(marks))})


def _folder(store: str, generation: int) -> str:
    return f"{store}/generation-{generation}"


def store_reports(reports: DataFrame, store: str, run_ts: dt.datetime) -> None:
    """Append one run's reports to the current generation."""
    write_reports(reports, _folder(store, generations(reports.sparkSession, store)[-1]), run_ts)


def read_store(spark: SparkSession, store: str, year: int | None = None, month: str | None = None) -> DataFrame:
    """The newest report per user-month of the current generation; ``year`` and ``month`` prune folders."""
    return read_reports(spark, _folder(store, generations(spark, store)[-1]), year, month)


def compact(spark: SparkSession, store: str) -> int:
    """Write the newest version of each report as the next generation and switch to it; returns its number.

    Versions are reduced before they are shuffled, and each keeps the time of its run, so later runs replace
    compacted reports as they would have replaced the ones they came from.
    """
    now = generations(spark, store)[-1]
    files = spark.read.option("mode", "FAILFAST").schema(REPORT_FILE_SCHEMA).json(_folder(store, now))
    report = F.struct(*REPORT_COLUMNS)
    newest = normalise_reports(files).groupBy("metadata").agg(F.max(F.struct("run_ts", F.to_json(report).alias("text"))).alias("last"))
    kind = files.select(*[F.col(name) for name in REPORT_COLUMNS]).schema
    rows = newest.select(F.col("last.run_ts").alias("run_ts"), F.from_json("last.text", kind).alias("report"))
    rows = rows.select("report.*", "run_ts", F.col("report.metadata.year").alias("year"), F.col("report.metadata.month").alias("month"))
    rows = rows.hint("rebalance", F.col("year"), F.col("month"))
    rows = rows.write.mode("overwrite").option("partitionOverwriteMode", "static")
    rows.partitionBy("year", "month").json(_folder(store, now + 1))
    files, mark = _file_system(spark, f"{store}/current/{now + 1}")
    files.create(mark, True).close()
    return now + 1


def drop_generations(spark: SparkSession, store: str) -> list[int]:
    """Delete the folders before the current generation, once nobody reads them any more; returns their numbers."""
    gone = []
    for generation in generations(spark, store)[:-1]:
        files, folder = _file_system(spark, _folder(store, generation))
        if files.delete(folder, True):
            gone.append(generation)
    return gone
