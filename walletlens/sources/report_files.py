"""Reports as JSON.

One JSON line per report in folders by year and month name. A run appends; the newest report
of a user-month wins on reading, so a rerun replaces a report without touching its neighbours.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from walletlens.functions.dates import ntz
from walletlens.schema import REPORT_FILE_SCHEMA

REPORT_COLUMNS = ["metadata", "report_components", "evaluations", "best_approaches"]


def write_reports(reports: DataFrame, root: str, run_ts: dt.datetime) -> None:
    """Append one run's reports."""
    rows = reports.select(
        *REPORT_COLUMNS,
        ntz(run_ts).alias("run_ts"),
        F.col("metadata.year").alias("year"),
        F.col("metadata.month").alias("month"),
    )
    rows = rows.hint("rebalance", F.col("year"), F.col("month"))
    rows.write.mode("append").partitionBy("year", "month").json(root)


def normalise_reports(files: DataFrame) -> DataFrame:
    """Older files name two fields differently."""
    return files.select(
        "metadata",
        "report_components",
        F.coalesce("evaluations", "evaluation").alias("evaluations"),
        F.coalesce("best_approaches", "chosen_approaches").alias("best_approaches"),
        "run_ts",
    )


def latest_reports(reports: DataFrame) -> DataFrame:
    """The newest report per user-month.

    An aggregate, so that many versions of one report are reduced before they are shuffled;
    ``max_by`` on the run keeps every column of the same report. A report without a run counts as
    the oldest, and of two reports of one run the one whose JSON text sorts last is taken.
    """
    report = F.struct(*REPORT_COLUMNS)
    newest = reports.groupBy("metadata").agg(
        F.max_by(report, F.struct("run_ts", F.to_json(report))).alias("r")
    )
    return newest.select([F.col(f"r.{name}").alias(name) for name in REPORT_COLUMNS])


def read_reports(
    spark: SparkSession, root: str, year: int | None = None, month: str | None = None
) -> DataFrame:
    """S8 over the folders of ``write_reports``; ``year`` and ``month`` prune folders."""
    files = spark.read.option("mode", "FAILFAST").schema(REPORT_FILE_SCHEMA).json(root)
    if year is not None:
        files = files.filter(F.col("year") == year)
    if month is not None:
        files = files.filter(F.col("month") == month)
    return latest_reports(normalise_reports(files))


def read_report_documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """S8 over one indented JSON document per file; the file's time stands for the run."""
    files = (
        spark.read.option("multiLine", "true")
        .option("mode", "FAILFAST")
        .schema(REPORT_FILE_SCHEMA)
        .json(paths)
        .withColumn(
            "run_ts",
            F.coalesce("run_ts", F.col("_metadata.file_modification_time").cast("timestamp_ntz")),
        )
    )
    return latest_reports(normalise_reports(files))
