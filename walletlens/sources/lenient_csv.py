"""CSV files of which no line is lost: lines of another width come back as rows with their text.

Files are read in splits, line by line. A quoted line break makes a record of two lines; files that hold a
line with an odd number of quotes are found first, in splits as well, and only these are read whole by
one task each. A quote that is never closed takes the rest of its file into one malformed row.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from walletlens.functions.text import null_if_token
from walletlens.schema import PROCESSED_COLUMNS, RAW_COLUMNS, text_schema
from walletlens.sources.csv_files import DIALECT

#: The columns beside the file's own.
SOURCE_FILE, MALFORMED_LINE = "source_file", "malformed_line"


def files_with_line_breaks(spark: SparkSession, paths: str | list[str]) -> list[str]:
    """The files in which a line ends within quotes. As many names reach the driver as it lists anyway."""
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), "value")
    open_ended = lines.filter(F.regexp_count("value", F.lit('"')) % 2 == 1)
    return sorted(row.file for row in open_ended.select("file").distinct().collect())


def _read(spark: SparkSession, paths: str | list[str], columns: list[str], header: bool, whole: bool) -> DataFrame:
    schema = T.StructType([*text_schema(columns).fields, T.StructField(MALFORMED_LINE, T.StringType())])
    options = {
        **DIALECT,
        "header": str(header).lower(),
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": MALFORMED_LINE,
        "enforceSchema": "true",
        # A line's width shows only if all of it is parsed.
        "columnPruning": "false",
        "multiLine": str(whole).lower(),
    }
    return spark.read.options(**options).schema(schema).csv(paths).withColumn(SOURCE_FILE, F.col("_metadata.file_path"))


def read_lenient(spark: SparkSession, paths: str | list[str], columns: list[str], header: bool = True) -> DataFrame:
    """``columns`` as text by position, and for each row its ``source_file`` and, if malformed, its ``malformed_line``.

    A malformed line has more or fewer fields than there are columns; its columns are null. A missing path raises.
    """
    broken = files_with_line_breaks(spark, paths)
    rows = _read(spark, paths, columns, header, whole=False)
    if broken:
        whole = _read(spark, [unquote(file) for file in broken], columns, header, whole=True)
        rows = rows.filter(~F.col(SOURCE_FILE).isin(broken)).unionByName(whole)
    fits = F.col(MALFORMED_LINE).isNull()
    values = [F.when(fits, null_if_token(F.col(name))).alias(name) for name in columns]
    return rows.select(*values, SOURCE_FILE, MALFORMED_LINE)


def read_raw_lenient(spark: SparkSession, paths: str | list[str], header: bool = True) -> DataFrame:
    """S1 + P1: the ten raw columns; see ``cleaning.coerce_raw_lines``."""
    return read_lenient(spark, paths, RAW_COLUMNS, header)


def read_processed_lenient(spark: SparkSession, paths: str | list[str], header: bool = True) -> DataFrame:
    """The six processed columns; see ``cleaning.coerce_lines``."""
    return read_lenient(spark, paths, PROCESSED_COLUMNS, header)
