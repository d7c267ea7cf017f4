"""Raw and processed CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from walletlens.functions.text import null_if_token
from walletlens.operators.cleaning import rename_positional
from walletlens.schema import PROCESSED_SCHEMA, RAW_COLUMNS, RAW_SCHEMA

# Quotes inside a field are doubled, as spreadsheet and data-frame writers do; blanks are data.
DIALECT = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}
# A line with more or fewer fields than the file's columns is an error, not a row with shifted
# or missing values; pruned columns would hide it.
_STRICT = {**DIALECT, "mode": "FAILFAST", "columnPruning": "false", "enforceSchema": "true"}


def _null_tokens(df: DataFrame) -> DataFrame:
    return df.select([null_if_token(F.col(name)).alias(name) for name in df.columns])


def read_raw_csv(spark: SparkSession, path: str | list[str], check_header: bool = True) -> DataFrame:
    """S1 + P1: ten text columns by position, whatever the header calls them.

    With ``check_header`` the header is read for its number of columns first, so that a file
    of another width fails before any job runs.
    """
    if check_header:
        header = spark.read.options(**DIALECT).csv(path)
        rename_positional(header, RAW_COLUMNS)
    return _null_tokens(spark.read.options(**_STRICT).schema(RAW_SCHEMA).csv(path))


def read_processed_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Six text columns; a missing path raises. Types are set by the cleaning operators."""
    return _null_tokens(spark.read.options(**_STRICT).schema(PROCESSED_SCHEMA).csv(path))


def write_processed_csv(processed: DataFrame, path: str) -> None:
    """S3: one CSV folder, written in parallel."""
    processed.write.mode("overwrite").options(**DIALECT).csv(path)
