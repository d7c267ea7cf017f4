"""Schemas, key lists and fixed names shared by all modules."""

from __future__ import annotations

from pyspark.sql import types as T

KEYS = ["user_id", "year", "month"]

SPEND = "SPEND"
CASH_IN = "CASH-IN"
SAFE = "Safe"
UNSAFE = "Unsafe"
FALLBACK_APPROACH = "chain_of_thought"

# Exact money: eight decimals, sums up to 1e30. Doubles appear only at the edge.
MONEY = "decimal(30,8)"

RAW_COLUMNS = [
    "user_id",
    "segment_tag1",
    "segment_tag2",
    "segment_tag3",
    "timestamp",
    "source",
    "transaction_type",
    "transaction_method",
    "platform",
    "amount",
]
PROCESSED_COLUMNS = [
    "user_id",
    "timestamp",
    "transaction_type",
    "transaction_method",
    "amount",
    "segment_tag",
]

# The texts the reader of the raw files takes for a missing value.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def text_schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


RAW_SCHEMA = text_schema(RAW_COLUMNS)
PROCESSED_SCHEMA = text_schema(PROCESSED_COLUMNS)

TRANSACTION_SCHEMA = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("transaction_type", T.StringType()),
        T.StructField("transaction_method", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("segment_tag", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("month", T.IntegerType()),
    ]
)

_EVALUATION = T.StructType(
    [
        T.StructField("ethical_flag", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("similarity_score", T.DoubleType()),
    ]
)
_TEXT_MAP = T.MapType(T.StringType(), T.StringType())
_EVALUATION_MAP = T.MapType(T.StringType(), _EVALUATION)

METADATA = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("year", T.LongType()),
        T.StructField("month", T.StringType()),
    ]
)

# Both names of the two drifting fields, so one read covers old and new report files.
REPORT_FILE_SCHEMA = T.StructType(
    [
        T.StructField("metadata", METADATA),
        T.StructField("report_components", _TEXT_MAP),
        T.StructField("evaluations", _EVALUATION_MAP),
        T.StructField("evaluation", _EVALUATION_MAP),
        T.StructField("best_approaches", _TEXT_MAP),
        T.StructField("chosen_approaches", _TEXT_MAP),
        T.StructField("run_ts", T.TimestampNTZType()),
    ]
)
