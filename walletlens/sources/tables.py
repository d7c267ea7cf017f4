"""The given benchmark tables in the engine's shapes: transactions, raw files, candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from walletlens.schema import RAW_COLUMNS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_EVENT_TYPE = """
    CASE WHEN event_type IN ('purchase','click') THEN 'SPEND'
         WHEN event_type IN ('signup','view') THEN 'CASH-IN' ELSE 'OTHER' END"""
_EVENT_METHOD = """
    CASE event_id % 4 WHEN 0 THEN 'SEND MONEY' WHEN 1 THEN 'QR'
         WHEN 2 THEN 'MAYA SHOP' ELSE 'BANK TRANSFER' END"""


def event_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One month of transactions with all types, empty tags and two tags per user."""
    return table(spark, sf_dir, "events").selectExpr(
        "CAST(user_id AS STRING) AS user_id",
        "ts AS timestamp",
        f"{_EVENT_TYPE} AS transaction_type",
        f"{_EVENT_METHOD} AS transaction_method",
        "value AS amount",
        """CASE (user_id + CASE WHEN day(ts) > 15 THEN 1 ELSE 0 END) % 4
             WHEN 0 THEN 'PROFESSIONAL_HUSTLERS, PRUDENT_PLANNERS' WHEN 1 THEN 'LUSH_DRINKERS'
             WHEN 2 THEN '' ELSE 'LOAN_AND_GAMING' END AS segment_tag""",
        "CAST(year(ts) AS INT) AS year",
        "CAST(month(ts) AS INT) AS month",
    )


def order_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many months of transactions with date-only times."""
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.selectExpr(
        "CAST(o_custkey AS STRING) AS user_id",
        "o_orderdate AS timestamp",
        """CASE o_orderstatus WHEN 'F' THEN 'SPEND' WHEN 'O' THEN 'CASH-IN' ELSE 'OTHER' END
             AS transaction_type""",
        "upper(substr(o_orderpriority, 3)) AS transaction_method",
        "o_totalprice AS amount",
        "coalesce(c_mktsegment, '') AS segment_tag",
        "CAST(year(o_orderdate) AS INT) AS year",
        "CAST(month(o_orderdate) AS INT) AS month",
    )


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw text rows, with the defects the cleaning operators deal with."""
    return (
        table(spark, sf_dir, "events")
        .selectExpr(
            "CASE WHEN event_id % 97 <> 0 THEN CAST(user_id AS STRING) END AS user_id",
            "CASE user_id % 3 WHEN 0 THEN 'PRUDENT_PLANNERS' WHEN 1 THEN 'nan' END AS tag1",
            "CASE WHEN user_id % 5 < 2 THEN 'LUSH_DRINKERS' WHEN user_id % 5 = 2 THEN ' ' END AS tag2",
            "CASE WHEN user_id % 2 = 0 THEN 'LOAN_AND_GAMING' END AS tag3",
            """CASE WHEN event_id % 89 = 0 THEN 'no date'
                 ELSE date_format(ts, 'yyyy-MM-dd HH:mm:ss') END AS timestamp""",
            "'app' AS source",
            f"{_EVENT_TYPE} AS transaction_type",
            f"CASE WHEN event_id % 101 <> 0 THEN {_EVENT_METHOD} END AS transaction_method",
            "props AS platform",
            """CASE WHEN event_id % 31 = 0 THEN 'abc' WHEN event_id % 37 = 0 THEN NULL
                 WHEN event_id % 41 = 0 THEN 'nan' WHEN event_id % 43 = 0 THEN 'inf'
                 WHEN event_id % 47 = 0 THEN '-Infinity' WHEN event_id % 53 = 0 THEN '-12.3456'
                 ELSE CAST(value AS STRING) END AS amount""",
        )
        .toDF(*RAW_COLUMNS)
    )


def given_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate outputs with given vectors, flags and texts, for the report operators.

    Vectors 0, 1 and 2 stand for the templates of the three approaches; the others are outputs
    of owners with two report components each. The template side is three rows by its key.
    """
    vectors = table(spark, sf_dir, "embeddings")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    texts = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("output_text"))
    templates = vectors.filter("vec_id < 3").selectExpr(
        "CAST(vec_id AS INT) AS approach_rank", "embedding AS template_embedding"
    )
    outputs = (
        vectors.filter("vec_id >= 3")
        .selectExpr(
            "vec_id AS doc_id",
            "vec_id DIV 3 AS owner",
            "CAST(vec_id % 3 AS INT) AS approach_rank",
            "embedding AS output_embedding",
            "0.5 + (vec_id % 1000) / 2000.0D AS confidence",
        )
        .join(labels, "doc_id", "left")
        .join(texts, "doc_id", "left")
    )
    return outputs.join(F.broadcast(templates), "approach_rank").selectExpr(
        "CAST(owner DIV 2 AS STRING) AS user_id",
        "2024 AS year",
        "1 AS month",
        "CASE owner % 2 WHEN 0 THEN 'executive_summary' ELSE 'recommendations' END AS component",
        """CASE approach_rank WHEN 0 THEN 'zero_shot' WHEN 1 THEN 'few_shot'
             ELSE 'chain_of_thought' END AS approach""",
        "approach_rank",
        "output_text",
        "CASE WHEN toxic = 1 THEN 'Unsafe' ELSE 'Safe' END AS ethical_flag",
        "confidence",
        "template_embedding",
        "output_embedding",
    )


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of a raw file without a header: some short, some long, some with a quoted line break.

    ``broken`` tells the lines with a break, which belong into files of their own.
    """
    fields = ["CAST(user_id AS STRING)", "CASE user_id % 3 WHEN 0 THEN 'PRUDENT_PLANNERS' ELSE '' END"]
    break_tag = '"' + "LUSH" + "\n" + 'DRINKERS"'
    fields += [f"CASE WHEN event_id % 17 = 0 THEN '{break_tag}' ELSE '' END", "'nan'", "date_format(ts, 'yyyy-MM-dd')"]
    fields += ["'app'", _EVENT_TYPE, _EVENT_METHOD, "''", "CAST(value AS STRING)"]
    whole = "concat_ws(',', " + ", ".join(fields) + ")"
    return table(spark, sf_dir, "events").selectExpr(
        f"""CASE WHEN event_id % 17 = 0 THEN {whole}
              WHEN event_id % 11 = 0 THEN concat(CAST(user_id AS STRING), ',short')
              WHEN event_id % 13 = 0 THEN concat({whole}, ',one,', CAST(event_id AS STRING))
              ELSE {whole} END AS line""",
        "event_id % 17 = 0 AS broken",
    )


def dated_event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of raw files whose times are written in one of several formats, by ``delivery``.

    The deliveries: ISO times, two orders of day and month, one with only days that both orders read, and
    one that mixes two formats. Some lines have no time that anything could read.
    """
    patterns = {"iso": "yyyy-MM-dd HH:mm:ss", "american": "MM/dd/yyyy", "british": "dd/MM/yyyy HH:mm", "torn": "MM-dd-yyyy"}
    written = " ".join(f"WHEN '{name}' THEN date_format(ts, '{pattern}')" for name, pattern in patterns.items())
    mixed = "CASE WHEN event_id % 2 = 0 THEN date_format(ts, 'dd.MM.yyyy') ELSE date_format(ts, 'yyyy/MM/dd') END"
    delivered = table(spark, sf_dir, "events").selectExpr(
        "*",
        """CASE user_id % 5 WHEN 0 THEN 'iso' WHEN 1 THEN 'american' WHEN 2 THEN 'british' WHEN 3 THEN 'mixed'
             ELSE CASE WHEN day(ts) BETWEEN 2 AND 12 THEN 'torn' ELSE 'iso' END END AS delivery""",
    )
    time = f"CASE WHEN event_id % 19 = 0 THEN 'some day' ELSE CASE delivery {written} ELSE {mixed} END END"
    fields = ["CAST(user_id AS STRING)", "''", "''", "''", time, "'app'", _EVENT_TYPE, _EVENT_METHOD, "''", "CAST(value AS STRING)"]
    return delivered.selectExpr("concat_ws(',', " + ", ".join(fields) + ") AS line", "delivery")
