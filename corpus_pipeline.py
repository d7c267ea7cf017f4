"""The corpus pipeline: documents to packed training sequences in five stages.

Each stage takes (spark, documents, folder of the tables) and returns a DataFrame; all but the last
return the columns of documents. Between stages the rows are written and read again, so a lost
executor costs no more than its stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from walletlens.llm import decontaminate, jaccard_join, line_dedup, packing, quality
from walletlens.session import materialize
from walletlens.sources.tables import table

#: Share of a host's distinct pages above which a line is boilerplate. On sf0.1 the one line repeated by
#: every host is on 8.7 to 13.2 % of its pages; the next is on 4.6 % at most.
LINE_RATIO = 0.05


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return quality.drop_rejected(docs, table(spark, sf_dir, "labels"))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their host."""
    return line_dedup.drop_boilerplate(docs, ratio=LINE_RATIO)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies."""
    return jaccard_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_deduplication),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("packing", packed),
]

#: The classifier and the retrieval packing are beyond SQL; a brute-force version checks the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
