"""Secret scan with an incremental blob ledger.

Every historical version of a text is a blob, named by the SHA-256 of its bytes. The ledger holds the
findings of each blob under each version of the rules it was scanned with, also where there are none.
A scan looks only at pairs of blob and rule version that the ledger does not have yet, each blob once
however many paths hold it, appends them, and joins findings back to all paths.

Positions come from SQL functions: splitting a text at a rule's matches and extracting the same
matches gives alternating lengths, whose running sum is each match's place in code points. Running
sums are made in blocks of the square root of their number, so a text with very many matches takes
little more than in proportion to them.

DataFrame functions only. Blobs are made distinct before the scan, with equal texts of a task
combined before the shuffle. A blob held by a third of all paths is joined as a skewed key.

Null text: empty, no findings. Null, repeated or equal ids: one row out for each row in. Empty table:
no rows. Texts of any length are scanned whole. Other columns are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from walletlens.session import scratch_path

#: The base rules. Kind, pattern, fewest characters, group these are counted in.
BASE_RULES = (
    (
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        6,
        2,
    ),
    ("access", r"(AKIA[A-Z0-9]+)", 20, 1),
    ("hex", r"([0-9a-f]{24,})", 24, 1),
)
#: Further rules, in the same form.
MORE_RULES = (
    ("pem", r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)", 1, 1),
    ("jwt", r"(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", 1, 1),
    ("forge", r"(gh[pousr]_[A-Za-z0-9]{36,})", 1, 1),
    ("login", r"([a-z][a-z0-9+.-]{1,15}://[^\s/:@]{1,64}:[^\s/:@]{3,64}@)", 1, 1),
)
RULES = BASE_RULES + MORE_RULES

_FINDING = "struct<start:int,rank:int,kind:string,stop:int>"
_LEDGER = f"blob_id string, rule_version string, findings array<{_FINDING}>"


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda total, x: total + x)


def _sums_before(lengths: Column) -> Column:
    """For each place of a list that is not empty, the sum of what stands before it."""

    def in_blocks(lengths: Column, width: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / width).cast("int"))
        totals = F.transform(blocks, lambda k: _total(F.slice(lengths, k * width + 1, width)))

        def placed(totals: Column) -> Column:
            def within(k: Column, before: Column) -> Column:
                block = F.slice(lengths, k * width + 1, width)
                return F.transform(block, lambda _, i: before + _total(F.slice(block, F.lit(1), i)))

            starts = F.transform(blocks, lambda k: _total(F.slice(totals, F.lit(1), k)))
            return F.flatten(F.zip_with(blocks, starts, within))

        return _once(totals, placed)

    width = F.ceil(F.sqrt(F.size(lengths))).cast("int")
    return _once(F.struct(lengths.alias("lengths"), width.alias("width")), lambda x: in_blocks(x["lengths"], x["width"]))


def _matches(text: Column, rank: int, kind: str, pattern: str, fewest: int, group: int) -> Column:
    """Findings of one rule: leftmost matches without overlap, those too short dropped afterwards."""

    def place(gaps: Column, whole: Column, counted: Column) -> Column:
        # The last part of the split follows the last match.
        gaps = F.slice(gaps, F.lit(1), F.size(whole))
        before = _sums_before(F.zip_with(gaps, whole, lambda gap, length: gap + length))
        parts = F.arrays_zip(before.alias("before"), gaps.alias("gap"), whole.alias("whole"), counted.alias("counted"))

        def finding(part: Column) -> Column:
            start = part["before"] + part["gap"]
            return F.struct(
                start.alias("start"),
                F.lit(rank).alias("rank"),
                F.lit(kind).alias("kind"),
                (start + part["whole"]).alias("stop"),
            )

        return F.transform(F.filter(parts, lambda part: part["counted"] >= F.lit(fewest)), finding)

    lengths = F.array(
        F.transform(F.split(text, pattern, -1), F.char_length),
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.char_length),
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.char_length),
    )
    found = _once(lengths, lambda x: place(x[0], x[1], x[2]))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<{_FINDING}>"))


def rule_version(rules=RULES) -> str:
    """Names the rules; any change of them gives another version."""
    return hashlib.sha256(repr(tuple(rules)).encode()).hexdigest()[:16]


def findings(text: Column, rules=RULES) -> Column:
    """All findings of a text, by start, then by rule."""
    each = [_matches(text, rank, *rule) for rank, rule in enumerate(rules)]
    return F.array_sort(F.concat(*each))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a ledger; none where nothing has been written yet."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(hadoop):
        return spark.createDataFrame([], _LEDGER)
    return spark.read.schema(_LEDGER).parquet(path)


def scan(paths: DataFrame, ledger: str, text_column: str = "text", rules=RULES) -> None:
    """Scan the blobs of ``paths`` that the ledger has not seen under these rules, and append them to it.

    A scan that is run again after a failure adds only what is missing.
    """
    spark, version = paths.sparkSession, rule_version(rules)
    blobs = paths.select(F.coalesce(F.col(text_column), F.lit("")).alias("blob"))
    blobs = blobs.withColumn("blob_id", F.sha2("blob", 256)).dropDuplicates(["blob_id"])
    known = read_ledger(spark, ledger).filter(F.col("rule_version") == version).select("blob_id")
    unseen = blobs.join(known, "blob_id", "left_anti")
    rows = unseen.select("blob_id", F.lit(version).alias("rule_version"), findings(F.col("blob"), rules).alias("findings"))
    rows.write.mode("append").partitionBy("rule_version").parquet(ledger)


def found_in(
    paths: DataFrame,
    ledger: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    rules=RULES,
) -> DataFrame:
    """(id, findings) for every row of ``paths``; findings is null where the blob has not been scanned by these rules."""
    named = paths.select(F.col(id_column), F.sha2(F.coalesce(F.col(text_column), F.lit("")), 256).alias("__blob"))
    seen = read_ledger(paths.sparkSession, ledger).filter(F.col("rule_version") == rule_version(rules))
    # Two scans at the same time may both have added a blob.
    seen = seen.select(F.col("blob_id").alias("__blob"), "findings").dropDuplicates(["__blob"])
    return named.join(seen, "__blob", "left").select(id_column, "findings")


def shown(found: Column) -> Column:
    """Findings as kind:start:stop, joined by commas."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")


def document_secrets(documents: DataFrame, ledger: str | None = None) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256 (of the base spans as text), spans."""
    ledger = ledger or scratch_path(documents.sparkSession, "secret-ledger")
    scan(documents, ledger)
    found = found_in(documents, ledger)

    def of_rank(rank: int) -> Column:
        return F.filter("findings", lambda x: x["rank"] == rank)

    counts = [F.size(of_rank(k)).cast("long").alias(f"n_{kind}") for k, (kind, *_) in enumerate(BASE_RULES)]
    base = F.filter("findings", lambda x: x["rank"] < len(BASE_RULES))
    spans = shown(F.col("findings")).alias("spans")
    return found.select("doc_id", *counts, F.sha2(shown(base), 256).alias("base_sha256"), spans)
