"""Line dedup by site-relative frequency.

Pages are grouped by host. For each host the share of its distinct pages that contain a line is
taken, and lines above a ratio are boilerplate of that host and dropped from all its pages. A page
whose text another page of the host repeats exactly counts once, so a large group of copies makes
no line boilerplate.

DataFrame functions only. Lines travel as hashes and are combined before each shuffle, so a host
with a third of all pages sends one row per line and task. The boilerplate of a host is at most
(distinct lines of a mean page / ratio) lines, whatever its number of pages; the table of all hosts
is written, so that Spark broadcasts it while its size allows and joins (splitting hot hosts) beyond.

Null text: stays null, no lines. Empty and blank lines: kept, never counted. Null host: one host of
its own. Repeated rows: equal pages. A line is compared without the white space around it; a line
equal to the ratio stays. Very long texts: lines travel as hashes, and a text is cut whole in its row.
Empty table: no rows. Other columns pass through ``drop_boilerplate``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from walletlens.llm.columns import unused
from walletlens.session import materialize

#: A line in more than this share of a host's distinct pages is boilerplate.
RATIO = 0.1
#: Pages that must contain a line, so that hosts of a few pages lose nothing by chance.
MIN_PAGES = 5

_BLANK = " \t\r\f\x0b"


def _host(column: str) -> Column:
    """The host as a join key that is never null."""
    return F.concat(F.when(F.col(column).isNull(), "-").otherwise("+"), F.coalesce(F.col(column).cast("string"), F.lit("")))


def _line(line: Column) -> Column:
    return F.trim(line, F.lit(_BLANK))


def boilerplate_lines(
    documents: DataFrame,
    host_column: str = "source",
    text_column: str = "text",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
) -> DataFrame:
    """(host, line, pages, host_pages): hashes of the lines above the ratio, with their counts."""
    lines = F.filter(F.transform(F.split(F.col(text_column), "\n"), _line), lambda x: x != "")
    pages = (
        documents.filter(F.col(text_column).isNotNull())
        .select(
            _host(host_column).alias("host"),
            F.xxhash64(text_column).alias("page"),
            F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x))).alias("lines"),
        )
        .dropDuplicates(["host", "page"])
    )
    pages = materialize(pages, "host-pages")
    totals = pages.groupBy("host").agg(F.count("*").alias("host_pages"))
    counted = pages.select("host", F.explode("lines").alias("line")).groupBy("host", "line")
    counted = counted.agg(F.count("*").alias("pages")).filter(F.col("pages") >= min_pages)
    return counted.join(totals, "host").filter(F.col("pages") > F.lit(ratio) * F.col("host_pages"))


def _cut(
    documents: DataFrame, host_column: str, text_column: str, ratio: float, min_pages: int
) -> tuple[DataFrame, str, str, str]:
    """The documents with three more columns, and their names: text after the cut, numbers of lines and of dropped ones."""
    found = boilerplate_lines(documents, host_column, text_column, ratio, min_pages)
    names = unused(documents.columns, "host", "drop", "site", "kept", "cut", "lines", "dropped")
    host, drop, site, kept, cut, n_lines, n_dropped = names
    sites = found.groupBy(F.col("host").alias(host)).agg(F.collect_list("line").alias(drop))
    sites = materialize(sites, "host-boilerplate")
    joined = documents.withColumn(site, _host(host_column)).join(sites, F.col(site) == F.col(host), "left")
    lines = F.split(F.col(text_column), "\n")
    left = F.filter(lines, lambda x: ~F.array_contains(F.col(drop), F.xxhash64(_line(x))) | (_line(x) == ""))
    joined = joined.withColumn(kept, F.when(F.col(drop).isNotNull(), left).otherwise(lines))
    joined = joined.select(
        *documents.columns,
        F.array_join(kept, "\n").alias(cut),
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias(n_lines),
        F.coalesce(F.size(lines) - F.size(kept), F.lit(0)).cast("long").alias(n_dropped),
    )
    return joined, cut, n_lines, n_dropped


def dropped_lines(
    documents: DataFrame,
    id_column: str = "doc_id",
    host_column: str = "source",
    text_column: str = "text",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, text without the host's boilerplate."""
    slim = documents.select(id_column, host_column, text_column)
    found, cut, n_lines, n_dropped = _cut(slim, host_column, text_column, ratio, min_pages)
    return found.select(
        F.col(id_column).alias("doc_id"),
        F.when(F.col(text_column).isNull(), 0).otherwise(F.col(n_lines)).cast("long").alias("n_lines"),
        F.when(F.col(text_column).isNull(), 0).otherwise(F.col(n_dropped)).cast("long").alias("n_dropped"),
        F.col(cut).alias("text"),
    )


def drop_boilerplate(
    documents: DataFrame,
    host_column: str = "source",
    text_column: str = "text",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
) -> DataFrame:
    """The documents with their text cut, and n_chars, if there, counted anew; other columns unchanged."""
    found, cut, _, _ = _cut(documents, host_column, text_column, ratio, min_pages)
    out = found.withColumn(text_column, F.col(cut))
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.char_length(text_column).cast(documents.schema["n_chars"].dataType))
    return out.select(*documents.columns)
