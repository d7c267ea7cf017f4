"""Times written in a format nobody told: each file votes for its own.

Every row of a file is tried against all candidates at once, in one aggregation to a row per file. The candidate
that reads most rows is the file's format, so one day above 12 settles the order of day and month for all rows.
A file is refused as a whole where its rows do not settle it: two formats read the same rows to different
days (ambiguous), or some rows can be read by another format only (mixed). What no candidate reads is a
matter of its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The candidates, date part first; each may be followed by a time. ISO times are one more.
DATE_PATTERNS = (
    "MM/dd/yyyy",
    "dd/MM/yyyy",
    "yyyy/MM/dd",
    "MM-dd-yyyy",
    "dd-MM-yyyy",
    "dd.MM.yyyy",
    "dd MMM yyyy",
    "MMM dd, yyyy",
)
TIME_PATTERN = "[ HH:mm[:ss[.SSSSSS]]]"
ISO = "ISO"
AMBIGUOUS, MIXED = "ambiguous time format", "mixed time formats"


def readings(text: Column) -> dict[str, Column]:
    """The time that each candidate reads in a text, null where it does not fit."""
    text = F.trim(text)
    read = {ISO: F.when(text.rlike(r"^\d{4}-"), text.try_cast("timestamp_ntz"))}
    for pattern in DATE_PATTERNS:
        read[pattern] = F.try_to_timestamp(text, F.lit(pattern + TIME_PATTERN)).cast("timestamp_ntz")
    return read


def file_formats(lines: DataFrame, text: str = "timestamp", unit: str = "source_file") -> DataFrame:
    """Per file (``unit``): ``time_format``, or ``time_problem`` where its rows do not settle one; both null without a time."""
    names = list(readings(F.lit("")))
    read = lines.select(unit, F.array(*readings(F.col(text)).values()).alias("read")).filter(F.exists("read", lambda x: x.isNotNull()))
    votes = [F.count_if(F.col("read")[k].isNotNull()).alias(f"votes_{k}") for k in range(len(names))]
    # Of two formats that read the same rows, whether any row tells them apart.
    pairs = [(a, b) for a in range(len(names)) for b in range(a)]
    apart = [F.max(F.col("read")[a] != F.col("read")[b]).alias(f"apart_{a}_{b}") for a, b in pairs]
    counted = read.groupBy(unit).agg(F.count("*").alias("rows"), *votes, *apart)
    most = F.greatest(*[F.col(f"votes_{k}") for k in range(len(names))])
    best = F.coalesce(*[F.when(F.col(f"votes_{k}") == most, F.lit(name)) for k, name in enumerate(names)])
    torn = F.lit(False)
    for a, b in pairs:
        both = (F.col(f"votes_{a}") == most) & (F.col(f"votes_{b}") == most)
        torn = torn | (both & F.coalesce(f"apart_{a}_{b}", F.lit(True)))
    problem = F.when(most < F.col("rows"), MIXED).when(torn, AMBIGUOUS)
    return counted.select(unit, F.when(problem.isNull(), best).alias("time_format"), problem.alias("time_problem"))


def with_inferred_times(lines: DataFrame, text: str = "timestamp", unit: str = "source_file") -> DataFrame:
    """The lines with ``parsed_time`` by their file's format, and ``time_problem`` for rows of refused files.

    Rows of refused files that no candidate reads have no time, like such rows of any file. The table of
    formats has a row per file; Spark broadcasts it while its size allows.
    """
    joined = lines.join(file_formats(lines, text, unit), unit, "left")
    by_format = [F.when(F.col("time_format") == name, read) for name, read in readings(F.col(text)).items()]
    readable = F.coalesce(*readings(F.col(text)).values()).isNotNull()
    return joined.select(
        *lines.columns,
        F.coalesce(*by_format).alias("parsed_time"),
        F.when(readable, F.col("time_problem")).alias("time_problem"),
    )
