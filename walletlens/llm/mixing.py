"""Mixing sources to target weights by entropy balancing.

Each source has a target of words. Of all rates r of its documents, between 0 and ``MOST`` copies, with
sum(size * r) equal to the target, those nearest to one copy each in entropy, sum(r * log(r) - r), are
r = min(MOST, exp(t * size)): the documents are tilted exponentially by their size. t solves the convex
dual of the source's word constraint. Newton's method on the logarithm of the words reached, kept inside a
bracket that shrinks with every step, runs for all sources at once: each step is one aggregation over
counts of (source, size), so documents are read once and no step depends on how many share a size.

Rates become whole copies in two exact steps. Along falling sizes the copies of each (source, size)
group are its share rounded after adding what earlier groups were rounded off, so what is left at the
end is of the order of the smallest documents. Within a group one copy more goes to documents spread
evenly along a hash of their id; groups are cut into buckets of about ``BUCKET`` documents for that, and
equal rows count as one with a multiplicity.

Targets: sources in the order of their code points, null last, weigh 1, 2, 3 and so on again, and share
all words; a target stops at ``MOST`` times the words of its source, and what is beyond is shared anew
by weight until no target is above that. Documents without words have size 0 and take nothing.

Null text: size 0. A null source is a source of its own, the last. Null or repeated ids: each row is a
document; equal rows get the same copies or differ by one. Very long texts: only their size is kept. If
documents are few and large, whole copies may miss the target by part of a document. Empty table: no
rows. Other columns are not read, whatever their names. Every rerun gives the same copies, as nothing is random.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from walletlens.llm.row_numbers import numbered
from walletlens.session import materialize

#: Most copies of a document, and most words of a target as a multiple of its source's.
MOST = 3
WEIGHTS = (1, 2, 3)
WORD = r"[^\x20\x09-\x0D]+"
#: Documents of one (source, size) group that are ranked together, about.
BUCKET = 10_000
#: Newton steps end when every source's words are this near to its target, relatively.
NEAR, MOST_STEPS = 1e-9, 200
#: Equal rows that are written out at a time.
COPIES = 1 << 16

_GROUP = "source string, size long, rows long, rate double"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _exact(parts: Column) -> Column:
    """A sum that does not depend on the order of the rows, so that reruns take the same steps."""
    return F.sum(parts.cast("decimal(28,8)")).cast("double")


def water_filled(sources: DataFrame, most: float = MOST) -> DataFrame:
    """(source, weight, words) with ``target``: the level at which min(most * words, level * weight) add up to all words.

    Each round fixes the sources above the level and raises it for the others; levels only rise, so
    no source comes back. A round is one aggregation to a single row.
    """
    cap = F.col("words") * float(most)
    level, fixed = 0.0, -1
    while True:
        capped = cap <= level * F.col("weight")
        row = sources.agg(
            F.sum("words").cast("double").alias("total"),
            F.sum(F.when(capped, cap).otherwise(0.0)).alias("taken"),
            F.sum(F.when(~capped, F.col("weight")).otherwise(0)).alias("weights"),
            F.count_if(capped).alias("fixed"),
        ).head()
        if not row.weights or row.fixed == fixed:
            break
        fixed, level = row.fixed, (row.total - row.taken) / row.weights
    return sources.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")) if row.weights else cap)


def tilts(groups: DataFrame, sources: DataFrame, most: float = MOST) -> DataFrame:
    """Per source ``tilt``, the dual variable of its word constraint; null where it is without bound.

    ``groups``: (source, size > 0, rows); ``sources``: (source, words, target) with 0 < target < most * words.
    """
    log_most = F.log(F.lit(float(most)))
    shape = groups.groupBy("source").agg(
        F.min("size").cast("double").alias("smallest"),
        (_exact(F.col("size").cast("double") ** 2 * F.col("rows")) / F.sum(F.col("size") * F.col("rows"))).alias("scale"),
    )
    # In units of 1 / scale. All rates at the cap, or all at target / words, end the bracket.
    ratio = F.log(F.col("target") / F.col("words"))
    state = sources.join(shape, "source")
    low = F.when(ratio < 0, ratio * F.col("scale") / F.col("smallest")).otherwise(0.0)
    high = F.when(ratio > 0, log_most * F.col("scale") / F.col("smallest")).otherwise(0.0)
    start = F.least(F.greatest(ratio, low), high)
    state = state.select(
        "source", "target", "scale", low.alias("low"), high.alias("high"), start.alias("tilt"), F.lit(False).alias("done")
    )
    state = materialize(state, "mixing-tilts")
    for _ in range(MOST_STEPS):
        if state.filter("NOT done").isEmpty():
            break
        joined = groups.join(state.filter("NOT done"), "source")
        x = F.col("size") / F.col("scale")
        power = F.col("tilt") * x
        mass = F.col("size").cast("double") * F.col("rows") * F.when(power < log_most, F.exp(power)).otherwise(float(most))
        slope = F.when(power < log_most, mass * x).otherwise(0.0)
        sums = joined.groupBy("source").agg(_exact(mass).alias("mass"), _exact(slope).alias("slope"))
        step = state.join(sums, "source", "left")
        over = F.col("mass") > F.col("target")
        low, high = F.when(over, F.col("low")).otherwise(F.col("tilt")), F.when(over, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - F.log(F.col("mass") / F.col("target")) * F.col("mass") / F.col("slope")
        inside = F.when((F.col("slope") > 0) & (newton > low) & (newton < high), newton).otherwise((low + high) / 2)
        near = F.abs(F.col("mass") / F.col("target") - 1) <= NEAR
        stuck = (high - low) <= F.lit(1e-15) * F.greatest(F.abs(low), F.abs(high))
        move = ~F.col("done") & ~near
        state = step.select(
            "source",
            "target",
            "scale",
            F.when(move, low).otherwise(F.col("low")).alias("low"),
            F.when(move, high).otherwise(F.col("high")).alias("high"),
            F.when(move, inside).otherwise(F.col("tilt")).alias("tilt"),
            (F.col("done") | near | stuck).alias("done"),
        )
        state = materialize(state, "mixing-tilts")
    return state.select("source", (F.col("tilt") / F.col("scale")).alias("tilt"))


def _copies(most: int):
    """Whole copies of each group of a source, along falling sizes; reads one partition of whole sources in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, owed, first = None, 0.0, True
        for batch in batches:
            out = []
            columns = (batch.column(k).to_pylist() for k in range(4))
            for source, size, rows, rate in zip(*columns, strict=True):
                if first or source != of:
                    of, owed, first = source, 0.0, False
                share = size * rows * rate + owed
                copies = min(most * rows, max(0, round(share / size))) if size else 0
                owed = share - copies * size if size else owed
                out.append(copies)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "copies"])

    return run


def mixed(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words of its copies), copies, rate."""
    docs = documents.select(
        F.col(id_column).cast("long").alias("doc_id"),
        # A null source sorts behind all others.
        F.coalesce(F.concat(F.lit("+"), F.col(source_column).cast("string")), F.lit("-")).alias("source"),
        word_count(F.col(text_column)).alias("size"),
    )
    entries = materialize(docs.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows")), "mixing-entries")
    groups = materialize(entries.groupBy("source", "size").agg(F.sum("rows").alias("rows")), "mixing-groups")

    sources = groups.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("words"))
    sources = numbered(sources, [F.col("source")], "at")
    turn = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("at") % len(WEIGHTS) + 1).cast("int"))
    sources = materialize(sources.select("source", "words", turn.alias("weight")), "mixing-sources")
    sources = materialize(water_filled(sources), "mixing-targets")

    free = sources.filter(F.col("target") < MOST * F.col("words"))
    rated = groups.join(tilts(groups.filter("size > 0"), free), "source", "left")
    power = F.col("tilt") * F.col("size")
    rate = F.when(F.col("size") == 0, 1.0).when(power < F.log(F.lit(float(MOST))), F.exp(power)).otherwise(float(MOST))
    rated = rated.select("source", "size", "rows", rate.alias("rate"))
    along = rated.repartition("source").sortWithinPartitions("source", F.col("size").desc())
    dealt = materialize(along.mapInArrow(_copies(MOST), f"{_GROUP}, copies long"), "mixing-copies")

    # The copies beyond an equal number for all rows of a group, first by bucket, then by row.
    plan = dealt.select(
        "source",
        "size",
        F.col("rows").alias("all_rows"),
        "rate",
        F.floor(F.col("copies") / F.col("rows")).alias("base"),
        (F.col("copies") % F.col("rows")).alias("extra"),
    )
    key = F.xxhash64("doc_id")
    placed = entries.join(plan, ["source", "size"])
    placed = placed.withColumn("bucket", F.pmod(key, F.ceil(F.col("all_rows") / BUCKET).cast("long")))
    buckets = placed.groupBy("source", "size", "bucket").agg(F.sum("rows").alias("bucket_rows"))
    earlier = F.sum("bucket_rows").over(Window.partitionBy("source", "size").orderBy("bucket")) - F.col("bucket_rows")
    buckets = buckets.select("source", "size", "bucket", earlier.alias("earlier"))
    placed = placed.join(buckets, ["source", "size", "bucket"])
    order = Window.partitionBy("source", "size", "bucket").orderBy(key, "doc_id")
    upto = F.sum("rows").over(order) + F.col("earlier")

    def spread(rows: Column) -> Column:
        """Of the extra copies, how many the first ``rows`` rows of the group hold."""
        return F.floor(rows.cast("decimal(19,0)") * F.col("extra").cast("decimal(19,0)") / F.col("all_rows").cast("decimal(19,0)")).cast("long")

    more = (spread(F.col("upto")) - spread(F.col("upto") - F.col("rows"))).alias("more")
    placed = placed.withColumn("upto", upto).select("doc_id", "source", "size", "rate", "rows", "base", more)

    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(COPIES).cast("long"))).alias("start")
    parts = placed.select("*", each)
    one = F.explode(F.sequence(F.col("start"), F.least(F.col("rows"), F.col("start") + COPIES) - 1)).alias("which")
    copies = F.col("base") + F.when(F.col("which") < F.col("more"), 1).otherwise(0)
    given = sources.select("source", F.col("words").alias("source_size"), "target")
    return (
        parts.select("*", one)
        .join(given, "source")
        .select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), "rate")
    )
