"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

Every text becomes the set of its distinct word shingles (hashed to 64 bits). A set's shingles are
ordered rare first by counts of the whole corpus, kept in two tables of fixed size: shingles whose
cell holds clearly more documents than cells do on average come last, and among the others those of
rarer words come first, because a table of fixed size cannot tell rare shingles apart. Any order
that is the same for all sets gives exact results. Two sets
that reach the threshold share a shingle within their prefixes, so joining prefixes finds all pairs;
prefix shingles that no set of a near size shares are dropped before, length, positional and suffix
filters drop pairs within the join, and each remaining pair is verified once. The suffix filter bounds
the whole overlap: the sets' members are dealt into ``RANGES`` hash ranges, and ranges with an even count
on one side and an odd one on the other differ by one at least.

Groups of copies stay linear. Equal sets are one node from the start. Then every node is compared
with one pivot of a few of its prefix shingles, and what is left open with one pivot of each, which
joins near copies to components; only shingles that still span two components are joined pair by
pair, and only across components. Pairs within a
component cannot change it, so the components are exact.

Null or empty text, or text without words: an empty set, linked with nothing. Null document ids:
in no component (null). Repeated rows and ties: rows of one id count as linked; the component's id
is its smallest document id. Very long texts: whole, one at a time with its batch. Empty table: no rows.
Other columns of the input are not read; ``one_of_each`` keeps them, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from walletlens.llm.columns import unused
from walletlens.llm.components import connected_components
from walletlens.llm.words import WordHashes, chunks, shingle_runs, word_and_shingle_runs
from walletlens.session import materialize

#: Size of the tables of shingles and of words. What shares a cell counts as frequent as all in it.
COUNT_CELLS = 1 << 18
#: Hash ranges of the suffix filter.
RANGES = 256
#: Prefix shingles per document whose pivot it is compared with before the pairwise join.
PIVOTS = 3
#: Most rows of at most 24 bytes that are broadcast in a join; more are shuffled.
BROADCAST_ROWS = 500_000

_PROFILE = "node_doc long, n long, digest binary, parity array<bigint>, cell int, cell_docs long"
_PREFIX = "shingle long, digest binary, n int, pos int"
_SETS = "node_doc long, digest binary, n long, sketch binary, members binary"


def _digest(members: np.ndarray) -> bytes:
    return hashlib.blake2b(members.tobytes(), digest_size=16).digest()


def _sketch(members: np.ndarray) -> bytes:
    """One parity bit for each of at least four hash ranges per member: a sixteenth to an eighth of the set."""
    ranges = 1 << max(6, (4 * len(members) - 1).bit_length())
    counts = np.bincount((members & np.uint64(ranges - 1)).astype(np.intp), minlength=ranges)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def _cells_of(hashes: np.ndarray, cells: int) -> np.ndarray:
    return (hashes & np.uint64(cells - 1)).astype(np.intp)


def _rarity(counts: np.ndarray, cells: int) -> np.ndarray:
    """The tables that order shingles: how far a shingle's cell is above chance, and how common a word is.

    A cell that holds only chance company stays within a few roots of the mean, and counts as 0.
    """
    documents, words = counts[:cells], counts[cells:]
    mean = documents.mean()
    above = np.maximum(documents - (mean + 4 * np.sqrt(mean) + 1), 0)
    common = np.rint(64 * np.log2(words + 1.0))
    return np.concatenate([np.ceil(above), common]).astype(np.int64)


def _profiles(size: int, cells: int):
    """Per document its set's size, digest and parities; per task counts of shingle cells, then of word cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, counts = WordHashes(), set(), np.zeros(2 * cells, np.int64)
        nothing_in = np.zeros(RANGES // 64, np.int64)
        for batch in batches:
            for first, texts in chunks(batch, 1):
                sizes, digests, parities, new, words_of_new = [], [], [], [], []
                for words, run_of in word_and_shingle_runs(hashes, texts, size):
                    members = np.unique(run_of)
                    sizes.append(len(members))
                    digest = _digest(members)
                    digests.append(digest)
                    if not len(members):
                        parities.append(nothing_in)
                        continue
                    counts_in = np.bincount((members >> np.uint64(56)).astype(np.intp), minlength=RANGES)
                    parities.append(np.packbits(counts_in & 1).view(np.int64))
                    if digest not in seen:
                        seen.add(digest)
                        new.append(members)
                        words_of_new.append(words)
                if new:
                    counts[:cells] += np.bincount(_cells_of(np.concatenate(new), cells), minlength=cells)
                    counts[cells:] += np.bincount(_cells_of(np.concatenate(words_of_new), cells), minlength=cells)
                rows = len(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, rows),
                        pa.array(sizes, pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.array(parities, pa.list_(pa.int64())),
                        pa.nulls(rows, pa.int32()),
                        pa.nulls(rows, pa.int64()),
                    ],
                    ["node_doc", "n", "digest", "parity", "cell", "cell_docs"],
                )
        used = np.flatnonzero(counts)
        nothing = pa.nulls(len(used), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                nothing,
                nothing,
                pa.nulls(len(used), pa.binary()),
                pa.nulls(len(used), pa.list_(pa.int64())),
                pa.array(used.astype(np.int32)),
                pa.array(counts[used]),
            ],
            ["node_doc", "n", "digest", "parity", "cell", "cell_docs"],
        )

    return run


def _prefixes(size: int, cells: int, rarity, percent: int):
    """The rarest shingles of each set: enough that two linked sets share one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, table = WordHashes(), set(), np.frombuffer(rarity.value, np.int64)
        frequent, common = table[:cells], table[cells:]
        for batch in batches:
            for _, texts in chunks(batch, 1):
                kept, digests, sizes = [], [], []
                for words, run_of in word_and_shingle_runs(hashes, texts, size):
                    members, first = np.unique(run_of, return_index=True)
                    total = len(members)
                    if not total or (digest := _digest(members)) in seen:
                        continue
                    seen.add(digest)
                    length = total - -(-percent * total // 100) + 1
                    common_words = common[_cells_of(words, cells)]
                    of_run = sum(common_words[k : k + len(run_of)] for k in range(min(size, len(words))))
                    rare_first = np.lexsort((of_run[first], frequent[_cells_of(members, cells)]))
                    kept.append(members[rare_first[:length]])
                    digests.append(digest)
                    sizes.append(total)
                if not kept:
                    continue
                lengths = np.array([len(x) for x in kept])
                starts = np.cumsum(lengths) - lengths
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(kept).view(np.int64)),
                        pa.array(digests, pa.binary()).take(pa.array(np.repeat(np.arange(len(kept)), lengths))),
                        pa.array(np.repeat(np.array(sizes, np.int32), lengths)),
                        pa.array((np.arange(lengths.sum()) - np.repeat(starts, lengths)).astype(np.int32)),
                    ],
                    ["shingle", "digest", "n", "pos"],
                )

    return run


def _member_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for first, texts in chunks(batch, 1):
                sets = [np.unique(x) for x in shingle_runs(hashes, texts, size)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(texts)),
                        pa.array(map(_digest, sets), pa.binary()),
                        pa.array(map(len, sets), pa.int64()),
                        pa.array(map(_sketch, sets), pa.binary()),
                        pa.array([x.tobytes() for x in sets], pa.binary()),
                    ],
                    ["node_doc", "digest", "n", "sketch", "members"],
                )

    return run


def _may_link(percent: int):
    """The suffix filter at the resolution of the sets. Sketches fold by halves to the same ranges."""

    @F.arrow_udf("boolean")
    def may_reach(left: pa.Array, right: pa.Array, n_left: pa.Array, n_right: pa.Array) -> pa.Array:
        out = []
        for a, b, n, m in zip(*(x.to_pylist() for x in (left, right, n_left, n_right)), strict=True):
            x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
            while len(x) != len(y):
                x, y = (x, y) if len(x) > len(y) else (y, x)
                x = x[: len(x) // 2] ^ x[len(x) // 2 :]
            odd = int(np.unpackbits(x ^ y).sum())
            out.append((100 + percent) * odd <= (100 - percent) * (n + m))
        return pa.array(out, pa.bool_())

    return may_reach


def _linked(percent: int):
    @F.arrow_udf("boolean")
    def reaches(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(left.to_pylist(), right.to_pylist(), strict=True):
            x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * common >= percent * (len(x) + len(y) - common))
        return pa.array(out, pa.bool_())

    return reaches


def _pairs(left: DataFrame, right: DataFrame, percent: int, apart: str) -> DataFrame:
    """Distinct pairs (a, b), a < b, of rows with one shingle that pass the length, positional and suffix filters.

    Linked sets share at least percent * (n1 + n2) / (100 + percent) shingles, so at most
    (100 - percent) * (n1 + n2) / (100 + percent) are in one of them only. At the first shingle that
    two sets share, no more can follow than the shorter rest holds.
    """
    x, y = left.alias("x"), right.alias("y")
    odd = " + ".join(f"bit_count(x.parity[{k}] ^ y.parity[{k}])" for k in range(RANGES // 64))
    fits = (
        f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) AND "
        f"{100 + percent} * least(x.n - x.pos, y.n - y.pos) >= {percent} * (x.n + y.n) AND "
        f"{100 + percent} * ({odd}) <= {100 - percent} * (x.n + y.n)"
    )
    joined = x.join(y, F.expr(f"x.shingle = y.shingle AND {apart} AND {fits}"))
    return joined.selectExpr("least(x.digest, y.digest) AS a", "greatest(x.digest, y.digest) AS b").distinct()


def _with_partners(postings: DataFrame, percent: int) -> DataFrame:
    """The distinct ``postings`` without those that no other set of their shingle can be linked with.

    If the next shorter set is too short, so are all shorter ones; likewise the longer ones, and what follows the
    shingle is even less enough for them.
    """
    by_size = Window.partitionBy("shingle").orderBy("n")
    near = postings.withColumn("shorter", F.lag("n").over(by_size)).withColumn("longer", F.lead("n").over(by_size))
    kept = (
        f"100L * shorter >= {percent}L * n OR (100L * n >= {percent}L * longer AND "
        f"{100 + percent}L * (n - pos) >= {percent}L * (n + longer))"
    )
    return near.filter(kept).select("shingle", "digest", "n", "pos")


def small(rows: DataFrame) -> DataFrame:
    """``rows`` (written, of few short columns) marked for broadcast if there are few enough; a shuffle join beyond."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _verified(pairs: DataFrame, docs: DataFrame, sizes: DataFrame, size: int, percent: int) -> DataFrame:
    """The written ``pairs`` that reach the threshold. Only their sets are made, and each pair is verified once.

    Sketches travel first, so that whole sets travel only for pairs that are hardly ever apart.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("digest")).distinct()
    wanted = materialize(sizes.join(ends, "digest", "left_semi").select("node_doc", "digest"), "jaccard-wanted")
    wanted = small(wanted)
    texts = docs.join(wanted.select("node_doc"), "node_doc", "left_semi")
    made = texts.mapInArrow(_member_sets(size), _SETS).join(wanted, ["node_doc", "digest"], "left_semi")
    sets = materialize(made.select("digest", "n", "sketch", "members"), "jaccard-sets")

    def with_ends(pairs: DataFrame, *columns: str) -> DataFrame:
        for end in ("a", "b"):
            of_end = [F.col(name).alias(f"{name}_{end}") for name in columns]
            pairs = pairs.join(sets.select(F.col("digest").alias(end), *of_end), end)
        return pairs

    close = with_ends(pairs, "n", "sketch").filter(_may_link(percent)("sketch_a", "sketch_b", "n_a", "n_b"))
    close = materialize(close.select("a", "b"), "jaccard-close")
    return with_ends(close, "members").filter(_linked(percent)("members_a", "members_b")).select("a", "b")


def similar_documents(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    size: int = 3,
    percent: int = 90,
    cells: int = COUNT_CELLS,
) -> DataFrame:
    """Per document: doc_id, n_shingles (size of its set), component_id (smallest id it reaches).

    Two documents link when 100 * intersection >= percent * union of their sets of ``size``-word
    shingles. ``percent`` is an integer from 1 to 100, ``cells`` a power of two.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(id_column).cast("long").alias("node_doc"), F.col(text_column).alias("node_text"))
    seen = materialize(docs.mapInArrow(_profiles(size, cells), _PROFILE), "jaccard-profiles")
    profiles = seen.filter("cell IS NULL").select("node_doc", "n", "digest", "parity")

    counts = np.zeros(2 * cells, np.int64)  # at most this many rows come to the driver
    summed = seen.filter("cell IS NOT NULL").groupBy("cell").agg(F.sum("cell_docs").alias("docs")).toArrow()
    counts[summed["cell"].to_numpy()] = summed["docs"].to_numpy()
    del summed
    shared = spark.sparkContext.broadcast(_rarity(counts, cells).tobytes())

    del counts
    prefixes = docs.filter("node_doc IS NOT NULL").mapInArrow(_prefixes(size, cells, shared, percent), _PREFIX)
    same = Window.partitionBy("shingle")
    postings = (
        prefixes.withColumn("low", F.min("digest").over(same))
        .withColumn("high", F.max("digest").over(same))
        .filter("low <> high")
        .select("shingle", "digest", "n", "pos")
        .distinct()
    )
    postings = materialize(_with_partners(postings, percent), "jaccard-postings")
    shared.destroy()
    nodes = materialize(postings.select("digest").distinct(), "jaccard-nodes")
    sizes = profiles.join(nodes, "digest", "left_semi").filter("node_doc IS NOT NULL")
    sizes = sizes.groupBy("digest").agg(F.min("node_doc").alias("node_doc"), F.min("n").alias("n"), F.min("parity").alias("parity"))
    sizes = materialize(sizes, "jaccard-sizes")
    few = Window.partitionBy("digest").orderBy(F.xxhash64("shingle"))
    rows = postings.join(sizes.select("digest", "parity"), "digest").withColumn("rank", F.row_number().over(few))
    rows = materialize(rows.withColumn("label", F.col("digest")), "jaccard-open")

    def with_label(rows: DataFrame, known: DataFrame) -> DataFrame:
        rows = rows.join(known.withColumnRenamed("node", "digest"), "digest", "left")
        return rows.withColumn("label", F.coalesce("label", "digest"))

    def still_open(rows: DataFrame, labels: DataFrame) -> DataFrame:
        """The rows of shingles that span two components; as components only grow, no other can open again."""
        labelled = with_label(rows.drop("label"), labels)
        across = labelled.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high"))
        across = across.filter("low <> high").select("shingle")
        return materialize(labelled.join(across, "shingle", "left_semi"), "jaccard-open")

    def with_pivots(tried: DataFrame, among: DataFrame) -> DataFrame:
        pivot = F.min_by(F.struct("digest", "n", "pos", "parity", "label"), F.xxhash64("digest", "shingle"))
        pivots = among.groupBy("shingle").agg(pivot.alias("pivot")).select("shingle", "pivot.*")
        return _pairs(tried, pivots, percent, "x.label <> y.label")

    done = materialize(with_pivots(rows.filter(F.col("rank") <= PIVOTS), rows), "jaccard-pairs")
    links = materialize(_verified(done, docs, sizes, size, percent), "jaccard-links")
    labels = connected_components(links)
    for step in ("pivots", "all"):
        rows = still_open(rows, labels)
        pairs = with_pivots(rows, rows) if step == "pivots" else _pairs(rows, rows, percent, "x.label < y.label")
        pairs = materialize(pairs.join(done, ["a", "b"], "left_anti"), "jaccard-pairs")
        found = materialize(_verified(pairs, docs, sizes, size, percent), "jaccard-links")
        done, links = done.unionByName(pairs), links.unionByName(found)
        labels = connected_components(links)

    named = with_label(profiles, labels).withColumn("label", F.when(F.col("n") > 0, F.col("label")))
    first = named.filter("label IS NOT NULL").groupBy("label").agg(F.min("node_doc").alias("component_id"))
    # Rows of one id may hold texts of several components, which that id then links.
    named = materialize(named.join(first, "label", "left").select("node_doc", "n", "component_id"), "jaccard-named")
    bridges = named.filter("node_doc <> component_id").selectExpr("node_doc AS a", "component_id AS b")
    repeated = named.filter("node_doc IS NOT NULL").groupBy("node_doc").agg(F.countDistinct("component_id").alias("k"))
    repeated = repeated.filter("k > 1").select("node_doc")
    if not repeated.isEmpty():
        merged = connected_components(bridges).selectExpr("node AS component_id", "label AS merged")
        named = named.join(merged, "component_id", "left").withColumn(
            "component_id", F.coalesce("merged", "component_id")
        )
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("node_doc"))
    return named.select(
        F.col("node_doc").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("node_doc").isNotNull(), component).alias("component_id"),
    )


def one_of_each(documents: DataFrame, size: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents without those that have a similar one with a smaller id; columns unchanged.

    Of rows that share an id (or have none) and their text, any one stays.
    """
    found = similar_documents(documents, id_column, text_column, size, percent)
    name, key, times = unused(documents.columns, "gone", "key", "times")
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias(name))
    gone = small(materialize(gone.distinct(), "jaccard-gone"))
    kept = documents.join(gone, F.col(id_column) == F.col(name), "left_anti")
    again = documents.groupBy(F.col(id_column).alias(key)).agg(F.count("*").alias(times)).filter(F.col(times) > 1)
    again = materialize(again.select(key), "jaccard-again")
    if again.isEmpty():
        return kept
    of_repeated = F.col(id_column).eqNullSafe(F.col(key))
    repeated = kept.join(again, of_repeated, "left_semi").withColumn(key, F.sha2(text_column, 256))
    repeated = repeated.dropDuplicates([id_column, key]).select(*documents.columns)
    return kept.join(again, of_repeated, "left_anti").unionByName(repeated)
