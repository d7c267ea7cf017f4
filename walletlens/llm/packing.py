"""Lexical retrieval packing: documents with related words share training windows.

Each document's ids (with an end id) are cut into full windows of their own and a tail. The tails are
indexed in shards of related content, and every shard is packed by itself from its own BM25 index: its
next unused tail seeds a window, its best unused neighbours fill the window in turn, the neighbour
that does not fit is cut, and what is left of it seeds the next window.

A tail's shard follows from its words alone, at the same cost for every tail. Up to ``GUIDES`` tails of the
corpus, those with the smallest hashes, are guides; every tail is scored by BM25 against all of them, and its best
``RANKED`` guides, best first, are its place (ties: the guide with the smaller hash). Tails are dealt
and sorted in ranges of that place, and each ``SHARD_TAILS`` in a row are a shard. Tails of one guide lie
together however they were stored; a guide with many tails is cut into shards by the next guides of its tails.
Scores are sums of whole numbers, so a place depends on no order. The work is proportional to the tails.

Document frequencies and the mean length are counted over all documents before anything is packed.
The guides are a bounded sample that only steers where a tail goes; every tail is indexed and packed.
Index and scores are bounded, and only the last window of a shard's run is not full.

Null or empty text: the end id alone. Repeated or null ids: each row is packed by itself. Equal
scores in a shard: the earlier tail. Very long texts: many full windows. Empty table: no rows. Other columns
are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from walletlens.llm.token_ids import TokenIds, added_tokens, windows
from walletlens.llm.words import chunks
from walletlens.session import materialize

WINDOW = 2048
END_ID = 1
#: Tails in one shard of the index.
SHARD_TAILS = 2048
#: Most tails whose scores tell a tail's place, the tails to each of them at least, and how many make a place.
GUIDES, PER_GUIDE, RANKED = 1024, 32, 3
#: Tails scored at a time, and the commonest terms, which are scored as a dense matrix.
TAIL_BLOCK, STEP = 1 << 12, 1 << 8
DENSE_TERMS = 1 << 10
#: Steps of one for a term's weight. Sums below 2^24 are exact in single precision.
STEPS = 128
#: Tails a task packs, about.
TASK_TAILS = 1 << 13
#: BM25: saturation of repeats, and share of the length correction.
K1, B = 1.2, 0.75

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_TOKENS = f"{_PIECE}, tail binary, counts array<long>"
_TAIL = "doc_id long, start long, doc_tokens long, tail binary"
_PLACED = f"{_TAIL}, place array<int>, score double"
_COLUMNS = [part.split()[0] for part in _PIECE.split(", ")]


def default_tokenizer() -> tuple[str, str, dict[str, int]]:
    """Rank file, pattern and added tokens of the public byte-level vocabulary of 50,257 ids."""
    import public_tokenizers

    added = added_tokens(str(public_tokenizers.path("byte_bpe_50k.json")))
    return str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN, added


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _pieces(rows: list[tuple], tails: list[bytes | None]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_COLUMNS)
    arrays = [pa.array(column, pa.int64()) for column in columns]
    arrays += [pa.array(tails, pa.binary()), pa.nulls(len(rows), pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(arrays, [*_COLUMNS, "tail", "counts"])


def _tokenised(tokenizer: tuple | None, size: int):
    """Full windows as pieces, tails with their ids, and per task one row of document counts of each id.

    The counts end with the number of documents and of ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = TokenIds(*(tokenizer or default_tokenizer()))
        end = np.array([END_ID], tokens.dtype)
        vocabulary = max(tokens.n_ids, END_ID + 1) + 1
        having, documents, total = np.zeros(vocabulary, np.int64), 0, 0
        number = TaskContext.get().partitionId() << 34
        for batch in batches:
            ids_of = batch.column(0).to_pylist()
            for first, texts in chunks(batch, 1):
                rows, tails = [], []
                for k, ids in enumerate(tokens.of(texts)):
                    ids = np.concatenate([ids, end])
                    doc, count = ids_of[first + k], len(ids)
                    present = np.zeros(vocabulary, bool)
                    present[ids] = True
                    having += present
                    documents += 1
                    total += count
                    for a, b in windows(count, size):
                        rows.append((doc, a, size, _crc(ids[a:b]), count, 2 * number, 0))
                        tails.append(None)
                        number += 1
                    start = count // size * size
                    if start < count:
                        rows.append((doc, start, count - start, None, count, None, None))
                        tails.append(ids[start:].tobytes())
                yield _pieces(rows, tails)
        counts = np.append(having, [documents, total])
        arrays = [pa.nulls(1, pa.int64())] * len(_COLUMNS)
        arrays += [pa.nulls(1, pa.binary()), pa.array([counts], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, [*_COLUMNS, "tail", "counts"])

    return run


def _weighed(tails: list[np.ndarray], idf: np.ndarray, mean: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, term and BM25 weight of each telling term of each tail, by owner."""
    lengths = np.array([len(x) for x in tails])
    owner = np.repeat(np.arange(len(tails), dtype=np.int64), lengths)
    key, repeats = np.unique(owner << 32 | np.concatenate(tails).astype(np.int64), return_counts=True)
    owner, term = key >> 32, key & 0xFFFFFFFF
    telling = idf[term] > 0
    owner, term, repeats = owner[telling], term[telling], repeats[telling]
    norm = K1 * (1 - B + B * lengths[owner] / mean)
    return owner, term, idf[term] * repeats * (K1 + 1) / (repeats + norm)


class ShardIndex:
    """BM25 scores of the tails of one shard, by token id."""

    def __init__(self, tails: list[np.ndarray], idf: np.ndarray, mean: float):
        owner, term, weight = _weighed(tails, idf, mean)
        self.count = len(tails)
        self.terms = np.split(term, np.searchsorted(owner, np.arange(1, self.count)))
        by_term = np.argsort(term, kind="stable")
        self.owner, self.weight = owner[by_term], weight[by_term]
        bounds = np.bincount(term, minlength=len(idf)).cumsum()
        self.stop, self.size = bounds, np.diff(bounds, prepend=0)

    def scores(self, seed: int) -> np.ndarray:
        """Of every tail for the terms of the seed."""
        terms = self.terms[seed]
        sizes = self.size[terms]
        ends = np.cumsum(sizes)
        at = np.repeat(self.stop[terms] - ends, sizes) + np.arange(ends[-1] if len(ends) else 0)
        return np.bincount(self.owner[at], weights=self.weight[at], minlength=self.count)


def retrieval_order(tails: list[np.ndarray], idf: np.ndarray, mean: float, size: int) -> list[int]:
    """The tails in packing order: after each seed its best unused neighbours until the window is full."""
    index = ShardIndex(tails, idf, mean)
    unused = np.ones(len(tails), bool)
    order: list[int] = []
    filled, scores = 0, None
    for _ in range(len(tails)):
        best = int(np.argmax(np.where(unused, scores, -1.0))) if scores is not None else int(np.argmax(unused))
        unused[best] = False
        order.append(best)
        filled += len(tails[best])
        if scores is None or filled >= size:
            # This tail, or what did not fit of it, is the seed of the window now being filled.
            filled %= size
            scores = index.scores(best) if filled else None
    return order


class GuideIndex:
    """BM25 scores of the guides for the terms of tails."""

    def __init__(self, guides: list[np.ndarray], idf: np.ndarray, mean: float):
        common = np.flatnonzero(idf > 0)
        common = common[np.argsort(idf[common], kind="stable")[:DENSE_TERMS]]
        column = np.full(len(idf), -1)
        column[common] = np.arange(len(common))
        owner, term, weight = _weighed(guides, idf, mean)
        weight = np.rint(weight * STEPS).astype(np.float32)
        self.column, self.count = column, len(guides)
        dense = column[term] >= 0
        self.dense = np.zeros((int(column.max(initial=-1)) + 1, self.count), np.float32)
        self.dense[column[term[dense]], owner[dense]] = weight[dense]
        owner, term, weight = owner[~dense], term[~dense], weight[~dense]
        by_term = np.argsort(term, kind="stable")
        self.owner, self.weight = owner[by_term], weight[by_term]
        self.size = np.bincount(term, minlength=len(idf))
        self.stop = self.size.cumsum()

    def scores(self, terms: list[np.ndarray]) -> np.ndarray:
        """A row per list of distinct terms, a column per guide, in steps."""
        row = np.repeat(np.arange(len(terms)), [len(x) for x in terms])
        term = np.concatenate(terms).astype(np.int64)
        dense = self.column[term] >= 0
        asked = np.zeros((len(terms), len(self.dense)), np.float32)
        asked[row[dense], self.column[term[dense]]] = 1
        out = asked @ self.dense
        row, term = row[~dense], term[~dense]
        sizes = self.size[term]
        ends = np.cumsum(sizes)
        at = np.repeat(self.stop[term] - ends, sizes) + np.arange(ends[-1] if len(ends) else 0)
        np.add.at(out.reshape(-1), np.repeat(row, sizes) * self.count + self.owner[at], self.weight[at])
        return out


def _placed(guides, idf, mean: float, dtype: str):
    """Every tail with its best guides, best first, and the score of the best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not guides.value:  # there is no tail
            return
        weights = np.frombuffer(idf.value, np.float64)
        index = GuideIndex([np.frombuffer(x, dtype) for x in guides.value], weights, mean)
        ranked = min(RANKED, index.count)

        def scored(batch: pa.RecordBatch) -> pa.RecordBatch:
            terms = [np.unique(np.frombuffer(x, dtype)) for x in batch.column("tail").to_pylist()]
            places, scores = [], []
            for a in range(0, len(terms), STEP):
                found = index.scores(terms[a : a + STEP])
                at = np.arange(len(found))
                scores.append(found.max(axis=1))
                best = np.empty((len(found), ranked), np.int32)
                for k in range(ranked):
                    best[:, k] = found.argmax(axis=1)
                    found[at, best[:, k]] = -1
                places.append(best)
            place = np.concatenate(places)
            lists = pa.ListArray.from_arrays(np.arange(0, place.size + 1, ranked, dtype=np.int32), pa.array(place.ravel()))
            arrays = [*batch.columns, lists, pa.array(np.concatenate(scores).astype(np.float64))]
            return pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, "place", "score"])

        for batch in batches:
            for a in range(0, batch.num_rows, TAIL_BLOCK):
                yield scored(batch.slice(a, TAIL_BLOCK))

    return run


def _by_place(tails: DataFrame, number: int, idf, mean: float, dtype: str) -> DataFrame:
    """The tails dealt and sorted so that those of related words lie together."""
    # Tasks send their smallest hashes only, then come the tails up to the last hash, one each.
    hashed = tails.select(F.xxhash64("tail").alias("key"), "tail")
    keys = hashed.select("key").distinct().orderBy("key").limit(min(GUIDES, 1 + number // PER_GUIDE)).collect()
    chosen = hashed.filter(F.col("key") <= (keys[-1].key if keys else 0)).groupBy("key").agg(F.min("tail").alias("tail"))
    guides = tails.sparkSession.sparkContext.broadcast([row.tail for row in sorted(chosen.collect())])
    order = [F.col("place"), F.col("score").desc(), F.col("doc_id"), F.col("start")]
    placed = tails.mapInArrow(_placed(guides, idf, mean, dtype), _PLACED)
    dealt = placed.repartitionByRange(1 + number // TASK_TAILS, *order)
    return dealt.sortWithinPartitions(*order).select("doc_id", "start", "doc_tokens", "tail")


def _packed(idf, mean: float, size: int, shard: int, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.frombuffer(idf.value, np.float64)
        sequence = TaskContext.get().partitionId() << 34
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal sequence
            tails = [np.frombuffer(row[3], dtype) for row in held]
            rows, offset = [], 0
            for k in retrieval_order(tails, weights, mean, size):
                doc, start, whole, _ = held[k]
                ids, done = tails[k], 0
                while done < len(ids):
                    take = min(size - offset, len(ids) - done)
                    crc = _crc(ids[done : done + take])
                    rows.append((doc, start + done, take, crc, whole, 2 * sequence + 1, offset))
                    done, offset = done + take, offset + take
                    if offset == size:
                        sequence, offset = sequence + 1, 0
            if offset:
                sequence += 1
            columns = [pa.array(column, pa.int64()) for column in zip(*rows, strict=True)]
            return pa.RecordBatch.from_arrays(columns, _COLUMNS)

        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                held.append(row)
                if len(held) == shard:
                    yield flush()
                    held = []
        if held:
            yield flush()

    return run


def pack(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    tokenizer: tuple[str, str] | tuple[str, str, dict[str, int]] | None = None,
    size: int = WINDOW,
    shard: int = SHARD_TAILS,
) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer`` is a rank file that every executor can read, its pattern and, if any, its added tokens.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    tokens = materialize(docs.mapInArrow(_tokenised(tokenizer, size), _TOKENS), "packing-tokens")

    # One count for each id of the vocabulary, plus two: bounded by the vocabulary.
    counted = tokens.filter("counts IS NOT NULL").select(F.posexplode("counts").alias("at", "n"))
    counted = counted.groupBy("at").agg(F.sum("n").alias("n")).orderBy("at").toArrow()["n"].to_numpy().astype(np.float64)
    if not len(counted):
        return tokens.select(*_COLUMNS)
    having, (total_docs, total_ids) = counted[:-2], counted[-2:]
    idf = np.log(np.maximum((total_docs - having + 0.5) / (having + 0.5), 1.0))
    shared = spark.sparkContext.broadcast(idf.tobytes())
    mean = max(1.0, total_ids / max(1.0, total_docs))
    dtype = "uint16" if len(having) - 1 <= 1 << 16 else "uint32"

    whole = tokens.filter("sequence_id IS NOT NULL").select(*_COLUMNS)
    tails = tokens.filter("tail IS NOT NULL").select("doc_id", "start", "doc_tokens", "tail")
    number = tails.count()
    tails = _by_place(tails, number, shared, mean, dtype)
    return whole.unionByName(tails.mapInArrow(_packed(shared, mean, size, shard, dtype), _PIECE))
