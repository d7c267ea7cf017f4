"""Benchmark decontamination by fingerprints of item-sized windows.

Every benchmark item has a 64-bit SimHash of its word shingles. A document's windows of the same
number of words get theirs from running bit sums. A multi-index of eight one-byte blocks finds the
items near a window: fingerprints within ``RADIUS`` = 23 bits differ by at most two bits in one block
at least, so looking up every block with up to two bits changed misses none of them. What is left
after counting all 64 bits is verified exactly: the weighted Jaccard similarity of the two multisets
of shingles, weighted by their counts, must reach the threshold.

Windows that share no shingle with any item of their size have similarity 0 and get no fingerprint.
At the threshold of 0.8 the expected distance is 10 bits with a deviation of 3, so the radius loses
about one window in a million, and a near copy has several.

Words are runs without ASCII white space, in lower case, without punctuation at their ends; words of
punctuation alone do not count. A document shorter than an item is one window.

The index of a pass holds at most ``ITEMS_PER_PASS`` items and ``BYTES_PER_PASS`` of their text and
is broadcast; a larger benchmark takes several passes over the documents. Documents are neither
shuffled nor grouped, so copies and hot sources spread over tasks as they are stored.

Null or empty documents: no match. Null, empty or wordless items: ignored. Items with fewer words
than a shingle: one shingle, matched as a whole. Repeated items and ids: one match each. Ties: the
first window. Very long texts: all their windows, one text at a time with its batch. Empty tables: no rows.
Other columns are not read; ``drop_contaminated`` keeps them, whatever their names.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from walletlens.llm.words import CACHE_WORDS, chunks, mix, rolling, short_shingle

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 23
_BLOCKS = 8
_FLIPS = RADIUS // _BLOCKS

ITEMS_PER_PASS = 20_000
BYTES_PER_PASS = 32_000_000
_WINDOWS_AT_ONCE = 4096

_MATCH = "array<struct<item_id:long,start_word:long,n_words:long,distance:int,similarity:double>>"
_MATCH_TYPE = pa.list_(
    pa.struct(
        [
            ("item_id", pa.int64()),
            ("start_word", pa.int64()),
            ("n_words", pa.int64()),
            ("distance", pa.int32()),
            ("similarity", pa.float64()),
        ]
    )
)
_ENDS = string.punctuation + "«»„“”‘’‚…–—¿¡·"
_BITS_SET = np.array([bin(x).count("1") for x in range(256)], np.uint8)


class PlainWords(dict):
    """Hash of each word without case and outer punctuation; 0 where nothing is left."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        plain = word.decode("utf-8", "replace").lower().strip(_ENDS)
        value = self[word] = xxhash.xxh64_intdigest(plain) | 1 if plain else 0
        return value

    def of(self, text: bytes) -> np.ndarray:
        words = text.split()
        found = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        return found[found != 0]


def shingles_of(words: np.ndarray) -> np.ndarray:
    """Shingle hashes of a text in order; all its words as one where it is shorter."""
    if 0 < len(words) < SHINGLE:
        return short_shingle(words)
    return rolling(words, SHINGLE)


def _bits(shingles: np.ndarray) -> np.ndarray:
    return np.unpackbits(mix(shingles).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1)


def simhashes(shingles: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints (eight bytes each) of the windows of ``width`` shingles at ``starts``."""
    sums = np.zeros((len(shingles) + 1, 64), np.int32)
    np.cumsum(_bits(shingles), axis=0, out=sums[1:])
    return np.packbits(2 * (sums[starts + width] - sums[starts]) > width, axis=1)


def weighted_similarity(left: np.ndarray, right: np.ndarray) -> float:
    """Sum of the smaller counts over the sum of the larger counts."""
    x, count_x = np.unique(left, return_counts=True)
    y, count_y = np.unique(right, return_counts=True)
    _, at_x, at_y = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    common = int(np.minimum(count_x[at_x], count_y[at_y]).sum())
    return common / (len(left) + len(right) - common)


class ItemIndex:
    """Multi-index of the items' fingerprints, per item size."""

    def __init__(self, items: list[tuple[int | None, str | None]], threshold: float):
        self.threshold = threshold
        plain = PlainWords()
        self.by_size: dict[int, list[tuple[int | None, np.ndarray, np.ndarray]]] = {}
        self.short: list[tuple[int | None, np.ndarray, np.uint64]] = []
        for item, text in items:
            words = plain.of((text or "").encode())
            if 0 < len(words) < SHINGLE:
                self.short.append((item, words, rolling(words, len(words))[0]))
            elif len(words):
                shingles = shingles_of(words)
                whole = simhashes(shingles, np.array([0]), len(shingles))[0]
                self.by_size.setdefault(len(words), []).append((item, np.sort(shingles), whole))
        self.near = {size: self._blocks(held) for size, held in self.by_size.items()}
        pairs = [(s, size) for size, held in self.by_size.items() for s in np.unique(np.concatenate([x[1] for x in held]))]
        pairs.sort()
        self.keys = np.array([s for s, _ in pairs], np.uint64)
        self.sizes = np.array([size for _, size in pairs], np.int64)
        cells = 1 << max(16, min(26, (64 * len(pairs) + 1).bit_length()))
        self.mask = np.uint64(cells - 1)
        self.maybe = np.zeros(cells, bool)
        self.maybe[(self.keys & self.mask).astype(np.int64)] = True

    @staticmethod
    def _blocks(held) -> np.ndarray:
        """[block, byte value, item]: whether the item's block is within the allowed flips of that value."""
        prints = np.array([x[2] for x in held])
        values = np.arange(256, dtype=np.uint8)
        return np.stack([_BITS_SET[values[:, None] ^ prints[None, :, b]] <= _FLIPS for b in range(_BLOCKS)])

    def touched(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, item size) of every shingle that some item of that size has."""
        at = np.flatnonzero(self.maybe[(shingles & self.mask).astype(np.int64)])
        low = np.searchsorted(self.keys, shingles[at], side="left")
        high = np.searchsorted(self.keys, shingles[at], side="right")
        counts = high - low
        place = np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        return np.repeat(at, counts), self.sizes[place]

    def matches(self, shingles: np.ndarray, n_words: int, at: np.ndarray, size: int) -> Iterator[tuple]:
        """The best window of each matching item of ``size``, given the positions ``at`` it touches."""
        held = self.by_size[size]
        width = len(shingles) if n_words < size else max(1, size - SHINGLE + 1)
        edges = np.zeros(len(shingles) - width + 2, np.int64)
        np.add.at(edges, np.maximum(at - width + 1, 0), 1)
        np.add.at(edges, np.minimum(at, len(edges) - 2) + 1, -1)
        starts = np.flatnonzero(np.cumsum(edges)[:-1] > 0)
        best: dict[int, tuple] = {}
        while len(starts):
            part = starts[: np.searchsorted(starts, starts[0] + _WINDOWS_AT_ONCE)]
            starts = starts[len(part) :]
            base = part[0]
            local = shingles[base : part[-1] + width]
            prints = simhashes(local, part - base, width)
            near = self.near[size]
            found = np.logical_or.reduce([near[b][prints[:, b]] for b in range(_BLOCKS)])
            for k in np.flatnonzero(found.any(axis=0)):
                item, members, whole = held[k]
                distance = _BITS_SET[prints ^ whole].sum(axis=1)
                inside = np.concatenate([[0], np.cumsum(np.isin(local, members))])
                most = inside[part - base + width] - inside[part - base]
                bound = most / np.maximum(1, width + len(members) - most)
                for w in np.flatnonzero(found[:, k] & (distance <= RADIUS) & (bound >= self.threshold)):
                    start = part[w]
                    if k in best and bound[w] <= best[k][0]:
                        continue
                    similarity = weighted_similarity(shingles[start : start + width], members)
                    if similarity >= self.threshold and (k not in best or similarity > best[k][0]):
                        best[k] = (similarity, item, int(start), min(n_words, size), int(distance[w]))
        for similarity, item, start, words, distance in best.values():
            yield item, start, words, distance, similarity

    def search(self, plain: PlainWords, texts: list[bytes]) -> list[list[tuple]]:
        """The matches of each text."""
        words = [plain.of(text) for text in texts]
        runs = [shingles_of(x) for x in words]
        out: list[list[tuple]] = [[] for _ in texts]
        for item, members, whole in self.short:
            for t, found in enumerate(words):
                for start in np.flatnonzero(rolling(found, len(members)) == whole):
                    if np.array_equal(found[start : start + len(members)], members):
                        out[t].append((item, int(start), len(members), 0, 1.0))
                        break
        if not len(self.keys) or not runs:
            return out
        ends = np.cumsum([len(run) for run in runs])
        at, sizes = self.touched(np.concatenate(runs))
        for t in np.unique(np.searchsorted(ends, at, side="right")):
            begin = ends[t] - len(runs[t])
            low, high = np.searchsorted(at, [begin, ends[t]])
            place, size_of = at[low:high] - begin, sizes[low:high]
            for size in np.unique(size_of):
                out[t] += self.matches(runs[t], len(words[t]), place[size_of == size], int(size))
        return out


def _search(items, threshold: float):
    @F.arrow_udf(_MATCH)
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index, plain = ItemIndex(items.value, threshold), PlainWords()
        names = ("item_id", "start_word", "n_words", "distance", "similarity")
        for texts in batches:
            out: list[list[dict]] = []
            for _, part in chunks(pa.RecordBatch.from_arrays([texts], ["text"]), 0):
                out += [[dict(zip(names, x, strict=True)) for x in found] for found in index.search(plain, part)]
            yield pa.array(out, _MATCH_TYPE)

    return search


def searches(benchmark: DataFrame, threshold: float, item_column: str, text_column: str) -> list:
    """One function from a text column to its matches for each bounded part of the benchmark."""
    items = benchmark.select(
        F.col(item_column).cast("long").alias("item"), F.col(text_column).alias("text")
    ).filter("trim(text) <> ''")
    size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()
    passes = max(1, -(-size[0] // (ITEMS_PER_PASS // 2)), -(-size[1] // (BYTES_PER_PASS // 2)))
    out = []
    for k in range(passes if size[0] else 0):
        part = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == k)
        rows = [tuple(row) for row in part.collect()]  # about half of ITEMS_PER_PASS
        out.append(_search(benchmark.sparkSession.sparkContext.broadcast(rows), threshold))
    return out


def contaminated(
    documents: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    threshold: float = SIMILARITY,
) -> DataFrame:
    """Per document and matching item: doc_id, item_id, start_word, n_words, distance, similarity of the best window."""
    docs = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    found = [
        docs.select("doc_id", F.inline(search("text")))
        for search in searches(benchmark, threshold, item_column, item_text_column)
    ]
    if not found:
        return docs.select("doc_id", F.inline(F.array().cast(_MATCH)))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def drop_contaminated(
    documents: DataFrame,
    benchmark: DataFrame,
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    threshold: float = SIMILARITY,
) -> DataFrame:
    """The documents that match no item; columns unchanged."""

    def clean(search) -> Column:
        return F.size(search(text_column)) == 0

    for search in searches(benchmark, threshold, item_column, item_text_column):
        documents = documents.filter(clean(search))
    return documents
