"""Words and shingles of batches of texts as 64-bit hashes, for code that runs inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

CHUNK_BYTES = 1_000_000
CACHE_WORDS = 1 << 17
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Hash of each word, kept while it is likely to come again. Bounded by ``CACHE_WORDS``."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def chunks(batch: pa.RecordBatch, column: int, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of rows of a batch with about ``limit`` bytes of text: (first row, texts). A null is empty."""
    texts = batch.column(column).cast(pa.large_binary())
    lengths = np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1])
    ends = np.cumsum(lengths)
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit)))
        yield start, [text or b"" for text in texts.slice(start, stop - start).to_pylist()]
        start = stop


def lower_words(text: bytes) -> list[bytes]:
    """Runs of bytes other than ASCII white space, A-Z in lower case."""
    return text.lower().split()


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that every bit depends on all others."""
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def rolling(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words, at the run's first word."""
    count = len(words) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for k in range(size):
        total = total * _FACTOR + words[k : k + count]
    return mix(total)


def short_shingle(words: np.ndarray) -> np.ndarray:
    """The single shingle of a text with fewer words than a shingle has."""
    return np.array([xxhash.xxh64_intdigest(words.tobytes(), seed=len(words))], np.uint64)


def shingle_runs(hashes: WordHashes, texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """The shingle hashes of each text, in order and with repeats; empty for a text without words."""
    for _, run in word_and_shingle_runs(hashes, texts, size):
        yield run


def word_and_shingle_runs(
    hashes: WordHashes, texts: list[bytes], size: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The word hashes and the shingle hashes of each text, as ``shingle_runs`` gives them."""
    split = [lower_words(text) for text in texts]
    ends = np.cumsum([len(words) for words in split])
    all_words = hashes.of([word for words in split for word in words])
    runs = rolling(all_words, size)
    start = 0
    for end in ends:
        words = all_words[start:end]
        if end - start >= size:
            yield words, runs[start : end - size + 1]
        elif end > start:
            yield words, short_shingle(words)
        else:
            yield words, words
        start = end
