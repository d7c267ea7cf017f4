"""Language identification as a mixture of languages per document.

A language is a distribution over hashed character n-grams (a letter, with the one before, with both
neighbours; word edges included), learned from labelled documents. A word's likelihood under a
language is the product of its n-grams', tempered because n-grams overlap. A document's words come from its languages in
unknown proportions, which expectation-maximisation estimates. It runs for the strongest language
alone, the strongest two and so on, in the order of their proportions with all languages, and the set
with the best penalised likelihood (half the log of the word count for each further language) gives
the proportions; the largest is the prediction.

Words are runs of letters, in lower case. The model is a table of ``CELLS`` n-gram cells per language,
whatever the corpus holds. Counting is combined per task before the shuffle. Predictions look at one
document's words at a time, so no group can be large.

Null text, empty text or no letter: ``und`` with score 0 and no proportions. Nothing to learn from:
``und`` for all. Ties: the language first by name. Repeated or null ids: each row by itself. Very long
texts: one is in memory at a time, with a number for each of its words and languages. Empty table: no rows.
Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from walletlens.llm.words import chunks

#: Hashed n-gram cells of the model.
CELLS = 1 << 16
#: Most labelled documents the model is learned from, those with the smallest hashes of their ids.
MAX_LEARNED = 20_000
#: Added to every count; exponent on word likelihoods; rounds of expectation-maximisation.
SMOOTHING, TEMPER, ROUNDS = 0.5, 0.5, 10
UNKNOWN = "und"

_RESULT = "struct<lang:string,score:double,mixture:map<string,double>>"
_COUNTS = "lang string, cell int, n long"
_RESULT_TYPE = pa.struct(
    [("lang", pa.string()), ("score", pa.float64()), ("mixture", pa.map_(pa.string(), pa.float64()))]
)
_CHUNK = 1_000_000


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(code).isalpha() for code in range(0x110000)])


def _cells(codes: np.ndarray, before: np.ndarray | int, two_before: np.ndarray | int) -> np.ndarray:
    """Cell of each n-gram of code points; 0 stands for none, 32 for a word's edge."""
    mixed = codes * np.uint32(0x9E3779B1) + before * np.uint32(0x85EBCA77) + two_before * np.uint32(0xC2B2AE3D)
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (mixed ^ (mixed >> np.uint32(13))) & np.uint32(CELLS - 1)


def letter_cells(texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(cells of the n-grams around each letter, one array per length; first letter of each word; its text)."""
    plain = [text.decode("utf-8", "replace").lower() for text in texts]
    ends = np.cumsum([len(text) + 1 for text in plain])
    codes = np.frombuffer((" " + " ".join(plain) + "  ").encode("utf-32-le", "replace"), np.uint32)
    is_letter = _letters()[codes]
    codes = np.where(is_letter, codes, np.uint32(32))
    at = np.flatnonzero(is_letter)
    here, before, after = codes[at], codes[at - 1], codes[at + 1]
    none = np.uint32(0)
    cells = [_cells(here, none, none), _cells(here, before, none), _cells(after, here, before)]
    first = np.flatnonzero(before == 32)
    return cells, first, np.searchsorted(ends, at[first] - 1, side="right")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, cell, n) of a task's documents (lang, text)."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for start, texts in chunks(batch, 1, limit=_CHUNK):
            for lang in set(langs[start : start + len(texts)]):
                own = [text for k, text in enumerate(texts) if langs[start + k] == lang]
                total = counts.setdefault(lang, np.zeros(CELLS, np.int64))
                for cells in letter_cells(own)[0]:
                    total += np.bincount(cells, minlength=CELLS)
    for lang, total in counts.items():
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(total[used])],
            ["lang", "cell", "n"],
        )


@dataclass
class LanguageModel:
    """Names of the languages, and log probabilities of each n-gram cell in each."""

    names: list[str]
    table: np.ndarray

    def results(self, texts: list[bytes]) -> list[dict]:
        """Prediction of each text."""
        out = [{"lang": UNKNOWN, "score": 0.0, "mixture": {}}] * len(texts)
        cells, first, text_of = letter_cells(texts)
        if not len(first) or not self.names:
            return out
        letters = self.table[cells[0]] + self.table[cells[1]] + self.table[cells[2]]
        words = np.float32(TEMPER) * np.add.reduceat(letters, first, axis=0)
        held, starts = np.unique(text_of, return_index=True)
        shares = mixtures(words, starts)
        for row, t in zip(shares, held, strict=True):
            best = int(np.argmax(row))
            chosen = {self.names[k]: float(row[k]) for k in np.flatnonzero(row)}
            out[t] = {"lang": self.names[best], "score": min(1.0, float(row[best])), "mixture": chosen}
        return out

    def identify(self, text: Column | str) -> Column:
        """Struct of lang, score and mixture for a text column."""
        model = self

        @F.arrow_udf(_RESULT)
        def identified(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in batches:
                out: list[dict] = []
                for _, part in chunks(pa.RecordBatch.from_arrays([texts], ["text"]), 0, limit=_CHUNK):
                    out += model.results(part)
                yield pa.array(out, _RESULT_TYPE)

        return identified(text)


def learn(
    documents: DataFrame,
    usable: Column,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
    max_learned: int = MAX_LEARNED,
) -> LanguageModel:
    """A model from a bounded sample of the documents that are ``usable`` and have a language."""
    known = documents.filter(usable & F.col(lang_column).isNotNull() & F.col(id_column).isNotNull())
    known = known.select(F.col(id_column).alias("id"), F.col(lang_column).alias("lang"), F.col(text_column).alias("text"))
    sample = known.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(max_learned)
    # At most max_learned ids.
    rows = known.join(F.broadcast(sample), "id").select("lang", "text")
    counted = rows.mapInArrow(_count, _COUNTS).groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    counted = counted.toPandas()  # at most CELLS rows a language
    names = sorted(counted["lang"].unique())
    counts = np.full((CELLS, len(names)), SMOOTHING)
    at = counted["lang"].map({name: k for k, name in enumerate(names)})
    counts[counted["cell"].to_numpy(dtype=np.int64), at.to_numpy(dtype=np.int64)] += counted["n"].to_numpy()
    return LanguageModel([str(name) for name in names], np.log(counts / counts.sum(axis=0)).astype(np.float32))


def _estimate(likely: np.ndarray, starts: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the allowed languages of each document, and its log likelihood."""
    lengths = np.diff(np.append(starts, len(likely)))
    shares, every = allowed / allowed.sum(axis=1, keepdims=True), np.ones(likely.shape[1], np.float32)
    for _ in range(ROUNDS):
        parts = likely * np.repeat(shares, lengths, axis=0)
        parts /= (parts @ every)[:, None]
        shares = np.add.reduceat(parts, starts, axis=0) / lengths[:, None].astype(np.float32)
    whole = np.log((likely * np.repeat(shares, lengths, axis=0)) @ every)
    return shares, np.add.reduceat(whole, starts)


def mixtures(logs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Proportions of the selected languages of each document.

    ``logs`` holds log likelihoods of words (rows) per language, ``starts`` each document's first word.
    All languages together fit best; where even that gains less over the strongest one than the
    penalty for a second, no other set can win and none is tried.
    """
    likely = np.exp(np.maximum(logs - logs.max(axis=1, keepdims=True), np.float32(-60.0)))
    lengths = np.diff(np.append(starts, len(logs)))
    languages = logs.shape[1]
    penalty = 0.5 * np.log(lengths)
    full, fit = _estimate(likely, starts, np.ones((len(starts), languages), np.float32))
    rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1)
    chosen = (rank == 0).astype(np.float32)
    alone = likely[np.arange(len(likely)), np.repeat(np.argmax(chosen, axis=1), lengths)]
    single = np.add.reduceat(np.log(alone), starts)
    mixed = np.flatnonzero(fit - single > penalty)
    if not len(mixed):
        return chosen
    rows = np.zeros(len(starts), bool)
    rows[mixed] = True
    likely = likely[np.repeat(rows, lengths)]
    starts = np.cumsum(lengths[mixed]) - lengths[mixed]
    best, shares_of, rank, penalty = single[mixed], chosen[mixed], rank[mixed], penalty[mixed]
    for size in range(2, languages + 1):
        shares, fit = _estimate(likely, starts, (rank < size).astype(np.float32))
        score = fit - (size - 1) * penalty
        better = score > best
        shares_of = np.where(better[:, None], shares, shares_of)
        best = np.where(better, score, best)
    chosen[mixed] = shares_of
    return chosen


def predicted(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, mixture. Only documents that are not held out are learned from."""
    fold = F.crc32(F.col(id_column).cast("string").cast("binary")) % 4
    held_out = F.coalesce(fold == 2, F.lit(False))
    model = learn(documents, ~held_out, id_column, text_column, lang_column)
    rows = documents.select(F.col(id_column).alias("doc_id"), held_out.alias("held_out"), F.col(text_column).alias("text"))
    found = rows.select("doc_id", "held_out", model.identify("text").alias("found"))
    return found.select(
        "doc_id",
        "held_out",
        F.col("found.lang").alias("lang_pred"),
        F.col("found.score").alias("score"),
        F.col("found.mixture").alias("mixture"),
    )
