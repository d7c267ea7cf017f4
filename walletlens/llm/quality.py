"""Quality classifier with hierarchical empirical Bayes over sites.

A sparse logistic regression, fitted on at most ``MAX_LABELS`` labelled documents, gives each document
its own evidence: the log odds of being good given which words, word endings and word shapes occur
anywhere in its text and how often a word repeats the one before. All documents' probabilities are then summed by host and by path within host.
Site rates are shrunk: a path's towards its host's, a host's towards the global rate, each by a prior
strength estimated from the spread between sites beyond chance. A document's posterior log odds are
its evidence plus the log odds of its path's shrunken rate (without the document itself) less those
of the global rate. Documents below even odds are rejected.

A document is good if its label says quality 1 and toxic 0; a missing one of the two counts as good.

Sums per site are combined before the shuffle. The table of sites is written and joined, so that Spark
broadcasts it while its size allows and splits hot sites beyond. Texts are not shuffled otherwise.

Null or empty text: no words, evidence of the intercept. Null host or path: a site of its own. Null or
repeated ids: each row is judged by itself. Labels without both values or without a document are not
used; without labelled documents of both kinds the evidence is 0 and everything stays. Very long texts: read in
parts of some megabytes. Empty table: no rows. Other columns are not read; ``drop_rejected`` keeps them,
whatever their names.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from walletlens.llm.words import CACHE_WORDS, chunks
from walletlens.llm.columns import unused
from walletlens.session import materialize

#: Most labelled documents a fit reads, those with the smallest hashes of their ids.
MAX_LABELS = 20_000
#: Hashed features: words, punctuation at word ends, shapes of words, shares of words that repeat the one before.
WORD_CELLS, ENDING_CELLS, SHAPES = 1 << 16, 256, 4
REPEATED = (0.0, 0.02, 0.1, 0.3)
FEATURES = WORD_CELLS + ENDING_CELLS + SHAPES + len(REPEATED)
#: Penalty on absolute weights, and most steps of the fit.
PENALTY, STEPS = 0.0003, 40
#: Bounds of the estimated prior strengths, in documents.
STRENGTHS = (1.0, 1e6)

_NO_ENDING = WORD_CELLS
_SHAPE_AT = WORD_CELLS + ENDING_CELLS


class WordFeatures(dict):
    """The three features of a word, 21 bits each."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        text = word.decode("utf-8", "replace")
        core = text.strip(string.punctuation)
        ending = text[len(text.rstrip(string.punctuation)) :] if core else text
        cell = xxhash.xxh32_intdigest(core.lower()) % WORD_CELLS
        end = _NO_ENDING + (1 + xxhash.xxh32_intdigest(ending) % (ENDING_CELLS - 1) if ending else 0)
        shape = 0 if not core else 1 if core.isupper() and len(core) > 1 else 2 if core.isalpha() else 3
        value = self[word] = cell | end << 21 | (_SHAPE_AT + shape) << 42
        return value

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(features, three per word and one per level of repetition reached; text each is from)."""
        split = [text.split() for text in texts]
        lengths = np.array([len(words) for words in split])
        packed = np.fromiter((self[w] for words in split for w in words), np.int64, lengths.sum())
        low = (1 << 21) - 1
        text_of = np.repeat(np.arange(len(texts)), lengths)
        again = (packed[1:] == packed[:-1]) & (text_of[1:] == text_of[:-1])
        share = np.bincount(text_of[1:][again], minlength=len(texts)) / np.maximum(1, lengths)
        level, reached = np.nonzero(share > np.array(REPEATED)[:, None])
        parts = [packed & low, packed >> 21 & low, packed >> 42, FEATURES - len(REPEATED) + level]
        return np.concatenate(parts), np.concatenate([text_of, text_of, text_of, reached])


def _texts(batches: Iterator[pa.Array]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts, with whether each ends its batch."""
    for texts in batches:
        done = 0
        for _, part in chunks(pa.RecordBatch.from_arrays([texts], ["text"]), 0):
            done += len(part)
            yield done == len(texts), part
        if not len(texts):
            yield True, []


@F.arrow_udf(ArrayType(IntegerType()))
def present_features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The distinct features of each text, ascending."""
    known, out = WordFeatures(), []
    for last, texts in _texts(batches):
        if texts:
            features, text_of = known.of(texts)
            pairs = np.unique(text_of * (1 << 21) + features)
            bounds = np.searchsorted(pairs, np.arange(1, len(texts)) * (1 << 21))
            out += np.split((pairs & ((1 << 21) - 1)).astype(np.int32), bounds)
        if last:
            yield pa.array(out, pa.list_(pa.int32()))
            out = []


@dataclass
class Evidence:
    """A fitted classifier: weights of the features that have one, and the intercept."""

    features: list[int]
    weights: list[float]
    intercept: float

    def log_odds(self, text: Column | str) -> Column:
        """Log odds that a text is good, from the features that occur in it."""
        features, weights, intercept = self.features, self.weights, self.intercept

        @F.arrow_udf("double")
        def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            table = np.zeros(FEATURES)
            table[features] = weights
            known, out = WordFeatures(), []
            for last, texts in _texts(batches):
                if texts:
                    found, text_of = known.of(texts)
                    telling = table[found] != 0
                    pairs = np.unique(text_of[telling] * (1 << 21) + found[telling])
                    sums = np.bincount(pairs >> 21, weights=table[pairs & ((1 << 21) - 1)], minlength=len(texts))
                    out.append(intercept + sums)
                if last:
                    yield pa.array(np.concatenate(out) if out else np.zeros(0))
                    out = []

        return score(text)


def fit_evidence(
    documents: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    max_labels: int = MAX_LABELS,
    good: str = "coalesce(quality, 1) = 1 AND coalesce(toxic, 0) = 0",
    labelled: str = "quality IS NOT NULL OR toxic IS NOT NULL",
) -> Evidence:
    """A classifier from a bounded sample of labelled documents; the same for the same tables."""
    sample = labels.filter(labelled).select(
        F.col(id_column).cast("long").alias("__id"), F.expr(f"CAST({good} AS DOUBLE)").alias("label")
    )
    sample = sample.filter("__id IS NOT NULL").orderBy(F.xxhash64("__id"), "__id", "label").limit(max_labels)
    sample = materialize(sample, "quality-sample")
    docs = documents.select(F.col(id_column).cast("long").alias("__id"), F.col(text_column).alias("__text"))
    # At most max_labels rows of two numbers.
    rows = docs.join(F.broadcast(sample), "__id").select("label", present_features("__text").alias("found"))
    rows = materialize(rows, "quality-training")
    kinds = rows.agg(F.min("label"), F.max("label")).head()
    if kinds[0] is None or kinds[0] == kinds[1]:
        return Evidence([], [], 0.0)

    @F.udf(VectorUDT())
    def vector(found):
        return Vectors.sparse(FEATURES, found, [1.0] * len(found))

    model = LogisticRegression(
        maxIter=STEPS, regParam=PENALTY, elasticNetParam=1.0, standardization=False, aggregationDepth=2
    ).fit(rows.select("label", vector("found").alias("features")))
    weights = model.coefficients.toArray()
    used = np.flatnonzero(weights)
    return Evidence(used.tolist(), weights[used].tolist(), float(model.intercept))


def _strength(within: float, between: float, documents: float, squares: float, groups: float) -> float:
    """Prior strength from weighted squared deviations: binomial spread over what exceeds it between groups."""
    low, high = STRENGTHS
    scale = documents - squares
    extra = (between - groups * within) / scale if scale > 0 else 0.0
    return min(high, max(low, within / extra - 1)) if extra > 0 else high


def site_rates(sums: DataFrame) -> DataFrame:
    """Shrunken rates from sums (host, path, n, good): host, path, n, good, host_rate, strength, global_rate."""
    host = sums.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))
    total = host.agg(F.sum("host_n").alias("n"), F.sum("host_good").alias("good")).head()
    if not total["n"]:
        return sums.select(
            "host", "path", "n", "good", *(F.lit(0.5).alias(k) for k in ("host_rate", "strength", "global_rate"))
        )
    documents = float(total["n"])
    rate = min(1 - 1e-6, max(1e-6, total["good"] / documents))
    spread = host.agg(
        F.sum(F.col("host_n") * F.pow(F.col("host_good") / F.col("host_n") - rate, 2)).alias("between"),
        F.sum(F.pow("host_n", F.lit(2)) / documents).alias("squares"),
        F.count("*").alias("groups"),
    ).head()
    host_strength = _strength(rate * (1 - rate), spread["between"], documents, spread["squares"], spread["groups"] - 1)
    host = host.withColumn(
        "host_rate", (F.col("host_good") + host_strength * rate) / (F.col("host_n") + host_strength)
    )
    sites = sums.join(host, "host")
    spread = sites.agg(
        F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - F.col("host_good") / F.col("host_n"), 2)).alias("between"),
        F.sum(F.pow("n", F.lit(2)) / F.col("host_n")).alias("squares"),
        (F.count("*") - F.countDistinct("host")).alias("groups"),
    ).head()
    strength = _strength(rate * (1 - rate), spread["between"], documents, spread["squares"], spread["groups"])
    return sites.select(
        "host", "path", "n", "good", "host_rate", F.lit(strength).alias("strength"), F.lit(rate).alias("global_rate")
    )


def _key(column: Column) -> Column:
    """A join key that is never null."""
    return F.concat(F.when(column.isNull(), "-").otherwise("+"), F.coalesce(column.cast("string"), F.lit("")))


def _logit(rate: Column) -> Column:
    bounded = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), rate))
    return F.log(bounded / (1 - bounded))


def with_posterior(
    documents: DataFrame,
    evidence: Evidence,
    host: Column,
    path: Column,
    text_column: str = "text",
    keep: list[str] | None = None,
) -> tuple[DataFrame, str, str, str]:
    """The documents' columns (those of ``keep``) with three more, and their names.

    These are the evidence (log odds), the rate of the site and the quality (posterior probability).
    Texts are scored once: the scored rows are written, with the text only where it is kept.
    """
    keep = documents.columns if keep is None else keep
    names = unused(documents.columns, "host_key", "path_key", "evidence", "site_rate", "quality")
    host_key, path_key, log_odds, site_rate, quality = names
    scored = documents.select(
        *keep, _key(host).alias(host_key), _key(path).alias(path_key), evidence.log_odds(text_column).alias(log_odds)
    )
    scored = materialize(scored, "quality-scored")
    probability = 1 / (1 + F.exp(-F.col(log_odds)))
    sums = scored.groupBy(F.col(host_key).alias("host"), F.col(path_key).alias("path"))
    sums = materialize(sums.agg(F.count("*").alias("n"), F.sum(probability).alias("good")), "quality-sites")
    sites = materialize(site_rates(sums), "quality-rates")
    joined = scored.join(sites, (F.col(host_key) == sites["host"]) & (F.col(path_key) == sites["path"]))
    others = sites["good"] - probability + sites["strength"] * sites["host_rate"]
    rate = others / (sites["n"] - 1 + sites["strength"])
    odds = F.col(log_odds) + _logit(rate) - _logit(sites["global_rate"])
    found = joined.select(
        *(scored[c] for c in keep), log_odds, rate.alias(site_rate), (1 / (1 + F.exp(-odds))).alias(quality)
    )
    return found, log_odds, site_rate, quality


def judged(documents: DataFrame, labels: DataFrame, host_column: str = "source", path_column: str = "lang") -> DataFrame:
    """Per document: doc_id, evidence, site_rate, quality (posterior probability of being good), kept."""
    evidence = fit_evidence(documents, labels)
    host, path = F.col(host_column), F.col(path_column)
    found, log_odds, rate, quality = with_posterior(documents, evidence, host, path, keep=["doc_id"])
    return found.select(
        "doc_id",
        F.col(log_odds).alias("evidence"),
        F.col(rate).alias("site_rate"),
        F.col(quality).alias("quality"),
        (F.col(quality) >= 0.5).alias("kept"),
    )


def drop_rejected(
    documents: DataFrame, labels: DataFrame, host_column: str = "source", path_column: str = "lang"
) -> DataFrame:
    """The documents at even odds or better; columns unchanged."""
    evidence = fit_evidence(documents, labels)
    found, _, _, quality = with_posterior(documents, evidence, F.col(host_column), F.col(path_column))
    return found.filter(F.col(quality) >= 0.5).select(*documents.columns)
