"""The quality posterior and the language mixture against plain loops over documents and words."""

from __future__ import annotations

import collections
import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from walletlens.llm import language, quality
from walletlens.sources.tables import table


def strength_of(within, between, documents, squares, groups):
    scale = documents - squares
    extra = (between - groups * within) / scale if scale > 0 else 0.0
    low, high = quality.STRENGTHS
    return min(high, max(low, within / extra - 1)) if extra > 0 else high


def plain_posteriors(rows):
    """rows: (host, path, evidence). The chance of each document, site by site and document by document."""
    chance = [1 / (1 + math.exp(-evidence)) for _, _, evidence in rows]
    hosts, sites = collections.defaultdict(list), collections.defaultdict(list)
    for (host, path, _), p in zip(rows, chance, strict=True):
        hosts[host].append(p)
        sites[host, path].append(p)
    total = len(rows)
    rate = min(1 - 1e-6, max(1e-6, sum(chance) / total))
    between = sum(len(v) * (sum(v) / len(v) - rate) ** 2 for v in hosts.values())
    squares = sum(len(v) ** 2 / total for v in hosts.values())
    prior = strength_of(rate * (1 - rate), between, total, squares, len(hosts) - 1)
    host_rate = {host: (sum(v) + prior * rate) / (len(v) + prior) for host, v in hosts.items()}
    between = sum(len(v) * (sum(v) / len(v) - sum(hosts[h]) / len(hosts[h])) ** 2 for (h, _), v in sites.items())
    squares = sum(len(v) ** 2 / len(hosts[h]) for (h, _), v in sites.items())
    prior = strength_of(rate * (1 - rate), between, total, squares, len(sites) - len(hosts))

    def logit(x):
        x = min(1 - 1e-6, max(1e-6, x))
        return math.log(x / (1 - x))

    out = []
    for (host, path, evidence), p in zip(rows, chance, strict=True):
        others = sum(sites[host, path]) - p + prior * host_rate[host]
        site = others / (len(sites[host, path]) - 1 + prior)
        out.append((site, 1 / (1 + math.exp(-(evidence + logit(site) - logit(rate))))))
    return out


def test_posteriors_equal_plain_shrinkage(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    # Sparse sites, sites of null names and one of a single document, besides the given ones.
    documents = documents.withColumn("source", F.expr("CASE WHEN doc_id % 50 = 0 THEN NULL WHEN doc_id = 7 THEN 'one' ELSE source END"))
    found = quality.judged(documents, table(spark, sf_dir, "labels")).collect()
    sites = {row.doc_id: (row.source, row.lang) for row in documents.collect()}
    rows = [(*sites[row.doc_id], row.evidence) for row in found]
    for row, (site, posterior) in zip(found, plain_posteriors(rows), strict=True):
        assert math.isclose(row.site_rate, site, rel_tol=1e-9) and math.isclose(row.quality, posterior, rel_tol=1e-9)
        assert row.kept == (row.quality >= 0.5)


def plain_mixture(logs):
    """Shares of the languages of one document by expectation-maximisation, sets tried by size; logs: words x languages."""
    words, languages = len(logs), len(logs[0])
    likely = [[math.exp(max(x - max(row), -60.0)) for x in row] for row in logs]

    def estimate(allowed):
        shares = [1 / len(allowed) if k in allowed else 0.0 for k in range(languages)]
        for _ in range(language.ROUNDS):
            sums = [0.0] * languages
            for row in likely:
                whole = sum(s * x for s, x in zip(shares, row, strict=True))
                for k in range(languages):
                    sums[k] += shares[k] * row[k] / whole
            shares = [x / words for x in sums]
        return shares, sum(math.log(sum(s * x for s, x in zip(shares, row, strict=True))) for row in likely)

    full, _ = estimate(range(languages))
    order = sorted(range(languages), key=lambda k: -full[k])
    alone = order[0]
    best, chosen = sum(math.log(row[alone]) for row in likely), [float(k == alone) for k in range(languages)]
    for size in range(2, languages + 1):
        shares, fit = estimate(order[:size])
        score = fit - (size - 1) * 0.5 * math.log(words)
        if score > best:
            best, chosen = score, shares
    return chosen


def test_mixtures_equal_plain_expectation_maximisation(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    model = language.learn(documents, F.col("doc_id") % 4 != 2)
    texts = {row.lang: row.text for row in documents.filter("length(text) BETWEEN 200 AND 2000 AND lang IS NOT NULL").collect()}
    pairs = [f"{texts[a][:400]} {texts[b][:300]}" for a, b in itertools.combinations(sorted(texts), 2)]
    cases = [*texts.values(), *pairs, " ".join(text[:150] for text in texts.values()), "x", "der the"]
    for case, found in zip(cases, model.results([case.encode() for case in cases]), strict=True):
        cells, first, _ = language.letter_cells([case.encode()])
        letters = sum(model.table[c] for c in cells)
        logs = (np.float32(language.TEMPER) * np.add.reduceat(letters, first, axis=0)).astype(float).tolist()
        shares = plain_mixture(logs)
        expected = {name: share for name, share in zip(model.names, shares, strict=True) if share > 0}
        assert set(found["mixture"]) == set(expected)
        assert all(abs(found["mixture"][name] - share) < 2e-3 for name, share in expected.items())
        assert found["lang"] == max(expected, key=expected.get)
    assert any(len(model.results([case.encode()])[0]["mixture"]) > 1 for case in pairs)


def test_language_takes_columns_of_any_name(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choices(["uno", "dos"] if k % 2 else ["ein", "zwei"], k=9)), "es" if k % 2 else "de", 1, 1) for k in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, __id int, id int")
    found = language.predicted(frame).collect()
    assert all(row.lang_pred == ("es" if row.doc_id % 2 else "de") for row in found) and len(found) == 60
