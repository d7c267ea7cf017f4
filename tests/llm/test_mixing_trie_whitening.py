"""Source mixing, the conversation trie and embedding whitening against brute force, and on rows with defects."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from walletlens.llm import mixing, prefix_trie, whitening
from walletlens.llm.row_numbers import numbered
from walletlens.sources.tables import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return len(WORD.findall(text or ""))


# --- mixing -----------------------------------------------------------------------------------


def brute_targets(totals):
    """Shares by weight; what exceeds three times a source goes to the others until none does."""
    names = sorted((name for name in totals if name is not None), key=lambda x: x.encode()) + ([None] if None in totals else [])
    weight = {name: k % 3 + 1 for k, name in enumerate(names)}
    total = Fraction(sum(totals.values()))
    fixed = {}
    while True:
        rest = [name for name in names if name not in fixed]
        left = total - sum(fixed.values())
        share = {name: left * weight[name] / sum(weight[x] for x in rest) for name in rest}
        over = {name: Fraction(3 * totals[name]) for name in rest if share[name] > 3 * totals[name]}
        if not over:
            return {name: float(x) for name, x in {**fixed, **share}.items()}
        fixed |= over


def check_mix(found, docs):
    totals, sizes = collections.Counter(), collections.defaultdict(list)
    for doc_id, text, source in docs:
        totals[source] += words(text)
        sizes[doc_id].append((words(text), source))
    targets = brute_targets(totals)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in found) == sorted(
        (d is None, d or 0, size) for d, rows in sizes.items() for size, _ in rows
    )
    taken = collections.Counter()
    for row in found:
        fits = [s for size, s in sizes[row.doc_id] if size == row.size and totals[s] == row.source_size]
        assert any(math.isclose(row.target, targets[s], rel_tol=1e-12, abs_tol=1e-9) for s in fits)
        assert row.taken == row.size * row.copies and 0 <= row.copies <= 3
        if len(set(fits)) == 1:
            taken[fits[0]] += row.taken
    return totals, targets, taken


def test_mix_of_the_given_documents_is_near_its_targets(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    docs = [(r.doc_id, r.text, r.source) for r in documents.select("doc_id", "text", "source").collect()]
    found = mixing.mixed(documents).collect()
    totals, targets, taken = check_mix(found, docs)
    for source in totals:
        assert abs(taken[source] - targets[source]) <= max(40, 0.005 * targets[source])
    assert sorted(map(tuple, mixing.mixed(documents.repartition(5)).collect())) == sorted(map(tuple, found))


def test_tilts_solve_the_dual(spark, sf_dir):
    """The rates before rounding reach each target, and equal sizes of a source have equal rates."""
    found = mixing.mixed(table(spark, sf_dir, "documents")).collect()
    by_target = collections.defaultdict(list)
    for row in found:
        by_target[row.source_size].append(row)
    for rows in by_target.values():
        assert math.isclose(sum(r.size * r.rate for r in rows), rows[0].target, rel_tol=1e-7)
        tilt = {round(math.log(r.rate) / r.size, 9) for r in rows if r.size and r.rate < 3}
        assert len(tilt) <= 1


def test_mix_of_rows_with_defects(spark):
    rows = [(k, "w " * (k % 7), "a") for k in range(300)] + [(5, "w " * 5, "a")] * 50
    rows += [(None, "x y z", None), (None, None, "b"), (7, "", "b"), (8, "one two", "\U0001f600"), (9, "é ß", "￿")]
    rows += [(1000 + k, "w " * 400, "c") for k in range(30)]
    schema = "doc_id long, text string, source string, size string, target string, rows int, copies int"
    documents = spark.createDataFrame([(*row, "s", "t", 1, 2) for row in rows], schema)
    found = mixing.mixed(documents).collect()
    totals, targets, taken = check_mix(found, rows)
    assert abs(taken["c"] - targets["c"]) <= 200 and abs(taken["a"] - targets["a"]) <= 6
    assert [r.target for r in found if r.source_size == 0] == [0.0, 0.0]
    assert mixing.mixed(documents.limit(0)).collect() == []
    nothing = mixing.mixed(documents.filter("source = 'b'")).collect()
    assert [(r.size, r.taken, r.target) for r in nothing] == [(0, 0, 0.0)] * 2


def test_buckets_give_a_group_its_copies_exactly(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 10)
    rows = [(k, "w w w", "a") for k in range(500)] + [(k, "v " * 5, "b") for k in range(1000, 1200)]
    found = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    _, targets, taken = check_mix(found, rows)
    assert abs(taken["a"] - targets["a"]) <= 1.5 and abs(taken["b"] - targets["b"]) <= 2.5


def test_numbers_follow_the_order(spark):
    rows = spark.range(0, 1000, numPartitions=7).selectExpr("id", "id % 13 AS k")
    found = numbered(rows, [F.col("k"), F.col("id")], "at").orderBy("at").collect()
    assert [r.at for r in found] == list(range(1000))
    assert [(r.k, r.id) for r in found] == sorted((r.k, r.id) for r in found)


# --- trie -------------------------------------------------------------------------------------


def brute_trie(rows):
    spoken = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            said = (role or "", text or "")
            key = hashlib.md5(f"{len(said[0])}:{said[0]}{said[1]}".encode()).digest()
            spoken[conv].append(((turn is not None, turn or 0, key), said))
    spoken = {conv: [said for _, said in sorted(turns)] for conv, turns in spoken.items()}
    whole = {}
    for conv, turns in spoken.items():
        h = zlib.crc32(str(conv).encode()) % 4
        whole[conv] = tuple(spoken.get(conv - int(math.fmod(conv, 20)), [])[:h] + turns[h:])
    members = collections.defaultdict(list)
    for conv in sorted(whole):
        for d in range(len(whole[conv]) + 1):
            members[whole[conv][:d]].append(conv)
    children = collections.Counter(node[:-1] for node in members if node)
    leaves, saved = collections.Counter(), collections.Counter()
    for node, convs in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(convs) - 1) * (words(node[-1][1]) if node else 0)
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in convs if len(whole[c]) == len(node))
        parent = members[node[:-1]][0] if node else None
        sha = hashlib.sha256(ends.encode()).hexdigest()
        out.append((convs[0], len(node), parent, len(convs), children[node], leaves[node], saved[node], sha))
    return sorted(map(repr, out))


def found_trie(frame, **options):
    return sorted(repr(tuple(row)) for row in prefix_trie.trie(frame, **options).collect())


@pytest.fixture(scope="module")
def defective_turns():
    rng = random.Random(3)
    texts = ["", None, "hi there", "é ß 日本", "one\ttwo\x0bthree", "x " * 5]
    rows = []
    for conv in range(-45, 130):
        for turn in range(rng.randrange(0, 9)):
            rows.append((conv, turn if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(texts)))
    rows += [(40, k, "user", f"long {k // 3}") for k in range(40)] + [(41, k, "user", f"long {k // 3}") for k in range(55)]
    rows += [(60, 3, "user", "again")] * 30 + [(None, 1, "user", "nobody")] * 3
    # One conversation many times, and one that is the start of others.
    rows += [(conv, k, "user", "same") for conv in range(200, 300) for k in range(4 + (conv % 50 == 0))]
    return rows


TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize(("width", "shard_rows"), [(64, 20_000), (5, 9), (1, 3)])
def test_trie_equals_brute_force(spark, defective_turns, width, shard_rows):
    frame = spark.createDataFrame([(*row, "k", 1) for row in defective_turns], TURNS + ", id string, n int")
    assert found_trie(frame, width=width, shard_rows=shard_rows) == brute_trie(defective_turns)


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    assert found_trie(spark.createDataFrame([], TURNS)) == []
    assert found_trie(spark.createDataFrame([(None, 1, "user", "x")], TURNS)) == []
    turnless = [(conv, 0, "user", "x") for conv in range(1, 20)]
    assert found_trie(spark.createDataFrame(turnless, TURNS)) == brute_trie(turnless)


# --- whitening --------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, y string, n int"


def check_whitened(spark, found, kept, rank):
    """Against numpy on the same whole numbers."""
    x = np.floor(np.array([v for _, v in kept], np.float32).astype(float) * 64).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    variance = np.cov((fit - 1_000_000).astype(float).T, bias=True).reshape(x.shape[1], x.shape[1])
    values, vectors = np.linalg.eigh(variance)
    values, vectors = values[::-1][:rank], vectors[:, ::-1][:, :rank]
    assert len(found) == len(kept) * rank
    by_row = collections.defaultdict(list)
    for row in found:
        assert row.n == n and 0 <= row.identity_error <= 1e-9
        assert math.isclose(row.explained, values[row.component - 1] / variance.trace(), rel_tol=1e-9)
        by_row[row.vec_id].append(row)
    space = np.zeros((len(kept), rank))
    for k, (vec_id, _) in enumerate(kept):
        rows = sorted(by_row[vec_id], key=lambda row: row.component)[:rank]
        assert {r.deviation for r in rows} == {int(((n * x[k] - s) ** 2).sum())}
        space[k] = [r.whitened for r in rows]
    expected = (x - s / n) @ vectors / np.sqrt(values)
    return space, expected


def test_whitening_equals_numpy_on_the_given_vectors(spark, sf_dir):
    embeddings = table(spark, sf_dir, "embeddings")
    kept = [(r.vec_id, r.embedding) for r in embeddings.collect()]
    space, expected = check_whitened(spark, whitening.whitened(embeddings).collect(), kept, 16)
    assert np.abs(np.abs(space) - np.abs(expected)).max() < 1e-8


def test_whitening_of_rows_with_defects(spark):
    rng = np.random.default_rng(5)
    good = [(k, [float(v) for v in rng.normal(size=4).astype(np.float32)]) for k in range(40)]
    good += [(100 + k, good[3][1]) for k in range(20)]
    bad = [(200, None), (201, [1.0, None, 0.0, 0.0]), (202, [1.0, math.nan, 0.0, 0.0]), (203, [math.inf] * 4), (204, [1.0]), (205, []), (206, [1e30] * 4)]
    rows = [(vec_id, vector, 0, "y", 1) for vec_id, vector in good + bad]
    found = whitening.whitened(spark.createDataFrame(rows, VECTORS)).collect()
    space, expected = check_whitened(spark, found, good, 4)
    assert np.abs(np.abs(space) - np.abs(expected)).max() < 1e-8
    for few in ([], rows[:1], rows[3:4] + rows[40:60], rows[40:]):
        assert whitening.whitened(spark.createDataFrame(few, VECTORS)).collect() == []


def test_equal_eigenvalues_and_missing_dimensions(spark):
    """A cross in three of five dimensions: one eigenvalue three times, and 0 twice."""
    points = [[s * (k == i) for i in range(3)] + [0.5, 0.5] for k in range(3) for s in (1.0, -1.0)]
    rows = [(k, p, 0, "y", 1) for k, p in enumerate(points)]
    found = whitening.whitened(spark.createDataFrame(rows, VECTORS)).collect()
    space, expected = check_whitened(spark, found, list(enumerate(points)), 3)
    assert np.allclose(space @ space.T, expected @ expected.T, atol=1e-12)


def test_polynomial_roots_and_products_are_exact(spark):
    rng = np.random.default_rng(1)
    half = rng.integers(-50, 50, (6, 6))
    matrix = (half @ half.T).tolist()
    polynomial = whitening.characteristic_polynomial(spark, matrix)
    assert np.allclose([float(c) for c in polynomial[::-1]], np.poly(np.array(matrix, float)), rtol=1e-6)
    assert polynomial[0] == round(np.linalg.det(half)) ** 2 and polynomial[-1] == 1
    # (t - 2)^3 (t - 3) (t - 8): repeated and neighbouring roots, one on a power of two.
    spread = [1]
    for root in (2, 2, 2, 3, 8):
        spread = [a - root * b for a, b in zip([0, *spread], [*spread, 0], strict=True)]
    assert [whitening.roots_above(spread, a) for a in (0, 1, 2, 3, 7, 8)] == [5, 5, 2, 1, 1, 0]
    roots, bits = whitening.largest_roots(spread, 17, 5)
    assert [root / 2**bits for root in roots] == pytest.approx([8, 3, 2, 2, 2], abs=1e-30)
    y = rng.integers(-(1 << 40), 1 << 40, (50, 3))
    assert (whitening._products(y) == y.astype(object).T @ y.astype(object)).all()
