"""Rows that once ended a job or were dealt with in part: clashing names, odd JSON, very many matches."""

from __future__ import annotations

import collections
import hashlib
import json
import math
import random
import re
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from walletlens.llm import fingerprints, html_text, jaccard_join, line_dedup, quality, secret_scan, tool_calls, words
from walletlens.llm.columns import unused
from walletlens.sources.tables import table

CLASHING = "host site cut lines kept drop dropped host_key path_key evidence site_rate quality gone key times __text __host __evidence _host"


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(k, f"word{k % 40} some words of page {k}\nshared line of all pages", "en", "a", 10) for k in range(60)]
    rows += [(None, "no id", None, None, None), (70, None, "en", "a", None), (71, "", "de", "b", 0)] + rows[:2] + rows[:1]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return frame.select("*", *[F.lit(name).alias(name) for name in CLASHING.split()])


def test_unused_names_differ_in_any_case():
    assert unused(["HOST", "_host", "b"], "host", "b", "c") == ["__host", "_b", "c"]


def test_columns_of_any_name_pass_through(spark, clashing):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    for kept in (
        quality.drop_rejected(clashing, labels.limit(0)),
        line_dedup.drop_boilerplate(clashing),
        jaccard_join.one_of_each(clashing),
    ):
        assert kept.columns == clashing.columns
        rows = kept.collect()
        assert rows and all(row[name] == name for row in rows for name in CLASHING.split())
    assert quality.judged(clashing, labels).count() == clashing.count()
    texts = [row.text for row in line_dedup.drop_boilerplate(clashing).filter("source = 'a'").collect() if row.text]
    assert texts and not any("shared line" in text for text in texts)


def test_one_row_stays_of_rows_with_the_same_id_and_text(spark, clashing):
    kept = jaccard_join.one_of_each(clashing.unionByName(clashing))
    ids = [row.doc_id for row in kept.collect()]
    assert len(ids) == len(set(ids)) == 63


def test_the_pipeline_takes_defects_and_nothing(spark, clashing, tmp_path):
    """All stages one after the other, each on what the one before wrote."""
    for name, rows in (("documents", clashing), ("labels", None), ("benchmark", None)):
        if rows is None:
            kind = "doc_id long, quality int, toxic int" if name == "labels" else "item_id long, text string"
            rows = spark.createDataFrame([], kind)
        rows.write.parquet(str(tmp_path / f"{name}.parquet"))
        rows.limit(0).write.parquet(str(tmp_path / "none" / f"{name}.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {row.doc_id for row in found} <= {*range(60), None, 70, 71} and len(found) > 2
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).collect() == []


# --- tool calls -------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("arguments", "problem"),
    [
        ('{"x":1e400}', "malformed"),
        ('{"x":-1E999}', "malformed"),
        ('{"x":"\\ud800"}', "malformed"),
        ('{"\\udfff":1}', "malformed"),
        ('{"x":' + "9" * 5000 + "}", "malformed"),
        ("[" * 100_000, "malformed"),
        ('{"x":1,"x":2}', "repeated key"),
        ('{"x":{"y":1,"y":1}}', "repeated key"),
        ('{"x":NaN}', "malformed"),
        ('{"x":"\\ud83d\\ude00"}', "x is no number"),
        ('{"x":1e308}', None),
    ],
)
def test_odd_arguments_get_a_problem(arguments, problem):
    value, found = tool_calls._parsed(arguments)
    found = found or tool_calls.problem_of(value, {"x": ("number", True)})
    assert found == problem


def test_odd_arguments_do_not_end_the_job(spark):
    texts = ['{"x":1e400}', '{"x":"\\ud800"}', '{"x":1,"x":2}', '{"x":1.5}', "x" * 1_000_000, None]
    calls = [(1, str(k), k, "f", text, None, "extra") for k, text in enumerate(texts)]
    frame = spark.createDataFrame(calls, "conversation long, call_id string, turn long, name string, arguments string, after string, problem string")
    results = spark.createDataFrame([(1, "3", 9, "done", 1)], "conversation long, call_id string, turn long, content string, json int")
    rows = {row.call_id: row for row in tool_calls.linked(frame, results, {"f": {"x": ("number", True)}}).collect()}
    problems = [rows[str(k)].problem for k in range(len(texts))]
    assert problems == ["malformed", "malformed", "repeated key", None, "malformed", "no arguments"]
    assert json.loads(rows["3"].json)["arguments"] == {"x": 1.5} and rows["3"].status == "linked"


# --- secrets ----------------------------------------------------------------------------------


def brute_findings(text):
    found = []
    for rank, (kind, pattern, fewest, group) in enumerate(secret_scan.RULES):
        for match in re.finditer(pattern, text):
            if len(match[group]) >= fewest:
                found.append((match.start(), rank, kind, match.end()))
    return ",".join(f"{kind}:{start}:{stop}" for start, _, kind, stop in sorted(found))


PARTS = [
    "-----BEGIN PRIVATE KEY-----", "-----BEGIN RSA PRIVATE KEY-----", "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeK", "eyJshort.x.y",
    "ghp_" + "a1B2" * 9, "gho_" + "x" * 35, "https://user:pass1@host", "ftp://u:p@h", "postgres://é:secret9@db", "é 日本",
    'password: "hunter2hunter"', "AKIA" + "Q" * 16, "0123456789abcdef" * 2, "token=abc", "\n", " ", "😀",
]


def test_spans_of_all_rules_equal_brute_force(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(PARTS) + rng.choice(["", " "]) for _ in range(rng.randrange(0, 40))) for _ in range(200)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in secret_scan.document_secrets(frame).collect():
        assert row.spans == brute_findings(texts[row.doc_id])
    kinds = {span.split(":")[0] for text in texts for span in brute_findings(text).split(",") if span}
    assert kinds == {rule[0] for rule in secret_scan.RULES}


def test_very_many_matches_in_one_text(spark):
    digests = [hashlib.md5(str(k).encode()).hexdigest() for k in range(100_000)]
    text = " ".join(digests)
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    start = time.perf_counter()
    row = secret_scan.document_secrets(frame).head()
    assert time.perf_counter() - start < 60
    assert row.n_hex == len(digests)
    assert row.spans == ",".join(f"hex:{33 * k}:{33 * k + 32}" for k in range(len(digests)))


# --- fingerprints -----------------------------------------------------------------------------


def pair_counts(text):
    counts = collections.Counter()
    for line in text.split("\n"):
        words = re.split(r"[ \t\r\f\x0b]+", line.strip(" \t\r\f\x0b")) if line.strip(" \t\r\f\x0b") else []
        counts.update(zip(words, words[1:], strict=False) if len(words) > 1 else words)
    return counts


def cosine(left, right):
    size = math.sqrt(sum(n * n for n in left.values()) * sum(n * n for n in right.values()))
    return sum(n * right[pair] for pair, n in left.items()) / size if size else 0.0


def test_likeness_estimates_the_likeness_of_word_pairs(spark, sf_dir):
    """Of every given document and its edited text, and of documents one after the other."""
    documents = table(spark, sf_dir, "documents")
    given = {row.doc_id: row.text or "" for row in documents.collect()}
    order = sorted(given)
    errors = []
    for row in fingerprints.edited_fingerprints(documents).collect():
        text, after = given[row.doc_id], given[order[(order.index(row.doc_id) + 1) % len(order)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        errors.append(abs(row.near_edited - cosine(pair_counts(text), pair_counts(edited))))
        errors.append(abs(row.near_next - cosine(pair_counts(text), pair_counts(after))))
    assert sum(errors) / len(errors) < 0.07 and sorted(errors)[int(0.99 * len(errors))] < 0.25


def test_one_word_more_or_other_leaves_a_sentence_alike(spark):
    rng = random.Random(6)
    rows = []
    for _ in range(200):
        words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(60)]
        other = list(words)
        other[rng.randrange(60)] = "changed"
        rows.append((" ".join(words), " ".join([*words, "more"]), " ".join(other)))
    frame = spark.createDataFrame(rows, "a string, b string, c string")
    prints = frame.select(*[fingerprints.fingerprint(F.col(name)).alias(name) for name in "abc"])
    near = prints.select(*[fingerprints.likeness(F.col("a"), F.col(name)).alias(name) for name in "bc"]).collect()
    assert min(row.b for row in near) > 0.9 and sum(row.c for row in near) / 200 > 0.93 and min(row.c for row in near) > 0.85


def test_the_next_document_of_scattered_ids(spark):
    rng = random.Random(7)
    ids = [rng.randrange(-(2**62), 2**62) for _ in range(300)]
    frame = spark.createDataFrame([(k, f"text {k}") for k in ids], "doc_id long, text string").repartition(6)
    found = {row.doc_id: row.next_text for row in fingerprints.with_next(frame, "doc_id", "text").collect()}
    order = sorted(ids)
    assert found == {k: f"text {after}" for k, after in zip(order, order[1:] + order[:1], strict=True)}


def plain_votes(hashes):
    return [
        sum(sum(h >> (k + 21 * lane) & 1 for h in hashes) % (1 << 20) << 21 * lane for lane in range(3)) for k in range(21)
    ]


def test_votes_count_the_bits_of_all_hashes(spark):
    rng = random.Random(8)
    rows = [([rng.randrange(-(2**63), 2**63) for _ in range(n)],) for n in (0, 1, 6, 7, 8, 13, 14, 15, 500)]
    rows += [([-1] * 30,), ([0] * 30,)]
    for row in spark.createDataFrame(rows, "h array<long>").select("h", fingerprints._votes(F.col("h")).alias("v")).collect():
        assert row.v == plain_votes(row.h)


def test_votes_take_less_than_a_step_for_each_hash_and_long(spark):
    hashes = F.transform(F.sequence(F.lit(1), F.lit(700)), lambda x: F.xxhash64(x, "id"))
    frame = spark.range(0, 2000, numPartitions=8).select(hashes.alias("h")).cache()
    frame.count()

    def one_by_one(found):
        return F.transform(
            F.sequence(F.lit(0), F.lit(20)),
            lambda k: F.aggregate(
                found,
                F.lit(0).cast("long"),
                lambda total, h: (total + F.call_function("shiftrightunsigned", h, k).bitwiseAND(F.lit(1 << 42 | 1 << 21 | 1))),
            ),
        )

    def seconds(column):
        began = time.perf_counter()
        frame.select(column.alias("v")).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    plain = min(seconds(one_by_one(F.col("h"))) for _ in range(3))
    assert min(seconds(fingerprints._votes(F.col("h"))) for _ in range(3)) < 0.7 * plain


# --- joins ------------------------------------------------------------------------------------


def test_only_shingles_shared_by_sets_of_near_sizes_are_joined(spark):
    rng = random.Random(9)
    rows = [(s, f"{s}-{k}".encode(), n, rng.randrange(n)) for s in range(300) for k in range(s % 5 + 2) for n in [rng.randrange(5, 60)]]
    rows += [(999, b"a", 10, 0), (999, b"b", 100, 0), (999, b"c", 105, 0), (999, b"d", 1000, 0)]
    frame = spark.createDataFrame(rows, "shingle long, digest binary, n int, pos int")
    kept = {(r.shingle, bytes(r.digest)) for r in jaccard_join._with_partners(frame, 90).collect()}
    for s, digest, n, pos in rows:
        others = [(m, at) for t, other, m, at in rows if t == s and other != digest]
        near = [(m, at) for m, at in others if 100 * min(n, m) >= 90 * max(n, m)]
        if any(190 * min(n - pos, m - at) >= 90 * (n + m) for m, at in near):
            assert (s, digest) in kept
        if not near:
            assert (s, digest) not in kept
    assert {digest for s, digest in kept if s == 999} == {b"b", b"c"}


def test_texts_are_split_in_parts_of_a_megabyte():
    batch = pa.RecordBatch.from_pylist([{"text": "word " * 200} for _ in range(5000)])
    parts = [sum(map(len, texts)) for _, texts in words.chunks(batch, 0)]
    assert sum(parts) == 5_000_000 and max(parts) <= 1_000_000


# --- pages ------------------------------------------------------------------------------------


def test_given_pages_without_their_article_tag_give_the_same_text(spark, sf_dir):
    for row in table(spark, sf_dir, "pages").collect():
        renamed = re.sub(r"<(/?)(article|main)\b", r"<\1div", row.html)
        assert html_text.main_text(renamed) == html_text.main_text(row.html)


BODY = "".join(f"<p>Paragraph {k} of the article, which says a little, and then some more about the matter.</p>" for k in range(5))
TEXT = [f"Paragraph {k} of the article, which says a little, and then some more about the matter." for k in range(5)]


@pytest.mark.parametrize("around", ["article", "main", "div"])
def test_names_of_classes_only_weigh(around):
    def lines(more):
        return html_text.main_text(f"<body><nav><a href=/>Home</a></nav><{around}>{BODY}{more}</{around}></body>").split("\n")

    assert lines('<p class="related">A related matter is told here.</p>') == [*TEXT, "A related matter is told here."]
    more = '<div class="discussion"><h2>Discussion</h2><p>The matter is discussed.</p></div>'
    assert lines(more) == [*TEXT, "Discussion", "The matter is discussed."]
    assert lines('<p class="byline">By Jane Doe</p>') == [*TEXT, "By Jane Doe"]
    assert lines('<ul class="related"><li><a href=/1>Another story</a></li><li><a href=/2>And another</a></li></ul>') == TEXT
    comments = "".join(f"<p>Reader {k}, who writes, a lot, of words, here, says this, and that, and more.</p>" for k in range(40))
    assert lines(f'<div class="comments">{comments}</div>') == TEXT
    assert lines('<div class="ad">Buy this now, it is cheap.</div><div class="cookie-notice">We use cookies.</div>') == TEXT


def test_sections_beside_the_best_container_stay():
    page = f"<body><div><div>{BODY}</div><div><h2>B</h2><p>Short words</p></div><div>Share this</div></div></body>"
    assert html_text.main_text(page).split("\n") == [*TEXT, "B", "Short words"]


def test_pages_with_defects(spark):
    rows = [(1, "u", f"<article>{BODY}</article>", "x", 1), (1, "u", f"<article>{BODY}</article>", "x", 1), (None, None, None, "x", 1), (2, None, "", "x", 1)]
    rows += [(3, "u", "<p>" + "long text, " * 200_000, "x", 1), (4, "u", "<div class='comments'><p>Only readers.</p></div>", "x", 1)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    found = html_text.page_texts(frame).collect()
    assert [(r.page_id, r.url) for r in found] == [row[:2] for row in rows]
    assert [r.n_chars for r in found] == [len(r.text) for r in found]
    assert found[0].text == found[1].text == "\n".join(TEXT) and found[2].text == found[3].text == ""
    assert found[4].n_chars == 11 * 200_000 - 1 and found[5].text == ""
    assert html_text.page_texts(frame.limit(0)).collect() == []
