"""The registered queries of this package and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from walletlens.llm import (
    decontaminate,
    fingerprints,
    html_text,
    jaccard_join,
    language,
    line_dedup,
    mixing,
    packing,
    prefix_trie,
    quality,
    secret_scan,
    tool_calls,
    whitening,
)
from walletlens.sources.tables import table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(table(spark, sf_dir, "documents"))


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP2_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce({_LOWER}, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM words
), sizes AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM sets),
flat AS (SELECT doc_id, unnest(s) AS g FROM sets),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM flat x JOIN flat y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * c >= 90 * (p.n + q.n - c)
), reach AS (
  SELECT a AS doc_id, b AS other FROM links
  UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a
)
SELECT s.doc_id, s.n AS n_shingles, least(s.doc_id, min(r.other)) AS component_id
FROM sizes s LEFT JOIN reach r ON r.doc_id = s.doc_id GROUP BY s.doc_id, s.n
"""


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.page_texts(table(spark, sf_dir, "pages"))


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.document_secrets(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tool_calls.conversation_calls(table(spark, sf_dir, "conversations"))
    return tool_calls.linked(calls, results, tool_calls.CONVERSATION_SCHEMAS)


OP8_SQL = """
WITH RECURSIVE asked AS (
  SELECT conv_id, turn, concat(conv_id, '-', turn) AS call_id, CASE role WHEN 'user' THEN 'ask' ELSE 'instruct' END AS name,
    text FROM conversations WHERE role IN ('user', 'system')
), calls AS (
  SELECT conv_id, call_id, turn, min(struct_pack(n := name, t := text)) AS first, count(*) AS n_calls
  FROM asked GROUP BY 1, 2, 3
), results AS (
  SELECT conv_id, concat(conv_id, '-', turn - 1) AS call_id, min(turn) AS turn, min(text) AS content, count(*) AS n_results
  FROM conversations WHERE role = 'assistant' GROUP BY 1, 2
), deep AS (
  SELECT conv_id, turn, CAST(0 AS BIGINT) AS depth FROM calls c
  WHERE NOT EXISTS (SELECT 1 FROM calls p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 2)
  UNION ALL SELECT c.conv_id, c.turn, d.depth + 1 FROM deep d JOIN calls c ON c.conv_id = d.conv_id AND c.turn = d.turn + 2
)
SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, c.turn AS call_turn,
  r.turn AS result_turn, coalesce(n_calls, 0) AS n_calls, coalesce(n_results, 0) AS n_results, depth,
  CASE WHEN c.call_id IS NULL THEN 'orphan_result' WHEN r.call_id IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
  c.call_id IS NOT NULL AND c.first.t IS NOT NULL AS valid,
  CASE WHEN c.call_id IS NOT NULL AND c.first.t IS NULL THEN 'missing text' END AS problem,
  concat('{"arguments":', CASE WHEN c.first.t IS NOT NULL THEN concat('{"text":', to_json(c.first.t), ',"turn":', c.turn, '}')
    ELSE 'null' END, ',"call_id":"', coalesce(c.call_id, r.call_id), '","depth":', coalesce(CAST(depth AS VARCHAR), 'null'),
    ',"name":', coalesce('"' || c.first.n || '"', 'null'), ',"result":', coalesce(to_json(content), 'null'), '}') AS json
FROM calls c LEFT JOIN deep d ON d.conv_id = c.conv_id AND d.turn = c.turn
FULL JOIN results r ON r.conv_id = c.conv_id AND r.call_id = c.call_id
"""


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predicted(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dropped_lines(table(spark, sf_dir, "documents"))


_TRIMMED = "trim({}, ' ' || chr(9) || chr(13) || chr(12) || chr(11))"
OP10_SQL = f"""
WITH pages AS (
  SELECT doc_id, coalesce('+' || source, '-') AS host, text, string_split(text, chr(10)) AS lines FROM documents
), different AS (SELECT host, text, any_value(lines) AS lines FROM pages WHERE text IS NOT NULL GROUP BY 1, 2),
totals AS (SELECT host, count(*) AS host_pages FROM different GROUP BY 1),
counted AS (
  SELECT host, line, count(*) AS n FROM (
    SELECT host, unnest(list_distinct(list_transform(lines, lambda x: {_TRIMMED.format('x')}))) AS line FROM different)
  WHERE line <> '' GROUP BY 1, 2
), sites AS (
  SELECT host, list(line) AS gone FROM counted JOIN totals USING (host)
  WHERE n >= 5 AND n > CAST(0.1 AS DOUBLE) * host_pages GROUP BY 1
), cut AS (
  SELECT doc_id, text, lines,
    list_filter(lines, lambda x: gone IS NULL OR NOT list_contains(gone, {_TRIMMED.format('x')})) AS kept
  FROM pages LEFT JOIN sites USING (host)
)
SELECT doc_id, coalesce(len(lines), 0) AS n_lines, coalesce(len(lines) - len(kept), 0) AS n_dropped,
  CASE WHEN text IS NOT NULL THEN array_to_string(kept, chr(10)) END AS text
FROM cut
"""


def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


_CRC32 = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(c) + 1), lambda k: ascii(c[k])::BIGINT)),
  lambda s, byte: list_reduce(list_prepend(xor(s, byte), range(8)),
    lambda r, step: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384::BIGINT) ELSE r // 2 END))"""
_DIGEST = "md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))"
_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"
OP12_SQL = f"""
WITH own AS (
  SELECT conv_id, list({{'id': {_DIGEST}, 'w': {_WORDS}}} ORDER BY turn NULLS FIRST, {_DIGEST}) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), headed AS (
  SELECT conv_id, turns, CAST(xor({_CRC32}, 4294967295::BIGINT) % 4 AS BIGINT) AS h
  FROM (SELECT *, CAST(conv_id AS VARCHAR) AS c FROM own)
), rebuilt AS (
  SELECT x.conv_id, list_concat(coalesce(b.turns[1:x.h], []), x.turns[x.h + 1:]) AS turns
  FROM headed x LEFT JOIN own b ON b.conv_id = x.conv_id - x.conv_id % 20
), paths AS (
  SELECT conv_id, d, len(turns) AS length, turns[d].w AS w, array_to_string(list_transform(turns[1:d], lambda t: t.id), '') AS node,
    array_to_string(list_transform(turns[1:d - 1], lambda t: t.id), '') AS parent
  FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT d, node, min(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, max(coalesce(w, 0)) AS w,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (length = d), '')) AS ends_sha256
  FROM paths GROUP BY d, node
), figures AS (
  SELECT n.*, p.conv_id AS parent_conv_id,
    (SELECT count(*) FROM nodes c WHERE c.d = n.d + 1 AND c.parent = n.node) AS n_children
  FROM nodes n LEFT JOIN nodes p ON n.d > 0 AND p.d = n.d - 1 AND p.node = n.parent
), above AS (
  SELECT DISTINCT a.d AS d, a.node AS node, b.d AS below_d, b.node AS below
  FROM paths a JOIN paths b ON a.conv_id = b.conv_id AND b.d >= a.d
), subtree AS (
  SELECT a.d, a.node, sum((f.n_children = 0)::INT) AS n_leaves, sum((f.n_convs - 1) * f.w) AS saved_tokens
  FROM above a JOIN figures f ON f.d = a.below_d AND f.node = a.below GROUP BY a.d, a.node
)
SELECT f.conv_id, f.d AS depth, f.parent_conv_id, f.n_convs, f.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
  CAST(s.saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM figures f JOIN subtree s ON s.d = f.d AND s.node = f.node
"""


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


ALL = {
    "op1_quality_classifier": (op1_quality_classifier, None),
    "op2_ngram_jaccard_join": (op2_ngram_jaccard_join, OP2_SQL),
    "op3_benchmark_decontamination": (op3_benchmark_decontamination, None),
    "op4_html_extraction": (op4_html_extraction, None),
    "op5_document_fingerprints": (op5_document_fingerprints, None),
    "op6_secret_scan": (op6_secret_scan, None),
    "op7_packing": (op7_packing, None),
    "op8_chat_formatting": (op8_chat_formatting, OP8_SQL),
    "op9_language_id": (op9_language_id, None),
    "op10_line_dedup": (op10_line_dedup, OP10_SQL),
    "op11_source_mixing": (op11_source_mixing, None),
    "op12_conversation_trie": (op12_conversation_trie, OP12_SQL),
    "op13_embedding_whitening": (op13_embedding_whitening, None),
}


def queries():
    return {name: query for name, (query, _) in ALL.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in ALL.items() if sql is not None}
