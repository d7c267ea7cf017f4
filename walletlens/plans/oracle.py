"""Shared parts of the oracle SQL: the adapters and the profile, written for DuckDB."""

from __future__ import annotations

EVENT_TYPE = """CASE WHEN event_type IN ('purchase','click') THEN 'SPEND'
    WHEN event_type IN ('signup','view') THEN 'CASH-IN' ELSE 'OTHER' END"""
EVENT_METHOD = """CASE event_id % 4 WHEN 0 THEN 'SEND MONEY' WHEN 1 THEN 'QR'
    WHEN 2 THEN 'MAYA SHOP' ELSE 'BANK TRANSFER' END"""

EVENTS = f"""t AS (
  SELECT CAST(user_id AS VARCHAR) AS user_id, ts AS timestamp,
    {EVENT_TYPE} AS transaction_type, {EVENT_METHOD} AS transaction_method, value AS amount,
    CASE (user_id + CASE WHEN day(ts) > 15 THEN 1 ELSE 0 END) % 4
      WHEN 0 THEN 'PROFESSIONAL_HUSTLERS, PRUDENT_PLANNERS' WHEN 1 THEN 'LUSH_DRINKERS'
      WHEN 2 THEN '' ELSE 'LOAN_AND_GAMING' END AS segment_tag,
    CAST(year(ts) AS INT) AS year, CAST(month(ts) AS INT) AS month
  FROM events)"""

ORDERS = """t AS (
  SELECT CAST(o_custkey AS VARCHAR) AS user_id, o_orderdate AS timestamp,
    CASE o_orderstatus WHEN 'F' THEN 'SPEND' WHEN 'O' THEN 'CASH-IN' ELSE 'OTHER' END
      AS transaction_type,
    upper(substr(o_orderpriority, 3)) AS transaction_method, o_totalprice AS amount,
    coalesce(c_mktsegment, '') AS segment_tag,
    CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey)"""

RAW = f"""raw AS (
  SELECT CASE WHEN event_id % 97 <> 0 THEN CAST(user_id AS VARCHAR) END AS user_id,
    CASE WHEN event_id % 89 <> 0 THEN date_trunc('second', ts) END AS timestamp,
    {EVENT_TYPE} AS transaction_type,
    CASE WHEN event_id % 101 <> 0 THEN {EVENT_METHOD} END AS transaction_method,
    CASE WHEN event_id % 31 = 0 THEN 'abc' WHEN event_id % 37 = 0 THEN NULL
      WHEN event_id % 41 = 0 THEN 'nan' WHEN event_id % 43 = 0 THEN 'inf'
      WHEN event_id % 47 = 0 THEN '-Infinity' WHEN event_id % 53 = 0 THEN '-12.3456'
      ELSE CAST(value AS VARCHAR) END AS amount_text,
    concat_ws(', ', CASE WHEN user_id % 3 = 0 THEN 'PRUDENT_PLANNERS' END,
      CASE WHEN user_id % 5 < 2 THEN 'LUSH_DRINKERS' WHEN user_id % 5 = 2 THEN ' ' END,
      CASE WHEN user_id % 2 = 0 THEN 'LOAN_AND_GAMING' END) AS segment_tag
  FROM events),
typed AS (
  SELECT *, CASE WHEN amount_text IS NULL OR amount_text IN ('abc', 'nan') THEN 0.0
      ELSE CAST(amount_text AS DOUBLE) END AS amount,
    CASE WHEN user_id IS NULL THEN 'missing user_id'
      WHEN timestamp IS NULL THEN 'missing or unparsable timestamp'
      WHEN transaction_method IS NULL THEN 'missing transaction_method'
      WHEN amount_text IN ('inf', '-Infinity') THEN 'infinite amount' END AS reason
  FROM raw)"""


#: CRC-32 of the ASCII text ``c`` before its last step, bit by bit.
CRC32 = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(c) + 1), lambda k: ascii(c[k])::BIGINT)),
  lambda s, byte: list_reduce(list_prepend(xor(s, byte), range(8)),
    lambda r, step: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384::BIGINT) ELSE r // 2 END))"""


def total(kind: str) -> str:
    return (
        f"coalesce(CAST(sum(CASE WHEN transaction_type = '{kind}' "
        f"THEN CAST(amount AS DECIMAL(18,2)) END) AS DOUBLE), 0.0)"
    )


def count(kind: str) -> str:
    return f"count(CASE WHEN transaction_type = '{kind}' THEN 1 END)"


STATS = f"""stats AS (
  SELECT user_id, year, month, {total('SPEND')} AS total_spend, {count('SPEND')} AS spend_count,
    {total('CASH-IN')} AS total_cash_in, {count('CASH-IN')} AS cash_in_count,
    CAST(coalesce(sum(CASE WHEN transaction_type = 'CASH-IN' THEN CAST(amount AS DECIMAL(18,2))
      WHEN transaction_type = 'SPEND' THEN -CAST(amount AS DECIMAL(18,2)) END), 0) AS DOUBLE) AS net
  FROM t GROUP BY user_id, year, month)"""

METHODS = """methods AS (
  SELECT user_id, year, month, transaction_method, transaction_type, count(*) AS n,
    CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS amt
  FROM t GROUP BY user_id, year, month, transaction_method, transaction_type)"""

SEGMENTS = """segments AS (
  SELECT user_id, year, month, string_agg(segment_tag, '|' ORDER BY segment_tag) AS tags,
    string_agg(replace(lower(segment_tag), '_', ' '), ', ' ORDER BY segment_tag) AS shown
  FROM (SELECT DISTINCT user_id, year, month, segment_tag FROM t
        WHERE segment_tag IS NOT NULL AND segment_tag <> '') d
  GROUP BY user_id, year, month)"""


def _method_text(kind: str, total_name: str) -> str:
    return (
        f"string_agg(CASE WHEN transaction_type = '{kind}' AND {total_name} > 0 THEN "
        f"lower(transaction_method) || ' with ' || printf('%.2f', amt / {total_name} * 100) || '%' "
        f"END, ', ' ORDER BY transaction_method)"
    )


PROFILE = f"""{STATS}, {METHODS}, {SEGMENTS},
shares AS (
  SELECT user_id, year, month, {_method_text('SPEND', 'total_spend')} AS spend_text,
    {_method_text('CASH-IN', 'total_cash_in')} AS cash_in_text
  FROM methods JOIN stats USING (user_id, year, month) GROUP BY user_id, year, month),
profiles AS (
  SELECT user_id, year, month, spend_count > 0 OR cash_in_count > 0 AS has_data,
    CASE WHEN spend_count > 0 OR cash_in_count > 0 THEN
      'User ' || user_id || ' monthly transactions Summary (Timestamp: ' ||
      printf('%d-%02d', year, month) || ')' || chr(10) ||
      '- Total spend is ' || printf('%.2f', total_spend) || ' with ' || spend_count ||
      ' transactions' || chr(10) ||
      coalesce('- Spending methods include ' || spend_text,
        '- No spending methods recorded or zero total spend.') || chr(10) ||
      '- Total cash-in is ' || printf('%.2f', total_cash_in) || ' with ' || cash_in_count ||
      ' transactions' || chr(10) ||
      coalesce('- Cash-in methods include ' || cash_in_text,
        '- No cash-in methods recorded or zero total cash-in.') || chr(10) ||
      '- User tags: ' || coalesce(shown, 'Not available')
    ELSE 'User ' || user_id || ' (' || printf('%d-%02d', year, month) || ')' || chr(10) ||
      'No transaction data found for this period.' END AS profile_text
  FROM stats JOIN shares USING (user_id, year, month)
    LEFT JOIN segments USING (user_id, year, month))"""

CANDIDATES = """templates AS (
  SELECT vec_id AS approach_rank, CAST(embedding AS DOUBLE[]) AS template
  FROM embeddings WHERE vec_id < 3),
candidates AS (
  SELECT CAST(vec_id // 3 // 2 AS VARCHAR) AS user_id, 2024 AS year, 1 AS month,
    CASE vec_id // 3 % 2 WHEN 0 THEN 'executive_summary' ELSE 'recommendations' END AS component,
    CASE vec_id % 3 WHEN 0 THEN 'zero_shot' WHEN 1 THEN 'few_shot' ELSE 'chain_of_thought' END
      AS approach,
    CAST(vec_id % 3 AS INTEGER) AS approach_rank, d.text AS output_text,
    CASE WHEN toxic = 1 THEN 'Unsafe' ELSE 'Safe' END AS ethical_flag,
    0.5 + (vec_id % 1000) / CAST(2000 AS DOUBLE) AS confidence,
    list_inner_product(template, CAST(embedding AS DOUBLE[])) AS similarity
  FROM embeddings JOIN templates ON vec_id % 3 = approach_rank
    LEFT JOIN labels l ON l.doc_id = vec_id LEFT JOIN documents d ON d.doc_id = vec_id
  WHERE vec_id >= 3),
scored AS (
  SELECT *, CASE WHEN ethical_flag = 'Safe' THEN similarity ELSE -1.0 END AS score FROM candidates),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, year, month, component
    ORDER BY score DESC, approach_rank) AS place FROM scored) r WHERE place = 1)"""

REPORT_ROWS = """SELECT user_id, CAST(year AS BIGINT) AS year, 'January' AS month, component,
  output_text, ethical_flag, CAST(printf('%.2f', confidence) AS DOUBLE) AS confidence,
  CAST(printf('%.2f', similarity) AS DOUBLE) AS similarity_score, approach FROM best"""


def values(rows: list[tuple]) -> str:
    """Rows as the body of a VALUES list."""

    def literal(value) -> str:
        return str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(literal(value) for value in row) + ")" for row in rows)
