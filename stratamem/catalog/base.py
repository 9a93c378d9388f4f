"""SQL fragments shared by the counterparts: the model tables of ``sources.tables``."""

from __future__ import annotations

from stratamem import constants as K
from stratamem.sources.tables import AS_OF, IDS_PER_DOC, TURNS_PER_CONVERSATION

WS = K.WHITESPACE
WS_CLASS = K.WS_CLASS
STOPS = ", ".join(f"'{w}'" for w in K.STOP_WORDS)
NOW = f"TIMESTAMP '{AS_OF}'"


def strip(x: str) -> str:
    return f"trim({x}, '{WS}')"


def tokens(x: str) -> str:
    return (f"list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), "
            f"lambda w: length(w) > 1 AND w NOT IN ({STOPS}))")


def word_set(x: str) -> str:
    return (f"list_distinct(list_filter(regexp_split_to_array(lower({x}), '{WS_CLASS}+'), "
            f"lambda w: w <> ''))")


def round4(x: str) -> str:
    return f"floor(({x}) * 1e4 + 0.5e0) / 1e4"


def rank_key(x: str) -> str:
    return f"floor(({x}) * 1e9 + 0.5e0) / 1e9"


def age_days(then: str) -> str:
    return f"((epoch_us({NOW}) - epoch_us({then})) / 8.64e10)"


def tenant(n: str) -> str:
    return f"(['en', 'fr', 'de', 'es'])[(({n}) % 4) + 1]"


def session_name(n: str) -> str:
    return f"'src' || (({n}) % 20)"


def days_before(n: str) -> str:
    return f"({NOW} - to_days(CAST({n} AS INTEGER)))"


def cosine(a: str, b: str) -> str:
    return f"list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


def project_slug(x: str) -> str:
    return (f"coalesce(nullif(trim(regexp_replace({strip(f'lower({x})')}, '[^a-z0-9]+', '_', 'g'), '_'), ''), "
            f"'default')")


def skill_slug(x: str) -> str:
    return f"trim(regexp_replace({strip(f'lower({x})')}, '[^a-z0-9]+', '-', 'g'), '-')"


def redacted(x: str) -> str:
    for pattern, ignore_case in K.INJECTION_PATTERNS:
        flag = "(?i)" if ignore_case else ""
        x = f"regexp_replace({x}, '{flag}{pattern}', '{K.REDACTED}', 'g')"
    return strip(x)


DOCS = f"""docs AS (
  SELECT d.doc_id, d.text, d.lang AS user_id, d.source AS session_id,
    CASE WHEN d.doc_id % 4 <> 3 THEN d.source END AS project,
    CASE d.doc_id % 3 WHEN 0 THEN 'L2' WHEN 1 THEN 'L3' ELSE 'L4' END AS memory_layer,
    CASE WHEN d.doc_id % 23 = 0 THEN 1e0 ELSE 0.5e0 + 0.4e0 * coalesce(l.quality, 0) END AS importance,
    d.doc_id % 17 = 0 AS is_pinned, coalesce(l.toxic, 0) = 1 AS is_deprecated,
    {days_before('(d.doc_id * 7) % 400')} AS created_at,
    CASE WHEN d.doc_id % 5 = 0 THEN {days_before('d.doc_id % 50')} END AS last_accessed_at,
    CASE WHEN coalesce(l.toxic, 0) = 1 THEN {days_before('d.doc_id % 60')} END AS deprecated_at,
    CASE WHEN d.doc_id % 29 = 0 THEN 'skill' END AS item_type,
    CASE WHEN d.doc_id % 11 = 0 THEN 'cp-' || d.doc_id END AS checkpoint_name
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""

ITEMS = DOCS + f""", cut AS (
  SELECT *, 1 + greatest(CAST(ceil((length(text) - 600) / 520e0) AS BIGINT), 0) AS chunk_total
  FROM docs WHERE length(text) > 0), items AS (
  SELECT c.doc_id * {IDS_PER_DOC} + t.i AS id, c.* EXCLUDE (text), t.i AS chunk_index,
    {strip('substr(c.text, CAST(t.i * 520 + 1 AS BIGINT), 600)')} AS content
  FROM cut c, unnest(range(c.chunk_total)) AS t(i)
  WHERE {strip('substr(c.text, CAST(t.i * 520 + 1 AS BIGINT), 600)')} <> '')"""

EMBEDDED = ITEMS + """, stored AS (
  SELECT i.*, e.embedding FROM items i
  JOIN embeddings e ON e.vec_id = (i.doc_id * 7 + i.chunk_index) % (SELECT count(*) FROM embeddings))"""

ASKED = f"""asked AS (
  SELECT b.item_id AS query_id, {tenant('b.item_id')} AS user_id,
    CASE WHEN b.item_id % 8 >= 4 THEN {session_name('b.item_id')} END AS session_id,
    CASE WHEN b.item_id % 8 >= 6 THEN {session_name('b.item_id')} END AS project,
    b.text AS query_text, e.embedding
  FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id % (SELECT count(*) FROM embeddings))"""

MESSAGES = f"""messages AS (
  SELECT -(conv_id * {TURNS_PER_CONVERSATION} + turn) - 1 AS id, {tenant('conv_id')} AS user_id,
    {session_name('conv_id')} AS session_id, conv_id * {TURNS_PER_CONVERSATION} + turn AS seq, role,
    {strip('text')} AS content, CASE WHEN role = 'system' THEN 0.9e0 ELSE 0.5e0 END AS importance,
    role = 'system' AS is_pinned,
    {days_before('conv_id % 30')} - to_minutes(CAST(turn * 7 % 60 AS INTEGER)) AS created_at
  FROM conversations WHERE {strip('text')} <> '')"""

TASKS = f"""tasks AS (
  SELECT o_orderkey AS id, o_custkey AS user_id, 'Order ' || o_orderkey AS title,
    o_orderpriority AS description,
    CASE WHEN o_orderstatus = 'O' THEN 'pending' WHEN o_orderstatus = 'P' THEN 'in_progress'
         WHEN o_orderkey % 10 = 0 THEN 'cancelled' ELSE 'done' END AS status,
    CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 'high'
         WHEN substr(o_orderpriority, 1, 1) = '3' THEN 'medium' ELSE 'low' END AS priority,
    {session_name('o_orderkey')} AS project, o_orderdate AS created_at
  FROM orders)"""

SKILL_NAME = ("array_to_string(list_transform(string_split(p_name, ' '), "
              "lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') || ' #' || p_partkey")
SKILLS = f"""skills AS (
  SELECT p_partkey AS id, {SKILL_NAME} AS name, {skill_slug(SKILL_NAME)} AS slug, p_type AS description,
    concat_ws(' ', p_name, p_brand, p_type) AS content, p_brand AS project,
    {tenant('p_partkey')} AS user_id, {days_before('p_partkey % 365')} AS created_at
  FROM part)"""

MATCHES = """(s.user_id = q.user_id AND NOT s.is_deprecated
    AND (q.session_id IS NULL OR s.session_id = q.session_id)
    AND (q.project IS NULL OR s.memory_layer = 'L4' OR s.project = q.project))"""
