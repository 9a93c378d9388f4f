"""Relevance signals, budgets, diversification and the whole retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamem import constants as K
from stratamem.catalog import base as b
from stratamem.functions import scoring, text
from stratamem.operators.budget import allocation
from stratamem.operators.topn import dedup_keep_first
from stratamem.plans import retrieve as plan
from stratamem.sources import tables

QUERY = "the thing of tion and ing est un des la"


def _scored_items(spark: SparkSession, base: str) -> DataFrame:
    """Every item against one query, without vectors (semantic 0)."""
    items = tables.memory_items(spark, base).withColumn("semantic", F.lit(0.0)).withColumn(
        "query_words", F.array(*[F.lit(w) for w in dict.fromkeys(QUERY.split())]))
    return plan.score(items, tables.as_of())


def recency(spark, base):
    """Recency signal per document."""
    docs = tables.document_rows(spark, base)
    return docs.select("doc_id", scoring.round4(
        scoring.recency(F.col("created_at"), tables.as_of())).alias("recency"))


def importance_boost(spark, base):
    docs = tables.document_rows(spark, base)
    return docs.select("doc_id", scoring.round4(
        scoring.importance(F.col("importance"), F.col("is_pinned"))).alias("importance"))


def user_signal(spark, base):
    """Share of the query's words found in each whole document."""
    docs = tables.read_texts(spark, base, "documents", "doc_id")
    return docs.select("doc_id", scoring.round4(
        scoring.user_signal_of_text(F.lit(QUERY), F.col("text"))).alias("signal"))


def combined_score(spark, base):
    return _scored_items(spark, base).select("id", "recency_score", "importance_score",
                                             "user_signal_score", "combined")


def score_split(spark, base):
    """Every item as kept or dropped at the threshold."""
    label = F.when(F.col("combined") >= K.DROP_BELOW, "kept").otherwise("dropped")
    return _scored_items(spark, base).select("id", label.alias("decision"))


def token_budgets(spark, base):
    """Items and tokens per layer and tenant, with the layer's budget."""
    from stratamem.operators.budget import layer_limit
    items = tables.memory_items(spark, base)
    return (items.groupBy("user_id", "memory_layer")
            .agg(F.count(F.lit(1)).alias("items"),
                 F.sum(text.token_estimate(F.col("content"))).alias("tokens"))
            .withColumn("budget", layer_limit(F.col("memory_layer"))))


def budget_allocation(spark, base):
    """The allocation next to what all stored items would use."""
    used = tables.memory_items(spark, base).agg(
        F.sum(text.token_estimate(F.col("content"))).alias("stored_tokens"))
    return allocation(spark).withColumn("stored_tokens", used.scalar())


def dedup_first(spark, base):
    """First message of each role and session, in arrival order."""
    m = tables.l1_messages(spark, base)
    return dedup_keep_first(m, ["user_id", "session_id", "role"], [F.col("seq")]).select(
        "user_id", "session_id", "role", "seq")


def _retrieve(spark, base, **options):
    return plan.retrieve(tables.memory_items(spark, base, True), tables.retrieval_queries(spark, base),
                         tables.l1_messages(spark, base), tables.as_of(), plan.RetrieveOptions(**options))


def retrieve_e2e(spark, base):
    """Hybrid retrieval with round-robin diversification."""
    return _retrieve(spark, base, diversify="round_robin")


def retrieve_mmr(spark, base):
    """Hybrid retrieval with maximal marginal relevance."""
    return _retrieve(spark, base, diversify="auto")


def retrieve_plain(spark, base):
    """Hybrid retrieval without diversification."""
    return _retrieve(spark, base, diversify="none")


def retrieve_positional(spark, base):
    """Round-robin retrieval that pairs lexical scores by position."""
    return _retrieve(spark, base, diversify="round_robin", positional_lexical=True)


def result_tokens(spark, base):
    """Rows and tokens per query of the round-robin retrieval."""
    return plan.result_tokens(_retrieve(spark, base, diversify="round_robin"), tables.retrieval_queries(spark, base))


def context_candidates(spark, base):
    """Candidates per query and layer before scoring, working memory included."""
    rows = plan.candidates(tables.memory_items(spark, base, True), tables.retrieval_queries(spark, base),
                           tables.l1_messages(spark, base), plan.RetrieveOptions(diversify="none"))
    return rows.groupBy("query_id", "memory_layer").agg(F.count(F.lit(1)).alias("candidates"))


QUERIES = {f.__name__: f for f in (
    recency, importance_boost, user_signal, combined_score, score_split, token_budgets, budget_allocation,
    dedup_first, retrieve_e2e, retrieve_mmr, retrieve_plain, retrieve_positional, result_tokens,
    context_candidates)}

_WORDS = "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(QUERY.split())) + "]"
_REC = f"1e0 / (1e0 + greatest({b.age_days('created_at')}, 0e0))"
_IMP = "CASE WHEN is_pinned THEN least(importance + 0.2e0, 1e0) ELSE importance END"


def _signal(words: str, content: str) -> str:
    shared = f"len(list_intersect({words}, {b.word_set(content)}))"
    return f"CASE WHEN len({words}) > 0 THEN CAST({shared} AS DOUBLE) / len({words}) ELSE 0e0 END"


def _combined(sem: str, words: str) -> str:
    return b.round4(f"0.25e0 * ({_REC}) + 0.4e0 * ({sem}) + 0.25e0 * ({_IMP}) + 0.1e0 * ({_signal(words, 'content')})")


_ALL_SCORED = f"""WITH {b.ITEMS}, scored AS (SELECT id, {b.round4(_REC)} AS recency_score,
  {b.round4(_IMP)} AS importance_score, {b.round4(_signal(_WORDS, 'content'))} AS user_signal_score,
  {_combined('0e0', _WORDS)} AS combined FROM items)"""

_TERM = ("(n * ln((total - df + 0.5e0) / (df + 0.5e0) + 1e0) * (tf * 2.5e0) / "
         "(tf + 1.5e0 * (1e0 - 0.75e0 + 0.75e0 * doc_len / avg_len)))")

CANDIDATES = f"""WITH RECURSIVE {b.EMBEDDED}, {b.ASKED}, {b.MESSAGES}, sims AS (
  SELECT q.query_id, s.memory_layer, s.id, {b.cosine('s.embedding', 'q.embedding')} AS sem
  FROM asked q JOIN stored s ON {b.MATCHES}), ranked_hits AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, memory_layer
    ORDER BY {b.rank_key('sem')} DESC, id) AS rank FROM sims WHERE {b.rank_key('sem')} >= 0), recent AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, session_id ORDER BY seq DESC) AS back FROM messages),
  cand AS (
  SELECT h.query_id, h.id, h.sem, h.rank, s.memory_layer, s.session_id, s.content, s.importance,
    s.is_pinned, s.created_at, s.embedding,
    CASE s.memory_layer WHEN 'L2' THEN 2 WHEN 'L3' THEN 3 ELSE 4 END AS layer_ord,
    CASE WHEN s.memory_layer = 'L4' THEN 'global' ELSE 'project' END AS scope
  FROM ranked_hits h JOIN stored s ON s.id = h.id WHERE h.rank <= 30
  UNION ALL
  SELECT q.query_id, m.id, 0e0, -m.back, 'L1', m.session_id, m.content, m.importance, m.is_pinned,
    m.created_at, NULL, 1, 'project'
  FROM asked q JOIN recent m ON m.user_id = q.user_id AND m.session_id = q.session_id WHERE m.back <= 20)"""


def _bm25_sql() -> str:
    return f""", toks AS (SELECT query_id, scope, id, {b.tokens('content')} AS tokens FROM cand),
  grp AS (SELECT query_id, scope, count(*) AS total, avg(len(tokens)) AS avg_len FROM toks GROUP BY ALL),
  qt AS (SELECT query_id, term, count(*) AS n FROM (
    SELECT query_id, unnest({b.tokens('query_text')}) AS term FROM asked) GROUP BY ALL),
  tf AS (SELECT query_id, scope, id, term, doc_len, count(*) AS tf FROM (
    SELECT query_id, scope, id, len(tokens) AS doc_len, unnest(tokens) AS term FROM toks) GROUP BY ALL),
  hit AS (SELECT tf.*, n FROM tf JOIN qt ON qt.query_id = tf.query_id AND qt.term = tf.term),
  dfs AS (SELECT query_id, scope, term, count(*) AS df FROM hit GROUP BY ALL),
  lex AS (SELECT hit.query_id, hit.scope, hit.id, sum({_TERM}) AS s
    FROM hit JOIN dfs USING (query_id, scope, term) JOIN grp USING (query_id, scope) GROUP BY ALL),
  lexall AS (SELECT c.query_id, c.scope, c.id, coalesce(s, 0e0) AS s FROM cand c
    LEFT JOIN lex USING (query_id, scope, id)),
  lexnorm AS (SELECT *, s / CASE WHEN max(s) OVER w = 0 THEN 1e0 ELSE max(s) OVER w END AS bm25_norm
    FROM lexall WINDOW w AS (PARTITION BY query_id, scope))"""


def _ranked_sql(positional: bool) -> str:
    kept = """kept AS (SELECT *, row_number() OVER (PARTITION BY query_id, scope
      ORDER BY combined DESC, layer_ord, rank) AS kept_ord FROM sig WHERE combined >= 0.2e0)"""
    if positional:
        kept += """, placed AS (SELECT query_id, scope, bm25_norm, row_number() OVER (
          PARTITION BY query_id, scope ORDER BY layer_ord, rank) AS place FROM sig),
        paired AS (SELECT k.* EXCLUDE (bm25_norm), p.bm25_norm FROM kept k JOIN placed p
          ON p.query_id = k.query_id AND p.scope = k.scope AND p.place = k.kept_ord)"""
    final = "paired" if positional else "kept"
    return f"""{_bm25_sql()}, sig AS (SELECT c.*, l.bm25_norm,
      {b.round4(_REC)} AS recency_score, {b.round4('least(greatest(c.sem, 0e0), 1e0)')} AS semantic_score,
      {b.round4(_IMP)} AS importance_score, {b.round4(_signal('words', 'content'))} AS user_signal_score,
      {_combined('least(greatest(c.sem, 0e0), 1e0)', 'words')} AS combined
      FROM cand c JOIN lexnorm l ON l.query_id = c.query_id AND l.scope = c.scope AND l.id = c.id
      JOIN (SELECT query_id AS qid, {b.word_set('query_text')} AS words FROM asked) qw ON qw.qid = c.query_id),
    {kept}, fin AS (SELECT *, length(content) // 4 AS token_estimate, {b.round4(
      '0.6e0 * (0.6e0 * semantic_score + 0.4e0 * bm25_norm) + (1e0 - 0.6e0) * combined')} AS score FROM {final}),
    spent AS (SELECT *, sum(token_estimate) OVER (PARTITION BY query_id, scope, memory_layer
      ORDER BY is_pinned DESC, score DESC, kept_ord ROWS UNBOUNDED PRECEDING) AS used FROM fin),
    trimmed AS (SELECT *, row_number() OVER (PARTITION BY query_id, scope
        ORDER BY layer_ord, is_pinned DESC, score DESC, kept_ord) AS merge_ord
      FROM spent WHERE used <= CASE memory_layer WHEN 'L1' THEN 4000 WHEN 'L2' THEN 1000
        WHEN 'L3' THEN 2000 ELSE 500 END),
    ordered AS (SELECT *, coalesce(nullif(session_id, ''), memory_layer) AS src,
      row_number() OVER (PARTITION BY query_id, scope ORDER BY score DESC, merge_ord) AS o,
      count(*) OVER (PARTITION BY query_id, scope) AS size FROM trimmed)"""


_NONE = ", picked AS (SELECT *, o AS pos FROM ordered WHERE o <= 10)"
_RR = """, rr1 AS (SELECT *, min(o) OVER (PARTITION BY query_id, scope, src) AS head,
    row_number() OVER (PARTITION BY query_id, scope, src ORDER BY o) - 1 AS turn FROM ordered),
  rr2 AS (SELECT *, dense_rank() OVER (PARTITION BY query_id, scope ORDER BY head) - 1 AS place FROM rr1),
  rr3 AS (SELECT *, max(place) OVER (PARTITION BY query_id, scope) + 1 AS srcs FROM rr2),
  rr4 AS (SELECT *, row_number() OVER (PARTITION BY query_id, scope ORDER BY
    CASE WHEN size <= 10 THEN o ELSE turn END,
    CASE WHEN size <= 10 THEN 0 ELSE ((place - turn) % srcs + srcs) % srcs END) AS rr_pos FROM rr3)"""
_PICK_RR = _RR + ", picked AS (SELECT *, rr_pos AS pos FROM rr4 WHERE rr_pos <= 10)"
# Groups above ten rows choose step by step; rows without a vector fill what is left.
_PICK_MMR = _RR + f""", pairs AS (SELECT a.query_id, a.scope, a.o, c.o AS other,
    {b.cosine('a.embedding', 'c.embedding')} AS sim FROM ordered a JOIN ordered c
    ON c.query_id = a.query_id AND c.scope = a.scope WHERE a.size > 10
    AND a.embedding IS NOT NULL AND c.embedding IS NOT NULL),
  chosen AS (
    SELECT query_id, scope, 0 AS step, CAST([] AS BIGINT[]) AS took FROM ordered WHERE size > 10 GROUP BY ALL
    UNION ALL
    SELECT query_id, scope, step + 1, list_append(took, o) FROM (
      SELECT v.*, row_number() OVER (PARTITION BY query_id, scope ORDER BY val DESC, o) AS best FROM (
        SELECT s.query_id, s.scope, s.step, s.took, r.o,
          floor((0.6e0 * r.score - (1e0 - 0.6e0) * greatest(coalesce(max(p.sim), 0e0), 0e0)) * 1e9 + 0.5e0) AS val
        FROM chosen s JOIN ordered r ON r.query_id = s.query_id AND r.scope = s.scope
          AND r.embedding IS NOT NULL AND NOT list_contains(s.took, r.o)
        LEFT JOIN pairs p ON p.query_id = r.query_id AND p.scope = r.scope AND p.o = r.o
          AND list_contains(s.took, p.other)
        WHERE s.step < 10 GROUP BY s.query_id, s.scope, s.step, s.took, r.o, r.score) v) WHERE best = 1),
  longest AS (SELECT query_id, scope, arg_max(took, step) AS took FROM chosen GROUP BY ALL),
  spare AS (SELECT query_id, scope, o, row_number() OVER (PARTITION BY query_id, scope ORDER BY o) AS n
    FROM ordered WHERE size > 10 AND embedding IS NULL),
  picked AS (
    SELECT *, o AS pos FROM rr4 WHERE size <= 10
    UNION ALL
    SELECT r.*, CASE WHEN len(l.took) = 0 THEN r.rr_pos
        WHEN r.embedding IS NOT NULL THEN list_position(l.took, r.o)
        ELSE len(l.took) + sp.n END AS pos
    FROM rr4 r JOIN longest l USING (query_id, scope) LEFT JOIN spare sp USING (query_id, scope, o)
    WHERE r.size > 10 AND CASE WHEN len(l.took) = 0 THEN r.rr_pos <= 10
        WHEN r.embedding IS NOT NULL THEN list_contains(l.took, r.o)
        ELSE len(l.took) + sp.n <= 10 END)"""
_OUT = """, final AS (SELECT *, row_number() OVER (PARTITION BY query_id
    ORDER BY score DESC, scope DESC, pos) AS result_rank FROM picked)"""
_COLS = """SELECT query_id, result_rank, id, memory_layer, score, recency_score, semantic_score,
  importance_score, user_signal_score, {} AS bm25_norm, token_estimate, content
  FROM final WHERE result_rank <= 10""".format(b.round4("bm25_norm"))


def _e2e(pick: str, positional: bool = False) -> str:
    return CANDIDATES + _ranked_sql(positional) + pick + _OUT


ORACLE = {
    "recency": f"WITH {b.DOCS} SELECT doc_id, {b.round4(_REC)} AS recency FROM docs",
    "importance_boost": f"WITH {b.DOCS} SELECT doc_id, {b.round4(_IMP)} AS importance FROM docs",
    "user_signal": f"SELECT doc_id, {b.round4(_signal(_WORDS, 'text'))} AS signal FROM documents",
    "combined_score": f"{_ALL_SCORED} SELECT * FROM scored",
    "score_split": f"""{_ALL_SCORED} SELECT id,
      CASE WHEN combined >= 0.2e0 THEN 'kept' ELSE 'dropped' END AS decision FROM scored""",
    "token_budgets": f"""WITH {b.ITEMS} SELECT user_id, memory_layer, count(*) AS items,
      CAST(sum(length(content) // 4) AS BIGINT) AS tokens,
      CASE memory_layer WHEN 'L2' THEN 1000 WHEN 'L3' THEN 2000 ELSE 500 END AS budget
      FROM items GROUP BY user_id, memory_layer""",
    "budget_allocation": f"""WITH {b.ITEMS} SELECT 2000 AS system_prompt, 1000 AS current_message,
      4000 AS response_headroom, 4000 AS "L1", 1000 AS "L2", 2000 AS "L3", 500 AS "L4",
      128000 AS total_available, 14500 AS total_used, 113500 AS remaining,
      CAST(sum(length(content) // 4) AS BIGINT) AS stored_tokens FROM items""",
    "dedup_first": f"""WITH {b.MESSAGES} SELECT user_id, session_id, role, min(seq) AS seq
      FROM messages GROUP BY user_id, session_id, role""",
    "retrieve_e2e": _e2e(_PICK_RR) + _COLS,
    "retrieve_mmr": _e2e(_PICK_MMR) + _COLS,
    "retrieve_plain": _e2e(_NONE) + _COLS,
    "retrieve_positional": _e2e(_PICK_RR, True) + _COLS,
    "result_tokens": _e2e(_PICK_RR) + """SELECT b.item_id AS query_id, count(f.query_id) AS items,
      CAST(coalesce(sum(token_estimate), 0) AS BIGINT) AS total_tokens FROM benchmark b
      LEFT JOIN (SELECT * FROM final WHERE result_rank <= 10) f ON f.query_id = b.item_id GROUP BY b.item_id""",
    "context_candidates": CANDIDATES + """SELECT query_id, memory_layer, count(*) AS candidates
      FROM cand GROUP BY query_id, memory_layer""",
}
