"""Term statistics and BM25 over the whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamem.catalog import base as b
from stratamem.functions import scoring, text
from stratamem.operators import lexical as lx
from stratamem.operators import lexical_index
from stratamem.session import scratch_path
from stratamem.sources import tables

QUERY = "For the thing and the tion, which ment is the ing of tion"
QUERY_TOKENS = ["thing", "tion", "ment", "ing", "tion"]


def _docs(spark: SparkSession, base: str) -> DataFrame:
    return tables.read_texts(spark, base, "documents", "doc_id").select(
        "doc_id", text.tokenize(F.col("text")).alias("tokens"))


def tokenize_counts(spark, base):
    """Tokens and distinct tokens per document."""
    return _docs(spark, base).select("doc_id", F.size("tokens").alias("tokens"),
                                     F.size(F.array_distinct("tokens")).alias("distinct_tokens"))


def term_freq(spark, base):
    return lx.term_frequency(_docs(spark, base), "doc_id")


def doc_freq(spark, base):
    return lx.document_frequency(_docs(spark, base))


def corpus_stats(spark, base):
    return lx.corpus_stats(_docs(spark, base)).select(
        "total_docs", scoring.round4(F.col("avg_doc_len")).alias("avg_doc_len"))


def bm25_scores(spark, base):
    """One query against every document."""
    scored = lx.bm25_against_corpus(_docs(spark, base), "doc_id", QUERY_TOKENS)
    return scored.select("doc_id", scoring.round4(F.col("bm25")).alias("bm25"))


def bm25_normalized(spark, base):
    """The same scores divided by the best one."""
    scored = lx.bm25_against_corpus(_docs(spark, base), "doc_id", QUERY_TOKENS)
    top = scored.agg(F.max("bm25")).scalar()
    norm = F.col("bm25") / F.when(F.col("top") == 0, F.lit(1.0)).otherwise(F.col("top"))
    return scored.withColumn("top", top).select("doc_id", scoring.round4(norm).alias("bm25_norm"))


def sparse_vector_norm(spark, base):
    """Terms and length of every document's BM25 term vector."""
    vectors = lx.sparse_vectors(_docs(spark, base), "doc_id")
    return lx.sparse_norms(vectors, "doc_id", tables.read(spark, base, "documents")).select(
        "doc_id", "terms", scoring.round4(F.col("length")).alias("length"))


def sparse_cosine(spark, base):
    """Cosine of every document's term vector with the query's term counts."""
    vectors = lx.sparse_vectors(_docs(spark, base), "doc_id")
    query = spark.createDataFrame(
        [(t, float(QUERY_TOKENS.count(t))) for t in dict.fromkeys(QUERY_TOKENS)], "term string, weight double")
    return lx.sparse_similarity(vectors, "doc_id", query, tables.read(spark, base, "documents")).select(
        "doc_id", scoring.round4(F.col("similarity")).alias("similarity"))


def bm25_topk(spark, base):
    """The ten best items of all for every benchmark passage, from a written index."""
    items = tables.memory_items(spark, base).select("id", text.tokenize(F.col("content")).alias("tokens"))
    # Neighbouring windows of a document share words and therefore a block.
    index = lexical_index.write_index(items, "id", scratch_path(spark, "lexical-index"),
                                      near=F.shiftright("id", 5))
    queries = tables.read(spark, base, "benchmark").select(
        F.col("item_id").alias("query_id"), text.tokenize(F.col("text")).alias("tokens"))
    return lexical_index.bm25_topk(index, queries, 10).select(
        "query_id", "id", "rank", scoring.round4(F.col("bm25")).alias("bm25"))


QUERIES = {f.__name__: f for f in (
    tokenize_counts, term_freq, doc_freq, corpus_stats, bm25_scores, bm25_normalized,
    sparse_vector_norm, sparse_cosine, bm25_topk)}

_TOK = f"tok AS (SELECT doc_id, source, {b.tokens('text')} AS tokens FROM documents)"
_TF = """tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM tok)
  GROUP BY doc_id, term)"""
_IDF = "ln((total - df + 0.5e0) / (df + 0.5e0) + 1e0)"
_TERM = f"({_IDF} * (tf * 2.5e0) / (tf + 1.5e0 * (1e0 - 0.75e0 + 0.75e0 * doc_len / avg_len)))"
_QT = "qt AS (SELECT * FROM (VALUES ('thing', 1), ('tion', 2), ('ment', 1), ('ing', 1)) v(term, n))"
_WEIGHTS = f"""WITH {_TOK}, {_TF}, dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  st AS (SELECT count(*) AS total, avg(len(tokens)) AS avg_len FROM tok),
  w AS (SELECT tf.doc_id, tf.term, {_TERM} AS weight
    FROM tf JOIN dfs USING (term) JOIN (SELECT doc_id, len(tokens) AS doc_len FROM tok) d USING (doc_id), st)"""
_SCORED = f"""WITH {_TOK}, {_TF}, {_QT},
  dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  st AS (SELECT count(*) AS total, avg(len(tokens)) AS avg_len FROM tok),
  part AS (SELECT d.doc_id, sum(qt.n * {_TERM}) AS s FROM qt JOIN tf USING (term) JOIN dfs USING (term)
    JOIN (SELECT doc_id, len(tokens) AS doc_len FROM tok) d ON d.doc_id = tf.doc_id, st GROUP BY d.doc_id),
  scored AS (SELECT tok.doc_id, coalesce(s, 0e0) AS s FROM tok LEFT JOIN part USING (doc_id))"""

_TOPK = f"""WITH {b.ITEMS}, tok AS (SELECT id AS doc_id, {b.tokens('content')} AS tokens FROM items), {_TF},
  qt AS (SELECT item_id AS query_id, term, count(*) AS n FROM (
    SELECT item_id, unnest({b.tokens('text')}) AS term FROM benchmark) GROUP BY ALL),
  dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  st AS (SELECT count(*) AS total, avg(len(tokens)) AS avg_len FROM tok),
  part AS (SELECT query_id, d.doc_id AS id, sum(qt.n * {_TERM}) AS s FROM qt JOIN tf USING (term) JOIN dfs USING (term)
    JOIN (SELECT doc_id, len(tokens) AS doc_len FROM tok) d ON d.doc_id = tf.doc_id, st GROUP BY ALL),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {b.rank_key('s')} DESC, id) AS rank FROM part)
  SELECT query_id, id, rank, {b.round4('s')} AS bm25 FROM ranked WHERE rank <= 10"""

ORACLE = {
    "bm25_topk": _TOPK,
    "tokenize_counts": f"""WITH {_TOK} SELECT doc_id, len(tokens) AS tokens,
      len(list_distinct(tokens)) AS distinct_tokens FROM tok""",
    "term_freq": f"WITH {_TOK}, {_TF} SELECT * FROM tf",
    "doc_freq": f"WITH {_TOK}, {_TF} SELECT term, count(*) AS df FROM tf GROUP BY term",
    "corpus_stats": f"""WITH {_TOK} SELECT count(*) AS total_docs,
      {b.round4('avg(len(tokens))')} AS avg_doc_len FROM tok""",
    "bm25_scores": f"""{_SCORED} SELECT doc_id, {b.round4('s')} AS bm25 FROM scored""",
    "bm25_normalized": f"""{_SCORED} SELECT doc_id, {b.round4(
      's / (SELECT CASE WHEN max(s) = 0 THEN 1e0 ELSE max(s) END FROM scored)')} AS bm25_norm FROM scored""",
    "sparse_vector_norm": f"""{_WEIGHTS} SELECT tok.doc_id, count(w.term) AS terms,
      {b.round4('coalesce(sqrt(sum(weight * weight)), 0e0)')} AS length FROM tok LEFT JOIN w USING (doc_id)
      GROUP BY tok.doc_id""",
    "sparse_cosine": f"""{_WEIGHTS}, {_QT} SELECT tok.doc_id, {b.round4(
      'coalesce(sum(weight * coalesce(qt.n, 0)) / (sqrt(sum(weight * weight)) * sqrt((SELECT sum(n * n) FROM qt))), 0e0)')}
      AS similarity FROM tok LEFT JOIN w USING (doc_id) LEFT JOIN qt USING (term) GROUP BY tok.doc_id""",
}
