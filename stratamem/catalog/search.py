"""Nearest-neighbour queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamem.catalog import base as b
from stratamem.functions import scoring, vector
from stratamem.operators import knn_pruned as pivots
from stratamem.operators.knn import knn
from stratamem.sources import tables


def _shown(hits: DataFrame, *cols: str) -> DataFrame:
    return hits.select("query_id", *cols, "id", "rank",
                       scoring.round4(F.col("semantic")).alias("semantic"))


def knn_topk(spark: SparkSession, base: str) -> DataFrame:
    """Ten nearest live items of the user per query."""
    hits = knn(tables.memory_items(spark, base, True), tables.retrieval_queries(spark, base), 10,
               group=None, filters=())
    return _shown(hits)


def knn_layer_candidates(spark: SparkSession, base: str) -> DataFrame:
    """Thirty nearest per query and layer under the session and project filters."""
    hits = knn(tables.memory_items(spark, base, True), tables.retrieval_queries(spark, base), 30,
               unfiltered={"L4": ("project",)})
    return _shown(hits, "memory_layer")


def knn_threshold(spark: SparkSession, base: str) -> DataFrame:
    """Up to fifty items per query with a similarity of at least 0.25."""
    hits = knn(tables.memory_items(spark, base, True), tables.retrieval_queries(spark, base), 50,
               group=None, threshold=0.25, filters=("session_id",))
    return _shown(hits)


def knn_pruned(spark: SparkSession, base: str) -> DataFrame:
    """Ten nearest live items of the user per query, from blocks around pivots."""
    index = pivots.build(tables.memory_items(spark, base, True), filters=())
    return _shown(pivots.knn_pruned(index, tables.retrieval_queries(spark, base), 10))


def knn_pruned_filtered(spark: SparkSession, base: str) -> DataFrame:
    """Up to fifty items per query with a similarity of at least 0.25 under the session filter."""
    index = pivots.build(tables.memory_items(spark, base, True), filters=("session_id",))
    return _shown(pivots.knn_pruned(index, tables.retrieval_queries(spark, base), 50, threshold=0.25))


def vector_cosine(spark: SparkSession, base: str) -> DataFrame:
    """Cosine of each stored vector with the next one."""
    e = tables.read(spark, base, "embeddings")
    following = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(following, "vec_id").select(
        "vec_id", scoring.round4(vector.cosine(F.col("embedding"), F.col("other"))).alias("cosine"))


QUERIES = {f.__name__: f for f in (
    knn_topk, knn_layer_candidates, knn_threshold, knn_pruned, knn_pruned_filtered, vector_cosine)}


def _knn_sql(k: int, group: str, condition: str, threshold: float) -> str:
    cols = "query_id, " + (f"{group}, " if group else "")
    part = cols.rstrip(", ")
    return f"""WITH {b.EMBEDDED}, {b.ASKED}, sims AS (
      SELECT q.query_id, s.memory_layer, s.id, {b.cosine('s.embedding', 'q.embedding')} AS sem
      FROM asked q JOIN stored s ON {condition}), hits AS (
      SELECT {cols} id, sem, row_number() OVER (PARTITION BY {part} ORDER BY {b.rank_key('sem')} DESC, id) AS rank
      FROM sims WHERE {b.rank_key('sem')} >= {threshold})
    SELECT {cols} id, rank, {b.round4('sem')} AS semantic FROM hits WHERE rank <= {k}"""


ORACLE = {
    "knn_topk": _knn_sql(10, "", "s.user_id = q.user_id AND NOT s.is_deprecated", 0),
    "knn_layer_candidates": _knn_sql(30, "memory_layer", b.MATCHES, 0),
    "knn_threshold": _knn_sql(
        50, "", "s.user_id = q.user_id AND NOT s.is_deprecated "
        "AND (q.session_id IS NULL OR s.session_id = q.session_id)", 0.25),
    "knn_pruned": _knn_sql(10, "", "s.user_id = q.user_id AND NOT s.is_deprecated", 0),
    "knn_pruned_filtered": _knn_sql(
        50, "", "s.user_id = q.user_id AND NOT s.is_deprecated "
        "AND (q.session_id IS NULL OR s.session_id = q.session_id)", 0.25),
    "vector_cosine": f"""SELECT a.vec_id, {b.round4(b.cosine('a.embedding', 'c.embedding'))} AS cosine
      FROM embeddings a JOIN embeddings c ON c.vec_id = a.vec_id + 1""",
}
