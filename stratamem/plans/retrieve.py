"""Hybrid ranked retrieval for a batch of queries.

Filtered dense candidates per layer and the session's working memory are scored
lexically against each other, blended with recency, importance and word overlap,
cut to the layer budgets, diversified and merged. After the one pass over the
items everything is keyed by query, and a query's candidates are bounded by the
over-fetch limit.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratamem import constants as K
from stratamem.functions import scoring, text
from stratamem.operators import diversify as div
from stratamem.operators.bounded import broadcast_if_small
from stratamem.operators.budget import budget_prefix, layer_limit
from stratamem.operators.knn import knn
from stratamem.operators.lexical import bm25_within_groups, max_normalized, query_terms
from stratamem.operators.topn import dedup_keep_first, top_n_per_group
from stratamem.session import materialize

GROUP = ["query_id", "scope"]
ITEM_FIELDS = ["id", "session_id", "memory_layer", "content", "importance", "is_pinned", "created_at"]
SIGNALS = ["recency_score", "semantic_score", "importance_score", "user_signal_score"]


@dataclass(frozen=True)
class RetrieveOptions:
    """``diversify``: auto (MMR where vectors exist), round_robin or none.

    ``positional_lexical`` pairs the i-th kept row with the i-th candidate's lexical
    score instead of its own.
    """

    top_k: int = K.TOP_K
    layers: tuple[str, ...] = K.LAYERS
    diversify: str = "auto"
    positional_lexical: bool = False
    budgets: dict[str, int] = field(default_factory=lambda: dict(K.LAYER_BUDGET))
    mmr_lambda: float = K.MMR_LAMBDA


def _scope(layer: Column) -> Column:
    return F.when(layer == K.IMMUNE_LAYER, "global").otherwise("project")


def _layer_ord(layer: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in K.LAYERS]), layer)


def vector_candidates(items: DataFrame, queries: DataFrame, opts: RetrieveOptions) -> DataFrame:
    """Nearest items per query and layer, three times as many as asked for.

    The project filter does not apply to user-global items.
    """
    wanted = items.filter(F.col("memory_layer").isin(*opts.layers))
    return knn(wanted, queries, K.OVERFETCH * opts.top_k,
               unfiltered={K.IMMUNE_LAYER: ("project",)})


def working_memory(messages: DataFrame, queries: DataFrame, n_queries: int,
                   size: int = K.WINDOW_SIZE) -> DataFrame:
    """The session window of every query that names a session."""
    keys = ["user_id", "session_id"]
    asked = queries.filter(F.col("session_id").isNotNull()).select("query_id", *keys)
    sessions = broadcast_if_small(asked.select(*keys).distinct(), n_queries)
    window = top_n_per_group(messages.join(sessions, keys, "left_semi"), keys,
                             [F.col("seq").desc()], size, rank_col="rank")
    return window.join(broadcast_if_small(asked, n_queries), keys)


def candidates(items: DataFrame, queries: DataFrame, messages: DataFrame | None,
               opts: RetrieveOptions) -> DataFrame:
    """Content rows of all candidates.

    Vectors are only matched in the first pass; content is fetched for the
    winners alone by joining their ids back to the items.
    """
    n_queries = queries.count()
    hits = vector_candidates(items, queries, opts)
    bound = n_queries * len(opts.layers) * K.OVERFETCH * opts.top_k
    hits = broadcast_if_small(hits.select("query_id", "id", "semantic", "rank"), bound)
    extra = ["embedding"] if opts.diversify == "auto" else []
    rows = items.select(*ITEM_FIELDS, *extra).join(hits, "id")
    if messages is not None and "L1" in opts.layers:
        recent = working_memory(messages, queries, n_queries).select(
            *[c for c in ITEM_FIELDS if c != "memory_layer"], F.lit("L1").alias("memory_layer"),
            "query_id", F.lit(0.0).alias("semantic"), (-F.col("rank")).alias("rank"))
        rows = rows.unionByName(recent, allowMissingColumns=True)
    rows = rows.withColumns({"scope": _scope(F.col("memory_layer")), "layer_ord": _layer_ord(F.col("memory_layer"))})
    return dedup_keep_first(rows, [*GROUP, "id"], [F.col("layer_ord"), F.col("rank")])


def score(rows: DataFrame, as_of: Column) -> DataFrame:
    """Add the four signals (rounded), and their combination."""
    c = F.col
    rec = scoring.recency(c("created_at"), as_of)
    imp = scoring.importance(c("importance"), c("is_pinned"))
    sig = scoring.user_signal(c("query_words"), text.word_set(c("content")))
    sem = scoring.clamp01(c("semantic"))
    signals = rows.withColumns({"_rec": rec, "_imp": imp, "_sig": sig, "_sem": sem})
    return signals.withColumns({
        "combined": scoring.round4(scoring.combined(c("_rec"), c("_sem"), c("_imp"), c("_sig"))),
        "recency_score": scoring.round4(c("_rec")),
        "semantic_score": scoring.round4(c("_sem")),
        "importance_score": scoring.round4(c("_imp")),
        "user_signal_score": scoring.round4(c("_sig")),
    }).drop("_rec", "_imp", "_sig", "_sem")


def rank_candidates(rows: DataFrame, queries: DataFrame, as_of: Column, opts: RetrieveOptions) -> DataFrame:
    """Candidates above the drop threshold with their final score."""
    order = [F.col("layer_ord"), F.col("rank")]
    tokens = rows.withColumn("tokens", text.tokenize(F.col("content")))
    asked = queries.select("query_id", text.tokenize(F.col("query_text")).alias("tokens"))
    terms = query_terms(asked, "query_id", "tokens")
    # A term takes two bytes of its text at least, so the bytes bound both tables.
    n_queries, size = queries.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("query_text")), F.lit(0))).first()
    lexical = bm25_within_groups(tokens, broadcast_if_small(terms, size // 2, text_bytes=size), GROUP)
    words = queries.select("query_id", text.word_set(F.col("query_text")).alias("query_words"))
    words = broadcast_if_small(words, n_queries, text_bytes=size)
    scored = score(rows.join(words, "query_id"), as_of).join(lexical, [*GROUP, "id"], "left").withColumn(
        "bm25_norm", max_normalized(F.coalesce("bm25", F.lit(0.0)), GROUP))
    if opts.positional_lexical:
        group = Window.partitionBy(*GROUP)
        whole = group.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        scored = scored.withColumn("_by_ord", F.collect_list("bm25_norm").over(whole))
    kept = scored.filter(F.col("combined") >= K.DROP_BELOW)
    if opts.positional_lexical:
        place = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.col("combined").desc(), *order))
        kept = kept.withColumn("bm25_norm", F.get("_by_ord", place - 1)).drop("_by_ord")
    fused = scoring.fused(F.col("semantic_score"), F.col("bm25_norm"))
    return kept.withColumns({
        "score": scoring.final_score(fused, F.col("combined")),
        "kept_ord": F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.col("combined").desc(), *order)),
        "token_estimate": text.token_estimate(F.col("content"))})


def within_budget(ranked: DataFrame, opts: RetrieveOptions) -> DataFrame:
    return budget_prefix(ranked, [*GROUP, "memory_layer"], [F.col("score").desc(), F.col("kept_ord")],
                         layer_limit(F.col("memory_layer"), opts.budgets))


def diversified(trimmed: DataFrame, opts: RetrieveOptions) -> DataFrame:
    """At most ``top_k`` rows per group with their place in ``pos``.

    Rows of one layer stay in budget order when scores tie across layers.
    """
    pinned_first = Window.partitionBy(*GROUP).orderBy(
        F.col("layer_ord"), F.col("is_pinned").desc(), F.col("score").desc(), F.col("kept_ord"))
    trimmed = trimmed.withColumn("merge_ord", F.row_number().over(pinned_first))
    order = [F.col("score").desc(), F.col("merge_ord")]
    if opts.diversify == "none":
        return top_n_per_group(trimmed, GROUP, order, opts.top_k, rank_col="pos")
    source = div.source_key(F.col("session_id"), F.col("memory_layer"))
    if opts.diversify == "round_robin":
        return div.round_robin(trimmed, GROUP, order, opts.top_k, source)
    return div.mmr_or_round_robin(trimmed, GROUP, ["score", "merge_ord"], opts.top_k, source,
                                  opts.mmr_lambda)


def retrieve(items: DataFrame, queries: DataFrame, messages: DataFrame | None, as_of: Column,
             opts: RetrieveOptions = RetrieveOptions()) -> DataFrame:
    """Ranked results of every query: at most ``top_k`` rows each, best first.

    The candidates, bounded per query, are written once: ranking reads them twice,
    and re-deriving them would mean another pass over the items.
    """
    rows = materialize(candidates(items, queries, messages, opts), "candidates")
    return rank_and_select(rows, queries, as_of, opts)


def rank_and_select(rows: DataFrame, queries: DataFrame, as_of: Column, opts: RetrieveOptions) -> DataFrame:
    """The same from candidates at hand."""
    ranked = rank_candidates(rows, queries, as_of, opts)
    picked = diversified(within_budget(ranked, opts), opts)
    order = [F.col("score").desc(), F.col("scope").desc(), F.col("pos")]
    final = top_n_per_group(picked, ["query_id"], order, opts.top_k, rank_col="result_rank")
    return final.select("query_id", F.col("result_rank").cast("int"), "id", "memory_layer",
                        "score", *SIGNALS,
                        scoring.round4(F.col("bm25_norm")).alias("bm25_norm"), "token_estimate", "content")


def result_tokens(results: DataFrame, queries: DataFrame) -> DataFrame:
    """Rows and tokens returned per query, 0 for queries without a result."""
    sums = results.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("items"), F.sum("token_estimate").alias("total_tokens"))
    return queries.select("query_id").join(sums, "query_id", "left").select(
        "query_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("items", "total_tokens")])
