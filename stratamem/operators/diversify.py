"""Diversification of ranked results."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratamem import constants as K


def source_key(session_id: Column, layer: Column) -> Column:
    return F.coalesce(F.nullif(session_id, F.lit("")), layer)


def round_robin(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
                source: Column, pos_col: str = "pos") -> DataFrame:
    """Take sources in turn, starting one source later each round.

    Groups of at most ``k`` rows keep their order. Adds ``pos`` from 1.
    """
    return _round_robin_places(df, keys, order, k, source, pos_col).filter(F.col(pos_col) <= k)


def _round_robin_places(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
                        source: Column, pos_col: str) -> DataFrame:
    """Place of every row in round-robin order, in closed form.

    Row r of source s (both from 0, sources by first appearance) is taken in round
    r at place (s - r) modulo the number of sources.
    """
    group = Window.partitionBy(*keys)
    by_source = Window.partitionBy(*keys, "_source")
    ranked = (df.withColumns({"_source": source,
                              "_ord": F.row_number().over(group.orderBy(*order)),
                              "_size": F.count(F.lit(1)).over(group)})
              .withColumns({"_first": F.min("_ord").over(by_source),
                            "_round": F.row_number().over(by_source.orderBy("_ord")) - 1})
              .withColumn("_place", F.dense_rank().over(group.orderBy("_first")) - 1)
              .withColumn("_sources", F.max("_place").over(group) + 1))
    kept_order = F.col("_size") <= k
    turn = F.pmod(F.col("_place") - F.col("_round"), F.col("_sources"))
    place = F.row_number().over(group.orderBy(
        F.when(kept_order, F.col("_ord")).otherwise(F.col("_round")),
        F.when(kept_order, F.lit(0)).otherwise(turn)))
    return ranked.withColumn(pos_col, place).drop(
        "_source", "_ord", "_size", "_first", "_round", "_place", "_sources")


def mmr_order(scores: np.ndarray, vectors: list, k: int, lam: float) -> list[int]:
    """Positions chosen by maximal marginal relevance from a ranked list."""
    n = len(scores)
    if k >= n:
        return list(range(n))
    with_vector = [i for i, v in enumerate(vectors) if v is not None and len(v)]
    if not with_vector:
        return list(range(k))
    sims = _pairwise([np.asarray(vectors[i], dtype="float64") for i in with_vector])
    open_, chosen = np.ones(len(with_vector), bool), []
    nearest = np.zeros(len(with_vector))
    relevance = lam * np.asarray(scores, dtype="float64")[with_vector]
    while len(chosen) < k and open_.any():
        value = np.where(open_, relevance - (1.0 - lam) * nearest, -np.inf)
        at = int(np.argmax(np.floor(value * 1e9 + 0.5)))
        chosen.append(with_vector[at])
        open_[at] = False
        nearest = np.maximum(nearest, sims[at])
    spare = [i for i in range(n) if i not in set(with_vector)]
    return chosen + spare[: k - len(chosen)]


def _pairwise(vectors: list[np.ndarray]) -> np.ndarray:
    """Cosines between all vectors; unequal lengths and zero vectors give 0."""
    out = np.zeros((len(vectors), len(vectors)))
    lengths = np.array([len(v) for v in vectors])
    for dim in np.unique(lengths):
        at = np.flatnonzero(lengths == dim)
        m = np.stack([vectors[i] for i in at])
        size = np.sqrt((m * m).sum(axis=1, keepdims=True))
        m = np.divide(m, size, out=np.zeros_like(m), where=size > 0)
        out[np.ix_(at, at)] = m @ m.T
    return out


def mmr(df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int,
        lam: float = K.MMR_LAMBDA, score: str = "score", embedding: str = "embedding",
        fallback: str | None = None, pos_col: str = "pos") -> DataFrame:
    """Greedy maximal marginal relevance per group; adds ``pos`` from 1.

    Each choice depends on the ones before it, so a group is handled in one task.
    A group is the candidate set of one query, bounded by the over-fetch limit.
    ``order`` names columns: descending score first, then ascending tie-breaks.
    A group without vectors takes its places from ``fallback`` where given.
    """
    schema = T.StructType(df.schema.fields + [T.StructField(pos_col, T.IntegerType())])
    ascending = [name != score for name in order]

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order), ascending=ascending, kind="stable")
        if fallback and pdf[embedding].isna().all():
            kept = pdf[pdf[fallback].between(1, k)].sort_values(fallback)
            return kept.assign(**{pos_col: kept[fallback].astype("int32")})
        taken = mmr_order(pdf[score].to_numpy(), pdf[embedding].tolist(), k, lam)
        return pdf.iloc[taken].assign(**{pos_col: np.arange(1, len(taken) + 1, dtype="int32")})

    return df.groupBy(*keys).applyInPandas(pick, schema)


def mmr_or_round_robin(df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int,
                       source: Column, lam: float = K.MMR_LAMBDA) -> DataFrame:
    """MMR for groups with vectors, round-robin for the others."""
    columns = [F.col(name).desc() if i == 0 else F.col(name) for i, name in enumerate(order)]
    placed = _round_robin_places(df, keys, columns, k, source, "_turn")
    return mmr(placed, keys, order, k, lam, score=order[0], fallback="_turn").drop("_turn")
