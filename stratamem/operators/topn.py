"""Ordered selection per group: top-n, last-n and first-occurrence deduplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
                    rank_col: str | None = None, salts: int = 1,
                    salt_on: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows of each group in ``order``.

    Catalyst turns the ``row_number() <= n`` filter into a group limit that runs
    before the shuffle, so a task ships at most ``n`` rows per group. With
    ``salts > 1`` the group is first cut down in that many slices, so that no
    single task sorts what thousands of tasks sent for one hot group. ``order``
    must be total for a repeatable result.
    """
    rank = rank_col or "_rank"
    if salts > 1:
        slice_col = F.pmod(F.xxhash64(*salt_on), F.lit(salts))
        window = Window.partitionBy(*keys, "_slice").orderBy(*order)
        df = (df.withColumn("_slice", slice_col)
              .withColumn("_slice_rank", F.row_number().over(window))
              .filter(F.col("_slice_rank") <= n)
              .drop("_slice", "_slice_rank"))
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.filter(F.col(rank) <= n)
    return kept if rank_col else kept.drop(rank)


def last_n_window(messages: DataFrame, keys: Sequence[str] = ("user_id", "session_id"),
                  seq: str = "seq", n: int = 20, pos_col: str = "pos") -> DataFrame:
    """The newest ``n`` rows of each key, numbered from the newest."""
    return top_n_per_group(messages, keys, [F.col(seq).desc()], n, rank_col=pos_col)


def dedup_keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in ``order``."""
    return top_n_per_group(df, keys, order, 1)
