"""Joins whose small side is checked before it is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of a few dozen bytes: about 30 MB at most.
MAX_BROADCAST_ROWS = 500_000
# For rows that hold texts.
MAX_BROADCAST_BYTES = 64 << 20


def broadcast_if_small(df: DataFrame, row_bound: int, limit: int = MAX_BROADCAST_ROWS,
                       text_bytes: int = 0) -> DataFrame:
    """Hint a broadcast only for a side of proven size; otherwise let it shuffle.

    ``text_bytes`` bounds the texts in the rows, where they have any of unlimited length.
    """
    return F.broadcast(df) if row_bound <= limit and text_bytes <= MAX_BROADCAST_BYTES else df


def join_by_frequency(rows: DataFrame, counts: DataFrame, key: str, count: str, total: int,
                      limit: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Join ``rows`` with ``counts``, which holds each key once and how often it occurs in ``rows``.

    ``total`` is the number of rows. At most ``limit`` keys can occur more than
    total / limit times; those are broadcast, so no hot key is ever shuffled. The
    keys left for the shuffle join are all rarer than that.
    """
    rare_most = max(total // limit, 1000)
    hot = counts.filter(F.col(count) > rare_most)
    marked = rows.join(F.broadcast(hot), key, "left")
    rare = marked.filter(F.col(count).isNull()).drop(count).join(
        counts.filter(F.col(count) <= rare_most), key)
    return marked.filter(F.col(count).isNotNull()).unionByName(rare)
