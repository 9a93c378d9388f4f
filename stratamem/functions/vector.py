"""Dense and sparse vector functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; empty, missing, unequal or zero vectors give 0."""
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b))
    scale = norm(a) * norm(b)
    return F.coalesce(F.when(usable & (scale > 0), dot(a, b) / scale), F.lit(0.0))


def rank_key(score: Column) -> Column:
    """A score at nine decimals, used only for ordering.

    Equal vectors then tie exactly whatever order their products were summed in;
    the grid is finer than the single precision a vector store ranks with.
    """
    return F.floor(score * 1e9 + 0.5) / 1e9


def sparse_cosine(a: Column, b: Column) -> Column:
    """Cosine of two term-weight maps."""
    shared = F.array_intersect(F.map_keys(a), F.map_keys(b))
    product = F.aggregate(shared, F.lit(0.0), lambda acc, t: acc + a[t] * b[t])

    def length(m: Column) -> Column:
        return F.sqrt(F.aggregate(F.map_values(m), F.lit(0.0), lambda acc, v: acc + v * v))

    scale = length(a) * length(b)
    return F.coalesce(F.when(scale > 0, product / scale), F.lit(0.0))
