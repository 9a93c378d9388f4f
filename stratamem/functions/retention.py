"""Retention predicates: immunity, time to live and grace period."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratamem import constants as K
from stratamem.functions.scoring import age_days


def is_immune(is_pinned: Column, layer: Column, importance: Column,
              metadata_type: Column, item_type: Column) -> Column:
    false = F.lit(False)
    return (
        F.coalesce(is_pinned, false)
        | F.coalesce(layer == K.IMMUNE_LAYER, false)
        | (F.coalesce(importance, F.lit(0.0)) >= 1.0)
        | F.coalesce(metadata_type == K.IMMUNE_TYPE, false)
        | F.coalesce(item_type == K.IMMUNE_TYPE, false)
    )


def base_ttl_days(layer: Column, ttl: dict[str, int] = K.BASE_TTL_DAYS) -> Column:
    """Days before an untouched item of the layer expires; null means never."""
    out = None
    for name, days in ttl.items():
        out = F.when(layer == name, F.lit(float(days))) if out is None else out.when(
            layer == name, F.lit(float(days)))
    return out


def effective_ttl_days(layer: Column, importance: Column,
                       factor: float = K.TTL_IMPORTANCE_FACTOR) -> Column:
    return base_ttl_days(layer) * (1.0 + F.coalesce(importance, F.lit(0.5)) * factor)


def is_expired(ttl_days: Column, last_seen: Column, as_of: Column) -> Column:
    """True once the age reaches the time to live; unknown age never expires."""
    return F.coalesce(age_days(last_seen, as_of) >= ttl_days, F.lit(False))


def grace_over(deprecated_at: Column, as_of: Column, grace_days: int = K.GRACE_DAYS) -> Column:
    """True after ``grace_days`` whole 24-hour days."""
    return F.coalesce(F.floor(age_days(deprecated_at, as_of)) >= grace_days, F.lit(False))
