"""Token budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratamem import constants as K
from stratamem.operators.records import latest_by_key


def layer_limit(layer: Column, budgets: dict[str, int] = K.LAYER_BUDGET) -> Column:
    pairs = [F.lit(x) for item in budgets.items() for x in item]
    return F.create_map(*pairs)[layer]


def budget_prefix(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                  limit: Column, tokens: str = "token_estimate") -> DataFrame:
    """Rows of each group before the first one that would overflow ``limit``.

    Pinned rows come first, then ``order``. Token counts are never negative, so
    the running total crosses the limit once and a filter on it is the prefix.
    """
    window = (Window.partitionBy(*keys)
              .orderBy(F.col("is_pinned").desc(), *order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (df.withColumn("used_tokens", F.sum(tokens).over(window))
            .filter(F.col("used_tokens") <= limit))


def recorded_usage(log: DataFrame, owner: str, part: str, resets: DataFrame | None = None) -> DataFrame:
    """The tokens last recorded per owner and part, without what the owner's last reset wiped.

    ``log`` (owner, part, seq, tokens) and ``resets`` (owner, seq) share one sequence. A
    part with very many records sends one row per task.
    """
    last = latest_by_key(log, [owner, part])
    if resets is None:
        return last
    wiped = resets.groupBy(owner).agg(F.max("seq").alias("_reset"))
    return last.join(wiped, owner, "left").filter(
        F.col("_reset").isNull() | (F.col("seq") > F.col("_reset"))).drop("_reset")


def total_usage(usage: DataFrame, owner: str) -> DataFrame:
    """Tokens and parts per owner."""
    return usage.groupBy(owner).agg(F.sum("tokens").alias("total"), F.count(F.lit(1)).alias("fields"))


def allocation(spark: SparkSession, total: int = K.TOTAL_BUDGET) -> DataFrame:
    """One row with the fixed and per-layer budgets and what remains."""
    used = sum(K.FIXED_BUDGET.values()) + sum(K.LAYER_BUDGET.values())
    row = {**K.FIXED_BUDGET, **K.LAYER_BUDGET, "total_available": total,
           "total_used": used, "remaining": total - used}
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in row.items()])
