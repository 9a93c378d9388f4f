"""Retention: what to expire, what to delete, and statistics.

All decisions depend on one row at a time, so a pass over the items needs no
shuffle until counts are taken, and those are combined before they move.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamem import constants as K
from stratamem.functions import retention, routing, text
from stratamem.functions.scoring import age_days


@dataclass(frozen=True)
class RetentionPolicy:
    base_ttl_days: dict[str, int] = field(default_factory=lambda: dict(K.BASE_TTL_DAYS))
    grace_days: int = K.GRACE_DAYS
    importance_factor: float = K.TTL_IMPORTANCE_FACTOR
    warn_days: int = K.EXPIRING_WITHIN_DAYS


DEFAULT_POLICY = RetentionPolicy()


def policy_from_conf(spark: SparkSession, prefix: str = "spark.stratamem.gc.") -> RetentionPolicy:
    """The policy with values taken from the session's settings where present."""
    def setting(name: str, default: float) -> float:
        return float(spark.conf.get(prefix + name, str(default)))

    ttl = {layer: int(setting(f"{layer.lower()}BaseTtlDays", days)) for layer, days in K.BASE_TTL_DAYS.items()}
    return RetentionPolicy(ttl, int(setting("gracePeriodDays", K.GRACE_DAYS)),
                           setting("importanceMultiplier", K.TTL_IMPORTANCE_FACTOR))


def _metadata_type(items: DataFrame) -> Column:
    return F.col("metadata")["type"] if "metadata" in items.columns else F.lit(None).cast("string")


def with_retention(items: DataFrame, as_of: Column, policy: RetentionPolicy = DEFAULT_POLICY) -> DataFrame:
    """Add immune, ttl_days, age_days, expired and grace_over."""
    c = F.col
    last_seen = F.coalesce(c("last_accessed_at"), c("created_at"))
    base = retention.base_ttl_days(c("memory_layer"), policy.base_ttl_days)
    ttl = base * (1.0 + F.coalesce(c("importance"), F.lit(0.5)) * policy.importance_factor)
    return (items
            .withColumn("immune", retention.is_immune(
                c("is_pinned"), c("memory_layer"), c("importance"), _metadata_type(items), c("item_type")))
            .withColumn("ttl_days", ttl)
            .withColumn("age_days", age_days(last_seen, as_of))
            .withColumn("expired", F.coalesce(F.col("age_days") >= F.col("ttl_days"), F.lit(False)))
            .withColumn("grace_over", retention.grace_over(c("deprecated_at"), as_of, policy.grace_days)))


def gc_plan(items: DataFrame, as_of: Column, policy: RetentionPolicy = DEFAULT_POLICY) -> DataFrame:
    """One row per item with its action and reason.

    Deprecated items past their grace period are ``deleted``; live, mutable items
    past their time to live are ``deprecated``; other live items are ``skipped``
    and deprecated items still in grace are ``waiting``. An item deprecated by a
    run is never deleted by the same run.
    """
    c = F.col
    marked = with_retention(items, as_of, policy)
    dead = F.coalesce(c("is_deprecated"), F.lit(False))
    action = (F.when(dead & c("grace_over"), "deleted")
              .when(dead, "waiting")
              .when(~c("immune") & c("expired"), "deprecated")
              .otherwise("skipped"))
    reason = (F.when(c("action") == "deleted", "grace period expired")
              .when(c("action") == "deprecated", F.concat(
                  F.lit("not accessed for "), c("ttl_days").cast("long").cast("string"), F.lit(" days"))))
    return marked.withColumn("action", action).withColumn("reason", reason)


def gc_totals(plan: DataFrame) -> DataFrame:
    """Actions per collection, and over all collections in the row without one."""
    def count_of(action: str) -> Column:
        return F.count_if(F.col("action") == action).alias(action)

    return plan.rollup("collection").agg(*[count_of(a) for a in ("deprecated", "deleted", "skipped")])


def gc_log(plan: DataFrame, run_id: str, as_of: Column) -> DataFrame:
    return plan.filter(F.col("action").isin("deleted", "deprecated")).select(
        F.lit(run_id).alias("run_id"), F.col("id").cast("string").alias("item_id"), "collection",
        F.coalesce("memory_layer", F.lit("unknown")).alias("memory_layer"), "action", "reason",
        as_of.alias("created_at"))


def gc_apply(plan: DataFrame, as_of: Column) -> DataFrame:
    """The items after the run: deleted rows gone, expired ones marked."""
    expired = F.col("action") == "deprecated"
    return (plan.filter(F.col("action") != "deleted")
            .withColumn("is_deprecated", F.col("is_deprecated") | expired)
            .withColumn("deprecated_at", F.when(expired, as_of).otherwise(F.col("deprecated_at")))
            .withColumn("deprecated_reason", F.when(expired, F.lit(K.EXPIRED_REASON)).otherwise(
                F.col("deprecated_reason") if "deprecated_reason" in plan.columns else F.lit(None).cast("string")))
            .drop("immune", "ttl_days", "age_days", "expired", "grace_over", "action", "reason"))


def hard_delete(items: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return items.join(ids.select(key), key, "left_anti")


def delete_user(items: DataFrame, user_id: str) -> DataFrame:
    return items.filter(~F.col("user_id").eqNullSafe(F.lit(user_id)))


def gc_stats(items: DataFrame, as_of: Column, by: list[str] | None = None,
             policy: RetentionPolicy = DEFAULT_POLICY) -> DataFrame:
    """Counts of mutually exclusive buckets in one pass, optionally per key.

    Items that have expired but were not swept yet are counted in the total only.
    """
    c = F.col
    dead = F.coalesce(c("is_deprecated"), F.lit(False))
    protected = c("immune") | c("ttl_days").isNull()
    remaining = c("ttl_days") - c("age_days")
    soon = (remaining > 0) & (remaining <= policy.warn_days)
    return with_retention(items, as_of, policy).groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("total_items"),
        F.count_if(~dead & protected).alias("protected"),
        F.count_if(~dead & ~protected & soon).alias("expiring_soon_14d"),
        F.count_if(dead).alias("already_deprecated"),
        F.count_if(dead & c("grace_over")).alias("pending_hard_delete"))


def with_collection(items: DataFrame) -> DataFrame:
    """Add the collection an item lives in, which is also the storage partition."""
    return items.withColumn("collection", routing.collection_of_item(
        F.col("memory_layer"), text.project_slug(F.coalesce("project", F.lit("")))))
