"""Retention queries over all items."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratamem import constants as K
from stratamem.catalog import base as b
from stratamem.functions import scoring
from stratamem.operators import lifecycle as lc
from stratamem.sources import tables

TIME = "yyyy-MM-dd HH:mm:ss"


def _items(spark, base):
    return lc.with_collection(tables.memory_items(spark, base))


def gc_plan(spark, base):
    """Action and reason for every item."""
    plan = lc.gc_plan(_items(spark, base), tables.as_of())
    return plan.select("id", "collection", "action", "reason",
                       scoring.round4(F.col("ttl_days")).alias("ttl_days"),
                       scoring.round4(F.col("age_days")).alias("age_days"))


def gc_run_totals(spark, base):
    """Actions per collection and in total."""
    return lc.gc_totals(lc.gc_plan(_items(spark, base), tables.as_of()))


def gc_log(spark, base):
    log = lc.gc_log(lc.gc_plan(_items(spark, base), tables.as_of()), "run-1", tables.as_of())
    return log.withColumn("created_at", F.date_format("created_at", TIME))


def gc_apply(spark, base):
    """The items left after a run, counted by state and deletion mark."""
    after = lc.gc_apply(lc.gc_plan(_items(spark, base), tables.as_of()), tables.as_of())
    return after.groupBy("collection", "is_deprecated", F.date_format("deprecated_at", TIME).alias("marked")).agg(
        F.count(F.lit(1)).alias("items"))


def gc_stats(spark, base):
    return lc.gc_stats(_items(spark, base), tables.as_of())


def gc_stats_by_user(spark, base):
    return lc.gc_stats(_items(spark, base), tables.as_of(), ["user_id"])


def hard_delete_anti(spark, base):
    """Items that remain once those past their grace period are deleted."""
    items = _items(spark, base)
    doomed = lc.gc_plan(items, tables.as_of()).filter(F.col("action") == "deleted").select("id")
    return lc.hard_delete(items, doomed).select("id", "memory_layer", "user_id")


def delete_by_user(spark, base):
    left = lc.delete_user(_items(spark, base), "fr")
    return left.groupBy("user_id").agg(F.count(F.lit(1)).alias("items"))


def collections(spark, base):
    """Every collection with its items."""
    return _items(spark, base).groupBy("collection").agg(F.count(F.lit(1)).alias("items"))


QUERIES = {f.__name__: f for f in (
    gc_plan, gc_run_totals, gc_log, gc_apply, gc_stats, gc_stats_by_user, hard_delete_anti,
    delete_by_user, collections)}

_PLAN = f"""WITH {b.ITEMS}, stored AS (SELECT *,
    CASE WHEN memory_layer = 'L4' THEN 'ctx_users'
      ELSE 'ctx_' || {b.project_slug("coalesce(project, '')")} END AS collection,
    is_pinned OR memory_layer = 'L4' OR importance >= 1e0 OR coalesce(item_type = 'skill', false) AS immune,
    CASE memory_layer WHEN 'L2' THEN 30e0 WHEN 'L3' THEN 90e0 END * (1e0 + importance * 3e0) AS ttl_days,
    {b.age_days('coalesce(last_accessed_at, created_at)')} AS age_days,
    coalesce(floor({b.age_days('deprecated_at')}) >= {K.GRACE_DAYS}, false) AS grace_over FROM items),
  acted AS (SELECT *, CASE WHEN is_deprecated AND grace_over THEN 'deleted' WHEN is_deprecated THEN 'waiting'
      WHEN NOT immune AND coalesce(age_days >= ttl_days, false) THEN 'deprecated' ELSE 'skipped' END AS action
    FROM stored),
  plan AS (SELECT *, CASE action WHEN 'deleted' THEN 'grace period expired' WHEN 'deprecated'
      THEN 'not accessed for ' || CAST(trunc(ttl_days) AS BIGINT) || ' days' END AS reason FROM acted)"""
_STATS = """count(*) AS total_items,
  CAST(count(*) FILTER (NOT is_deprecated AND (immune OR ttl_days IS NULL)) AS BIGINT) AS protected,
  CAST(count(*) FILTER (NOT is_deprecated AND NOT (immune OR ttl_days IS NULL)
    AND ttl_days - age_days > 0 AND ttl_days - age_days <= 14) AS BIGINT) AS expiring_soon_14d,
  CAST(count(*) FILTER (is_deprecated) AS BIGINT) AS already_deprecated,
  CAST(count(*) FILTER (is_deprecated AND grace_over) AS BIGINT) AS pending_hard_delete"""

ORACLE = {
    "gc_plan": f"""{_PLAN} SELECT id, collection, action, reason, {b.round4('ttl_days')} AS ttl_days,
      {b.round4('age_days')} AS age_days FROM plan""",
    "gc_run_totals": f"""{_PLAN} SELECT collection, count(*) FILTER (action = 'deprecated') AS deprecated,
      count(*) FILTER (action = 'deleted') AS deleted, count(*) FILTER (action = 'skipped') AS skipped
      FROM plan GROUP BY ROLLUP (collection)""",
    "gc_log": f"""{_PLAN} SELECT 'run-1' AS run_id, CAST(id AS VARCHAR) AS item_id, collection, memory_layer,
      action, reason, strftime({b.NOW}, '%Y-%m-%d %H:%M:%S') AS created_at
      FROM plan WHERE action IN ('deleted', 'deprecated')""",
    "gc_apply": f"""{_PLAN} SELECT collection, is_deprecated OR action = 'deprecated' AS is_deprecated,
      strftime(CASE WHEN action = 'deprecated' THEN {b.NOW} ELSE deprecated_at END, '%Y-%m-%d %H:%M:%S') AS marked,
      count(*) AS items FROM plan WHERE action <> 'deleted' GROUP BY ALL""",
    "gc_stats": f"{_PLAN} SELECT {_STATS} FROM plan",
    "gc_stats_by_user": f"{_PLAN} SELECT user_id, {_STATS} FROM plan GROUP BY user_id",
    "hard_delete_anti": f"{_PLAN} SELECT id, memory_layer, user_id FROM plan WHERE action <> 'deleted'",
    "delete_by_user": f"""WITH {b.ITEMS} SELECT user_id, count(*) AS items FROM items
      WHERE user_id IS DISTINCT FROM 'fr' GROUP BY user_id""",
    "collections": f"{_PLAN} SELECT collection, count(*) AS items FROM plan GROUP BY collection",
}
