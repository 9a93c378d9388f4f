"""Append-only change logs with a latest-state view, and record listings.

Parquet files are immutable, so every mutation is an appended event: ``upsert``
carries the whole item, ``touch``, ``deprecate`` and ``delete`` only an id. The
state is what the events of an id add up to, and compaction rewrites it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratamem.functions import text
from stratamem.operators.topn import top_n_per_group


def latest_by_key(log: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """The newest row of each key.

    The row limit applies before the shuffle, so a key with very many versions
    sends one row per task.
    """
    return top_n_per_group(log, keys, [F.col(seq).desc()], 1)


def fold_events(log: DataFrame) -> DataFrame:
    """Current items of a log of (seq, op, id, ts, reason, item).

    An item is visible from its last upsert after the last delete; touches and
    deprecations since that upsert apply to it. One aggregation with map-side
    combine does it in two steps: the last upsert and delete, then later marks.
    """
    c = F.col

    def at(op: str, value: Column) -> Column:
        return F.when(c("op") == op, value)

    marks = F.struct("seq", "ts", "reason")
    place = [n for n in ("collection",) if n in log.columns]
    # Only the sequence decides; a struct with maps could not be compared.
    newest = F.max_by(F.struct("seq", "item", *place), F.when(c("op") == "upsert", c("seq")))
    folded = log.groupBy("id").agg(
        newest.alias("up"),
        F.max(at("delete", c("seq"))).alias("deleted_seq"),
        F.max(at("touch", F.struct("seq", "ts"))).alias("touched"),
        F.max(at("deprecate", marks)).alias("dead"))
    live = folded.filter(c("up").isNotNull() & (
        c("deleted_seq").isNull() | (c("up.seq") > c("deleted_seq"))))
    later_touch = c("touched.seq") > c("up.seq")
    later_dead = F.coalesce(c("dead.seq") > c("up.seq"), F.lit(False))
    return (live.select("id", c("up.item").alias("item"), *[c(f"up.{n}").alias(n) for n in place],
                        F.when(later_touch, c("touched.ts")).alias("t"),
                        F.when(later_dead, c("dead")).alias("d"), later_dead.alias("is_dead"))
            .select("id", *place, *[f"item.{n}" for n in log.schema["item"].dataType.names if n != "id"],
                    F.col("t").alias("_touched"), F.col("d").alias("_dead"), "is_dead")
            .withColumn("last_accessed_at", F.coalesce("_touched", "last_accessed_at"))
            .withColumn("is_deprecated", c("is_dead") | F.coalesce("is_deprecated", F.lit(False)))
            .withColumn("deprecated_at", F.coalesce("_dead.ts", "deprecated_at"))
            .withColumn("deprecated_reason", F.coalesce("_dead.reason", "deprecated_reason"))
            .drop("_touched", "_dead", "is_dead"))


def touch(items: DataFrame, accesses: DataFrame, key: str = "id") -> DataFrame:
    """Apply the newest access time per item; accesses of unknown ids vanish.

    ``accesses`` (key, ts) is reduced to one row per item before the join.
    """
    newest = accesses.groupBy(key).agg(F.max("ts").alias("_ts"))
    return (items.join(newest, key, "left")
            .withColumn("last_accessed_at", F.greatest("last_accessed_at", "_ts")).drop("_ts"))


def deprecate(items: DataFrame, marks: DataFrame, key: str = "id") -> DataFrame:
    """Soft-delete the user's own items named in ``marks`` (key, user_id, ts, reason)."""
    newest = marks.groupBy(key, "user_id").agg(F.max(F.struct("ts", "reason")).alias("_m"))
    hit = F.col("_m").isNotNull()
    return (items.join(newest, [key, "user_id"], "left")
            .withColumn("is_deprecated", F.col("is_deprecated") | hit)
            .withColumn("deprecated_at", F.coalesce("_m.ts", "deprecated_at"))
            .withColumn("deprecated_reason", F.when(hit, F.col("_m.reason")))
            .drop("_m"))


def session_counters(messages: DataFrame, keys: Sequence[str] = ("user_id", "session_id")) -> DataFrame:
    return messages.groupBy(*keys).agg(
        F.sum(text.token_estimate(F.col("content"))).alias("token_count"),
        F.count(F.lit(1)).alias("message_count"))


def fold_sessions(log: DataFrame, keys: Sequence[str] = ("user_id", "session_id")) -> DataFrame:
    """Current session records of a log (keys, op, seq, created_at, and what a session holds).

    ``op`` is create, update or delete. The newest row says what a session holds, its
    last creation when it was created; updates of sessions that do not exist at the time
    vanish. One aggregation with map-side combine.
    """
    c = F.col

    def last(op: str) -> Column:
        return F.max(F.when(c("op") == op, F.struct("seq", "created_at")))

    held = [n for n in log.columns if n not in (*keys, "op", "seq", "created_at")]
    folded = log.groupBy(*keys).agg(
        last("create").alias("_born"), last("delete").alias("_gone"),
        F.max_by(F.struct(*held), F.when(c("op") != "delete", c("seq"))).alias("_now"))
    alive = c("_born").isNotNull() & (c("_gone").isNull() | (c("_born.seq") > c("_gone.seq")))
    return folded.filter(alive).select(*keys, *[c(f"_now.{n}").alias(n) for n in held],
                                       c("_born.created_at").alias("created_at"))


def window_after_clear(messages: DataFrame, clears: DataFrame, keys: Sequence[str] = ("user_id", "session_id"),
                       n: int = 20) -> DataFrame:
    """The newest ``n`` messages of each key sent after its last clear event.

    The newest rows are taken first: a clear can only cut their older end, and a
    long session never meets the join whole.
    """
    order = [F.col("seq").desc(), *[F.col(c).desc() for c in ("id",) if c in messages.columns]]
    newest = top_n_per_group(messages, keys, order, n, rank_col="pos")
    last = clears.groupBy(*keys).agg(F.max("seq").alias("_cleared"))
    alive = F.col("_cleared").isNull() | (F.col("seq") > F.col("_cleared"))
    return newest.join(last, list(keys), "left").filter(alive).drop("_cleared")


def only(df: DataFrame, **equals: object) -> DataFrame:
    """Equality filters; a None or empty value means no filter on that column."""
    for name, value in equals.items():
        if value not in (None, ""):
            df = df.filter(F.col(name) == value)
    return df


def newest_first(df: DataFrame, limit: int, key: str = "id") -> DataFrame:
    return df.orderBy(F.col("created_at").desc(), F.col(key)).limit(limit)


def newest_per_user(df: DataFrame, limit: int, key: str = "id") -> DataFrame:
    """The same listing for every user at once; adds ``pos`` from 1."""
    return top_n_per_group(df, ["user_id"], [F.col("created_at").desc(), F.col(key)], limit, rank_col="pos")


def apply_updates(tasks: DataFrame, updates: DataFrame, key: str = "id") -> DataFrame:
    """Partial update by the owner: nulls keep, an empty title keeps, an empty
    description is taken. ``updates`` has one row per task.
    """
    c = F.col
    changes = updates.select(key, "user_id", *[c(n).alias(f"_{n}") for n in
                                               ("status", "priority", "title", "description")])
    return (tasks.join(changes, [key, "user_id"], "left")
            .withColumn("status", F.coalesce(F.nullif("_status", F.lit("")), "status"))
            .withColumn("priority", F.coalesce(F.nullif("_priority", F.lit("")), "priority"))
            .withColumn("title", F.coalesce(F.nullif("_title", F.lit("")), "title"))
            .withColumn("description", F.coalesce("_description", "description"))
            .drop("_status", "_priority", "_title", "_description"))


def insert_unique(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` whose every unique key is free, for appending.

    Of new rows that share a key the first by all keys' values stays, one key after the
    other, so what is returned is unique in itself.
    """
    names = new.columns
    for key in keys:
        new = new.join(existing.select(key), key, "left_anti")
        new = top_n_per_group(new, [key], [F.col(k).asc_nulls_last() for k in keys], 1)
    return new.select(names)
