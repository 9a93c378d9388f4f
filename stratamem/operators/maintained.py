"""Statistics that stay current: additive deltas from a change log, folded into small tables.

A change carries an item's contribution before and after it. The old one counts minus one and
the new one plus one, so an insert is a plus row, a delete a minus row, and an update both.
Folding deltas gives the statistics of all items without reading them again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratamem.operators import lifecycle

DAY_MICROS = 86_400_000_000
DELETE = "delete"


def change_images(log: DataFrame, key: str, fields: Sequence[str], seq: str = "seq", op: str = "op") -> DataFrame:
    """Every log row with what its item contributed before and contributes after: key, seq, before, after.

    ``log`` holds an item's changes from its first one on, numbered per item by ``seq``, each
    with the whole item; a delete leaves nothing. Only the log is read.
    """
    after = F.when(F.col(op) != DELETE, F.struct(*fields))
    return log.select(key, seq, after.alias("after")).withColumn(
        "before", F.lag("after").over(Window.partitionBy(key).orderBy(seq)))


def signed(changes: DataFrame) -> DataFrame:
    """Plus and minus rows: the contribution's fields and ``sign``."""
    both = F.array(F.struct(F.lit(1).alias("sign"), F.col("after").alias("image")),
                   F.struct(F.lit(-1).alias("sign"), F.col("before").alias("image")))
    return changes.select(F.explode(both).alias("side")).filter(F.col("side.image").isNotNull()).select(
        "side.image.*", F.col("side.sign").alias("sign"))


def fold(parts: Sequence[DataFrame], keys: Sequence[str], counts: Sequence[str]) -> DataFrame:
    """The sum of a statistic's table and its deltas; keys that nothing contributes to any more go."""
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    sums = every.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts])
    some = F.lit(False)
    for c in counts:
        some = some | (F.col(c) != 0)
    return sums.filter(some) if keys else sums


# -- terms ------------------------------------------------------------------------------


def doc_freq_delta(rows: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Change of the number of texts per term; what a change leaves in place cancels before the shuffle."""
    return (rows.select("sign", F.explode_outer(F.array_distinct(tokens)).alias("term"))
            .filter(F.col("term").isNotNull()).groupBy("term").agg(F.sum("sign").alias("df")).filter(F.col("df") != 0))


def corpus_delta(rows: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Change of the number of texts and of tokens, one row."""
    return rows.agg(F.coalesce(F.sum("sign"), F.lit(0)).alias("docs"),
                    F.coalesce(F.sum(F.col("sign") * F.size(tokens)), F.lit(0)).alias("tokens"))


# -- retention ----------------------------------------------------------------------------


def retention_fields(items: DataFrame, as_of: Column,
                     policy: lifecycle.RetentionPolicy = lifecycle.DEFAULT_POLICY) -> DataFrame:
    """Add ``state`` (dead, protected or live) and ``due``, the microsecond of its next step.

    Neither depends on when it is computed, so a contribution stays valid as time goes on.
    """
    marked = lifecycle.with_retention(items, as_of, policy)
    dead = F.coalesce("is_deprecated", F.lit(False))
    safe = F.col("immune") | F.col("ttl_days").isNull()
    seen = F.unix_micros(F.coalesce("last_accessed_at", "created_at").cast("timestamp"))
    due = F.when(dead, F.unix_micros(F.col("deprecated_at").cast("timestamp")) + policy.grace_days * DAY_MICROS).when(
        ~safe, seen + F.ceil(F.col("ttl_days") * DAY_MICROS))
    return marked.withColumn("state", F.when(dead, "dead").when(safe, "protected").otherwise("live")).withColumn(
        "due", due.cast("long"))


def gc_delta(rows: DataFrame, by: Sequence[str] = ("collection",)) -> DataFrame:
    """Change of the number of items per key, state and due time."""
    return rows.groupBy(*by, "state", "due").agg(F.sum("sign").alias("items")).filter(F.col("items") != 0)


def gc_stats(state: DataFrame, as_of: Column, by: Sequence[str] = ("collection",),
             policy: lifecycle.RetentionPolicy = lifecycle.DEFAULT_POLICY) -> DataFrame:
    """The counts of ``lifecycle.gc_stats`` at any time, from the folded table alone."""
    left = F.col("due") - F.unix_micros(as_of.cast("timestamp"))
    soon = (left > 0) & (left <= policy.warn_days * DAY_MICROS)

    def held(condition: Column, name: str) -> Column:
        return F.sum(F.when(condition, F.col("items")).otherwise(0)).alias(name)

    kind = F.col("state")
    return state.groupBy(*by).agg(
        F.sum("items").alias("total_items"), held(kind == "protected", "protected"),
        held((kind == "live") & soon, "expiring_soon_14d"), held(kind == "dead", "already_deprecated"),
        held((kind == "dead") & (left <= 0), "pending_hard_delete"))
