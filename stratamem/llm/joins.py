"""Joins for keys that may hold a large share of all rows, and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratamem.operators.bounded import MAX_BROADCAST_BYTES, MAX_BROADCAST_ROWS, broadcast_if_small
from stratamem.session import discard, materialize

# Bits per key where keys are shipped as bits, two of them set: about one in seventy other rows passes at most.
KEY_BITS = 16
# Bits of a row of them, as bitmap_construct_agg makes it.
BITMAP = 1 << 15


def _marked(rows: DataFrame, key: str, keys: DataFrame, n: int) -> DataFrame:
    """Rows with ``_may``: true for every row whose key is among the ``n`` keys, and for few others.

    The keys are broadcast as bits at the places of their hashes.
    """
    buckets = max(1, -(-min(n * KEY_BITS, 8 * MAX_BROADCAST_BYTES) // BITMAP))

    def bucket(c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(buckets))

    def spots(c: str) -> list[Column]:
        return [F.pmod(F.xxhash64(c, F.lit(k)), F.lit(BITMAP)) for k in (1, 2)]

    def hit(spot: str) -> Column:
        byte = F.conv(F.hex(F.expr(f"substring(_bits, cast({spot} div 8 as int) + 1, 1)")), 16, 10).cast("long")
        return byte.bitwiseAND(F.expr(f"shiftleft(1L, cast({spot} % 8 as int))")) != 0

    name = keys.columns[0]
    marks = keys.select(bucket(name).alias("_bucket"), F.explode(F.array(*spots(name))).alias("_spot")).groupBy(
        "_bucket").agg(F.bitmap_construct_agg("_spot").alias("_bits"))
    one, other = spots(key)
    spotted = rows.withColumn("_bucket", bucket(key)).withColumn("_one", one).withColumn("_other", other)
    return spotted.join(F.broadcast(marks), "_bucket", "left").withColumn(
        "_may", F.coalesce(hit("_one") & hit("_other"), F.lit(False))).select(*rows.columns, "_may")


def rows_of_keys(rows: DataFrame, key: str, keys: DataFrame, n: int, limit: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """All rows whose ``key`` is among the ``n`` keys (one column, null too), without moving any.

    Where the keys are over ``limit``, and so too many to be broadcast, a few other rows come as well.
    """
    if n > limit:
        return _marked(rows, key, keys, n).filter("_may").drop("_may")
    return rows.join(F.broadcast(keys), rows[key].eqNullSafe(keys[keys.columns[0]]), "left_semi")


def rows_without_keys(rows: DataFrame, key: str, keys: DataFrame, n: int, limit: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """The rows whose ``key`` is not among the ``n`` distinct keys (one column, null too).

    Where the keys are too many to be broadcast, rows that surely stay are told by bits; of
    the others only the keys move, to find those that stay as well.
    """
    def among(one: DataFrame, many: DataFrame, how: str) -> DataFrame:
        return one.join(many, one[key].eqNullSafe(many[many.columns[0]]), how)

    if n <= limit:
        return among(rows, F.broadcast(keys), "left_anti")
    marked = _marked(rows, key, keys, n)
    spared = materialize(among(marked.filter("_may").select(key).distinct(), keys, "left_anti").select(
        F.col(key).alias("_spared")), "spared-keys")
    n_spared = spared.count()
    doubtful = marked.filter("_may").drop("_may")
    if n_spared > limit:
        stay = among(rows_of_keys(doubtful, key, spared, n_spared, limit), spared, "left_semi")
    else:
        stay = rows_of_keys(doubtful, key, spared, n_spared, limit)
    return marked.filter("NOT _may").drop("_may").unionByName(stay)


def left_join_unique(rows: DataFrame, table: DataFrame, key: str | list[str], count: str, total: int,
                     limit: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Left join with a table that holds each key once and, in ``count``, its number of rows.

    ``total`` is the number of rows, so at most ``limit`` keys can have more than
    total / limit of them: those are broadcast and their rows never shuffled. The rest of
    the table is joined by key, none of its keys being frequent. Both inputs are read
    twice and should be written tables.
    """
    often = max(total // limit, 1000)
    frequent = table.filter(F.col(count) > often)
    marked = rows.join(F.broadcast(frequent), key, "left")
    held = marked.filter(F.col(count).isNotNull())
    rest = marked.filter(F.col(count).isNull()).select(rows.columns)
    return held.unionByName(rest.join(table.filter(F.col(count) <= often), key, "left"))


def components(edges: DataFrame, label: str = "components") -> DataFrame | None:
    """Connected components of written edges (a, b): each node with its component's name.

    Every round merges each node with its smallest neighbour and keeps the edges between
    what remains; names should be hashes, so that a round removes a constant share of the
    nodes whatever the shape. None if there is no edge.
    """
    rounds, found = 0, None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
            edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        up = materialize(both.groupBy("node").agg(F.min("other").alias("other")).select(
            "node", F.least("node", "other").alias("up")), f"{label}-up-{rounds}")
        n = up.count()
        if found is None:
            found = up.withColumnRenamed("up", "component")
        else:
            step = broadcast_if_small(up.select(F.col("node").alias("component"), "up"), n)
            found = found.join(step, "component", "left").select(
                "node", F.coalesce("up", "component").alias("component"))
        ends = [broadcast_if_small(up.select(F.col("node").alias(c), F.col("up").alias(f"{c}_up")), n) for c in "ab"]
        last, edges = edges, materialize(edges.join(ends[0], "a").join(ends[1], "b").filter("a_up <> b_up").select(
            F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).distinct(),
            f"{label}-edges-{rounds}")
        if rounds:
            discard(last)  # the first edges are the caller's
        rounds += 1
    return materialize(found, label) if found is not None else None
