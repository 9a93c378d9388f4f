"""Retention by timers: one deadline per item, moved by touches and pins.

Instead of planning over all items at every tick, state holds what each item's deadline
depends on. Items lie in slices of a few hundred with a timer at the slice's earliest deadline.
When event time passes an item's deadline it is deprecated, and when its grace period ends it is
deleted; slices without an item that is due are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from stratamem.functions import retention
from stratamem.operators import lifecycle

DAY_MICROS = 86_400_000_000
PUT, TOUCH, PIN, UNPIN, DELETE = "put", "touch", "pin", "unpin", "delete"
CHANGE = ("id long, ts timestamp, op string, ttl_micros long, seen_micros long, deprecated_micros long, "
          "immune boolean, is_pinned boolean, memory_layer string, collection string")
EXPIRED = "id long, collection string, memory_layer string, action string, at timestamp"
_STATE = ("id long, ttl_micros long, seen_micros long, deprecated_micros long, immune boolean, is_pinned boolean, "
          "memory_layer string, collection string, due long")
_FIELDS = [f.split()[0] for f in _STATE.split(", ")]
# Items share state and timers in so many slices; a slice of a few hundred is read and written at once.
SLICES = 1024
SLICE_ITEMS = 256


def item_changes(items: DataFrame, at, policy: lifecycle.RetentionPolicy = lifecycle.DEFAULT_POLICY) -> DataFrame:
    """Put changes, known at the time ``at``, for items as retention knows them (with their collection)."""
    marked = lifecycle.with_retention(items.withColumns({
        "pinned": F.coalesce("is_pinned", F.lit(False)), "is_pinned": F.lit(False)}), at, policy)
    dead = F.coalesce("is_deprecated", F.lit(False))
    return marked.select(
        F.col("id").cast("long").alias("id"), at.alias("ts"), F.lit(PUT).alias("op"),
        F.ceil(F.col("ttl_days") * DAY_MICROS).cast("long").alias("ttl_micros"),
        F.unix_micros(F.coalesce("last_accessed_at", "created_at").cast("timestamp")).alias("seen_micros"),
        # A deprecated item without a time is never past its grace; the far future stands for that.
        F.when(dead, F.coalesce(F.unix_micros(F.col("deprecated_at").cast("timestamp")), F.lit(1 << 61))).alias("deprecated_micros"),
        "immune", F.col("pinned").alias("is_pinned"), F.coalesce("memory_layer", F.lit("unknown")).alias("memory_layer"),
        "collection")


def touches(rows: DataFrame, op: str = TOUCH) -> DataFrame:
    """Changes of another kind from rows with id and ts; a touch counts as an access at its time."""
    return rows.select(
        F.col("id").cast("long").alias("id"), "ts", F.lit(op).alias("op"), F.lit(None).cast("long").alias("ttl_micros"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("seen_micros"),
        *[F.lit(None).cast(t).alias(n) for n, t in (
            ("deprecated_micros", "long"), ("immune", "boolean"), ("is_pinned", "boolean"), ("memory_layer", "string"),
            ("collection", "string"))])


class ItemTimers(StatefulProcessor):
    """Keeps the deadlines of a slice of items; emits a row for each that passes.

    The slice is one state with one timer, at its earliest deadline: a call to the state store
    costs milliseconds, whether it carries one item or some hundred.
    """

    def __init__(self, grace_days: int):
        self.grace = grace_days * DAY_MICROS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getListState("items", _STATE)
        self.timer = handle.getValueState("timer", "due long")

    def _deadline(self, item: dict) -> int | None:
        """Milliseconds of event time from which the item is due, rounded up."""
        if item["deprecated_micros"] is not None:
            due = item["deprecated_micros"] + self.grace
        elif item["immune"] or item["is_pinned"] or item["ttl_micros"] is None or item["seen_micros"] is None:
            return None
        else:
            due = item["seen_micros"] + item["ttl_micros"]
        return -(-due // 1000)

    def _held(self) -> dict[int, dict]:
        rows = self.items.get() if self.items.exists() else ()
        return {r[0]: dict(zip(_FIELDS, r)) for r in rows}

    def _set_timer(self) -> int | None:
        return self.timer.get()[0] if self.timer.exists() else None

    def _keep(self, items: dict[int, dict], set_for: int | None) -> None:
        """Write the slice; ``set_for`` is the time its timer is set for now."""
        if items:
            self.items.put([tuple(item.values()) for item in items.values()])
        else:
            self.items.clear()
        due = min((item["due"] for item in items.values() if item["due"] is not None), default=None)
        if due == set_for:
            return
        if set_for is not None:
            self.handle.deleteTimer(set_for)
        if due is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(due)
            self.timer.update((due,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        items = self._held()
        order = {DELETE: 0, PUT: 1}  # of one instant a delete comes first, then a put
        changes = pd.concat(list(rows), ignore_index=True)
        changes["place"] = [order.get(op, 2) for op in changes["op"]]
        changes = changes.sort_values(["ts", "place"], kind="stable")[["op", *_FIELDS[:-1]]].astype(object)
        changed = set()
        for op, i, *facts in changes.where(changes.notna(), None).itertuples(index=False, name=None):
            item = items.get(i)
            if op == PUT:
                item = items[i] = dict(zip(_FIELDS, (i, *facts, None)))
                for n in ("ttl_micros", "seen_micros", "deprecated_micros"):
                    item[n] = None if item[n] is None else int(item[n])
            elif item is None:
                continue  # nothing is known of the item, or it is gone
            elif op == TOUCH:
                item["seen_micros"] = max(item["seen_micros"] or 0, int(facts[1]))
            elif op in (PIN, UNPIN):
                item["is_pinned"] = op == PIN
            elif op == DELETE:
                del items[i]
            changed.add(i)
        if changed:
            for i in changed & items.keys():
                items[i]["due"] = self._deadline(items[i])
            self._keep(items, self._set_timer())
        yield from ()  # changes alone expire nothing

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self._set_timer() != expiredTimerInfo.getExpiryTimeInMs():
            return
        now = timerValues.getCurrentWatermarkInMs()
        items, expired = self._held(), []
        for i, item in list(items.items()):
            if item["due"] is None or item["due"] > now:
                continue
            action = "deleted" if item["deprecated_micros"] is not None else "deprecated"
            expired.append((i, item["collection"], item["memory_layer"], action, pd.Timestamp(now, unit="ms")))
            if action == "deleted":
                del items[i]
            else:
                item["deprecated_micros"] = now * 1000
                item["due"] = self._deadline(item)
        self._keep(items, self._set_timer())
        yield pd.DataFrame(expired, columns=["id", "collection", "memory_layer", "action", "at"])

    def close(self) -> None:
        pass


def slices_for(items: int) -> int:
    """Slices for so many items, ``SLICE_ITEMS`` in each."""
    return max(1, -(-items // SLICE_ITEMS))


def expiry_stream(changes: DataFrame, delay: str = "0 seconds",
                  policy: lifecycle.RetentionPolicy = lifecycle.DEFAULT_POLICY, slices: int = SLICES) -> DataFrame:
    """What falls due as event time goes on, for append mode.

    ``changes`` has the columns of ``CHANGE``; rows without an id only move the time. Changes
    later than ``delay`` behind the newest time are dropped. An item is deprecated at its
    deadline and deleted a grace period later. ``slices`` stays the same for as long as the
    stream's state is kept.
    """
    # The condition names the event time, or it would move below the watermark and hide the ticks from it.
    timed = changes.withWatermark("ts", delay).filter(F.when(F.col("ts").isNotNull(), F.col("id")).isNotNull())
    sliced = timed.withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int"))
    return sliced.groupBy("slice").transformWithStateInPandas(
        ItemTimers(policy.grace_days), outputStructType=EXPIRED, outputMode="Append", timeMode="EventTime")
