"""An idempotent subscriber of published events.

Events carry an id and a position. Deliveries repeat and come late; within the watermark's
delay every event is taken once. What the subscriber derives (the newest access per item and
counters per channel) is folded batch by batch into a snapshot, so a reader opens the newest
snapshot alone, and a batch that is repeated after a failure writes the same snapshot again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamem import session
from stratamem.streaming.jobs import keep_state_on_disk

EVENT = "event_id string, position long, channel string, item string, ts timestamp"
SNAPSHOT = "kind string, key string, events long, newest timestamp, position long"


def subscribe(events: DataFrame, delay: str, channels: Sequence[str] | None = None, after: int | None = None) -> DataFrame:
    """Each event of the channels once, though delivered repeatedly and up to ``delay`` late.

    ``after`` replays from a position: only events beyond it are taken.
    """
    if channels is not None:
        events = events.filter(F.col("channel").isin(*channels))
    if after is not None:
        events = events.filter(F.col("position") > after)
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def summary(events: DataFrame) -> DataFrame:
    """Counters per channel and the newest access per item of one batch."""
    def of(kind: str, key: str) -> DataFrame:
        return events.filter(F.col(key).isNotNull()).groupBy(F.lit(kind).alias("kind"), F.col(key).alias("key")).agg(
            F.count(F.lit(1)).alias("events"), F.max("ts").alias("newest"), F.max("position").alias("position"))
    return of("channel", "channel").unionByName(of("item", "item"))


def fold(parts: DataFrame) -> DataFrame:
    return parts.groupBy("kind", "key").agg(
        F.sum("events").alias("events"), F.max("newest").alias("newest"), F.max("position").alias("position"))


def _snapshots(spark: SparkSession, path: str) -> list[int]:
    folder, system = session._folder(spark, path)
    if not system.exists(folder):
        return []
    names = [s.getPath().getName() for s in system.listStatus(folder)]
    return sorted(int(n[6:]) for n in names if n.startswith("epoch=")
                  and session.exists(spark, f"{path}/{n}/_SUCCESS"))


def run(stream: DataFrame, path: str, trigger: dict | None = None) -> str:
    """Drain a subscribed stream into snapshots below ``path``; resumes where it stopped."""
    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        parts = summary(batch.select("channel", "item", "ts", "position"))
        earlier = [e for e in _snapshots(spark, f"{path}/data") if e < epoch]
        if earlier:
            parts = parts.unionByName(spark.read.schema(SNAPSHOT).parquet(f"{path}/data/epoch={earlier[-1]}"))
        fold(parts).write.mode("overwrite").parquet(f"{path}/data/epoch={epoch}")
        for old in earlier[:-1]:  # the one before stays, in case this batch is repeated
            session.remove(spark, f"{path}/data/epoch={old}")

    keep_state_on_disk(stream.sparkSession)
    (stream.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", f"{path}/state")
     .trigger(**(trigger or {"availableNow": True})).start().awaitTermination())
    return path


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The newest state of a subscription: kind (channel or item), key, events, newest, position."""
    found = _snapshots(spark, f"{path}/data")
    if not found:
        return spark.createDataFrame([], SNAPSHOT)
    return spark.read.schema(SNAPSHOT).parquet(f"{path}/data/epoch={found[-1]}")


def position(spark: SparkSession, path: str) -> int | None:
    """The highest position taken so far, from which another subscriber may go on."""
    return snapshot(spark, path).agg(F.max("position")).first()[0]
