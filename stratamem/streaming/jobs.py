"""Structured Streaming jobs over message and event streams.

State lives in the state store and results go to files, both under the shared
folder, so a job resumes after losing executors or its driver. The window state
holds at most the window per session slice, however long the session.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from stratamem import constants as K
from stratamem import session
from stratamem.functions import text
from stratamem.operators import lifecycle
from stratamem.operators.records import latest_by_key
from stratamem.operators.topn import top_n_per_group

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PUBLISHED = T.StructType([T.StructField("channel", T.StringType()),
                          T.StructField("payload", T.MapType(T.StringType(), T.StringType())),
                          T.StructField("ts", T.TimestampType())])
MESSAGE = "user_id string, session_id string, seq long, op string, content string"
WINDOW = "user_id string, session_id string, slice int, seq long, pos int, content string"


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    """A stream of parquet files; ``path`` may be a folder, a file or a glob."""
    name = path.rstrip("/")
    glob = name if any(c in name for c in "*?[") else f"{name[:-1]}[{name[-1]}]"
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
            .format("parquet").load(glob))


def keep_state_on_disk(spark: SparkSession) -> None:
    """The state store of every stream of the session; the default one lives on the executors' heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def run_to_files(stream: DataFrame, path: str, mode: str = "append",
                 trigger: dict | None = None) -> str:
    """Drain the stream into files: one folder per batch, rewritten on a retry."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/data/epoch={epoch}")

    keep_state_on_disk(stream.sparkSession)
    query = (stream.writeStream.outputMode(mode).foreachBatch(write)
             .option("checkpointLocation", f"{path}/state")
             .trigger(**(trigger or {"availableNow": True})).start())
    query.awaitTermination()
    return f"{path}/data"


def run_for_state(stream: DataFrame, path: str, mode: str = "update", trigger: dict | None = None) -> str:
    """Drain the stream for what it leaves in its state; nothing else is written."""
    keep_state_on_disk(stream.sparkSession)
    query = (stream.writeStream.outputMode(mode).format("noop").option("checkpointLocation", f"{path}/state")
             .trigger(**(trigger or {"availableNow": True})).start())
    query.awaitTermination()
    return f"{path}/state"


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    full = T.StructType([*schema.fields, T.StructField("epoch", T.LongType())])
    return spark.read.schema(full).parquet(path)


def published_stream(spark: SparkSession, path: str, channel: str | None = None) -> DataFrame:
    """Events that the tool engine published under ``path`` (its ``published`` table), as a stream."""
    events = file_stream(spark, path, PUBLISHED)
    return events if channel is None else events.filter(F.col("channel") == channel)


# Working-memory window -------------------------------------------------------

class LastMessages(StatefulProcessor):
    """Keeps the newest messages of a session; a ``clear`` row empties the window."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.window = handle.getListState("window", "seq long, content string")
        self.cleared = handle.getValueState("cleared", "seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = pd.DataFrame(list(self.window.get()) if self.window.exists() else [],
                            columns=["seq", "content"])
        # The last clear is kept, since older messages may come after it, in this batch or later.
        cleared = self.cleared.get()[0] if self.cleared.exists() else None
        for part in rows:
            newest = part.loc[part["op"] == "clear", "seq"].max()
            if pd.notna(newest) and (cleared is None or newest > cleared):
                cleared = int(newest)
                self.cleared.update((cleared,))
            pushed = part.loc[part["op"] != "clear", ["seq", "content"]]
            kept = pd.concat([kept, pushed], ignore_index=True).sort_values("seq", kind="stable")
            if cleared is not None:
                kept = kept[kept["seq"] > cleared]
            kept = kept.tail(self.size)
        if len(kept):
            self.window.put([(int(s), c) for s, c in zip(kept["seq"], kept["content"])])
        else:
            self.window.clear()
        yield pd.DataFrame({
            "user_id": key[0], "session_id": key[1], "slice": key[2],
            "seq": [int(s) for s in kept["seq"]][::-1] or [None],
            "pos": list(range(1, len(kept) + 1)) or [0],
            "content": list(kept["content"])[::-1] or [None],
        }).astype({"slice": "int32", "seq": "Int64", "pos": "int32"})

    def close(self) -> None:
        pass


def window_stream(messages: DataFrame, size: int = K.WINDOW_SIZE, slices: int = 8) -> DataFrame:
    """Every changed session slice's window after each batch; position 0 marks an empty one.

    A session is kept in ``slices`` states by message, each with its own newest
    ``size`` messages, so that one busy session is shared among tasks. A clear
    goes to every slice.
    """
    every = F.sequence(F.lit(0), F.lit(slices - 1))
    own = F.array(F.pmod(F.xxhash64("seq"), F.lit(slices)).cast("int"))
    sliced = messages.withColumn("slice", F.explode(F.when(F.col("op") == "clear", every).otherwise(own)))
    return (sliced.groupBy("user_id", "session_id", "slice")
            .transformWithStateInPandas(LastMessages(size), outputStructType=WINDOW,
                                        outputMode="Update", timeMode="None"))


def current_windows(batches: DataFrame, size: int = K.WINDOW_SIZE) -> DataFrame:
    """The windows after the last batch that changed each slice, slices merged."""
    slice_key = ["user_id", "session_id", "slice"]
    last = batches.groupBy(*slice_key).agg(F.max("epoch").alias("epoch"))
    parts = batches.join(last, [*slice_key, "epoch"]).filter(F.col("pos") > 0)
    return top_n_per_group(parts.drop("epoch", "slice", "pos"), ["user_id", "session_id"],
                           [F.col("seq").desc()], size, rank_col="pos")


def windows_in_state(spark: SparkSession, state: str, size: int = K.WINDOW_SIZE) -> DataFrame:
    """The windows as the last batch left them, read from the state itself.

    What is read is bounded by the windows' size, however many batches there were.
    """
    held = spark.read.format("statestore").option("stateVarName", "window").load(state)
    return top_n_per_group(held.select("key.user_id", "key.session_id", "list_element.seq", "list_element.content"),
                           ["user_id", "session_id"], [F.col("seq").desc()], size, rank_col="pos")


# Counters, audit, access and retention ---------------------------------------

def counter_stream(messages: DataFrame) -> DataFrame:
    """Running tokens and messages per session, for update mode."""
    return messages.groupBy("user_id", "session_id").agg(
        F.sum(text.token_estimate(F.col("content"))).alias("token_count"),
        F.count(F.lit(1)).alias("message_count"))


def current_counters(batches: DataFrame) -> DataFrame:
    return latest_by_key(batches, ["user_id", "session_id"], "epoch").drop("epoch")


def audit_stream(events: DataFrame, action: Column, payload: list[str]) -> DataFrame:
    """Audit rows for an event stream, append only."""
    pairs = [x for name in payload for x in (F.lit(name), F.col(name).cast("string"))]
    return events.select(F.col("user_id").cast("string").alias("user_id"), action.alias("action"),
                         F.create_map(*pairs).alias("payload"), F.col("ts").alias("created_at"))


def access_stream(hits: DataFrame) -> DataFrame:
    """Newest access time per item so far, for update mode."""
    return hits.groupBy("id").agg(F.max("ts").alias("ts"))


def retention_daemon(ticks: DataFrame, items: Callable[[], DataFrame], path: str,
                     act: Callable[[DataFrame, object], None] | None = None,
                     policy: lifecycle.RetentionPolicy = lifecycle.DEFAULT_POLICY, trigger: dict | None = None) -> str:
    """Run retention for every batch of a tick stream, as of the batch's newest tick.

    ``ticks`` has one timestamp column ``ts``; use ``processingTime="24 hours"`` as
    trigger for a daily run. Each run writes its log under its batch number, then hands
    the written log to ``act`` (with the time of the run), which deprecates and deletes;
    the next run plans on what ``items`` gives then. A run that is repeated after a
    failure logs and acts on the same items again, so ``act`` must bear that.
    """

    def sweep(batch: DataFrame, epoch: int) -> None:
        newest = batch.agg(F.max("ts").alias("ts"))
        now = newest.scalar()
        plan = lifecycle.gc_plan(lifecycle.with_collection(items()), now, policy)
        log = lifecycle.gc_log(plan, f"run-{epoch}", now)
        log.write.mode("overwrite").parquet(f"{path}/data/epoch={epoch}")
        if act:
            act(batch.sparkSession.read.schema(log.schema).parquet(f"{path}/data/epoch={epoch}"), now)

    query = (ticks.writeStream.foreachBatch(sweep).option("checkpointLocation", f"{path}/state")
             .trigger(**(trigger or {"availableNow": True})).start())
    query.awaitTermination()
    return f"{path}/data"


def new_path(spark: SparkSession, label: str) -> str:
    return session.scratch_path(spark, label)
