"""Streams over several batches equal their batch meaning."""

from datetime import datetime

from pyspark.sql import functions as F

from stratamem.operators.lifecycle import gc_plan, with_collection
from stratamem.sources import tables
from stratamem.streaming import jobs

MESSAGE = "user_id string, session_id string, seq long, op string, content string"


def write_batches(spark, path, batches, schema=MESSAGE):
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/{n}")
    return f"{path}/*"


def drain(spark, stream, mode):
    path = jobs.run_to_files(stream, jobs.new_path(spark, "test"), mode)
    return jobs.read_batches(spark, path, stream.schema)


def test_window_survives_batches_and_clears(spark, tmp_path):
    def push(s, a, b):
        return [("u", s, i, "push", f"{s}{i}") for i in range(a, b)]
    batches = [push("a", 0, 30) + push("b", 0, 3), push("a", 30, 35) + [("u", "b", 3, "clear", None)],
               push("b", 4, 6) + [("u", "c", 0, "push", "c0"), ("u", "c", 1, "clear", None)]]
    from pyspark.sql.types import _parse_datatype_string
    glob = write_batches(spark, str(tmp_path / "in"), batches)
    stream = jobs.file_stream(spark, glob, _parse_datatype_string(MESSAGE), files_per_batch=1)
    got = jobs.current_windows(drain(spark, jobs.window_stream(stream), "update")).orderBy("session_id", "pos").collect()
    by = {}
    for r in got:
        by.setdefault(r.session_id, []).append(r.seq)
    assert by == {"a": list(range(34, 14, -1)), "b": [5, 4]}


def test_counters_over_batches(spark, tmp_path):
    from pyspark.sql.types import _parse_datatype_string
    glob = write_batches(spark, str(tmp_path / "in"), [
        [("u", "a", 0, "push", "x" * 8)], [("u", "a", 1, "push", "x" * 7), ("u", "b", 0, "push", "x")]])
    stream = jobs.file_stream(spark, glob, _parse_datatype_string(MESSAGE), files_per_batch=1)
    got = jobs.current_counters(drain(spark, jobs.counter_stream(stream), "update"))
    assert {(r.session_id, r.token_count, r.message_count) for r in got.collect()} == {("a", 3, 2), ("b", 0, 1)}


def test_retention_daemon_logs_each_tick(spark, sf, tmp_path):
    tick = [[(datetime(2024, 2, 1),)]]
    from pyspark.sql.types import _parse_datatype_string
    glob = write_batches(spark, str(tmp_path / "in"), tick, "ts timestamp")
    ticks = jobs.file_stream(spark, glob, _parse_datatype_string("ts timestamp"))
    path = jobs.retention_daemon(ticks, lambda: tables.memory_items(spark, sf), jobs.new_path(spark, "gc"))
    want = gc_plan(with_collection(tables.memory_items(spark, sf)), tables.as_of()).filter(
        F.col("action").isin("deleted", "deprecated")).count()
    assert spark.read.parquet(path).count() == want > 0


def test_a_clear_holds_for_messages_that_come_later(spark, tmp_path):
    from pyspark.sql.types import _parse_datatype_string
    batches = [[("u", "a", 50, "clear", None), ("u", "a", 45, "push", "old")],
               [("u", "a", 40, "push", "late"), ("u", "a", 60, "push", "new")], [("u", "a", 49, "push", "later")]]
    glob = write_batches(spark, str(tmp_path / "in"), batches)
    stream = jobs.file_stream(spark, glob, _parse_datatype_string(MESSAGE), files_per_batch=1)
    got = jobs.current_windows(drain(spark, jobs.window_stream(stream), "update")).collect()
    assert [r.seq for r in got] == [60]


def test_retention_daemon_acts(spark, sf, tmp_path):
    from pyspark.sql.types import _parse_datatype_string
    glob = write_batches(spark, str(tmp_path / "in"), [[(datetime(2024, 2, 1),)], [(datetime(2024, 2, 1, 1),)]],
                         "ts timestamp")
    ticks = jobs.file_stream(spark, glob, _parse_datatype_string("ts timestamp"), files_per_batch=1)
    done = str(tmp_path / "done")
    spark.createDataFrame([], "item_id string").write.parquet(done)

    def items():
        gone = spark.read.parquet(done).withColumnRenamed("item_id", "id")
        return tables.memory_items(spark, sf).join(gone, "id", "left_anti")

    path = jobs.retention_daemon(ticks, items, jobs.new_path(spark, "gc"),
                                 act=lambda log, now: log.select("item_id").write.mode("append").parquet(done))
    log = spark.read.parquet(path)
    assert log.count() == log.select("item_id").distinct().count() > 0
    assert log.select("run_id").distinct().count() == 1


def test_published_events_feed_the_access_stream(spark, tmp_path):
    from stratamem.plans.engine import MemoryEngine
    engine = MemoryEngine(spark, str(tmp_path / "engine"))
    rows = spark.createDataFrame([("ann", "L3", "a note"), ("bob", "L3", "b note")],
                                 "user_id string, memory_layer string, content string")
    stored = {r["id"] for r in engine.store(rows, datetime(2024, 2, 1)).collect()}
    stream = jobs.published_stream(spark, f"{engine.root}/published", "context_stored")
    hits = stream.select(F.col("payload")["id"].alias("id"), "ts")
    got = drain(spark, jobs.access_stream(hits), "update").collect()
    assert {r["id"] for r in got} == stored and {r["ts"] for r in got} == {datetime(2024, 2, 1)}
