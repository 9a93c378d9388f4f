"""State that streams keep: read back alone, driven by timers, and fed by repeated deliveries."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from stratamem.operators.lifecycle import RetentionPolicy
from stratamem.streaming import expiry, jobs, subscribe

MESSAGE = "user_id string, session_id string, seq long, op string, content string"


@pytest.fixture
def one_partition(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def feed(spark, path, batches, schema, start=0):
    for n, rows in enumerate(batches, start):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{n:03}")
    return f"{path}/*"


def stream(spark, glob, schema):
    return jobs.file_stream(spark, glob, _parse_datatype_string(schema), files_per_batch=1)


def test_window_reads_the_last_state_only(spark, tmp_path, one_partition):
    def batch(n):
        return [("u", f"s{s}", n * 10 + i, "push", f"{s}-{n}-{i}") for s in range(2) for i in range(10)]
    schema, path = _parse_datatype_string(MESSAGE), str(tmp_path / "window")
    sizes = []
    for start, end in ((0, 10), (10, 50)):
        glob = feed(spark, str(tmp_path / "in"), [batch(n) for n in range(start, end)], schema, start)
        state = jobs.run_for_state(jobs.window_stream(stream(spark, glob, MESSAGE), slices=2), path)
        held = spark.read.format("statestore").option("stateVarName", "window").load(state)
        sizes.append(held.count())
    # Two sessions of two slices of twenty messages, after 10 batches and after 50.
    assert sizes == [80, 80]
    got = jobs.windows_in_state(spark, state).orderBy("session_id", "pos").collect()
    assert [(r["session_id"], r["seq"], r["pos"]) for r in got] == [
        (f"s{s}", 499 - i, i + 1) for s in range(2) for i in range(20)]


def day(n, hour=0):
    return datetime(2024, 1, 1) + timedelta(days=n, hours=hour)


def test_timers_follow_touches_pins_and_grace(spark, tmp_path, one_partition):
    def put(i, at, **other):
        row = {"id": i, "memory_layer": "L2", "importance": 0.0, "is_pinned": False, "is_deprecated": False,
               "created_at": day(0), "last_accessed_at": None, "deprecated_at": None, "item_type": None, "collection": "c"}
        return row | other
    columns = ("id long, memory_layer string, importance double, is_pinned boolean, is_deprecated boolean, "
               "created_at timestamp, last_accessed_at timestamp, deprecated_at timestamp, item_type string, collection string")
    rows = [put(1, 0), put(2, 0), put(3, 0, is_pinned=True), put(4, 0, memory_layer="L4"), put(5, 0, importance=1.0),
            put(6, 0, is_deprecated=True, deprecated_at=day(-25)), put(7, 0, is_deprecated=True), put(8, 0), put(9, 0),
            put(10, 0, importance=None, last_accessed_at=day(2)), put(11, 0, memory_layer="L9")]
    put_rows = expiry.item_changes(spark.createDataFrame(
        [tuple(r.values()) for r in rows], columns), F.lit(day(0)), RetentionPolicy())
    schema = put_rows.schema

    def changes(op, *pairs):
        return expiry.touches(spark.createDataFrame(list(pairs), "id long, ts timestamp"), op)
    batches = [
        put_rows, changes("touch", (1, day(10)), (99, day(10))), changes("pin", (2, day(11))), changes("delete", (8, day(12))),
        changes("unpin", (3, day(13))), changes("tick", (None, day(29, 23))), changes("tick", (None, day(31))),
        changes("touch", (1, day(32))), changes("unpin", (2, day(50))), changes("tick", (None, day(61))),
        changes("tick", (None, day(62))), changes("tick", (None, day(95)))]
    for n, batch in enumerate(batches):
        batch.select(schema.names).coalesce(1).write.parquet(str(tmp_path / "in" / f"{n:03}"))
    source = jobs.file_stream(spark, str(tmp_path / "in" / "*"), schema, files_per_batch=1)
    path = jobs.run_to_files(expiry.expiry_stream(source), jobs.new_path(spark, "expiry"))
    got = sorted((r["id"], r["action"], (r["at"] - day(0)).days) for r in spark.read.parquet(path).collect())
    assert got == sorted([
        (1, "deprecated", 62),  # touched on day 32
        (2, "deprecated", 32),  # overdue when unpinned, as of the time known then
        (2, "deleted", 62), (3, "deprecated", 31), (3, "deleted", 61), (6, "deleted", 10),
        (9, "deprecated", 31), (9, "deleted", 61), (1, "deleted", 95), (10, "deprecated", 95)])


def test_items_of_a_slice_share_a_state_and_a_timer(spark, tmp_path, one_partition):
    """300 items of 40 days in few slices expire as each would alone."""
    columns = ("id long, memory_layer string, importance double, is_pinned boolean, is_deprecated boolean, "
               "created_at timestamp, last_accessed_at timestamp, deprecated_at timestamp, item_type string, collection string")
    rows = [(i, "L2", 0.0, i % 11 == 0, i % 13 == 0, day(-(i % 40)), None, day(-(i % 29)) if i % 13 == 0 else None, None, f"c{i % 3}")
            for i in range(300)]
    puts = expiry.item_changes(spark.createDataFrame(rows, columns), F.lit(day(0)), RetentionPolicy())

    def changes(op, *pairs):
        return expiry.touches(spark.createDataFrame(list(pairs), "id long, ts timestamp"), op)
    touched, gone, last = range(0, 300, 7), range(0, 300, 17), (10, 25, 31, 70)
    batches = [puts, changes("touch", *[(i, day(1)) for i in touched]), changes("delete", *[(i, day(2)) for i in gone]),
               *[changes("tick", (None, day(d))) for d in last]]
    for n, batch in enumerate(batches):
        batch.select(puts.schema.names).coalesce(1).write.parquet(str(tmp_path / "in" / f"{n:03}"))

    def run(slices):
        source = jobs.file_stream(spark, str(tmp_path / "in" / "*"), puts.schema, files_per_batch=1)
        path = jobs.new_path(spark, "expiry")
        out = jobs.run_to_files(expiry.expiry_stream(source, slices=slices), path)
        got = sorted((r["id"], r["action"], (r["at"] - day(0)).days) for r in spark.read.parquet(out).collect())
        timers = spark.read.format("statestore").option("stateVarName", "timer").load(f"{path}/state")
        items = spark.read.format("statestore").option("stateVarName", "items").load(f"{path}/state")
        return got, timers.count(), items.count()

    want, kept = [], 0
    for i, _, _, pinned, dead, created, _, marked, _, _ in rows:
        seen, by, at = (day(1) if i in touched else created), None, marked
        for now in (0, 1, 2, *last):  # the time is known once a batch is over
            if i in gone and now == 1 and by != "deleted":
                by = "gone"  # a batch takes its changes first, then what fell due by the batch before
            if by in ("gone", "deleted"):
                continue
            if at is not None:
                if at + timedelta(days=30) <= day(now):
                    by = "deleted"
                    want.append((i, by, now))
            elif not pinned and seen + timedelta(days=30) <= day(now):
                at = day(now)
                want.append((i, "deprecated", now))
        kept += by is None
    got, timers, items = run(2)
    assert got == sorted(want) and timers <= 2 and items == kept
    assert expiry.slices_for(0) == 1 and expiry.slices_for(expiry.SLICE_ITEMS + 1) == 2


def test_a_subscriber_takes_each_event_once(spark, tmp_path, one_partition):
    schema = _parse_datatype_string(subscribe.EVENT)

    def event(n, d, channel="stored", item=None):
        return (f"e{n}", n, channel, item or f"i{n % 3}", day(d))
    batches = [[event(1, 1), event(2, 1), event(2, 1)], [event(3, 2), event(1, 1)],
               [event(4, 5), event(3, 2), event(5, 1), event(6, 5, "other"), (None, 7, "stored", None, day(5))]]
    glob = feed(spark, str(tmp_path / "in"), batches, schema)
    path = str(tmp_path / "subscription")
    source = stream(spark, glob, subscribe.EVENT)
    subscribe.run(subscribe.subscribe(source, "10 days", ["stored"]), path)

    def shown():
        return {(r["kind"], r["key"]): (r["events"], r["newest"]) for r in subscribe.snapshot(spark, path).collect()}
    assert shown() == {("channel", "stored"): (6, day(5)), ("item", "i0"): (1, day(2)), ("item", "i1"): (2, day(5)),
                       ("item", "i2"): (2, day(1))}
    assert subscribe.position(spark, path) == 7
    # Later deliveries, again with repeats, go on from the snapshot; old ones of it are gone.
    feed(spark, str(tmp_path / "in"), [[event(4, 5), event(8, 6)]], schema, start=3)
    subscribe.run(subscribe.subscribe(stream(spark, glob, subscribe.EVENT), "10 days", ["stored"]), path)
    assert shown()["channel", "stored"] == (7, day(6)) and len(subscribe._snapshots(spark, f"{path}/data")) <= 2
    # Another subscriber replays from a position.
    other = str(tmp_path / "other")
    subscribe.run(subscribe.subscribe(stream(spark, glob, subscribe.EVENT), "10 days", after=5), other)
    assert {(r["key"], r["events"]) for r in subscribe.snapshot(spark, other).filter("kind = 'channel'").collect()} == {
        ("stored", 2), ("other", 1)}
    assert subscribe.snapshot(spark, str(tmp_path / "none")).collect() == []
