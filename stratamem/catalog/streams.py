"""Streaming jobs drained over the whole tables, next to their batch meaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratamem.catalog import base as b
from stratamem.functions import text
from stratamem.operators.lifecycle import with_collection
from stratamem.session import materialize
from stratamem.sources import tables
from stratamem.streaming import expiry, jobs, subscribe


def _stream(spark, base, name):
    path = f"{base}/{name}.parquet"
    return jobs.file_stream(spark, path, spark.read.parquet(path).schema)


def _messages(spark, base, clears=False):
    """Messages; with ``clears`` the third turn of every fifth conversation empties its session's window."""
    c, t = F.col("conv_id"), F.col("turn")
    clear = (c % 5 == 0) & (t == 2)
    return _stream(spark, base, "conversations").select(
        tables.tenant(c).alias("user_id"), tables.session_name(c).alias("session_id"),
        (c * tables.TURNS_PER_CONVERSATION + t).alias("seq"),
        F.when(clear & F.lit(clears), "clear").otherwise("push").alias("op"), text.strip(F.col("text")).alias("content")
    ).filter(F.col("content") != "")


def _drain(spark, stream, label, mode="append"):
    path = jobs.run_to_files(stream, jobs.new_path(spark, label), mode)
    return jobs.read_batches(spark, path, stream.schema)


def stream_l1_window(spark, base):
    """Working memory kept by a stateful stream, with clears among the messages in any order."""
    messages = _messages(spark, base, clears=True)
    state = jobs.run_for_state(jobs.window_stream(messages), jobs.new_path(spark, "window"))
    return jobs.windows_in_state(spark, state)


def stream_session_counters(spark, base):
    """Session counters kept by a streaming aggregation."""
    return jobs.current_counters(_drain(spark, jobs.counter_stream(_messages(spark, base)), "counters", "update"))


def stream_audit(spark, base):
    """Audit rows appended from the event stream, counted per action."""
    events = _stream(spark, base, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = jobs.audit_stream(events, F.concat(F.lit("context_"), F.col("event_type")), ["event_id", "value"])
    return _drain(spark, rows, "audit").groupBy("user_id", "action").agg(F.count(F.lit(1)).alias("entries"))


def stream_access(spark, base):
    """Newest access per item from the stream of view events."""
    documents = tables.read(spark, base, "documents").count()
    views = _stream(spark, base, "events").filter(F.col("event_type") == "view").select(
        F.pmod("event_id", F.lit(documents)).alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    batches = _drain(spark, jobs.access_stream(views), "access", "update")
    return batches.groupBy("id").agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_accessed_at"))


def stream_retention(spark, base):
    """Retention log written by the daemon, ticked by the event stream."""
    ticks = _stream(spark, base, "events").select(F.col("ts").cast("timestamp").alias("ts"))
    path = jobs.retention_daemon(ticks, lambda: tables.memory_items(spark, base), jobs.new_path(spark, "retention"))
    log = spark.read.parquet(path)
    return log.groupBy("collection", "action").agg(F.count(F.lit(1)).alias("items"))


def stream_expiry(spark, base):
    """What timers expire by the last event, with views as touches and some signups as pins."""
    items = with_collection(tables.memory_items(spark, base))
    documents = tables.read(spark, base, "documents").count()
    events = tables.read(spark, base, "events").select(
        "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"),
        (F.pmod("event_id", F.lit(documents)) * tables.IDS_PER_DOC).alias("id"))
    pins = events.filter((F.col("event_type") == "signup") & (F.col("event_id") % 7 == 0))
    changes = (expiry.item_changes(items, F.lit("2023-12-31 00:00:00").cast("timestamp"))
               .unionByName(expiry.touches(events.filter(F.col("event_type") == "view")))
               .unionByName(expiry.touches(pins, expiry.PIN))
               .unionByName(expiry.touches(events.withColumn("id", F.lit(None)), "tick")))
    written = materialize(changes, "item-changes")
    stream = jobs.file_stream(spark, written.inputFiles()[0].rsplit("/", 1)[0], written.schema, 1_000_000)
    slices = expiry.slices_for(written.filter(F.col("op") == expiry.PUT).count())
    return _drain(spark, expiry.expiry_stream(stream, slices=slices), "expiry").select("id", "collection", "memory_layer", "action")


DELIVERY_DAYS = 6


def stream_subscribe(spark, base):
    """Counters per channel and newest access per item, from events delivered late and twice."""
    documents = tables.read(spark, base, "documents").count()
    e = F.col("event_id")
    events = tables.read(spark, base, "events").select(
        e.cast("string").alias("event_id"), e.alias("position"), F.col("event_type").alias("channel"),
        F.when(F.col("event_type") == "view", F.pmod(e, F.lit(documents)).cast("string")).alias("item"),
        F.col("ts").cast("timestamp").alias("ts"),
        (F.floor(F.datediff(F.col("ts"), F.lit("2024-01-01")) / DELIVERY_DAYS) + F.when(e % 10 == 0, 1).otherwise(0)).alias("batch"))
    again = events.filter(F.col("position") % 3 == 0).withColumn("batch", F.col("batch") + 1)
    deliveries = materialize(events.unionByName(again), "deliveries")
    path = jobs.new_path(spark, "delivered")
    for batch in range(deliveries.agg(F.max("batch")).first()[0] + 1):
        deliveries.filter(F.col("batch") == batch).drop("batch").coalesce(1).write.parquet(f"{path}/{batch:03}")
    # Files come in the order of their writing, one a batch, so repeats meet what earlier batches left.
    stream = jobs.file_stream(spark, f"{path}/*", deliveries.drop("batch").schema, files_per_batch=1)
    taken = subscribe.run(subscribe.subscribe(stream, f"{3 * DELIVERY_DAYS} days"), jobs.new_path(spark, "subscription"))
    return subscribe.snapshot(spark, taken).select(
        "kind", "key", "events", F.date_format("newest", "yyyy-MM-dd HH:mm:ss").alias("newest"))


QUERIES = {f.__name__: f for f in (
    stream_l1_window, stream_session_counters, stream_audit, stream_access, stream_retention,
    stream_expiry, stream_subscribe)}

_AGE = "((epoch_us((SELECT max(ts) FROM events)) - epoch_us({})) / 8.64e10)"
ORACLE = {
    "stream_l1_window": f"""WITH {b.MESSAGES}, cleared AS (SELECT user_id, session_id, max(seq) AS last FROM messages
        WHERE (-id - 1) // {tables.TURNS_PER_CONVERSATION} % 5 = 0 AND (-id - 1) % {tables.TURNS_PER_CONVERSATION} = 2
        GROUP BY ALL), recent AS (SELECT m.*, row_number() OVER (
        PARTITION BY user_id, session_id ORDER BY seq DESC) AS pos
        FROM messages m LEFT JOIN cleared c USING (user_id, session_id) WHERE seq > coalesce(last, -1))
      SELECT user_id, session_id, seq, pos, content FROM recent WHERE pos <= 20""",
    "stream_session_counters": f"""WITH {b.MESSAGES} SELECT user_id, session_id,
      CAST(sum(length(content) // 4) AS BIGINT) AS token_count, count(*) AS message_count
      FROM messages GROUP BY ALL""",
    "stream_audit": """SELECT CAST(user_id AS VARCHAR) AS user_id, 'context_' || event_type AS action,
      count(*) AS entries FROM events GROUP BY ALL""",
    "stream_access": """SELECT event_id % (SELECT count(*) FROM documents) AS id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_accessed_at
      FROM events WHERE event_type = 'view' GROUP BY 1""",
    "stream_expiry": f"""WITH {b.ITEMS}, seen AS (SELECT event_id % (SELECT count(*) FROM documents) * {tables.IDS_PER_DOC} AS id,
        max(ts) FILTER (WHERE event_type = 'view') AS touched,
        bool_or(event_type = 'signup' AND event_id % 7 = 0) AS pinned FROM events GROUP BY 1), acted AS (
      SELECT id, memory_layer, CASE WHEN memory_layer = 'L4' THEN 'ctx_users'
          ELSE 'ctx_' || {b.project_slug("coalesce(project, '')")} END AS collection,
        CASE WHEN is_deprecated THEN CASE WHEN floor({_AGE.format('deprecated_at')}) >= 30 THEN 'deleted' END
          WHEN NOT (is_pinned OR coalesce(pinned, false) OR memory_layer = 'L4' OR importance >= 1e0
              OR coalesce(item_type = 'skill', false))
            AND {_AGE.format('greatest(coalesce(last_accessed_at, created_at), touched)')} >=
              CASE memory_layer WHEN 'L2' THEN 30e0 WHEN 'L3' THEN 90e0 END * (1e0 + importance * 3e0)
          THEN 'deprecated' END AS action
      FROM items LEFT JOIN seen USING (id))
      SELECT id, collection, memory_layer, action FROM acted WHERE action IS NOT NULL""",
    "stream_subscribe": """SELECT 'channel' AS kind, event_type AS key, count(*) AS events,
        strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS newest FROM events GROUP BY event_type
      UNION ALL SELECT 'item', CAST(event_id % (SELECT count(*) FROM documents) AS VARCHAR), count(*),
        strftime(max(ts), '%Y-%m-%d %H:%M:%S') FROM events WHERE event_type = 'view' GROUP BY 2""",
    "stream_retention": f"""WITH {b.ITEMS}, acted AS (SELECT
        CASE WHEN memory_layer = 'L4' THEN 'ctx_users'
          ELSE 'ctx_' || {b.project_slug("coalesce(project, '')")} END AS collection,
        CASE WHEN is_deprecated THEN CASE WHEN floor({_AGE.format('deprecated_at')}) >= 30 THEN 'deleted' END
          WHEN NOT (is_pinned OR memory_layer = 'L4' OR importance >= 1e0 OR coalesce(item_type = 'skill', false))
            AND {_AGE.format('coalesce(last_accessed_at, created_at)')} >=
              CASE memory_layer WHEN 'L2' THEN 30e0 WHEN 'L3' THEN 90e0 END * (1e0 + importance * 3e0)
          THEN 'deprecated' END AS action FROM items)
      SELECT collection, action, count(*) AS items FROM acted WHERE action IS NOT NULL GROUP BY ALL""",
}
