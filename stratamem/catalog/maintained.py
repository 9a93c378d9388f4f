"""Statistics kept by deltas, paged scans, lookups by key and times as text."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratamem.catalog import base as b
from stratamem.catalog import lifecycle as lifecycle_catalog
from stratamem.functions import isotime, text
from stratamem.operators import lifecycle, maintained, paging
from stratamem.plans import keyed
from stratamem.session import materialize
from stratamem.sources import tables

SCAN_ROWS = 500


def _log(rows, changes, key):
    """An insert of every row, then each change (condition, new values or None to delete) in turn."""
    first = rows.withColumns({"seq": F.lit(0), "op": F.lit("upsert")})
    log, state = first, rows
    for seq, (condition, values) in enumerate(changes, 1):
        changed = state.filter(condition)
        if values:
            changed = changed.withColumns(values)
            state = state.withColumns({n: F.when(condition, v).otherwise(F.col(n)) for n, v in values.items()})
        log = log.unionByName(changed.withColumns({
            "seq": F.lit(seq), "op": F.lit("upsert" if values else maintained.DELETE)}).select(log.columns))
    return log


def doc_freq_delta(spark, base):
    """Texts per term after edits, deprecations and deletes, from the log alone."""
    docs = tables.read_texts(spark, base, "documents", "doc_id").select("doc_id", "text", "source")
    d = F.col("doc_id")
    log = _log(docs, [(d % 5 == 0, {"text": F.concat(F.lit("edited again "), F.col("source"), F.lit(" "), F.col("text"))}),
                      (d % 35 == 0, {"text": F.lit("only this is left")}), (d % 11 == 0, None)], "doc_id")
    changes = maintained.change_images(
        log.select("doc_id", "seq", "op", text.tokenize(F.col("text")).alias("tokens")), "doc_id", ["tokens"])
    changes = materialize(changes, "text-changes")
    kept = materialize(maintained.doc_freq_delta(maintained.signed(changes.filter("seq = 0"))), "doc-freq")
    later = maintained.doc_freq_delta(maintained.signed(changes.filter("seq > 0")))
    return maintained.fold([kept, later], ["term"], ["df"])


def gc_stats_delta(spark, base):
    """Retention counts per collection after touches, deprecations and deletes, from the log alone."""
    items = lifecycle.with_collection(tables.memory_items(spark, base)).select(
        "id", "collection", "memory_layer", "importance", "is_pinned", "is_deprecated", "created_at", "last_accessed_at",
        "deprecated_at", "item_type", (F.col("doc_id") + F.col("chunk_index")).alias("n"))
    n, now = F.col("n"), tables.as_of()
    log = _log(items, [
        (n % 5 == 0, {"last_accessed_at": tables.days_before(F.lit(1))}),
        (n % 11 == 0, {"is_deprecated": F.lit(True),
                       "deprecated_at": tables.days_before(F.when(n % 2 == 0, 40).otherwise(10))}),
        (n % 7 == 0, None)], "id")
    fields = ["collection", "state", "due"]
    changes = materialize(maintained.change_images(
        maintained.retention_fields(log, now).select("id", "seq", "op", *fields), "id", fields), "item-changes")
    kept = materialize(maintained.gc_delta(maintained.signed(changes.filter("seq = 0"))), "gc-state")
    later = maintained.gc_delta(maintained.signed(changes.filter("seq > 0")))
    return maintained.gc_stats(maintained.fold([kept, later], fields, ["items"]), now)


def scan_pages(spark, base):
    """Every live item with its page and the cursor of the next one."""
    items = paging.live(tables.memory_items(spark, base)).select("id", "memory_layer")
    scan = paging.scan_pages(items, "id", SCAN_ROWS)
    return scan.rows.join(scan.pages.select("page", "next_offset"), "page").select(
        "id", "memory_layer", "page", F.col("next_offset").cast("string").alias("next_offset"))


def _records(spark, base):
    """Changes of sessions, profiles, tasks and skills: key, owner, seq, value."""
    o, c, p = F.col("o_orderkey"), F.col("c_custkey"), F.col("p_partkey")
    orders = tables.read(spark, base, "orders").select(o.alias("key"), F.col("o_custkey").cast("string").alias("owner"),
                                                       F.col("o_orderstatus").alias("value"))
    done = orders.filter(F.col("key") % 3 == 0).withColumn("value", F.lit("done"))
    messages = tables.read(spark, base, "conversations").groupBy(F.col("conv_id").alias("key")).agg(
        F.count(F.lit(1)).cast("string").alias("value"))
    people = tables.read(spark, base, "customer").select(c.alias("key"), c.cast("string").alias("owner"), F.col("c_mktsegment").alias("value"))
    skills = tables.read(spark, base, "part").select(p.alias("key"), tables.tenant(p).alias("owner"), F.col("p_brand").alias("value"))
    return {
        "task": orders.withColumn("seq", F.lit(0)).unionByName(done.withColumn("seq", F.lit(1))),
        "session": messages.select("key", tables.tenant(F.col("key")).alias("owner"), "value", F.lit(0).alias("seq")),
        "profile": people.withColumn("seq", F.lit(0)), "skill": skills.withColumn("seq", F.lit(0))}


def point_lookup(spark, base):
    """Sessions, profiles, tasks and skills by key: by their owner, by others, and where there is none."""
    out = None
    for kind, rows in _records(spark, base).items():
        log = keyed.write_keyed(rows, "key")
        k = F.col("key")
        asked = rows.filter((F.col("seq") == 0) & (k % 4 == 0)).select(
            k, F.when(k % 12 == 0, "intruder").otherwise(F.col("owner")).alias("user_id"))
        absent = asked.filter(k % 20 == 0).select((-k - 1).alias("key"), "user_id")
        got = keyed.lookup(log, asked.unionByName(absent)).select(
            F.lit(kind).alias("kind"), "key", "user_id", "outcome", "value")
        out = got if out is None else out.unionByName(got)
    return out


_FORMS = (
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss", "yyyyMMdd'T'HHmmss", "yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm'Z'",
    "yyyy-MM-dd'T'HH:mm:ss.SSS'+02:30'", "yyyy-MM-dd'T'HH:mm:ss'-0800'", "yyyy-MM-dd'T'HH", "dd.MM.yyyy", "yyyy-MM-dd'T'HH:mm:ss'+2'",
)


def iso_parse(spark, base):
    """Times written in many forms and read back; what is no ISO 8601 time goes aside."""
    events = tables.read(spark, base, "events")
    form = F.col("event_id") % len(_FORMS)
    written = F.lit(None).cast("string")
    for i, pattern in enumerate(_FORMS):
        written = F.when(form == i, F.date_format(F.col("ts").cast("timestamp"), pattern)).otherwise(written)
    read = isotime.parse_iso(F.col("written"))
    return events.select("event_id", written.alias("written")).select(
        "event_id", F.unix_micros(read).cast("string").alias("micros"), F.when(read.isNull(), "not a time").alias("problem"))


QUERIES = {f.__name__: f for f in (
    doc_freq_delta, gc_stats_delta, scan_pages, point_lookup, iso_parse)}

_CHANGED = f"""changed AS (SELECT * REPLACE (
    CASE WHEN n % 5 = 0 THEN {b.days_before('1')} ELSE last_accessed_at END AS last_accessed_at,
    is_deprecated OR n % 11 = 0 AS is_deprecated,
    CASE WHEN n % 11 = 0 THEN {b.days_before('CASE WHEN n % 2 = 0 THEN 40 ELSE 10 END')} ELSE deprecated_at END AS deprecated_at)
  FROM (SELECT *, doc_id + chunk_index AS n FROM items) WHERE n % 7 <> 0)"""
_SECOND, _MINUTE, _DAY = 1_000_000, 60_000_000, 86_400_000_000

ORACLE = {
    "doc_freq_delta": f"""WITH left_over AS (SELECT CASE WHEN doc_id % 35 = 0 THEN 'only this is left'
        WHEN doc_id % 5 = 0 THEN 'edited again ' || source || ' ' || text ELSE text END AS text
        FROM documents WHERE doc_id % 11 <> 0)
      SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({b.tokens('text')})) AS term FROM left_over) GROUP BY term""",
    "gc_stats_delta": lifecycle_catalog._PLAN.replace(", stored AS (", f", {_CHANGED}, stored AS (").replace(
        "AS grace_over FROM items)", "AS grace_over FROM changed)")
        + f" SELECT collection, {lifecycle_catalog._STATS} FROM plan GROUP BY collection",
    "scan_pages": f"""WITH {b.ITEMS}, placed AS (SELECT id, memory_layer,
        (row_number() OVER (ORDER BY id) - 1) // {SCAN_ROWS} AS page FROM items WHERE NOT is_deprecated), pages AS (
        SELECT page, min(id) AS start FROM placed GROUP BY page)
      SELECT p.id, p.memory_layer, p.page, CAST(f.start AS VARCHAR) AS next_offset FROM placed p LEFT JOIN pages f ON f.page = p.page + 1""",
    "point_lookup": f"""WITH r AS (
        SELECT 'task' AS kind, o_orderkey AS key, CAST(o_custkey AS VARCHAR) AS owner,
          CASE WHEN o_orderkey % 3 = 0 THEN 'done' ELSE o_orderstatus END AS value FROM orders
        UNION ALL SELECT 'session', conv_id, {b.tenant('conv_id')}, CAST(count(*) AS VARCHAR) FROM conversations GROUP BY conv_id
        UNION ALL SELECT 'profile', c_custkey, CAST(c_custkey AS VARCHAR), c_mktsegment FROM customer
        UNION ALL SELECT 'skill', p_partkey, {b.tenant('p_partkey')}, p_brand FROM part), asked AS (
        SELECT *, CASE WHEN key % 12 = 0 THEN 'intruder' ELSE owner END AS user_id FROM r WHERE key % 4 = 0)
      SELECT kind, key, user_id, CASE WHEN user_id = owner THEN 'found' ELSE 'denied' END AS outcome,
        CASE WHEN user_id = owner THEN value END AS value FROM asked
      UNION ALL SELECT kind, -key - 1, user_id, 'missing', NULL FROM asked WHERE key % 20 = 0""",
    "iso_parse": f"""WITH e AS (SELECT event_id, event_id % {len(_FORMS)} AS form, epoch_us(ts) AS t FROM events), m AS (
      SELECT event_id, CASE form WHEN 0 THEN t WHEN 1 THEN t // {_SECOND} * {_SECOND} WHEN 2 THEN t // {_SECOND} * {_SECOND}
        WHEN 3 THEN t // {_DAY} * {_DAY} WHEN 4 THEN t // {_MINUTE} * {_MINUTE}
        WHEN 5 THEN t // 1000 * 1000 - {150 * _MINUTE} WHEN 6 THEN t // {_SECOND} * {_SECOND} + {480 * _MINUTE}
        WHEN 7 THEN t // {60 * _MINUTE} * {60 * _MINUTE} END AS micros FROM e)
      SELECT event_id, CAST(micros AS VARCHAR) AS micros, CASE WHEN micros IS NULL THEN 'not a time' END AS problem FROM m""",
}
