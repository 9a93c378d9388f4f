"""Change logs, listings, tasks, skills, sessions and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratamem import constants as K
from stratamem.catalog import base as b
from stratamem.functions import routing, scoring, text
from stratamem.operators import budget as bud
from stratamem.operators import records as rec
from stratamem.operators import summaries
from stratamem.operators.knn import knn
from stratamem.operators.topn import last_n_window, top_n_per_group
from stratamem.operators.validation import checked
from stratamem.sources import tables

TIME = "yyyy-MM-dd HH:mm:ss"
_SQL_TIME = "'%Y-%m-%d %H:%M:%S'"


def _items(spark, base):
    return tables.memory_items(spark, base)


def list_items(spark, base):
    """First fifty live items of every user with a content preview."""
    live = _items(spark, base).filter(~F.col("is_deprecated"))
    first = top_n_per_group(live, ["user_id"], [F.col("id")], 50)
    return first.select("user_id", "id", "memory_layer", "importance", "is_pinned", "project",
                        F.substring("content", 1, K.LIST_PREVIEW_CHARS).alias("preview"))


def checkpoints_list(spark, base):
    """First fifty checkpoints of every user; the filter precedes the limit."""
    named = _items(spark, base).filter(F.col("checkpoint_name").isNotNull() & ~F.col("is_deprecated"))
    return top_n_per_group(named, ["user_id"], [F.col("id")], 50).select("user_id", "id", "checkpoint_name")


def checkpoints_after_limit(spark, base):
    """Checkpoints among the first fifty items of every user."""
    live = _items(spark, base).filter(~F.col("is_deprecated"))
    first = top_n_per_group(live, ["user_id"], [F.col("id")], 50)
    return first.filter(F.col("checkpoint_name").isNotNull()).select("user_id", "id", "checkpoint_name")


def scan_items(spark, base):
    """Full scan for retention, live items per layer."""
    live = _items(spark, base).filter(~F.col("is_deprecated"))
    return live.groupBy("memory_layer").agg(F.count(F.lit(1)).alias("items"), F.max("id").alias("last_id"))


def validate_items(spark, base):
    """Records checked against the item constraints, with the first broken one."""
    e = tables.read(spark, base, "events")
    layer = F.when(F.col("event_type") == "view", "L1").when(F.col("event_type") == "click", "L2").when(
        F.col("event_type") == "purchase", "L3").when(F.col("event_type") == "signup", "L4").otherwise("L9")
    importance = F.col("value") / 50
    content = F.regexp_replace(F.get_json_object("props", "$.k"), "^.$", " ")
    rows = e.select("event_type", layer.alias("memory_layer"), importance.alias("importance"), content.alias("content"))
    found = F.coalesce("problem", F.lit("none"))
    return checked(rows).groupBy("event_type", found.alias("problem")).agg(F.count(F.lit(1)).alias("records"))


def metadata_merge(spark, base):
    """Item metadata: defaults overlaid by chunk facts, the right side winning."""
    from stratamem.plans.store import merge_maps
    left = F.create_map(F.lit("source"), F.lit("store"), F.lit("project"), F.coalesce("project", F.lit("-")))
    right = F.create_map(F.lit("source"), F.col("session_id"), F.lit("chunk"), F.col("chunk_index").cast("string"))
    merged = merge_maps(left, right)
    return _items(spark, base).select("id", F.size(merged).alias("entries"), merged["source"].alias("source"),
                                      merged["project"].alias("project"), merged["chunk"].alias("chunk"))


def l1_last20(spark, base):
    """Working memory: newest twenty messages per user and session."""
    return last_n_window(tables.l1_messages(spark, base)).select("user_id", "session_id", "seq", "pos", "content")


def l1_after_clear(spark, base):
    """Working memory after a clear at every session's first system message."""
    m = tables.l1_messages(spark, base)
    clears = m.filter(F.col("role") == "system").groupBy("user_id", "session_id").agg(F.min("seq").alias("seq"))
    return rec.window_after_clear(m, clears).select("user_id", "session_id", "seq", "pos")


def l1_length(spark, base):
    return last_n_window(tables.l1_messages(spark, base)).groupBy("user_id", "session_id").agg(
        F.count(F.lit(1)).alias("length"))


def session_counters(spark, base):
    return rec.session_counters(tables.l1_messages(spark, base))


def session_records(spark, base):
    """Session records of a log: created with a user's first event of a kind, updated, some deleted and made anew."""
    e = tables.access_events(spark, base)
    op = (F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "error", "delete")
          .otherwise("update"))
    log = e.select(F.col("actor").alias("user_id"), F.pmod("seq", F.lit(7)).alias("session_id"), op.alias("op"), "seq",
                   F.when(op == "create", F.col("ts")).alias("created_at"), F.col("event_type").alias("status"))
    return rec.fold_sessions(log).select("user_id", "session_id", "status",
                                         F.date_format("created_at", TIME).alias("created_at"))


def budget_usage(spark, base):
    """Last recorded token count per user and event type, and their total."""
    return bud.total_usage(bud.recorded_usage(_recorded(spark, base), "actor", "event_type"), "actor")


def _recorded(spark, base):
    return tables.access_events(spark, base).withColumn("tokens", F.get_json_object("props", "$.k").cast("long"))


def budget_reset(spark, base):
    """The same where every sign-up wipes what its user recorded before."""
    log = _recorded(spark, base)
    resets = log.filter(F.col("event_type") == "signup")
    sets = log.filter(F.col("event_type") != "signup")
    return bud.recorded_usage(sets, "actor", "event_type", resets).select("actor", "event_type", "seq", "tokens")


def active_project(spark, base):
    """Latest project of every user from the event log."""
    e = tables.access_events(spark, base).withColumn("name", F.concat_ws(" ", "event_type", F.get_json_object("props", "$.k")))
    return rec.latest_by_key(e, ["actor"]).select(
        "actor", text.project_slug(F.col("name")).alias("project"),
        routing.collection_of_project(F.col("name")).alias("collection"))


def _log(spark, base):
    """An event log: every item stored, some stored again, touched, deprecated or deleted."""
    docs = tables.document_rows(spark, base)
    fields = F.struct("user_id", "memory_layer", "importance", "is_deprecated", "last_accessed_at",
                      "deprecated_at", F.lit(None).cast("string").alias("deprecated_reason"))
    d = F.col("doc_id")
    ops = F.filter(F.array(
        F.struct(F.lit(1).alias("n"), F.lit("upsert").alias("op"), F.lit(True).alias("on")),
        F.struct(F.lit(2).alias("n"), F.lit("touch").alias("op"), (d % 2 == 0).alias("on")),
        F.struct(F.lit(3).alias("n"), F.lit("deprecate").alias("op"), (d % 7 == 0).alias("on")),
        F.struct(F.lit(4).alias("n"), F.lit("delete").alias("op"), (d % 9 == 0).alias("on")),
        F.struct(F.lit(5).alias("n"), F.lit("upsert").alias("op"), (d % 6 == 0).alias("on")),
        F.struct(F.lit(6).alias("n"), F.lit("touch").alias("op"), (d % 4 == 0).alias("on")),
    ), lambda o: o["on"])
    events = docs.select(d.alias("id"), fields.alias("fields"), F.explode(ops).alias("o"))
    return events.select(
        "id", (d_seq := F.col("o.n")).cast("long").alias("seq"), F.col("o.op").alias("op"),
        tables.days_before(F.lit(10) - d_seq).alias("ts"),
        F.when(F.col("o.op") == "deprecate", "outdated").alias("reason"),
        F.when(F.col("o.op") == "upsert", F.col("fields")).alias("item"))


def latest_state_upsert(spark, base):
    """Current items of the change log."""
    now = rec.fold_events(_log(spark, base))
    return now.select("id", "user_id", "memory_layer", "is_deprecated", "deprecated_reason",
                      F.date_format("last_accessed_at", TIME).alias("last_accessed_at"))


def _documents(spark, base):
    return tables.read(spark, base, "documents").agg(F.count(F.lit(1)).alias("n")).scalar()


def touch_merge(spark, base):
    """Documents with the newest view event that refers to them."""
    docs = tables.document_rows(spark, base).select("doc_id", "last_accessed_at")
    views = tables.access_events(spark, base).filter(F.col("event_type") == "view").select(
        F.pmod("seq", _documents(spark, base)).alias("doc_id"), "ts")
    return rec.touch(docs, views, "doc_id").select(
        "doc_id", F.date_format("last_accessed_at", TIME).alias("last_accessed_at"))


def deprecate_merge(spark, base):
    """Items after the users' own deprecations; marks by other users have no effect."""
    items = _items(spark, base).withColumn("deprecated_reason", F.lit(None).cast("string"))
    marks = tables.access_events(spark, base).filter(F.col("event_type") == "error").select(
        (F.pmod("seq", _documents(spark, base)) * tables.IDS_PER_DOC).alias("id"),
        tables.tenant(F.col("actor")).alias("user_id"), "ts",
        F.concat(F.lit("event "), F.col("seq").cast("string")).alias("reason"))
    return rec.deprecate(items, marks).select("id", "is_deprecated", "deprecated_reason")


def task_list(spark, base):
    """Newest fifty pending tasks of every user."""
    pending = rec.only(tables.tasks(spark, base), status="pending")
    return rec.newest_per_user(pending, 50).select("user_id", "pos", "id", "title", "status", "priority")


def task_update(spark, base):
    """Tasks after owners' partial updates."""
    tasks = tables.tasks(spark, base)
    li = tables.read(spark, base, "lineitem").groupBy("l_orderkey").agg(
        F.max("l_returnflag").alias("flag"), F.sum("l_linenumber").alias("lines"))
    updates = li.join(tasks.select(F.col("id").alias("l_orderkey"), "user_id"), "l_orderkey").select(
        F.col("l_orderkey").alias("id"),
        F.when(F.col("lines") % 5 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("user_id"),
        F.when(F.col("flag") == "R", "done").otherwise("").alias("status"),
        F.when(F.col("lines") % 3 == 0, "high").alias("priority"),
        F.when(F.col("lines") % 2 == 0, "").otherwise(F.concat(F.lit("Lines "), F.col("lines").cast("string"))).alias("title"),
        F.when(F.col("flag") == "A", "").alias("description"))
    return rec.apply_updates(tasks, updates).select("id", "status", "priority", "title", "description")


def skill_list(spark, base):
    return rec.newest_per_user(tables.skills(spark, base), 50).select("user_id", "pos", "name", "slug", "project")


def skill_by_slug(spark, base):
    """Every part's name in capitals looked up by name or slug among its user's skills."""
    s = tables.skills(spark, base)
    asked = s.select("user_id", F.upper("name").alias("asked"), text.skill_slug(F.upper("name")).alias("slug"))
    hits = s.join(asked, ["user_id", "slug"])
    return top_n_per_group(hits, ["user_id", "asked"], [F.col("id")], 1).select("user_id", "asked", "id", "name")


def skill_find_join(spark, base):
    """Three best skills per query: vector hits joined to the owner's skill records."""
    s = tables.skills(spark, base)
    vectors = tables.read(spark, base, "embeddings")
    count = vectors.agg(F.count(F.lit(1)).alias("n")).scalar()
    points = (s.select("id", "user_id", "project", F.pmod("id", count).alias("vec_id"))
              .join(vectors, "vec_id")
              .select("id", "user_id", F.lit("skill").alias("item_type"), F.lit(False).alias("is_deprecated"),
                      "embedding"))
    asked = tables.retrieval_queries(spark, base).withColumn("item_type", F.lit("skill"))
    hits = knn(points, asked, K.SKILL_TOP_K, group=None, filters=("item_type",))
    owned = asked.select("query_id", "user_id")
    return (hits.join(owned, "query_id").join(s, ["id", "user_id"])
            .select("query_id", "rank", "id", "name", "description", "content",
                    scoring.round4(F.col("semantic")).alias("score")))


def skill_delete(spark, base):
    """Skills left after users delete those whose project ends in 7; others' stay."""
    s = tables.skills(spark, base)
    doomed = s.filter(F.endswith("project", F.lit("7"))).select(
        "id", tables.tenant(F.col("id") + (F.col("id") % 3 == 0).cast("int")).alias("user_id"))
    return s.join(doomed, ["id", "user_id"], "left_anti").select("id", "user_id", "name")


def skill_store_unique(spark, base):
    """New skills whose name and slug are still free."""
    s = tables.skills(spark, base)
    names = F.concat(F.initcap("p_name"), F.lit(" #"), (F.col("p_partkey") * 2).cast("string"))
    new = tables.read(spark, base, "part").select(F.col("p_partkey").alias("id"), names.alias("name")).withColumn(
        "slug", text.skill_slug(F.col("name")))
    return rec.insert_unique(s, new, ["name", "slug"]).select("id", "name", "slug")


def project_route(spark, base):
    """Collection of every item by layer and project."""
    slug = text.project_slug(F.concat(F.lit("  My "), F.coalesce("project", F.lit("")), F.lit("--App! ")))
    return _items(spark, base).select("id", routing.collection_of_item(F.col("memory_layer"), slug).alias("collection"))


def parser_route(spark, base):
    """Parser of every page address and of file names made from them."""
    p = tables.read(spark, base, "pages")
    kinds = F.array(*[F.lit(x) for x in (".docx", ".PDF", ".md", ".py", ".rs", ".YAML", ".mdx")])
    name = F.concat(F.lit("/data/p.1/file-"), F.col("page_id").cast("string"),
                    F.get(kinds, F.pmod("page_id", F.lit(8)).cast("int")))
    return p.select("page_id", routing.parser_of(F.col("url")).alias("url_parser"),
                    F.coalesce(routing.parser_of(name), F.lit("none")).alias("file_parser"))


def audit_counts(spark, base):
    """Audit rows per action and user."""
    e = tables.access_events(spark, base)
    action = F.when(F.col("event_type") == "view", "context_store").when(
        F.col("event_type") == "error", "context_deprecate").otherwise("context_summarize")
    return e.groupBy("actor", action.alias("action")).agg(
        F.count(F.lit(1)).alias("entries"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k_sum"))


def summarize_prompt(spark, base):
    """Prompt of every session's working memory."""
    t = summaries.session_transcripts(last_n_window(tables.l1_messages(spark, base)))
    return t.select("user_id", "session_id", summaries.prompt(F.col("messages"), focus="decisions").alias("prompt"))


def tokens_saved(spark, base):
    """Summary and token savings of every session."""
    s = summaries.summarize(last_n_window(tables.l1_messages(spark, base)))
    return s.select("user_id", "session_id", "summary", "tokens_before", "tokens_after", "tokens_saved")


def parse_entities(spark, base):
    """Entities parsed from one reply per event; broken or invalid lists give none."""
    e = tables.access_events(spark, base)
    conf = F.format_string("%.2f", F.col("value") / 40)
    entry = F.concat(F.lit('{"name": "'), F.col("event_type"), F.lit('", "type": "fact", "value": "'),
                     F.get_json_object("props", "$.k"), F.lit('", "confidence": '), conf, F.lit("}"))
    body = F.when(F.col("seq") % 5 == 0, F.concat(F.lit("["), entry)).otherwise(
        F.concat(F.lit("["), entry, F.lit("]")))
    reply = F.concat(F.lit("SUMMARY:  seen \nnoise\nENTITIES: "), body)
    entities = summaries.reply_entities(reply)
    return e.select("seq", summaries.reply_summary(reply).alias("summary"), F.size(entities).alias("entities"),
                    F.get(entities, F.lit(0))["value"].alias("first_value"))


QUERIES = {f.__name__: f for f in (
    list_items, checkpoints_list, checkpoints_after_limit, scan_items, validate_items, metadata_merge,
    l1_last20, l1_after_clear, l1_length, session_counters, session_records, budget_usage, budget_reset, active_project, latest_state_upsert,
    touch_merge, deprecate_merge, task_list, task_update, skill_list, skill_by_slug, skill_find_join,
    skill_delete, skill_store_unique, project_route, parser_route, audit_counts, summarize_prompt,
    tokens_saved, parse_entities)}

_FIRST = f"""WITH {b.ITEMS}, firsts AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY id) AS n
  FROM items WHERE NOT is_deprecated"""
_LAST20 = f"""WITH {b.MESSAGES}, recent AS (SELECT *, row_number() OVER (PARTITION BY user_id, session_id
  ORDER BY seq DESC) AS pos FROM messages)"""
_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
_VALID_PROBLEM = f"""CASE WHEN event_type NOT IN ('view', 'click', 'purchase', 'signup') THEN 'memory_layer'
  WHEN NOT (value / 50 BETWEEN 0 AND 1) THEN 'importance'
  WHEN {b.strip("regexp_replace(json_extract_string(props, '$.k'), '^.$', ' ')")} = '' THEN 'content'
  ELSE 'none' END"""
_HEAD, _TAIL = K.SUMMARY_PROMPT.replace("{max_tokens}", "500").split("{messages}")
_PROMPTS = _LAST20 + """, talk AS (SELECT user_id, session_id,
  string_agg('[' || strftime(created_at, '%H:%M') || '] ' || content, chr(10) ORDER BY seq) AS said,
  CAST(sum(length(content) // 4) AS BIGINT) AS tokens_before FROM recent WHERE pos <= 20 GROUP BY ALL)"""
_FALLBACK = " ".join(_HEAD.split("\n")[:3])
_EVENTS_NEWEST = "row_number() OVER (PARTITION BY {} ORDER BY event_id DESC) = 1"
_NEW_NAME = b.SKILL_NAME.replace("|| p_partkey", "|| (p_partkey * 2)")
_KINDS = "['.docx', '.PDF', '.md', '.py', '.rs', '.YAML', '.mdx', NULL]"


def _newest(table: str, where: str = "TRUE") -> str:
    return f"""SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) AS pos
      FROM {table} WHERE {where}"""


ORACLE = {
    "list_items": f"""{_FIRST}) SELECT user_id, id, memory_layer, importance, is_pinned, project,
      substr(content, 1, 200) AS preview FROM firsts WHERE n <= 50""",
    "checkpoints_list": f"""{_FIRST} AND checkpoint_name IS NOT NULL)
      SELECT user_id, id, checkpoint_name FROM firsts WHERE n <= 50""",
    "checkpoints_after_limit": f"""{_FIRST}) SELECT user_id, id, checkpoint_name FROM firsts
      WHERE n <= 50 AND checkpoint_name IS NOT NULL""",
    "scan_items": f"""WITH {b.ITEMS} SELECT memory_layer, count(*) AS items, max(id) AS last_id FROM items
      WHERE NOT is_deprecated GROUP BY memory_layer""",
    "validate_items": f"""SELECT event_type, {_VALID_PROBLEM} AS problem, count(*) AS records
      FROM events GROUP BY ALL""",
    "metadata_merge": f"""WITH {b.ITEMS} SELECT id, 3 AS entries, session_id AS source,
      coalesce(project, '-') AS project, CAST(chunk_index AS VARCHAR) AS chunk FROM items""",
    "l1_last20": f"{_LAST20} SELECT user_id, session_id, seq, pos, content FROM recent WHERE pos <= 20",
    "l1_after_clear": f"""WITH {b.MESSAGES}, clears AS (SELECT user_id, session_id, min(seq) AS at FROM messages
        WHERE role = 'system' GROUP BY ALL),
      alive AS (SELECT m.*, row_number() OVER (PARTITION BY m.user_id, m.session_id ORDER BY seq DESC) AS pos
        FROM messages m LEFT JOIN clears c USING (user_id, session_id) WHERE c.at IS NULL OR m.seq > c.at)
      SELECT user_id, session_id, seq, pos FROM alive WHERE pos <= 20""",
    "l1_length": f"""WITH {b.MESSAGES} SELECT user_id, session_id, least(count(*), 20) AS length
      FROM messages GROUP BY ALL""",
    "session_counters": f"""WITH {b.MESSAGES} SELECT user_id, session_id,
      CAST(sum(length(content) // 4) AS BIGINT) AS token_count, count(*) AS message_count
      FROM messages GROUP BY ALL""",
    "budget_usage": f"""WITH last AS (SELECT * FROM events QUALIFY {_EVENTS_NEWEST.format('user_id, event_type')})
      SELECT user_id AS actor, CAST(sum({_K}) AS BIGINT) AS total, count(*) AS fields FROM last GROUP BY user_id""",
    "session_records": f"""WITH log AS (SELECT user_id, event_id % 7 AS session_id, event_id AS seq, event_type, ts FROM events),
      folded AS (SELECT user_id, session_id, max(seq) FILTER (event_type = 'signup') AS born,
        max(seq) FILTER (event_type = 'error') AS gone, arg_max(ts, seq) FILTER (event_type = 'signup') AS created,
        arg_max(event_type, seq) FILTER (event_type <> 'error') AS status FROM log GROUP BY ALL)
      SELECT user_id, session_id, status, strftime(created, {_SQL_TIME}) AS created_at FROM folded
      WHERE born IS NOT NULL AND (gone IS NULL OR born > gone)""",
    "budget_reset": f"""WITH last AS (SELECT * FROM events WHERE event_type <> 'signup'
        QUALIFY {_EVENTS_NEWEST.format('user_id, event_type')}),
      wiped AS (SELECT user_id, max(event_id) AS wiped_at FROM events WHERE event_type = 'signup' GROUP BY user_id)
      SELECT user_id AS actor, event_type, event_id AS seq, CAST({_K} AS BIGINT) AS tokens
      FROM last LEFT JOIN wiped USING (user_id) WHERE wiped_at IS NULL OR event_id > wiped_at""",
    "active_project": f"""WITH last AS (SELECT *, event_type || ' ' || json_extract_string(props, '$.k') AS name
      FROM events QUALIFY {_EVENTS_NEWEST.format('user_id')})
      SELECT user_id AS actor, {b.project_slug('name')} AS project,
        'ctx_' || {b.project_slug('name')} AS collection FROM last""",
    "latest_state_upsert": f"""WITH {b.DOCS}, up AS (SELECT *, CASE WHEN doc_id % 6 = 0 THEN 5 ELSE 1 END AS up_seq,
        CASE WHEN doc_id % 9 = 0 THEN 4 END AS del_seq,
        CASE WHEN doc_id % 4 = 0 THEN 6 WHEN doc_id % 2 = 0 THEN 2 END AS touch_seq,
        CASE WHEN doc_id % 7 = 0 THEN 3 END AS dep_seq FROM docs)
      SELECT doc_id AS id, user_id, memory_layer, is_deprecated OR coalesce(dep_seq > up_seq, false) AS is_deprecated,
        CASE WHEN dep_seq > up_seq THEN 'outdated' END AS deprecated_reason,
        strftime(CASE WHEN touch_seq > up_seq THEN {b.days_before('10 - touch_seq')} ELSE last_accessed_at END,
          {_SQL_TIME}) AS last_accessed_at
      FROM up WHERE del_seq IS NULL OR up_seq > del_seq""",
    "touch_merge": f"""WITH {b.DOCS}, seen AS (SELECT event_id % (SELECT count(*) FROM documents) AS doc_id, max(ts) AS ts FROM events
        WHERE event_type = 'view' GROUP BY 1)
      SELECT doc_id, strftime(greatest(last_accessed_at, ts), {_SQL_TIME}) AS last_accessed_at
      FROM docs LEFT JOIN seen USING (doc_id)""",
    "deprecate_merge": f"""WITH {b.ITEMS}, marks AS (SELECT (event_id % (SELECT count(*) FROM documents)) * {tables.IDS_PER_DOC} AS id,
        {b.tenant('user_id')} AS user_id, ts, 'event ' || event_id AS reason FROM events WHERE event_type = 'error'),
      newest AS (SELECT id, user_id, arg_max(reason, ts) AS reason FROM marks GROUP BY id, user_id)
      SELECT i.id, i.is_deprecated OR n.id IS NOT NULL AS is_deprecated, n.reason AS deprecated_reason
      FROM items i LEFT JOIN newest n ON n.id = i.id AND n.user_id = i.user_id""",
    "task_list": f"""WITH {b.TASKS}, t AS ({_newest('tasks', "status = 'pending'")})
      SELECT user_id, pos, id, title, status, priority FROM t WHERE pos <= 50""",
    "task_update": f"""WITH {b.TASKS}, li AS (SELECT l_orderkey AS id, max(l_returnflag) AS flag,
        CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem GROUP BY 1),
      j AS (SELECT t.*, li.flag, li.lines, li.id IS NOT NULL AND li.lines % 5 <> 0 AS hit
        FROM tasks t LEFT JOIN li USING (id))
      SELECT id, CASE WHEN hit AND flag = 'R' THEN 'done' ELSE status END AS status,
        CASE WHEN hit AND lines % 3 = 0 THEN 'high' ELSE priority END AS priority,
        CASE WHEN hit AND lines % 2 <> 0 THEN 'Lines ' || lines ELSE title END AS title,
        CASE WHEN hit AND flag = 'A' THEN '' ELSE description END AS description FROM j""",
    "skill_list": f"""WITH {b.SKILLS}, t AS ({_newest('skills')})
      SELECT user_id, pos, name, slug, project FROM t WHERE pos <= 50""",
    "skill_by_slug": f"""WITH {b.SKILLS} SELECT user_id, upper(name) AS asked, id, name FROM skills""",
    "skill_find_join": f"""WITH {b.SKILLS}, {b.ASKED}, sims AS (
        SELECT q.query_id, s.id, {b.cosine('e.embedding', 'q.embedding')} AS sem FROM asked q
        JOIN skills s ON s.user_id = q.user_id
        JOIN embeddings e ON e.vec_id = s.id % (SELECT count(*) FROM embeddings)),
      hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {b.rank_key('sem')} DESC, id) AS rank
        FROM sims WHERE {b.rank_key('sem')} >= 0)
      SELECT query_id, rank, h.id, name, description, content, {b.round4('sem')} AS score
      FROM hits h JOIN skills s ON s.id = h.id WHERE rank <= 3""",
    "skill_delete": f"""WITH {b.SKILLS} SELECT id, user_id, name FROM skills
      WHERE NOT (project LIKE '%7' AND {b.tenant("id + CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END")} = user_id)""",
    "skill_store_unique": f"""WITH {b.SKILLS}, fresh AS (SELECT p_partkey AS id, {_NEW_NAME} AS name,
        {b.skill_slug(_NEW_NAME)} AS slug FROM part)
      SELECT * FROM fresh WHERE name NOT IN (SELECT name FROM skills) AND slug NOT IN (SELECT slug FROM skills)""",
    "project_route": f"""WITH {b.ITEMS} SELECT id, CASE WHEN memory_layer = 'L4' THEN 'ctx_users' ELSE 'ctx_' ||
      {b.project_slug("'  My ' || coalesce(project, '') || '--App! '")} END AS collection FROM items""",
    "parser_route": f"""WITH named AS (SELECT page_id, url, page_id % 8 AS kind FROM pages)
      SELECT page_id, CASE WHEN regexp_matches(url, '^https?://') THEN 'web' END AS url_parser,
        (['docx', 'pdf', 'markdown', 'code', 'code', 'code', 'markdown', 'none'])[kind + 1] AS file_parser
      FROM named""",
    "audit_counts": f"""SELECT user_id AS actor, CASE event_type WHEN 'view' THEN 'context_store'
      WHEN 'error' THEN 'context_deprecate' ELSE 'context_summarize' END AS action, count(*) AS entries,
      CAST(sum({_K}) AS BIGINT) AS k_sum FROM events GROUP BY ALL""",
    "summarize_prompt": f"""{_PROMPTS} SELECT user_id, session_id,
      '{_HEAD}' || said || chr(10) || chr(10) || 'Focus on: decisions' || '{_TAIL}' AS prompt FROM talk""",
    "tokens_saved": f"""{_PROMPTS}, done AS (SELECT *, {b.strip(f"'{_FALLBACK}'")} AS summary FROM talk)
      SELECT user_id, session_id, summary, tokens_before, length(summary) // 4 AS tokens_after,
        greatest(tokens_before - length(summary) // 4, 0) AS tokens_saved FROM done""",
    "parse_entities": f"""SELECT event_id AS seq, 'seen' AS summary,
      CASE WHEN event_id % 5 = 0 OR CAST(format('{{:.2f}}', value / 40) AS DOUBLE) > 1 THEN 0 ELSE 1 END AS entities,
      CASE WHEN event_id % 5 = 0 OR CAST(format('{{:.2f}}', value / 40) AS DOUBLE) > 1 THEN NULL
        ELSE json_extract_string(props, '$.k') END AS first_value FROM events""",
}
