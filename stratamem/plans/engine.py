"""The memory tools in batch form over tables in one shared folder.

Every tool takes a DataFrame of requests, so one call serves any number of users,
and appends to its tables; nothing is updated in place. ``now`` is always passed
in and must grow from call to call: it orders the events of an item.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratamem import constants as K
from stratamem import schema, session
from stratamem.functions import routing, text
from stratamem.operators import lifecycle, records, summaries
from stratamem.operators.bounded import broadcast_if_small
from stratamem.operators.knn import knn
from stratamem.operators.topn import top_n_per_group
from stratamem.operators.validation import checked
from stratamem.plans import ingest as ingest_plan
from stratamem.plans import retrieve as retrieve_plan
from stratamem.plans import store as store_plan
from stratamem.plans.retrieve import RetrieveOptions


def _fields(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


S, L, D, B, TS = schema.S, schema.L, schema.D, schema.B, schema.TS
TABLES = {
    "items": _fields(("seq", L), ("op", S), ("id", S), ("ts", TS), ("reason", S),
                     ("item", schema.MEMORY_ITEMS), ("collection", S)),
    "bases": _fields(("seq", L)),
    "messages": _fields(("id", S), ("user_id", S), ("session_id", S), ("seq", L), ("content", S),
                        ("importance", D), ("is_pinned", B), ("metadata", schema.STR_MAP), ("created_at", TS)),
    "quarantine": _fields(("user_id", S), ("session_id", S), ("memory_layer", S), ("importance", D), ("content", S),
                          ("problem", S), ("ts", TS)),
    "clears": _fields(("user_id", S), ("session_id", S), ("seq", L)),
    "projects": _fields(("user_id", S), ("project", S), ("seq", L)),
    "tasks": _fields(*[(f.name, f.dataType) for f in schema.TASKS], ("seq", L)),
    "skills": _fields(*[(f.name, f.dataType) for f in schema.SKILLS], ("seq", L), ("deleted", B)),
    "sessions": _fields(*[(f.name, f.dataType) for f in schema.SESSIONS], ("seq", L)),
    "session_log": _fields(("user_id", S), ("session_id", S), ("op", S), ("seq", L), ("created_at", TS), ("status", S),
                           ("metadata", schema.STR_MAP), ("updated_at", TS)),
    "profiles": _fields(*[(f.name, f.dataType) for f in schema.USER_PROFILES], ("seq", L)),
    "audit": schema.AUDIT_LOG,
    "gc_log": schema.GC_LOG,
    "accesses": _fields(("id", S), ("ts", TS), ("collection", S)),
    "published": _fields(("channel", S), ("payload", schema.STR_MAP), ("ts", TS)),
}
# More collections than this are found by a join instead of a filter on the files.
MAX_NAMED_COLLECTIONS = 1000
PARTITIONED = {"items": "collection", "accesses": "collection"}


class MemoryEngine:
    """Tables under ``root`` and the tools over them."""

    def __init__(self, spark: SparkSession, root: str, embedder: Callable[[Column], Column] | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.embed = embedder or store_plan.hashed_embedder()
        for name in TABLES:
            if not session.exists(spark, self._path(name)):
                self._append(name, spark.createDataFrame([], TABLES[name]))

    # Tables ------------------------------------------------------------------

    def _base(self) -> int | None:
        """The sequence number of the newest base, if any."""
        if not session.exists(self.spark, f"{self.root}/bases"):
            return None
        return self.spark.read.schema(TABLES["bases"]).parquet(f"{self.root}/bases").agg(F.max("seq").alias("s")).first().s

    def _path(self, name: str) -> str:
        """A table's folder; the item log and the accesses start anew behind every base."""
        return f"{self.root}/{name}-after-{self._base() or 0}" if name in ("items", "accesses") else f"{self.root}/{name}"

    def _log(self, base: int | None) -> DataFrame:
        """The item log behind a base that is known already."""
        return self.spark.read.schema(TABLES["items"]).parquet(f"{self.root}/items-after-{base or 0}")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(self._path(name))

    def _append(self, name: str, rows: DataFrame) -> None:
        fitted = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[name]])
        writer = fitted.write.mode("append")
        if name in PARTITIONED:
            writer = writer.partitionBy(PARTITIONED[name])
        writer.parquet(self._path(name))

    def _audit(self, rows: DataFrame, action: str, now: datetime, payload: list[str]) -> None:
        self._append("audit", store_plan.audit(rows, action, _ts(now), payload))

    def _publish(self, rows: DataFrame, channel: str, now: datetime, payload: list[str]) -> None:
        pairs = [x for name in payload for x in (F.lit(name), F.col(name).cast("string"))]
        self._append("published", rows.select(F.lit(channel).alias("channel"),
                                              F.create_map(*pairs).alias("payload"), _ts(now).alias("ts")))

    def items(self, collections: Iterable[str] | None = None, accessed: bool = True) -> DataFrame:
        """Current items of all collections, or of the named ones, whose files alone are read.

        ``accessed=False`` spares the join with the accesses where nobody looks at their time.

        All events of an item lie in its collection. With a compacted base, only items
        named by later events are folded; the others are read as they lie. The later
        events stay few between compactions.
        """
        def within(df: DataFrame) -> DataFrame:
            return df if collections is None else df.filter(F.col("collection").isin(list(collections)))

        if accessed:
            return records.touch(self.items(collections, False), within(self.table("accesses")))
        base = self._base()
        recent = within(self._log(base))
        if base is None:
            return records.fold_events(recent)
        stored = within(self.spark.read.schema(TABLES["items"]).parquet(f"{self.root}/bases-{base}"))
        named = recent.select("id").distinct()
        unchanged = stored.join(named, "id", "left_anti")
        fields = [f"item.{f.name}" for f in schema.MEMORY_ITEMS if f.name != "id"]
        changed = records.fold_events(stored.join(named, "id", "left_semi").unionByName(recent))
        return changed.unionByName(unchanged.select("id", "collection", *fields))

    def compact(self, now: datetime) -> None:
        """Write the current items as a base that later reads start from.

        The log and the base before it go, and with them the content of deleted items.
        No other call may write meanwhile.
        """
        before, logs = self._base(), [self._path("items"), self._path("accesses")]
        fields = F.struct(*[f.name for f in schema.MEMORY_ITEMS])
        folded = self.items().select(
            F.lit(0).cast("long").alias("seq"), F.lit("upsert").alias("op"), "id", F.col("created_at").alias("ts"),
            F.lit(None).cast("string").alias("reason"), fields.alias("item"), "collection")
        stamp = int(self.spark.range(1).select(_seq(now)).first()[0])
        folded.write.partitionBy("collection").parquet(f"{self.root}/bases-{stamp}")
        for name in PARTITIONED:
            session.remove(self.spark, f"{self.root}/{name}-after-{stamp}")
            self.spark.createDataFrame([], TABLES[name]).write.partitionBy("collection").parquet(
                f"{self.root}/{name}-after-{stamp}")
        self._append("bases", self.spark.range(1).select(F.lit(stamp).alias("seq")))
        for log in logs:
            session.remove(self.spark, log)
        if before is not None:
            session.remove(self.spark, f"{self.root}/bases-{before}")

    def working_memory(self, n: int = K.WINDOW_SIZE) -> DataFrame:
        return records.window_after_clear(self.table("messages"), self.table("clears"), n=n)

    # Projects ----------------------------------------------------------------

    def set_project(self, requests: DataFrame, now: datetime) -> DataFrame:
        """user_id, project -> slug and collection."""
        rows = _last_of_each(requests.select("user_id", text.project_slug(F.col("project")).alias("project")), ["user_id"]).withColumn(
            "seq", _seq(now))
        self._append("projects", rows)
        return rows.select("user_id", "project", routing.collection_of_slug(F.col("project")).alias("collection"))

    def get_project(self, users: DataFrame, suggestion: str = K.DEFAULT_SLUG) -> DataFrame:
        """Active project per user; where none is set, a suggestion instead."""
        latest = records.latest_by_key(self.table("projects"), ["user_id"]).select("user_id", "project")
        missing = F.col("project").isNull()
        return users.select("user_id").distinct().join(latest, "user_id", "left").select(
            "user_id", "project", routing.collection_of_slug(F.col("project")).alias("collection"),
            F.when(missing, F.lit(suggestion)).alias("suggestion"))

    # Writing -----------------------------------------------------------------

    def store(self, requests: DataFrame, now: datetime) -> DataFrame:
        """user_id, memory_layer, content and optionally importance, session_id,
        metadata, confidence, is_pinned -> stored items.

        Rows that are no valid items go to the quarantine table with the reason.
        """
        # Every row of every call is a request of its own; written, so that its name holds.
        call = uuid.uuid4().hex
        named = session.materialize(requests.withColumn("_place", F.monotonically_increasing_id()), "requests")
        named = named.withColumn("request", F.concat_ws(":", F.lit(call), "_place")).drop("_place")
        named = checked(_defaults(named, {
            "importance": F.lit(0.5), "session_id": F.lit(None).cast("string"), "is_pinned": F.lit(False),
            "metadata": F.lit(None).cast(schema.STR_MAP), "confidence": F.lit(1.0)}))
        bad = named.filter(F.col("problem").isNotNull())
        if not bad.isEmpty():
            self._append("quarantine", bad.withColumn("ts", _ts(now)))
        good = named.filter(F.col("problem").isNull()).drop("problem")
        rows = store_plan.store(good, _ts(now), self.embed)
        stored = session.materialize(rows, "stored")
        working = F.col("memory_layer") == "L1"
        home = self.get_project(stored).select("user_id", F.col("project").alias("_home"))
        items = stored.filter(~working).join(home, "user_id", "left")
        slug = F.coalesce("_home", F.lit(K.DEFAULT_SLUG))
        self._append("items", items.select(
            _seq(now).alias("seq"), F.lit("upsert").alias("op"), "id", _ts(now).alias("ts"),
            F.lit(None).cast("string").alias("reason"),
            F.struct(*[f.name for f in schema.MEMORY_ITEMS]).alias("item"),
            routing.collection_of_item(F.col("memory_layer"), slug).alias("collection")))
        order = F.coalesce(F.col("metadata")["seq"].cast("long"), F.lit(0))
        self._append("messages", stored.filter(working).withColumn("seq", _seq(now) + order))
        payload = ["id", "memory_layer", "importance", "embedded"]
        facts = stored.filter(F.coalesce(F.col("metadata")["chunk_index"], F.lit("0")) == "0").withColumn(
            "embedded", ~working)
        self._publish(facts, "context_stored", now, ["id", "user_id", "memory_layer", "embedded"])
        self._audit(facts, "context_store", now, payload)
        return facts.select("id", "user_id", "memory_layer", "embedded")

    def checkpoint(self, requests: DataFrame, now: datetime) -> DataFrame:
        """name, content, user_id, project, session_id -> pinned items."""
        return self.store(store_plan.checkpoint(requests), now)

    def ingest(self, sections: DataFrame, source: str, now: datetime, **options) -> DataFrame:
        """Sections of parsed sources (with user_id, session_id) -> counters per source."""
        self.store(ingest_plan.ingest_rows(sections, source, **options), now)
        return ingest_plan.ingest_result(sections, source)

    def deprecate(self, requests: DataFrame, now: datetime) -> DataFrame:
        """id, user_id, reason -> the users' own items, now soft-deleted."""
        own = self.items(self._collections_of(requests), False).select("id", "user_id", "collection").join(
            _last_of_each(requests.select("id", "user_id", "reason"), ["id", "user_id"]), ["id", "user_id"])
        marks = session.materialize(own, "deprecated")
        self._append("items", _mark(marks, "deprecate", now))
        self._audit(marks, "context_deprecate", now, ["id", "reason"])
        return marks.select("id", "user_id", F.lit(True).alias("deprecated"))

    # Reading -----------------------------------------------------------------

    def retrieve(self, requests: DataFrame, now: datetime, opts: RetrieveOptions = RetrieveOptions()) -> DataFrame:
        """query_id, user_id, query_text and optionally session_id, project.

        Searches the user's active project and the shared collection, and records
        an access for every vector candidate.
        """
        asked = _defaults(requests, {"session_id": F.lit(None).cast("string"),
                                     "project": F.lit(None).cast("string")})
        asked = session.materialize(asked.withColumn("embedding", self.embed(F.col("query_text"))), "queries")
        items = self._visible_items(asked)
        rows = session.materialize(retrieve_plan.candidates(items, asked, self.working_memory(), opts), "candidates")
        touched = rows.filter(F.col("memory_layer") != "L1").select("id").distinct()
        places = broadcast_if_small(touched, asked.count() * len(opts.layers) * K.OVERFETCH * opts.top_k)
        self._append("accesses", items.select("id", "collection").join(places, "id").withColumn("ts", _ts(now)))
        return retrieve_plan.rank_and_select(rows, asked, _ts(now), opts)

    def _collections_of(self, users: DataFrame) -> list[str] | None:
        """Every collection in which the users can have items, or None where they are too many to name.

        A user's items go to the project that was active then, to the default one before any
        was set, or to the shared collection.
        """
        asked = users.select("user_id").distinct()
        ever = self.table("projects").join(asked, "user_id", "left_semi").select(
            routing.collection_of_slug(F.col("project")).alias("c")).distinct()
        named = [r["c"] for r in ever.limit(MAX_NAMED_COLLECTIONS + 1).collect()]
        known = [K.COLLECTION_PREFIX + K.DEFAULT_SLUG, K.COLLECTION_PREFIX + K.SHARED_SLUG]
        return named + known if len(named) <= MAX_NAMED_COLLECTIONS else None

    def _visible_items(self, asked: DataFrame) -> DataFrame:
        """Items in the asking users' active collections and the shared one."""
        active = self.get_project(asked).select(
            "user_id", F.coalesce("collection", F.lit(K.COLLECTION_PREFIX + K.DEFAULT_SLUG)).alias("_active"))
        # Few collections are named to the reader, so that it opens their files only.
        named = active.select("_active").distinct().limit(MAX_NAMED_COLLECTIONS + 1).collect()
        few = len(named) <= MAX_NAMED_COLLECTIONS
        items = self.items([r["_active"] for r in named] + [K.COLLECTION_PREFIX + K.SHARED_SLUG] if few else None, False)
        shared = F.lit(K.COLLECTION_PREFIX + K.SHARED_SLUG)
        return items.join(broadcast_if_small(active, asked.count()), "user_id").filter(
            (F.col("collection") == F.col("_active")) | (F.col("collection") == shared)).drop("_active")

    def score(self, items: DataFrame, query: str, now: datetime) -> DataFrame:
        """Given items against one query, without vectors unless a semantic score is supplied."""
        rows = _defaults(items, {"semantic": F.lit(0.0)}).withColumn("query_words", text.word_set(F.lit(query)))
        keep = F.col("combined") >= K.DROP_BELOW
        return retrieve_plan.score(rows, _ts(now)).withColumn("kept", keep).drop("query_words")

    def list_items(self, user_id: str, memory_layer: str | None = None, checkpoints_only: bool = False,
                   include_deprecated: bool = False, project: str | None = None, limit: int = 50,
                   filter_after_limit: bool = False) -> DataFrame:
        """Items of the user's active project, or the shared ones for that layer.

        Checkpoints are picked before the limit unless ``filter_after_limit``.
        """
        visible = self._visible_items(self.spark.range(1).select(F.lit(user_id).alias("user_id")))
        rows = records.only(visible, user_id=user_id, memory_layer=memory_layer, project=project)
        if not memory_layer:
            rows = rows.filter(F.col("memory_layer") != K.IMMUNE_LAYER)
        if not include_deprecated:
            rows = rows.filter(~F.col("is_deprecated"))
        named = F.map_contains_key("metadata", "checkpoint_name")
        if checkpoints_only and not filter_after_limit:
            rows = rows.filter(named)
        rows = rows.orderBy("id").limit(limit)
        if checkpoints_only:
            rows = rows.filter(named)
        return rows.select("id", "memory_layer", F.substring("content", 1, K.LIST_PREVIEW_CHARS).alias("content"),
                           "importance", "is_pinned", "is_deprecated", "metadata")

    # Sessions ----------------------------------------------------------------

    def sessions(self) -> DataFrame:
        """Session records with their state."""
        return records.fold_sessions(self.table("session_log"))

    def session_write(self, requests: DataFrame, op: str, now: datetime) -> None:
        """create, update or delete: user_id, session_id and optionally status, metadata."""
        rows = _defaults(requests, {"status": F.lit("active"), "metadata": F.lit(None).cast(schema.STR_MAP)})
        born = _ts(now) if op == "create" else F.lit(None).cast("timestamp")
        self._append("session_log", rows.select(
            "user_id", "session_id", F.lit(op).alias("op"), _seq(now).alias("seq"), born.alias("created_at"),
            "status", "metadata", _ts(now).alias("updated_at")))

    def session_totals(self) -> DataFrame:
        """Tokens and messages ever sent per session, with its summary state."""
        counters = records.session_counters(self.table("messages").filter(F.col("session_id").isNotNull()))
        done = records.latest_by_key(self.table("sessions"), ["user_id", "session_id"]).select(
            "user_id", "session_id", "status", "summary", "key_entities", "summarized_at")
        return counters.join(done, ["user_id", "session_id"], "left").withColumn(
            "status", F.coalesce("status", F.lit("active")))

    def summarize(self, requests: DataFrame, now: datetime, reply_of=summaries.fallback_reply,
                  max_tokens: int = K.SUMMARY_TOKENS, focus: str | None = None) -> DataFrame:
        """user_id, session_id -> summary, entities, tokens saved.

        The summary is stored as an episodic item first; only then is the window
        cleared.
        """
        window = self.working_memory().join(requests.select("user_id", "session_id").distinct(),
                                            ["user_id", "session_id"], "left_semi")
        newest = window.groupBy("user_id", "session_id").agg(F.max("seq").alias("last_seq"))
        done = session.materialize(
            summaries.summarize(window, reply_of, max_tokens, focus).join(newest, ["user_id", "session_id"]), "summaries")
        self.store(done.filter(F.col("summary") != "").select(
            "user_id", "session_id", F.lit("L2").alias("memory_layer"), F.lit(K.SUMMARY_IMPORTANCE).alias("importance"),
            F.create_map(F.lit("source"), F.lit("summarize"), F.lit("session_id"), F.col("session_id")).alias("metadata"),
            F.col("summary").alias("content")), now)
        null = F.lit(None)
        self._append("sessions", done.select(
            "session_id", "user_id", F.lit("summarized").alias("status"), "summary", "key_entities",
            null.alias("token_count"), null.alias("message_count"), null.alias("metadata"), null.alias("created_at"),
            _ts(now).alias("updated_at"), _ts(now).alias("summarized_at"), _seq(now).alias("seq")))
        saved = F.col("tokens_before") - F.col("tokens_after")
        self._publish(done.withColumn("tokens_saved", saved), "session_summarized", now,
                      ["session_id", "user_id", "tokens_saved"])
        self._append("clears", done.select("user_id", "session_id", F.col("last_seq").alias("seq")))
        self._audit(done, "context_summarize", now, ["session_id", "tokens_before", "tokens_after"])
        return done.select("user_id", "session_id", "summary", "key_entities", "tokens_saved")

    # Tasks -------------------------------------------------------------------

    def tasks(self) -> DataFrame:
        return records.latest_by_key(self.table("tasks"), ["id"]).drop("seq")

    def task_add(self, requests: DataFrame, now: datetime) -> DataFrame:
        """title, user_id and optionally description, priority, project."""
        rows = _defaults(requests, {"description": F.lit(""), "priority": F.lit("medium"),
                                    "project": F.lit(None).cast("string")})
        made = rows.withColumns({
            "id": text.stable_id(F.col("user_id"), F.col("title"), F.col("description"), F.col("project"), _ts(now)),
            "priority": _one_of("priority", K.TASK_PRIORITY), "status": F.lit("pending"),
            "created_at": _ts(now), "updated_at": _ts(now), "seq": _seq(now)})
        self._append("tasks", made)
        return made.select("id", "title", "status", "priority")

    def task_list(self, user_id: str, status: str | None = "pending", priority: str | None = None,
                  project: str | None = None, limit: int = 50) -> DataFrame:
        rows = records.only(self.tasks(), user_id=user_id, status=status, priority=priority, project=project)
        return records.newest_first(rows, limit).select(
            "id", "title", "description", "status", "priority", "project", "created_at")

    def task_update(self, requests: DataFrame, now: datetime) -> DataFrame:
        """id, user_id, status, priority, title, description -> the owners' changed tasks.

        Several updates of one task in a call apply in their order and give one change.
        """
        checked = requests.withColumn("status", _one_of("status", K.TASK_STATUS)).withColumn(
            "priority", _one_of("priority", K.TASK_PRIORITY))
        checked = _last_of_each(checked.select("id", "user_id", *[
            F.nullif(n, F.lit("")).alias(n) for n in ("status", "priority", "title")], "description"), ["id", "user_id"])
        mine = self.tasks().join(checked.select("id", "user_id"), ["id", "user_id"], "left_semi")
        changed = session.materialize(
            records.apply_updates(mine, checked).withColumn("updated_at", _ts(now)), "tasks")
        self._append("tasks", changed.withColumn("seq", _seq(now)))
        return changed.select("id", "title", "status", "updated_at")

    # Skills ------------------------------------------------------------------

    def skills(self) -> DataFrame:
        return records.latest_by_key(self.table("skills"), ["id"]).filter(~F.col("deleted")).drop("seq", "deleted")

    def skill_store(self, requests: DataFrame, now: datetime) -> DataFrame:
        """name, description, content, user_id and optionally project, frontmatter.

        Names and slugs are unique; requests for taken ones are left out.
        """
        rows = _defaults(requests, {"project": F.lit(None).cast("string"),
                                    "frontmatter": F.lit(None).cast(schema.STR_MAP)})
        made = rows.withColumn("slug", text.skill_slug(F.col("name"))).withColumns({
            "id": text.stable_id(F.col("slug"), F.col("user_id"), _ts(now)),
            "created_at": _ts(now), "updated_at": _ts(now), "seq": _seq(now), "deleted": F.lit(False)})
        first = top_n_per_group(made, ["slug"], [F.col("user_id"), F.col("name")], 1)
        fresh = session.materialize(records.insert_unique(self.skills(), first, ["name", "slug"]), "skills")
        self._append("skills", fresh)
        home = self.get_project(fresh).select("user_id", F.col("project").alias("_home"))
        points = store_plan.skill_points(fresh, self.embed).join(home, "user_id", "left")
        self._append("items", points.select(
            _seq(now).alias("seq"), F.lit("upsert").alias("op"), "id", _ts(now).alias("ts"),
            F.lit(None).cast("string").alias("reason"),
            F.struct(*[f.name for f in schema.MEMORY_ITEMS]).alias("item"),
            routing.collection_of_slug(F.coalesce("_home", F.lit(K.DEFAULT_SLUG))).alias("collection")))
        return fresh.select("id", "name", "slug", "project", "created_at")

    def skill_find(self, requests: DataFrame, top_k: int = K.SKILL_TOP_K) -> DataFrame:
        """query_id, user_id, query_text and optionally project -> best own skills."""
        asked = _defaults(requests, {"project": F.lit(None).cast("string")}).withColumn(
            "item_type", F.lit("skill")).withColumn("embedding", self.embed(F.col("query_text")))
        asked = session.materialize(asked, "queries")
        points = self._visible_items(asked).filter(
            (F.col("memory_layer") == "L3") & (F.col("item_type") == "skill"))
        hits = knn(points, asked, top_k, group=None, filters=("item_type", "project"))
        owner = broadcast_if_small(asked.select("query_id", "user_id"), asked.count())
        return hits.join(owner, "query_id").join(self.skills(), ["id", "user_id"]).select(
            "query_id", "rank", "name", "description", "content", "frontmatter", F.col("semantic").alias("score"))

    def skill_get(self, requests: DataFrame) -> DataFrame:
        """name, user_id and optionally project -> the skill of that name or slug."""
        asked = _defaults(requests, {"project": F.lit(None).cast("string")}).select(
            F.col("name").alias("asked"), "user_id", F.col("project").alias("_project"),
            text.skill_slug(F.col("name")).alias("_slug"))
        # An equal name has an equal slug, so matching slugs finds both.
        hits = self.skills().withColumnRenamed("slug", "_slug").join(asked, ["_slug", "user_id"])
        scoped = hits.filter(F.col("_project").isNull() | F.col("_project").eqNullSafe(F.col("project")))
        first = top_n_per_group(scoped, ["user_id", "asked"], [F.col("id")], 1)
        return first.withColumnRenamed("_slug", "slug").drop("_project")

    def skill_list(self, user_id: str, project: str | None = None, limit: int = 50) -> DataFrame:
        rows = records.only(self.skills(), user_id=user_id, project=project)
        return records.newest_first(rows, limit).select("name", "slug", "description", "project")

    def skill_delete(self, requests: DataFrame, now: datetime) -> DataFrame:
        """name, user_id -> deleted skills, their vectors soft-deleted."""
        gone = session.materialize(self.skill_get(requests), "skills")
        self._append("skills", gone.withColumn("seq", _seq(now)).withColumn("deleted", F.lit(True)))
        places = self.items(self._collections_of(gone), False).select("id", "collection").join(gone.select("id"), "id")
        self._append("items", _mark(places.withColumn("reason", F.lit("skill deleted")), "deprecate", now))
        return gone.select("id", F.col("asked").alias("name"), F.lit(True).alias("deleted"))

    # Profiles and retention --------------------------------------------------

    def profile_upsert(self, requests: DataFrame, now: datetime) -> None:
        """user_id, profile."""
        self._append("profiles", _last_of_each(requests.select("user_id", "profile"), ["user_id"]).withColumn(
            "updated_at", _ts(now)).withColumn("seq", _seq(now)))

    def profile_get(self, users: DataFrame) -> DataFrame:
        latest = records.latest_by_key(self.table("profiles"), ["user_id"]).drop("seq")
        return latest.join(users.select("user_id").distinct(), "user_id", "left_semi")

    def gc_stats(self, now: datetime, user_id: str | None = None,
                 policy: lifecycle.RetentionPolicy = lifecycle.DEFAULT_POLICY) -> DataFrame:
        """Retention counts over everything, or over the user's active collection."""
        named = None
        if user_id:
            active = self.get_project(self.spark.range(1).select(F.lit(user_id).alias("user_id"))).first()
            named = [active["collection"] or K.COLLECTION_PREFIX + K.DEFAULT_SLUG]
        items = self.items(named)
        return lifecycle.gc_stats(items, _ts(now), policy=policy)

    def gc_run(self, run_id: str, now: datetime,
               policy: lifecycle.RetentionPolicy = lifecycle.DEFAULT_POLICY) -> DataFrame:
        """One retention pass: deletes, soft deletes, log, and counts per collection."""
        plan = session.materialize(lifecycle.gc_plan(self.items(), _ts(now), policy).select(
            "id", "collection", "memory_layer", "action", "reason"), "gc-plan")
        expired = plan.filter(F.col("action") == "deprecated").withColumn("reason", F.lit(K.EXPIRED_REASON))
        self._append("items", _mark(expired, "deprecate", now))
        self._append("items", _mark(plan.filter(F.col("action") == "deleted"), "delete", now))
        self._append("gc_log", lifecycle.gc_log(plan, run_id, _ts(now)))
        return lifecycle.gc_totals(plan)


def _ts(now: datetime) -> Column:
    return F.lit(now).cast("timestamp")


def _seq(now: datetime) -> Column:
    return F.unix_micros(_ts(now))


def _mark(rows: DataFrame, op: str, now: datetime) -> DataFrame:
    return rows.select(_seq(now).alias("seq"), F.lit(op).alias("op"), "id", _ts(now).alias("ts"), "reason",
                       F.lit(None).cast(schema.MEMORY_ITEMS).alias("item"), "collection")


def _last_of_each(requests: DataFrame, keys: list[str]) -> DataFrame:
    """One request per key: of every other column the last value given, in the order of the call."""
    rest = [c for c in requests.columns if c not in keys]
    placed = session.materialize(requests.withColumn("_place", F.monotonically_increasing_id()), "requests")
    return placed.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_place"))).alias(c) for c in rest])


def _defaults(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Optional request columns with their defaults, also where they are null."""
    for name, value in defaults.items():
        df = df.withColumn(name, F.coalesce(F.col(name), value) if name in df.columns else value)
    return df


def _one_of(name: str, allowed: Iterable[str]) -> Column:
    """The column, failing the job on a value outside the enumeration."""
    value = F.col(name)
    bad = F.raise_error(F.concat(F.lit(f"invalid {name}: "), value))
    return F.when(value.isNull() | value.isin("", *allowed), value).otherwise(bad)
