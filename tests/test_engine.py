"""The tools end to end on a small store."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stratamem.operators.lifecycle import RetentionPolicy
from stratamem.plans.engine import MemoryEngine

T0 = datetime(2024, 1, 1)


class Clock:
    def __init__(self):
        self.now = T0

    def __call__(self, **step):
        self.now += timedelta(**(step or {"seconds": 1}))
        return self.now


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    return MemoryEngine(spark, str(tmp_path_factory.mktemp("store")))


@pytest.fixture(scope="module")
def tick():
    return Clock()


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_life_of_a_memory(spark, engine, tick):
    users = frame(spark, "user_id string, project string", ("ann", "My App"), ("bob", "Other"))
    assert {(r.user_id, r.collection) for r in engine.set_project(users, tick()).collect()} == {
        ("ann", "ctx_my_app"), ("bob", "ctx_other")}
    got = engine.get_project(frame(spark, "user_id string", ("ann",), ("zoe",)), "folder").collect()
    assert {(r.user_id, r.project, r.suggestion) for r in got} == {("ann", "my_app", None), ("zoe", None, "folder")}

    rows = frame(spark, "user_id string, memory_layer string, content string, session_id string, metadata map<string,string>",
                 ("ann", "L2", "spark joins shuffle data", "s1", {"topic": "spark"}),
                 ("ann", "L3", "parquet stores columns", "s1", None),
                 ("ann", "L4", "prefers short answers about spark", "s1", None),
                 ("ann", "L3", "long text. " * 100, "s1", None),
                 ("bob", "L2", "spark joins shuffle data", "s1", None),
                 ("ann", "L1", "system: hello spark", "s1", {"seq": "1"}),
                 ("ann", "L1", "what about joins", "s1", {"seq": "2"}))
    stored = engine.store(rows, tick())
    assert stored.count() == 7
    items = engine.items()
    assert {r.collection for r in items.filter("user_id = 'ann'").collect()} == {"ctx_my_app", "ctx_users"}
    assert items.filter("content like '%long text%'").count() >= 2
    assert engine.table("audit").count() == engine.table("published").count() == 7

    asked = frame(spark, "query_id long, user_id string, query_text string, session_id string",
                  (1, "ann", "spark joins", "s1"), (2, "bob", "spark joins", None), (3, "zoe", "spark", None))
    found = engine.retrieve(asked, tick()).collect()
    assert {r.query_id for r in found} == {1, 2}
    top = [r.content for r in sorted(found, key=lambda r: r.result_rank) if r.query_id == 1]
    assert top[0] == "spark joins shuffle data" and "[REDACTED]hello spark" in top
    assert all(r.memory_layer == "L2" for r in found if r.query_id == 2)
    assert engine.items().filter("last_accessed_at is not null and user_id = 'bob'").count() == 1

    target = engine.items().filter("content = 'parquet stores columns'").first().id
    marks = frame(spark, "id string, user_id string, reason string", (target, "bob", "x"), ("nope", "ann", "x"))
    assert engine.deprecate(marks, tick()).count() == 0
    assert engine.deprecate(frame(spark, "id string, user_id string, reason string", (target, "ann", "old")), tick()).count() == 1
    assert engine.items().filter(F.col("id") == target).first().deprecated_reason == "old"
    shown = engine.list_items("ann", memory_layer="L3").collect()
    assert target not in {r.id for r in shown} and len(shown) >= 2

    points = frame(spark, "name string, content string, user_id string, project string, session_id string",
                   ("v1", "released", "ann", None, None))
    engine.checkpoint(points, tick())
    listed = engine.list_items("ann", checkpoints_only=True).collect()
    assert [(r.content, r.is_pinned, r.importance) for r in listed] == [("[Checkpoint: v1]\n\nreleased", True, 1.0)]


def test_score(spark, engine, tick):
    rows = frame(spark, "content string, importance double, is_pinned boolean, created_at timestamp",
                 ("alpha beta", .9, False, tick.now), ("gamma", 0.0, False, T0 - timedelta(days=900)))
    assert [(r.content, r.kept) for r in engine.score(rows, "alpha", tick()).orderBy("content").collect()] == [
        ("alpha beta", True), ("gamma", False)]


def test_summary_replaces_the_window(spark, engine, tick):
    assert engine.working_memory().filter("user_id = 'ann'").count() == 2
    done = engine.summarize(frame(spark, "user_id string, session_id string", ("ann", "s1"), ("ann", "none")), tick()).collect()
    assert len(done) == 1 and done[0].summary.startswith("You are a memory summarizer.")
    assert engine.working_memory().filter("user_id = 'ann'").count() == 0
    assert engine.items().filter("metadata['source'] = 'summarize'").first().memory_layer == "L2"
    totals = engine.session_totals().filter("user_id = 'ann'").first()
    assert (totals.status, totals.message_count) == ("summarized", 2)


def test_tasks(spark, engine, tick):
    engine.task_add(frame(spark, "title string, user_id string, priority string", ("a", "ann", None), ("b", "ann", "high")), tick())
    engine.task_add(frame(spark, "title string, user_id string", ("c", "ann"),), tick())
    listed = engine.task_list("ann").collect()
    assert listed[0].title == "c" and len(listed) == 3
    ids = {r.title: r.id for r in listed}
    change = "id string, user_id string, status string, priority string, title string, description string"
    assert engine.task_update(frame(spark, change, (ids["a"], "bob", "done", None, None, None)), tick()).count() == 0
    engine.task_update(frame(spark, change, (ids["a"], "ann", "done", None, "", "why")), tick())
    assert {r.title for r in engine.task_list("ann").collect()} == {"b", "c"}
    done = engine.task_list("ann", status="done").first()
    assert (done.title, done.description, done.priority) == ("a", "why", "medium")
    with pytest.raises(Exception, match="invalid status"):
        engine.task_update(frame(spark, change, (ids["a"], "ann", "lost", None, None, None)), tick())


def test_skills(spark, engine, tick):
    cols = "name string, description string, content string, user_id string, project string"
    rows = frame(spark, cols, ("Write Tests", "pytest cases", "steps", "ann", "p"), ("Deploy It", "ship code", "run", "ann", None))
    assert engine.skill_store(rows, tick()).count() == 2
    again = frame(spark, cols, ("write-tests", "x", "y", "bob", None), ("Third", "z", "w", "bob", None))
    assert [r.name for r in engine.skill_store(again, tick()).collect()] == ["Third"]
    asked = frame(spark, "query_id long, user_id string, query_text string", (1, "ann", "pytest cases"), (2, "bob", "z"))
    found = engine.skill_find(asked).filter("rank = 1").collect()
    assert {(r.query_id, r.name) for r in found} == {(1, "Write Tests"), (2, "Third")}
    who = "name string, user_id string, project string"
    got = engine.skill_get(frame(spark, who, ("write tests", "ann", None), ("Write Tests", "ann", "q"), ("Write Tests", "bob", None)))
    assert [(r.name, r.user_id) for r in got.collect()] == [("Write Tests", "ann")]
    assert engine.skill_list("ann", project="p").count() == 1
    assert engine.skill_delete(frame(spark, who, ("Write Tests", "bob", None), ("deploy-it", "ann", None)), tick()).count() == 1
    assert [r.name for r in engine.skill_list("ann").collect()] == ["Write Tests"]
    assert engine.items().filter("content = 'Deploy It'").first().is_deprecated


def test_profiles(spark, engine, tick):
    for lang in ("de", "en"):
        engine.profile_upsert(frame(spark, "user_id string, profile map<string,string>", ("ann", {"lang": lang})), tick())
    assert engine.profile_get(frame(spark, "user_id string", ("ann",))).first().profile == {"lang": "en"}


def test_retention_and_compaction(spark, engine, tick):
    before = engine.gc_stats(tick()).first()
    assert before.total_items == engine.items().count() and before.already_deprecated == 2
    own = engine.gc_stats(tick(), "bob").first()
    assert own.total_items == engine.items().filter("collection = 'ctx_other'").count() > 0
    later = tick(days=400)
    totals = {r.collection: r for r in engine.gc_run("r1", later).collect()}
    assert totals[None].deleted == 2 and totals[None].deprecated >= 3
    left = engine.items()
    assert left.filter("memory_layer = 'L4' or is_pinned").filter("is_deprecated").count() == 0
    assert engine.gc_run("r2", tick(days=1)).filter("collection is null").first().deleted == 0
    assert engine.gc_run("r3", tick(days=40), RetentionPolicy(grace_days=10)).filter(
        "collection is null").first().deleted == totals[None].deprecated
    everything = engine.items().count()
    engine.compact(tick())
    assert engine.items().count() == everything
    rows = frame(spark, "user_id string, memory_layer string, content string", ("ann", "L2", "after the base"))
    engine.store(rows, tick())
    kept = engine.items().filter("memory_layer = 'L4'").first()
    engine.deprecate(frame(spark, "id string, user_id string, reason string", (kept.id, kept.user_id, "r")), tick())
    now = engine.items()
    assert now.count() == everything + 1
    changed = now.filter(F.col("id") == kept.id).first()
    assert (changed.content, changed.is_deprecated) == (kept.content, True)
    engine.compact(tick())
    assert engine.items().count() == everything + 1
    assert engine.items().filter(F.col("id") == kept.id).first().deprecated_reason == "r"


def test_equal_content_and_invalid_items(spark, tmp_path):
    from datetime import datetime
    engine = MemoryEngine(spark, str(tmp_path / "again"))
    rows = spark.createDataFrame(
        [("ann", "L3", "same text", 0.5), ("ann", "L3", "same text", 0.5), ("ann", "L1", "ok", 0.5), ("ann", "L1", "ok", 0.5),
         ("ann", "L9", "x", 0.5), ("ann", "L3", "x", 7.5), ("ann", "L3", " ", 0.5)],
        "user_id string, memory_layer string, content string, importance double")
    for day in (1, 2):
        engine.store(rows, datetime(2024, 2, day))
    assert engine.items().filter("content = 'same text'").count() == 4
    assert engine.table("messages").select("id").distinct().count() == 4
    bad = {(r["problem"], r["content"]) for r in engine.table("quarantine").collect()}
    assert bad == {("memory_layer", "x"), ("importance", "x"), ("content", " ")}
    assert engine.table("quarantine").count() == 6


def test_reads_open_the_active_collections_only(spark, tmp_path):
    import subprocess
    from datetime import datetime
    root = str(tmp_path / "pruned")
    engine = MemoryEngine(spark, root)
    owners = spark.createDataFrame([("ann", "one"), ("bob", "two")], "user_id string, project string")
    engine.set_project(owners, datetime(2024, 2, 1))
    rows = spark.createDataFrame([("ann", "L3", "first note"), ("bob", "L3", "UNIQUEWORD note")],
                                 "user_id string, memory_layer string, content string")
    engine.store(rows, datetime(2024, 2, 2))
    listed = engine.list_items("ann")
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [collection" in plan and "ctx_one" in plan and "ctx_two" not in plan
    assert [r["content"] for r in listed.collect()] == ["first note"]
    engine.compact(datetime(2024, 2, 3))
    assert [r["content"] for r in engine.list_items("ann").collect()] == ["first note"]
    gone = engine.items().filter("user_id = 'bob'").select("id", "user_id", F.lit("old").alias("reason"))
    engine.deprecate(gone, datetime(2024, 2, 4))
    engine.gc_run("run", datetime(2024, 4, 30))
    engine.compact(datetime(2024, 5, 1))
    assert engine.items().count() == 1
    assert not subprocess.run(["grep", "-rl", "UNIQUEWORD", f"{root}/"], capture_output=True, text=True).stdout.count("items")
    MemoryEngine(spark, root)
    assert engine.items().count() == 1


def test_session_records(spark, tmp_path):
    from datetime import datetime
    engine = MemoryEngine(spark, str(tmp_path / "sessions"))
    ask = lambda *rows: spark.createDataFrame(rows, "user_id string, session_id string, status string")
    engine.session_write(ask(("ann", "s1", "active"), ("ann", "s2", "active")), "create", datetime(2024, 2, 1))
    engine.session_write(ask(("ann", "s1", "closed"), ("ann", "s9", "closed")), "update", datetime(2024, 2, 2))
    engine.session_write(ask(("ann", "s2", None)), "delete", datetime(2024, 2, 3))
    got = {(r["session_id"], r["status"], r["created_at"]) for r in engine.sessions().collect()}
    assert got == {("s1", "closed", datetime(2024, 2, 1))}


def test_repeated_requests_of_one_call_apply_in_order(spark, tmp_path):
    engine = MemoryEngine(spark, str(tmp_path / "repeated"))
    now = datetime(2024, 2, 1)
    made = engine.task_add(spark.createDataFrame([("ann", "write")], "user_id string, title string"), now).first()["id"]
    fields = "id string, user_id string, status string, priority string, title string, description string"
    updates = spark.createDataFrame([(made, "ann", "in_progress", None, None, "d1"), (made, "ann", "", "high", "", None),
                                     (made, "ann", None, None, "new", ""), (made, "bob", "done", None, None, None)], fields).coalesce(1)
    changed = engine.task_update(updates, datetime(2024, 2, 2)).collect()
    assert [(r["id"], r["title"], r["status"]) for r in changed] == [(made, "new", "in_progress")]
    tasks = engine.tasks().collect()
    assert [(r["priority"], r["description"], r["title"]) for r in tasks] == [("high", "", "new")]
    engine.set_project(spark.createDataFrame([("ann", "One"), ("ann", "Two")], "user_id string, project string").coalesce(1), now)
    assert [r["project"] for r in engine.get_project(spark.createDataFrame([("ann",)], "user_id string")).collect()] == ["two"]
    profiles = spark.createDataFrame([("ann", {"a": "1"}), ("ann", {"a": "2"})], "user_id string, profile map<string,string>")
    engine.profile_upsert(profiles.coalesce(1), now)
    assert [r["profile"] for r in engine.profile_get(spark.createDataFrame([("ann",)], "user_id string")).collect()] == [{"a": "2"}]


def test_reads_leave_the_item_log_alone_and_tools_name_their_collections(spark, tmp_path):
    engine = MemoryEngine(spark, str(tmp_path / "apart"))
    rows = "user_id string, memory_layer string, content string"
    for user, project in (("ann", "p1"), ("bob", "p2"), ("ann", "p3")):
        engine.set_project(spark.createDataFrame([(user, project)], "user_id string, project string"),
                           datetime(2024, 1, {"p1": 1, "p2": 2, "p3": 3}[project]))
        engine.store(spark.createDataFrame([(user, "L3", f"note of {project}")], rows), datetime(2024, 1, 5))
    before = engine.table("items").count()
    asked = spark.createDataFrame([(1, "ann", "note of p3")], "query_id long, user_id string, query_text string")
    for d in (1, 2):
        assert engine.retrieve(asked, datetime(2024, 2, d)).count() == 1
    assert engine.table("items").count() == before and engine.table("accesses").count() == 2
    seen = {r["content"]: r["last_accessed_at"] for r in engine.items().collect()}
    assert seen == {"note of p3": datetime(2024, 2, 2), "note of p1": None, "note of p2": None}
    # An item of a project that is no longer active can still be deprecated; others' collections are not read.
    users = spark.createDataFrame([("ann",)], "user_id string")
    assert sorted(engine._collections_of(users)) == ["ctx_default", "ctx_p1", "ctx_p3", "ctx_users"]
    old = engine.items().filter("content = 'note of p1'").first()["id"]
    marks = spark.createDataFrame([(old, "ann", "stale"), (old, "ann", "stale"), (old, "bob", "no")], "id string, user_id string, reason string")
    assert engine.deprecate(marks, datetime(2024, 2, 3)).count() == 1
    stats = engine.gc_stats(datetime(2024, 2, 4), "ann").first()
    assert stats["total_items"] == 1
    engine.compact(datetime(2024, 2, 5))
    assert engine.table("accesses").count() == 0
    after = {r["content"]: (r["last_accessed_at"], r["is_deprecated"]) for r in engine.items().collect()}
    assert after["note of p3"] == (datetime(2024, 2, 2), False) and after["note of p1"] == (None, True)
