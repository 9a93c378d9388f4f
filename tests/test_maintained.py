"""Folded deltas equal recounts; pages cover a scan; ISO texts are read as the standard says."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from stratamem.functions.isotime import parse_iso
from stratamem.operators import lifecycle, maintained, paging


def test_term_deltas_equal_a_recount(spark):
    rng = random.Random(1)
    log, now = [], {}
    steps = {}
    for _ in range(600):
        i = rng.randint(0, 60)
        steps[i] = steps.get(i, -1) + 1
        if rng.random() < 0.3:
            log.append((i, steps[i], "delete", ["gone"]))
            now.pop(i, None)
        else:
            now[i] = [rng.choice("abcdefghij") for _ in range(rng.randint(0, 6))]
            log.append((i, steps[i], "upsert", now[i]))
    frame = spark.createDataFrame(log, "id long, seq long, op string, tokens array<string>")
    changes = maintained.change_images(frame, "id", ["tokens"])
    parts = [maintained.signed(changes.filter(c)) for c in ("seq < 3", "seq >= 3 AND seq < 6", "seq >= 6")]
    df = maintained.fold([maintained.doc_freq_delta(p) for p in parts], ["term"], ["df"])
    want = {}
    for tokens in now.values():
        for t in set(tokens):
            want[t] = want.get(t, 0) + 1
    assert {r["term"]: r["df"] for r in df.collect()} == want
    corpus = maintained.fold([maintained.corpus_delta(p) for p in parts], [], ["docs", "tokens"]).first()
    assert tuple(corpus) == (len(now), sum(map(len, now.values())))


def test_unchanged_terms_cancel(spark):
    frame = spark.createDataFrame([(1, 0, "upsert", ["a", "b"]), (1, 1, "upsert", ["b", "c"]), (2, 0, "delete", ["x"])],
                                  "id long, seq long, op string, tokens array<string>")
    rows = maintained.signed(maintained.change_images(frame, "id", ["tokens"]).filter("seq = 1"))
    assert {(r["term"], r["df"]) for r in maintained.doc_freq_delta(rows).collect()} == {("a", -1), ("c", 1)}


def test_retention_counts_hold_at_later_times(spark):
    rng = random.Random(2)
    start = datetime(2024, 1, 1)
    rows = [(i, "c" if i % 3 else "d", rng.choice(["L2", "L3", "L4", "L9"]), rng.choice([0.0, 0.5, 1.0, None]), i % 7 == 0,
             i % 4 == 0, start - timedelta(days=rng.randint(0, 200), seconds=rng.randint(0, 9)), None,
             start - timedelta(days=rng.randint(0, 60)) if i % 4 == 0 and i % 8 else None, None) for i in range(400)]
    items = spark.createDataFrame(
        rows, "id long, collection string, memory_layer string, importance double, is_pinned boolean, is_deprecated boolean, "
              "created_at timestamp, last_accessed_at timestamp, deprecated_at timestamp, item_type string")
    fields = ["collection", "state", "due"]
    log = maintained.retention_fields(items, F.lit(start)).withColumns({"seq": F.lit(0), "op": F.lit("upsert")})
    state = maintained.gc_delta(maintained.signed(maintained.change_images(log, "id", fields)))
    for days in (0, 11, 75):
        at = F.lit(start + timedelta(days=days))
        assert sorted(maintained.gc_stats(state, at).collect()) == sorted(lifecycle.gc_stats(items, at, ["collection"]).collect())


# -- pages ---------------------------------------------------------------------------------


@pytest.mark.parametrize("n,size", [(1003, 100), (100, 100), (7, 100), (0, 10)])
def test_pages_cover_the_scan(spark, n, size):
    items = spark.createDataFrame([(f"k{i:05}", "L2", i % 9 == 0) for i in random.Random(3).sample(range(5000), n)],
                                  "id string, memory_layer string, is_deprecated boolean")
    scan = paging.scan_pages(items, "id", size)
    got, offset, pages = [], None, 0
    while True:
        page, offset = scan.fetch(offset)
        got += [r["id"] for r in page.orderBy("id").collect()]
        pages += 1
        assert len(got) == min(n, pages * size)
        if offset is None:
            break
    assert got == sorted(r["id"] for r in items.collect()) and pages == max(1, -(-n // size))
    with pytest.raises(KeyError):
        scan.fetch("no such cursor")


def test_a_page_reads_a_key_range(spark):
    scan = paging.scan_pages(spark.range(1000), "id", 100)
    page, following = scan.fetch(300)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert following == 400 and "GreaterThanOrEqual(id,300)" in plan and "LessThan(id,400)" in plan


def test_what_a_scan_covers(spark):
    items = spark.createDataFrame([(1, "L2", False), (2, "L2", True), (3, "L3", None)],
                                  "id long, memory_layer string, is_deprecated boolean")

    def ids(frame):
        return sorted(r["id"] for r in frame.collect())
    assert ids(paging.live(items)) == [1, 3] and ids(paging.live(items, "L2", True)) == [1, 2]


# -- times ---------------------------------------------------------------------------------


GOOD = ["2024-02-29", "20240229", "2024-02-29T01", "2024-02-29 01:02", "2024-02-29T01:02:03", "20240229T010203",
        "2024-02-29T01:02:03.5", "2024-02-29T01:02:03,123456", "2024-02-29T01:02:03.123456789", "2024-02-29T01:02:03Z",
        "2024-02-29T01:02:03+05:30", "2024-02-29T01:02:03-0530", "2024-02-29T01:02:03.25-11", "2024-02-29T23:59:59+23:59:59",
        "2024-02-29T01:02:03+01:00:00.500000", "0001-01-01", "9999-12-31T23:59:59.999999", "2024-02-29x01:02", "1969-12-31T23:59:59.1"]
BAD = ["", " ", "yesterday", "2023-02-29", "2024-13-01", "2024-00-10", "2024-1-1", "2024-02-2901:02", "2024-02-29T24:00",
       "2024-02-29T01:60", "2024-02-29T01:02:60", "2024-02-29T01:02:03+24:00", "2024-02-29T1:02", "2024-02-29 ", " 2024-02-29",
       "2024-02-29T01:02:03ZZ", "2024-0229", "2024-02-29T01:0203", "2024-02-29T01:02:03.", "29.02.2024", None]


def test_iso_texts(spark):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(GOOD + BAD)], "i int, s string").select(
        "i", F.unix_micros(parse_iso(F.col("s"))).alias("m")).collect()
    got = {r["i"]: r["m"] for r in rows}
    epoch = datetime(1970, 1, 1, tzinfo=timezone.utc)
    for i, s in enumerate(GOOD):
        want = datetime.fromisoformat(s)
        want = want if want.tzinfo else want.replace(tzinfo=timezone.utc)
        assert got[i] == (want - epoch) // timedelta(microseconds=1), s
    assert [s for i, s in enumerate(BAD) if got[len(GOOD) + i] is not None] == []


# -- lookups ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def records(spark):
    from stratamem.plans import keyed
    rows = [(i, f"u{i % 3}", s, f"v{s}") for i in range(50) for s in range(1 + i % 3)] + [(None, "u0", 0, "no key")]
    log = keyed.write_keyed(spark.createDataFrame(rows, "key long, owner string, seq int, value string"), "key", buckets=4)
    yield log
    log.drop()


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_fold_and_lookup_do_not_shuffle_the_log(spark, records):
    assert "Exchange" not in plan_of(records.newest())
    from stratamem.plans import keyed
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        asked = spark.range(40).select("id", F.col("id").alias("key"), F.lit("u0").alias("user_id"))
        plan = plan_of(keyed.lookup(records, asked))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # One exchange at most, and it is that of the requests.
    parts = plan.split("Exchange ")
    assert len(parts) == 2 and "FileScan" not in parts[1].split("SortAggregate")[0].split("+- Sort")[0].split("ObjectHash")[0]


def test_lookup_outcomes(spark, records):
    from stratamem.plans import keyed
    asked = spark.createDataFrame([(0, "u0"), (1, "u1"), (1, "u1"), (2, "u0"), (5, None), (99, "u0"), (None, "u0")],
                                  "key long, user_id string")
    got = sorted((repr(r["key"]), repr(r["user_id"]), r["outcome"], r["value"], r["owner"])
                 for r in keyed.lookup(records, asked).collect())
    assert got == sorted([("0", "'u0'", "found", "v0", "u0"), ("1", "'u1'", "found", "v1", "u1"), ("1", "'u1'", "found", "v1", "u1"),
                          ("2", "'u0'", "denied", None, None), ("5", "None", "denied", None, None),
                          ("99", "'u0'", "missing", None, None), ("None", "'u0'", "missing", None, None)])
    shared = keyed.lookup(records, asked.filter("key = 2"), public=F.col("value") == "v2").first()
    assert shared["outcome"] == "found" and shared["value"] == "v2"
