"""Operators against brute force."""

import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stratamem import constants as K
from stratamem.operators import budget, chunking, diversify, lexical, records, summaries
from stratamem.operators.knn import knn
from stratamem.operators.topn import dedup_keep_first, last_n_window, top_n_per_group


def knn_fixture(spark, seed=3, items=400, queries=23):
    rng = np.random.default_rng(seed)
    pool = rng.normal(size=(40, 6)).astype("float32")  # few vectors, hence many exact ties
    rows = []
    for i in range(items):
        emb = [float(x) for x in pool[rng.integers(40)]]
        if i % 50 == 0:
            emb = None
        elif i % 51 == 0:
            emb = [0.0] * 6
        elif i % 53 == 0:
            emb = emb[:4]
        rows.append((i, "hot" if rng.random() < .6 else f"u{rng.integers(3)}", f"s{rng.integers(3)}",
                     None if i % 4 == 0 else f"p{i % 2}", ["L2", "L3", "L4"][i % 3], i % 13 == 0, emb))
    item_df = spark.createDataFrame(rows, "id long, user_id string, session_id string, project string, "
                                    "memory_layer string, is_deprecated boolean, embedding array<float>")
    asked = [(q, "hot" if q % 2 else f"u{q % 3}", "s1" if q % 3 == 0 else ("" if q % 3 == 1 else None),
              "p1" if q % 4 == 0 else None, [float(x) for x in pool[q % 40]]) for q in range(queries)]
    query_df = spark.createDataFrame(asked, "query_id long, user_id string, session_id string, project string, "
                                     "embedding array<float>")
    return rows, asked, item_df, query_df


def brute_knn(rows, asked, k, threshold, by_layer, free):
    out = set()
    for q, user, session, project, qv in asked:
        groups = {}
        for i, u, s, p, layer, dead, e in rows:
            if dead or e is None or len(e) != len(qv) or u != user or (session and s != session):
                continue
            if project and p != project and layer not in free:
                continue
            a, c = np.array(e, dtype="float64"), np.array(qv, dtype="float64")
            size = np.linalg.norm(a) * np.linalg.norm(c)
            key = np.floor((a @ c / size if size else 0.0) * 1e9 + .5) / 1e9
            if key >= threshold:
                groups.setdefault(layer if by_layer else "", []).append((-key, i))
        for g, hits in groups.items():
            out |= {(q, g, i, n) for n, (_, i) in enumerate(sorted(hits)[:k], 1)}
    return out


@pytest.mark.parametrize("by_layer,threshold,max_block", [(True, 0.0, 4096), (False, 0.2, 4), (True, -1.0, 5)])
def test_knn_equals_brute_force(spark, by_layer, threshold, max_block):
    rows, asked, items, queries = knn_fixture(spark)
    got = knn(items, queries, 7, "memory_layer" if by_layer else None, threshold,
              unfiltered={"L4": ("project",)} if by_layer else None, max_block=max_block)
    layer = F.col("memory_layer") if by_layer else F.lit("")
    found = {tuple(r) for r in got.select("query_id", layer, "id", "rank").collect()}
    assert found == brute_knn(rows, asked, 7, threshold, by_layer, {"L4"} if by_layer else set())


def test_knn_merges_more_hits_than_fit_one_merge(spark, monkeypatch):
    import stratamem.operators.knn as module
    monkeypatch.setattr(module, "MERGE_ROWS", 10)
    monkeypatch.setattr(module, "QUERY_SLICE", 2)
    rows, asked, items, queries = knn_fixture(spark, seed=5)
    got = module.knn(items.coalesce(1), queries, 5)
    found = {tuple(r) for r in got.select("query_id", "memory_layer", "id", "rank").collect()}
    assert found == brute_knn(rows, asked, 5, 0.0, True, set())


def test_knn_without_queries_or_with_string_ids(spark):
    _, _, items, queries = knn_fixture(spark)
    assert knn(items, queries.limit(0), 3).count() == 0
    unembedded = queries.withColumn("embedding", F.lit(None).cast("array<float>"))
    assert knn(items, unembedded, 3).count() == 0
    named = items.withColumn("id", F.format_string("i%05d", "id"))
    assert knn(named, queries, 3).filter(F.col("rank") == 1).count() > 0


@pytest.mark.parametrize("salts", [1, 4])
def test_top_n_with_a_hot_group(spark, salts):
    rows = [("hot" if i % 3 else f"g{i % 7}", (i * 37) % 101, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, v int, id int")
    got = top_n_per_group(df, ["g"], [F.col("v").desc(), F.col("id")], 5, "rank", salts, ["id"])
    want = set()
    for g in {r[0] for r in rows}:
        best = sorted((-v, i) for gg, v, i in rows if gg == g)[:5]
        want |= {(g, i, n) for n, (_, i) in enumerate(best, 1)}
    assert {tuple(r) for r in got.select("g", "id", "rank").collect()} == want


def test_group_limit_runs_before_the_shuffle(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 3)
    plan = top_n_per_group(df, ["g"], [F.col("id")], 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_last_n_and_dedup(spark):
    df = spark.createDataFrame([("u", "s", i, f"m{i}") for i in range(30)], "user_id string, session_id string, seq int, c string")
    assert sorted(r.seq for r in last_n_window(df).collect()) == list(range(10, 30))
    first = dedup_keep_first(df, ["user_id"], [F.col("seq")]).collect()
    assert [r.seq for r in first] == [0]


def test_bm25_matches_direct_formula(spark):
    docs = [["python", "code", "python"], ["java", "code"], [], ["python"]]
    query = ["python", "code", "code", "absent"]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)

    def score(d):
        total = 0.0
        for t in query:
            df = sum(t in x for x in docs)
            tf = d.count(t)
            if tf:
                total += np.log((n - df + .5) / (df + .5) + 1) * tf * 2.5 / (tf + 1.5 * (.25 + .75 * len(d) / avg))
        return total

    want = [score(d) for d in docs]
    df = spark.createDataFrame(list(enumerate(docs)), "id int, tokens array<string>")
    got = dict(lexical.bm25_against_corpus(df, "id", query).collect())
    assert [got[i] for i in range(4)] == pytest.approx(want)
    rows = df.withColumn("query_id", F.lit(1))
    asked = spark.createDataFrame([(1, query)], "query_id int, tokens array<string>")
    grouped = lexical.bm25_within_groups(rows, lexical.query_terms(asked, "query_id", "tokens"), ["query_id"])
    by_id = {r.id: r.bm25 for r in grouped.collect()}
    assert [by_id.get(i, 0.0) for i in range(4)] == pytest.approx(want)


def test_empty_corpus_has_zero_average(spark):
    df = spark.createDataFrame([], "id int, tokens array<string>")
    assert lexical.corpus_stats(df).first().avg_doc_len == 0.0


def test_budget_prefix_stops_at_first_overflow(spark):
    rows = [("L3", i, False, 1100, 1.0 - i / 10) for i in range(5)] + [("L4", 9, False, 400, .9), ("L4", 10, True, 300, .1),
            ("L4", 11, False, 10, .2)]
    df = spark.createDataFrame(rows, "layer string, id int, is_pinned boolean, token_estimate int, score double")
    got = budget.budget_prefix(df, ["layer"], [F.col("score").desc()], budget.layer_limit(F.col("layer")))
    # The pinned row goes first; the next one overflows and ends the prefix.
    assert sorted(r.id for r in got.collect()) == [0, 10]


def test_allocation(spark):
    row = budget.allocation(spark).first()
    assert (row.total_used, row.remaining, row.L3) == (14500, 113500, 2000)


def round_robin_by_hand(sources, k):
    if len(sources) <= k:
        return list(range(len(sources)))
    names = list(dict.fromkeys(sources))
    queues = {n: [i for i, s in enumerate(sources) if s == n] for n in names}
    out, start = [], 0
    while len(out) < k:
        for step in range(len(names)):
            queue = queues[names[(start + step) % len(names)]]
            if queue and len(out) < k:
                out.append(queue.pop(0))
        start += 1
    return out


def test_round_robin_equals_simulation(spark):
    rnd = random.Random(7)
    cases = [[f"s{rnd.randint(0, rnd.randint(0, 5))}" for _ in range(rnd.randint(1, 18))] for _ in range(150)]
    df = spark.createDataFrame([(g, i, s) for g, c in enumerate(cases) for i, s in enumerate(c)], "g int, i int, s string")
    got = {}
    for r in diversify.round_robin(df, ["g"], [F.col("i")], 6, F.col("s")).orderBy("g", "pos").collect():
        got.setdefault(r.g, []).append(r.i)
    assert got == {g: round_robin_by_hand(c, 6) for g, c in enumerate(cases)}


def mmr_by_hand(scores, vectors, k, lam):
    n = len(scores)
    if k >= n:
        return list(range(n))
    rest = [i for i in range(n) if vectors[i]]
    if not rest:
        return list(range(k))
    def cos(a, b):
        a, b = np.array(a), np.array(b)
        size = np.linalg.norm(a) * np.linalg.norm(b)
        return float(a @ b / size) if len(a) == len(b) and size else 0.0
    chosen = []
    while rest and len(chosen) < k:
        value = {i: round(lam * scores[i] - (1 - lam) * max([0.0] + [cos(vectors[i], vectors[j]) for j in chosen]), 9) for i in rest}
        best = max(rest, key=lambda i: (value[i], -i))
        chosen.append(best)
        rest.remove(best)
    return chosen + [i for i in range(n) if not vectors[i]][:k - len(chosen)]


def test_mmr_equals_simulation(spark):
    rng = np.random.default_rng(11)
    rows, want = [], {}
    for g in range(60):
        n, lam = int(rng.integers(1, 14)), 0.6
        scores = sorted((round(float(x), 4) for x in rng.random(n)), reverse=True)
        vectors = [None if rng.random() < .2 else [float(x) for x in rng.integers(-2, 3, size=3)] for _ in range(n)]
        rows += [(g, i, s, v) for i, (s, v) in enumerate(zip(scores, vectors))]
        want[g] = mmr_by_hand(scores, vectors, 5, lam)
    df = spark.createDataFrame(rows, "g int, ord int, score double, embedding array<double>")
    got = {}
    for r in diversify.mmr(df, ["g"], ["score", "ord"], 5).orderBy("g", "pos").collect():
        got.setdefault(r.g, []).append(r.ord)
    assert got == want


@pytest.mark.parametrize("lam,first_two", [(1.0, [0, 1]), (0.0, [0, 2])])
def test_mmr_extremes(lam, first_two):
    vectors = [[1.0, 0, 0], [1.0, 0, 0], [0, 1.0, 0], [0, 0, 1.0]]
    assert diversify.mmr_order(np.array([.9, .8, .7, .6]), vectors, 2, lam) == first_two


def consume_chunks(text, got, size, overlap, seps):
    """Take the chunks of ``text`` off the front of ``got``, each checked as a longest run of pieces."""
    if len(text) <= size:
        assert got.pop(0) == text
        return
    sep = next((s for s in seps if s in text), "")
    if not sep:
        step = max(1, size - overlap)
        reach = 0
        while reach * step + size < len(text):
            assert got.pop(0) == text[reach * step:reach * step + size]
            reach += 1
        assert got.pop(0) == text[reach * step:]
        return
    finer, pieces, lead, carried = seps[seps.index(sep) + 1:], text.split(sep), "", False
    while pieces:
        if not lead and not pieces[0]:
            pieces, carried = pieces[1:], False
        elif finer and not carried and len(pieces[0]) > size:
            consume_chunks(pieces.pop(0), got, size, overlap, finer)
        else:
            fits = [n for n in range(1, len(pieces) + 1) if len(lead + sep.join(pieces[:n])) <= size]
            run = max(fits, default=1)
            chunk = got.pop(0)
            assert chunk == lead + sep.join(pieces[:run])
            pieces, carried = pieces[run:], True
            lead = chunk[-overlap:] + sep if overlap else ""


@pytest.mark.parametrize("size,overlap", [(100, 20), (50, 10), (30, 0), (10, 9), (600, 80)])
def test_chunks_are_longest_runs(size, overlap):
    rnd = random.Random(size)
    bits = ["word", "a", "longerword" * 9, ". ", ", ", "\n", "\n\n", " ", "! ", "é", "; ", "", "x" * 40, "  "]
    for _ in range(300):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 120)))
        for seps in (list(K.SEPARATORS), ["\n", ","]):
            got = [c[0] for c in chunking.split_recursively(text, size, overlap, seps)]
            if text.strip():
                consume_chunks(text, got, size, overlap, seps)
            assert got == []


def test_chunk_positions_count_consumed_pieces():
    assert chunking.split_recursively("aaaa bbbb cccc dddd", 10, 3) == [
        ("aaaa bbbb", 2, 11), ("bbb cccc", 8, 16), ("ccc dddd", 13, 21)]
    assert chunking.split_recursively("x" * 14, 10, 3) == [("x" * 10, 0, 10), ("x" * 7, 7, 14)]


def test_chunk_long_texts(spark):
    docs = spark.createDataFrame([(1, "short"), (2, "word " * 400), (3, " " * 700), (4, None)], "id int, t string")
    got = chunking.chunk_long_texts(docs, "t", ["id"]).orderBy("id", "chunk_index").collect()
    assert [(r.id, r.chunk_index) for r in got if r.id != 2] == [(1, 0), (4, 0)]
    long = [r for r in got if r.id == 2]
    assert len(long) == long[0].chunk_total > 1
    assert all(b.chunk_text.startswith(a.chunk_text[-80:]) for a, b in zip(long, long[1:]))


@pytest.mark.parametrize("size,overlap", [(600, 80), (10, 9), (7, 0), (5, 3)])
def test_char_windows_of_any_shape(spark, size, overlap):
    texts = ["", "x", "ab\ncdé😀fghijklmnop" * 3, "z" * size, "y" * (size + 1)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {}
    for r in chunking.char_windows(docs, "t", ["id"], size, overlap).orderBy("id", "chunk_index").collect():
        got.setdefault(r.id, []).append((r.chunk_text, r.start_pos))
    step = size - overlap
    for i, t in enumerate(texts):
        starts = [a for a in range(0, len(t), step) if a == 0 or a - step + size < len(t)]
        assert got.get(i, []) == [(t[a:a + size], a) for a in starts]


def test_sparse_vector_map(spark):
    docs = [["a", "b", "a"], ["b"], []]
    df = spark.createDataFrame(list(enumerate(docs)), "id int, tokens array<string>")
    long = {(r.id, r.term): r.weight for r in lexical.sparse_vectors(df, "id").collect()}
    idf = {t: np.log((3 - n + .5) / (n + .5) + 1) for t, n in (("a", 1), ("b", 2))}
    maps = df.select("id", lexical.sparse_vector_map(
        F.col("tokens"), F.create_map(*[F.lit(x) for kv in idf.items() for x in kv]), F.lit(4 / 3)).alias("m"))
    for r in maps.collect():
        assert r.m == pytest.approx({t: w for (i, t), w in long.items() if i == r.id})


def test_char_windows_cover_the_text(spark):
    texts = ["x" * n for n in (1, 599, 600, 601, 1120, 1121, 5000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for r in chunking.char_windows(docs, "t", ["id"]).collect():
        n, at = len(texts[r.id]), r.start_pos
        assert r.chunk_text == texts[r.id][at:at + 600]
        assert (r.chunk_index == r.chunk_total - 1) == (at + 600 >= n)


def test_paragraph_groups(spark):
    docs = spark.createDataFrame([(1, "a\n\n\n\n b \n\nc\n\n\nd"), (2, " \n\n "), (3, None)], "id int, t string")
    got = chunking.paragraph_groups(docs, "t", ["id"]).orderBy("group_index").collect()
    assert [(r.id, r.content) for r in got] == [(1, "a\n\nb\n\nc"), (1, "d")]


def test_fold_events(spark):
    t = [datetime(2024, 1, d) for d in range(1, 9)]
    item = lambda v: (v, False, None, None, None)
    rows = [(1, 1, "upsert", t[0], None, item("v1")), (1, 2, "upsert", t[1], None, item("v2")),
            (1, 3, "touch", t[2], None, None), (1, 4, "deprecate", t[3], "old", None),
            (2, 1, "upsert", t[0], None, item("x")), (2, 2, "delete", t[1], None, None),
            (3, 1, "upsert", t[0], None, item("y")), (3, 2, "delete", t[1], None, None),
            (3, 3, "upsert", t[2], None, item("z")), (4, 1, "touch", t[0], None, None),
            (5, 1, "upsert", t[0], None, item("q")), (5, 2, "deprecate", t[1], "r", None),
            (5, 3, "upsert", t[2], None, item("q2"))]
    log = spark.createDataFrame(rows, "id int, seq int, op string, ts timestamp, reason string, item struct<v:string,"
                                "is_deprecated:boolean,deprecated_at:timestamp,deprecated_reason:string,last_accessed_at:timestamp>")
    got = {r.id: r for r in records.fold_events(log).collect()}
    assert set(got) == {1, 3, 5}
    assert (got[1].v, got[1].is_deprecated, got[1].deprecated_reason, got[1].last_accessed_at) == ("v2", True, "old", t[2])
    assert (got[3].v, got[3].is_deprecated) == ("z", False)
    assert (got[5].v, got[5].is_deprecated, got[5].deprecated_reason) == ("q2", False, None)


def test_entities(spark):
    replies = ['SUMMARY: ok\nENTITIES: [{"name":"n","type":"t","value":"v"}]', "SUMMARY: a\nSUMMARY:  b ", "ENTITIES: [oops",
               'ENTITIES: [{"name":"n","type":"t","value":"v","confidence":2}]', 'ENTITIES: [{"name":"n"}]', "ENTITIES: {}"]
    df = spark.createDataFrame(list(enumerate(replies)), "i int, r string")
    got = df.select("i", summaries.reply_summary(F.col("r")).alias("s"), summaries.reply_entities(F.col("r")).alias("e")).orderBy("i").collect()
    assert [r.s for r in got] == ["ok", "b", "", "", "", ""]
    assert [len(r.e) for r in got] == [1, 0, 0, 0, 0, 0]
    assert got[0].e[0].confidence == 1.0


def test_bounded_groups_do_not_hide_a_global_window(spark):
    df = spark.range(10).withColumn("g", F.col("id") % 2)
    total = df.withColumn("n", F.count("*").over(Window.partitionBy("g")))
    assert "SinglePartition" not in total._jdf.queryExecution().executedPlan().toString()


def test_join_by_frequency_with_hot_keys(spark):
    from stratamem.operators.bounded import join_by_frequency
    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(
        F.concat(F.lit("k"), F.col("id") % 700)).alias("term"))
    counts = rows.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    got = join_by_frequency(rows, counts, "term", "n", 5000, limit=2)
    assert got.count() == 5000
    assert got.exceptAll(rows.join(counts, "term").select(*got.columns)).count() == 0


def test_window_after_clear(spark):
    cols = "user_id string, session_id string, seq int"
    sent = spark.createDataFrame([("u", s, i) for s in "abc" for i in range(40)], cols)
    clears = spark.createDataFrame([("u", "a", 35), ("u", "b", 3), ("u", "a", 30), ("u", "z", 1)], cols)
    got = {}
    for r in records.window_after_clear(sent, clears).orderBy("pos").collect():
        got.setdefault(r.session_id, []).append(r.seq)
    assert got == {"a": [39, 38, 37, 36], "b": list(range(39, 19, -1)), "c": list(range(39, 19, -1))}


def test_parts_of_separators_only_are_passed_over():
    for text in (". " * 400 + "\n\nfoo", " " * 700 + "\n\nfoo bar", "x" * 700 + "\n\n" + ". " * 400 + "\n\nend"):
        chunks = chunking.split_recursively(text)
        assert chunks and all(t in text or len(t) > 600 for t, _, _ in chunks)
        starts = [a for _, a, _ in chunks]
        assert starts == sorted(starts)


def test_many_queries_read_the_items_once(spark, tmp_path):
    import numpy as np
    rng = np.random.default_rng(4)
    users = ["a", "b", "c"]
    items = spark.createDataFrame(
        [(i, users[i % 5 % 3], f"L{i % 2}", None if i % 7 else "s", None, False,
          rng.normal(size=4 if i % 50 else 3).tolist()) for i in range(900)],
        "id long, user_id string, memory_layer string, session_id string, project string, is_deprecated boolean, "
        "embedding array<double>")
    items.write.parquet(f"{tmp_path}/items")
    items = spark.read.parquet(f"{tmp_path}/items")
    queries = spark.createDataFrame(
        [(q, users[q % 3], "s" if q % 4 == 0 else None, None, rng.normal(size=3 if q % 100 == 0 else 4).tolist())
         for q in range(10_500)], "query_id long, user_id string, session_id string, project string, embedding array<double>")
    few = queries.filter("query_id < 1000")
    fetched = knn(items, few, 3).collect()
    sliced = knn(items, few, 3, max_block=64, slice_items=100).collect()
    key = lambda r: (r["query_id"], r["memory_layer"], r["rank"])
    assert [(*key(r), r["id"]) for r in sorted(sliced, key=key)] == [(*key(r), r["id"]) for r in sorted(fetched, key=key)]
    many = knn(items, queries, 2, slice_items=100)
    assert many.select("query_id").distinct().count() > 10_000
    assert many._jdf.queryExecution().executedPlan().toString().count(f"{tmp_path}/items") <= 1


def test_new_rows_are_unique_among_themselves(spark):
    have = spark.createDataFrame([("a", "x")], "name string, slug string")
    new = spark.createDataFrame([("b", "y"), ("b", "z"), ("c", "y"), ("d", "x"), ("e", "w")], "name string, slug string")
    got = records.insert_unique(have, new, ["name", "slug"]).collect()
    assert sorted(map(tuple, got)) == [("b", "y"), ("e", "w")]


def test_chunker_holds_slices_of_a_batch(spark):
    import pyarrow as pa

    from stratamem.operators import chunking
    texts = pa.array(["a" * 30, None, "b" * 80, "", "c" * 40, "d" * 50])
    runs = [r.to_pylist() for r in chunking.text_slices(texts, 100)]
    assert [len(r) for r in runs] == [2, 2, 2] and sum(runs, []) == texts.to_pylist()
    assert [r.to_pylist() for r in chunking.text_slices(pa.array([], pa.string()), 100)] == [[]]
    # Long and short texts of one batch of 3 MB, which is cut in several slices, keep their chunks.
    rows = [(i, f"word{i} " * (i % 7 * 3000)) for i in range(40)]
    docs = spark.createDataFrame(rows, "id long, body string").coalesce(1)
    got = chunking.chunk_long_texts(docs, "body", ["id"]).orderBy("id", "chunk_index").collect()
    want = [(i, n, t) for i, body in rows if len(body) > 0 for n, (t, _, _) in enumerate(chunking.split_recursively(body))]
    assert [(r["id"], r["chunk_index"], r["chunk_text"]) for r in got if r["chunk_text"]] == want
