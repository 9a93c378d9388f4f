"""Indexed search against plain search: block-pruned BM25 and pivot-pruned neighbours."""

import math
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratamem.operators import lexical_index
from stratamem.session import materialize, scratch_path


def brute_bm25(docs, query, k):
    """Scores from the definition, ties by id."""
    n, avg = len(docs), sum(len(d) for d in docs.values()) / len(docs)
    df = Counter(t for d in docs.values() for t in set(d))
    scored = []
    for i, d in docs.items():
        tf = Counter(d)
        s = sum(math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(d) / avg))
                for t in query if tf[t])
        if any(t in tf for t in query):
            scored.append((-round(s, 9), i))
    return [(i, r + 1) for r, (_, i) in enumerate(sorted(scored)[:k])]


@pytest.fixture(scope="module")
def topics(spark):
    """Texts of forty topics that share common words; neighbouring ids share a topic."""
    rng = random.Random(3)
    words = [[f"t{t}w{w}" for w in range(25)] for t in range(40)]
    common = [f"c{i}" for i in range(20)]
    docs = {}
    for i in range(1600):
        own = words[i // 40]
        docs[i] = [rng.choice(own if rng.random() < 0.5 else common) for _ in range(rng.randint(0, 30))]
    docs[1600], docs[1601] = docs[5], docs[5]
    queries = {q: [rng.choice(words[q % 40]) for _ in range(4)] + [rng.choice(common) for _ in range(6)] for q in range(30)}
    queries |= {100: [], 101: ["nowhere"], 102: ["c1"], 103: ["c1", "c1", "t0w0", "nowhere"]}
    frame = spark.createDataFrame(list(docs.items()), "id long, tokens array<string>")
    index = lexical_index.write_index(frame, "id", scratch_path(spark, "index"), near=F.floor(F.col("id") / 40), block_docs=40)
    return docs, queries, index


@pytest.mark.parametrize("k,probe", [(1, 1), (10, 4), (150, 2), (5000, 1)])
def test_bm25_topk_equals_brute_force(spark, topics, k, probe):
    docs, queries, index = topics
    asked = spark.createDataFrame(list(queries.items()), "query_id long, tokens array<string>")
    got = defaultdict(list)
    for r in lexical_index.bm25_topk(index, asked, k, probe=probe).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["id"], r["rank"]))
    assert got == {q: w for q, ts in queries.items() if (w := brute_bm25(docs, ts, k))}


def test_bm25_topk_skips_blocks(spark, topics):
    docs, queries, index = topics
    asked = spark.createDataFrame([(q, t) for q, t in queries.items() if q < 30], "query_id long, tokens array<string>")
    visited = []
    lexical_index.bm25_topk(index, asked, 5, probe=2, visited=visited).collect()
    blocks, first, second = [v.count() for v in visited]
    # 30 queries and some 40 blocks, all of which hold the common words.
    assert first == 60 and first + second < 400 and blocks < 1230


def test_postings_are_bounded_and_the_index_reopens(spark, topics):
    docs, queries, index = topics
    assert index.postings.agg(F.max(F.size("docs"))).first()[0] <= 130  # topics that share a block
    assert index.postings.filter("term = 'c1'").count() > 10
    assert index.terms.filter("term = 'c1'").first()["df"] == sum("c1" in d for d in docs.values())


def test_a_block_lies_in_one_file(spark, topics):
    lies = topics[2].postings.select("block", F.input_file_name().alias("file")).distinct()
    assert lies.groupBy("block").count().agg(F.max("count")).first()[0] == 1


def test_queries_move_a_few_rows_per_task(spark, topics, monkeypatch):
    """Neither blocks nor texts become rows per query, whose number grew with the texts."""
    docs, queries, index = topics
    asked = spark.createDataFrame(list(queries.items()), "query_id long, tokens array<string>")
    rows = {}

    def seen(df, label):
        table = materialize(df, label)
        rows[label] = table.count()
        return table

    monkeypatch.setattr(lexical_index, "materialize", seen)
    monkeypatch.setattr(lexical_index, "HELD_SCORES", 100)
    monkeypatch.setattr(lexical_index, "MAX_BLOCK_ROWS", 20)  # in two turns
    got = defaultdict(list)
    for r in lexical_index.bm25_topk(index, asked, 10, probe=4).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["id"], r["rank"]))
    assert got == {q: w for q, ts in queries.items() if (w := brute_bm25(docs, ts, 10))}
    tasks = index.blocks.rdd.getNumPartitions()
    assert rows["first-blocks"] <= 33 * 4 and rows["second-hits"] <= 33 * (10 + lexical_index.SPARE) * tasks


@pytest.mark.parametrize("held", [1, 1 << 19])
def test_blocks_hold_every_token_once(spark, monkeypatch, held):
    monkeypatch.setattr(lexical_index, "HELD_BYTES", held)
    texts = [(1, "a", ["x", "y", "x"]), (1, "b", []), (2, "c", []), (2, "d", [""]), (3, "e", ["y"]), (3, "f", ["z", "y"])]
    batch = pa.record_batch([[t[k] for t in texts] for k in (0, 1)] + [[len(t[2]) for t in texts]] * 2 + [
        [lexical_index._BETWEEN.join(t[2]) for t in texts]], ["block", "key", "length", "n", "joined"])
    rows = [r for b in lexical_index._blocks("key")(iter([batch.slice(0, 4), batch.slice(4)])) for r in b.to_pylist()]
    assert [(r["block"], r["keys"], r["lengths"]) for r in rows] == [(1, ["a", "b"], [3, 0]), (2, ["c", "d"], [0, 1]), (3, ["e", "f"], [1, 2])]
    found = Counter()
    for r in rows:
        start = 0
        for term, end in zip(r["terms"], r["ends"]):
            found.update({(r["keys"][s], term): n for s, n in zip(r["slots"][start:end], r["tfs"][start:end])})
            start = end
        assert start == len(r["slots"]) == len(r["tfs"])
    assert found == Counter((k, w) for _, k, words in texts for w in words)


def test_index_of_nothing(spark):
    empty = spark.createDataFrame([], "id long, tokens array<string>")
    index = lexical_index.write_index(empty, "id", scratch_path(spark, "index"))
    asked = spark.createDataFrame([(1, ["a"])], "query_id long, tokens array<string>")
    assert lexical_index.bm25_topk(index, asked, 3).collect() == []


# -- neighbours -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def clustered(spark):
    """Items around twelve centres for two tenants, one holding most; some without direction or of other length."""
    import numpy as np
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    rows = []
    for i in range(3000):
        v = centres[i % 12] + 0.15 * rng.normal(size=16)
        rows.append((i, "a" if i % 8 else "b", f"s{i % 3}", None, i % 50 == 49, [float(x) for x in v]))
    rows += [(3000 + i, "a", "s0", None, False, [0.0] * 16) for i in range(5)]
    rows += [(3100 + i, "a", "s0", None, False, [1.0, float(i)]) for i in range(5)]
    rows += [(3200 + i, "a", "s1", None, False, rows[0][5]) for i in range(300)] + [(3600, "a", "s1", None, False, None)]
    items = spark.createDataFrame(
        rows, "id long, user_id string, session_id string, project string, is_deprecated boolean, embedding array<double>")
    asked = [(q, "a" if q % 3 else "b", "s1" if q % 4 == 0 else None, None,
              [float(x) for x in centres[q % 12] + 0.15 * rng.normal(size=16)]) for q in range(60)]
    asked += [(100, "a", None, None, [0.0] * 16), (101, "a", None, None, [1.0, 1.0]), (102, "nobody", None, None, [1.0] * 16),
              (103, "a", "", None, [-float(x) for x in centres[0]]), (104, "a", None, None, None)]
    return items, spark.createDataFrame(
        asked, "query_id long, user_id string, session_id string, project string, embedding array<double>")


@pytest.mark.parametrize("k,threshold,probe", [(7, 0.0, 2), (400, -1.0, 1), (5, 0.9, 1)])
def test_pruned_search_equals_plain_search(spark, clustered, k, threshold, probe):
    from stratamem.operators import knn_pruned
    from stratamem.operators.knn import knn
    items, asked = clustered
    index = knn_pruned.build(items, pivots=24, block_items=64)
    got = knn_pruned.knn_pruned(index, asked, k, threshold, probe=probe, max_block=16)
    want = knn(items, asked, k, group=None, threshold=threshold)

    def rows(frame):
        return sorted((r["query_id"], r["rank"], r["id"], round(r["semantic"], 8)) for r in frame.collect())
    assert rows(got) == rows(want)


def test_pruned_search_skips_blocks(spark, clustered):
    from stratamem.operators import knn_pruned
    items, asked = clustered
    index = knn_pruned.build(items, pivots=24, block_items=64)
    assert index.items.groupBy(*knn_pruned.BLOCK).count().agg(F.max("count")).first()[0] < 110
    visited = []
    knn_pruned.knn_pruned(index, asked.filter("query_id < 60 AND session_id IS NULL"), 5, probe=2, visited=visited).collect()
    pairs, first, second = [v.count() for v in visited]
    assert first + second < pairs / 4
    # A block is shuffled once, whether one query or all of them visit it.
    blocks = second and visited[2].select(*knn_pruned.BLOCK).distinct().count()
    assert blocks <= index.blocks.count()
