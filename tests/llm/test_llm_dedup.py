"""Exact copies, similar shingle sets and repeated passages against brute force."""

import hashlib
import os
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stratamem.llm import exact_dedup, joins, ngram_join, substring_dedup
from stratamem.llm.batches import Texts
from stratamem.session import materialize, shared_dir

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pairs_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.collect()]


# -- exact dedup --------------------------------------------------------------------


def check_exact(docs, got):
    rows = pairs_of(docs)
    groups = defaultdict(list)
    for i, t in rows:
        groups[t.translate(LOWER)].append(i)
    assert len(got) == len(rows)
    kept = Counter()
    for r in got:
        match = [(t, ids) for t, ids in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"]]
        (text, ids), = match
        best = max((i for i in ids if i is not None), default=None)
        assert r["doc_id"] in ids and r["keep_id"] == best and r["group_size"] == len(ids)
        kept[text] += r["kept"]
        assert not r["kept"] or r["doc_id"] == best
    assert all(kept[t] == 1 for t in groups)


@pytest.mark.parametrize("table_bytes", [1, 3000, 64 << 20])
def test_exact_edges(edge_docs, table_bytes):
    if table_bytes == 1:
        edge_docs = edge_docs.filter("doc_id < 9 or doc_id is null")
    check_exact(edge_docs, exact_dedup.exact_duplicates(edge_docs, table_bytes).collect())


def test_exact_hot_groups_are_broadcast(spark):
    docs = spark.createDataFrame([(i, "same" if i % 3 else f"t{i}") for i in range(3000)], "doc_id long, text string")
    check_exact(docs, exact_dedup.exact_duplicates(docs, broadcast_rows=2).collect())


def test_exact_empty_table(no_docs):
    assert exact_dedup.exact_duplicates(no_docs).collect() == []
    assert exact_dedup.drop_copies(no_docs).collect() == []


def test_drop_copies_keeps_columns(edge_docs):
    left = exact_dedup.drop_copies(edge_docs)
    assert left.columns == edge_docs.columns
    texts = [t.translate(LOWER) for _, t in pairs_of(left)]
    assert len(texts) == len(set(texts)) == len({t.translate(LOWER) for _, t in pairs_of(edge_docs)})


def test_drop_copies_tells_repeated_ids_apart(spark):
    rows = [(1, "a"), (1, "a"), (1, "B"), (2, "b"), (None, "c"), (None, "C"), (None, "d"), (3, "d"), (4, None), (5, "")]
    docs = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "doc_id long, text string, n int")
    left = sorted(((r["doc_id"], (r["text"] or "").lower()) for r in exact_dedup.drop_copies(docs).collect()),
                  key=lambda r: r[1])
    assert left == [(5, ""), (1, "a"), (2, "b"), (None, "c"), (3, "d")]


def test_drop_copies_moves_no_text_beyond_the_broadcast_limit(spark):
    docs = spark.createDataFrame([(i, f"t{i % 40}") for i in range(400)] + [(7, "t7"), (None, "t8")], "doc_id long, text string")
    docs = materialize(docs, "texts")
    left = exact_dedup.drop_copies(docs, broadcast_rows=3)
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan.split("Union")[0] and plan.count("BroadcastHashJoin") > 1
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter((i, f"t{i % 40}") for i in range(360, 400))


def test_a_stage_leaves_only_its_rows(spark, monkeypatch):
    def slow(spark, docs, base):
        return materialize(materialize(docs, "one").filter("doc_id > 1"), "two")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("first", slow), ("second", slow), ("last", lambda s, d, b: d)])
    monkeypatch.setattr(corpus_pipeline, "read", lambda *a: spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string"))
    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    assert [tuple(r) for r in corpus_pipeline.run(spark, "").collect()] == [(2, "b")]
    assert [name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - before] == ["second"]


def test_table_compares_contents():
    table = exact_dedup.ContentTable(1 << 20)
    assert table.add(b"\0" * 32, b"a", 1, 1) and table.add(b"\0" * 32, b"a", 5, 2)
    assert table.entries == [[b"\0" * 32, b"a", 5, 3]]
    with pytest.raises(ValueError):
        table.add(b"\0" * 32, b"b", 2, 1)
    for i in range(5000):
        assert table.add(hashlib.sha256(str(i).encode()).digest(), str(i).encode(), i, 1)
    assert len(table.entries) == 5001


# -- n-gram join --------------------------------------------------------------------


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < width else [tuple(w[i:i + width]) for i in range(len(w) - width + 1)])


def test_blocks_meet_as_one_matrix_does():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60 if k % 3 else 4000, rng.integers(1, 80))) for k in range(150)]
    sizes = np.array([len(g) for g in sets])
    plain = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    square = ngram_join.overlaps(np.concatenate(sets), sizes)
    np.fill_diagonal(square, sizes)
    assert (square == plain).all()
    assert (ngram_join.overlaps(np.concatenate(sets), sizes, 40) == plain[:40, 40:]).all()


def brute_components(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                up[root(a)] = root(b)
    ids = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        ids[root(k)].append(i)
    least = {k: min((i for i in v if i is not None), default=None) for k, v in ids.items()}
    return sorted(((i, len(sets[k]), least[root(k)]) for k, (i, _) in enumerate(rows)), key=str)


def check_join(docs, width=4, percent=85):
    got = ngram_join.similar_documents(docs, width, percent).collect()
    want = brute_components(pairs_of(docs), width, percent)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == want


def test_join_edges(edge_docs):
    check_join(edge_docs)


def test_join_empty(no_docs):
    assert ngram_join.similar_documents(no_docs).collect() == []
    assert ngram_join.drop_similar(no_docs).collect() == []


def edited_family(rng, n, words, edits):
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(words)]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10 ** 6)}"
        yield " ".join(w)


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80)])
def test_join_finds_every_link_near_the_threshold(spark, width, percent):
    rng = random.Random(width)
    texts = []
    for words, edits in ((12, 1), (40, 2), (90, 5), (150, 9), (300, 14), (700, 30)):
        texts += edited_family(rng, 25, words, edits)
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    check_join(docs, width, percent)


def test_large_group_that_one_centre_does_not_join(spark):
    # A chain: neighbours are similar, the ends are not, and all share a long stretch.
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[:300] + [f"c{max(j, k)}" if j < 8 * k else f"d{j}" for j in range(100)]) for k in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check_join(docs)


def test_signatures_of_similar_sets_meet():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 5, 7, 8, 12, 20, 33, 60, 150, 400, 1500):
        for _ in range(40):
            union = np.unique(rng.integers(0, 1 << 62, n * 2).astype(np.uint64))[:n]
            loose = int(n * 0.15)
            cut = rng.permutation(len(union))[:loose]
            side = rng.random(loose) < rng.choice([0.0, 0.5, 1.0])
            a, b = np.delete(union, cut[side]), np.delete(union, cut[~side])
            common = len(np.intersect1d(a, b))
            if 100 * common >= 85 * len(union):
                assert np.intersect1d(ngram_join.signatures(a, 85), ngram_join.signatures(b, 85)).size


def test_texts_are_read_twice(spark, tmp_path):
    # Once for all that is asked of every text, and once for the sets of those that can link.
    def counted(batches):
        for batch in batches:
            with open(tmp_path / "read", "a") as f:
                f.write("".join(f"{i}\n" for i in batch.column("doc_id").to_pylist()))
            yield batch
    rng = random.Random(8)
    rows = list(enumerate(t for _ in range(6) for t in edited_family(rng, 5, 120, 2)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    # Its results are kept nowhere, so each use of the texts runs it again.
    check_join(docs.select("doc_id", "text").mapInArrow(counted, "doc_id long, text string"))
    read = Counter(int(line) for line in (tmp_path / "read").read_text().split())
    # One more of each is the test's own look at the rows.
    assert len(read) == 30 and set(read.values()) == {3}


@pytest.mark.parametrize("width", [1, 4, 5])
def test_sets_of_a_slice(width):
    texts = ["", None, "a", "a b c", "A b c d", "a a a a a a a", "  x  y\tz\n", "é É Ä b c d e f", "p q r s t p q r s t"] * 2
    grams, at = ngram_join.shingle_sets(pa.record_batch([pa.array(texts)], ["text"]), width)
    sets = [grams[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
    assert [len(s) for s in sets] == [len(shingles(t or "", width)) for t in texts]
    assert all(s == sorted(set(s)) for s in sets) and sets[:9] == sets[9:]
    of = {}
    for s, t in zip(sets, texts):
        assert of.setdefault(shingles(t or "", width), s) == s
    assert len({tuple(s) for s in sets}) == len(of) == len(set(zip(*(k.tolist() for k in ngram_join.set_keys(grams, at)))))


def random_sets(seed, n, pool):
    rng = np.random.default_rng(seed)
    pool = rng.integers(0, (1 << 63) - 1, pool).astype(np.uint64) * np.uint64(2)
    return [np.unique(rng.choice(pool, rng.integers(1, 60))) for _ in range(n)]


def as_rows(sets):
    return np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])


def in_buckets(batches, n):
    """The packed rows of several tasks, as one task of those that read them gets them: ``n`` to a batch."""
    table = pa.Table.from_batches(batches).sort_by("bucket").combine_chunks()
    return iter(table.to_batches(max_chunksize=n))


@pytest.mark.parametrize("cells", [1, 1 << 18])
def test_many_sets_are_signed_as_each_alone(monkeypatch, cells):
    monkeypatch.setattr(ngram_join, "SIGNED_CELLS", cells)
    sets = [*random_sets(2, 60, 500), np.zeros(0, np.uint64), *random_sets(3, 3, 5)]
    sig, owner = ngram_join.set_signatures(*as_rows(sets), 85)
    for k, one in enumerate(sets):
        assert sorted(sig[owner == k]) == sorted(ngram_join.signatures(one, 85))


@pytest.mark.parametrize("held", [1, 40, 1 << 18])
def test_shingles_of_one_set_alone(monkeypatch, held):
    monkeypatch.setattr(ngram_join, "HELD_ROWS", held)
    sets = random_sets(6, 90, 900)
    sets += sets[:10]  # a set that several tasks give is one
    key = np.arange(100) % 90 - 45
    batches = []
    for a in range(0, 100, 25):
        low = ngram_join.as_binary(*as_rows(sets[a:a + 25]))
        rows = pa.record_batch([pa.array(key[a:a + 25]), low], ["key", "low"])
        batches += ngram_join._sampled(7, 1.0)(iter([rows, rows.slice(0, 0)]))
    alone = list(ngram_join._alone(9)(in_buckets(batches, 3)))
    got = [row for batch in ngram_join._counted(in_buckets(alone, 2)) for row in zip(*batch.to_pydict().values())]
    holders = defaultdict(set)
    for k, one in zip(key.tolist(), sets):
        for gram in one.tolist():
            holders[gram].add(k)
    assert sorted(got) == sorted(Counter(min(v) for v in holders.values() if len(v) == 1).items())


def test_rows_of_shingles_alone_do_not_grow_with_the_tasks():
    # 400 sets whose 50 shingles lie in 40 tasks: as many rows of a set's count would be some 15 times the sets.
    rng = np.random.default_rng(9)
    grams = np.sort(rng.integers(0, (1 << 63) - 1, (400, 50)).astype(np.uint64), axis=1)
    rows = pa.record_batch([pa.array(np.arange(400)), ngram_join.as_binary(grams.ravel(), np.arange(401) * 50)], ["key", "low"])
    packed = list(ngram_join._sampled(40, 0.5)(iter([rows])))
    assert packed[0].num_rows == 40
    made = [b for k in range(40) for b in ngram_join._alone(4)(iter([packed[0].slice(k, 1)]))]
    assert sum(b.num_rows for b in made) <= 160


@pytest.mark.parametrize("held", [1, 400, 1 << 18])
def test_members_of_groups_come_once(monkeypatch, held):
    monkeypatch.setattr(ngram_join, "HELD_ROWS", held)
    sets = random_sets(7, 80, 60) + random_sets(7, 20, 60)
    batches = []
    for a in range(0, 100, 20):
        values, at = as_rows(sets[a:a + 20])
        rows = pa.record_batch([pa.array(np.arange(a, a + 20)), ngram_join.as_list(
            pa.array(values.view(np.int64)), np.diff(at))], ["id", "grams"])
        # A part of a batch has offsets of its own.
        batches += ngram_join._sign(85, 7)(iter([rows.slice(0, 6), rows.slice(6)]))
    got = [(int(s), i) for batch in ngram_join._match(in_buckets(batches, 3))
           for s, i in zip(batch.column("sig").to_numpy().view(np.uint64), batch.column("id").to_pylist())]
    groups = defaultdict(set)
    for i, one in enumerate(sets):
        for sig in ngram_join.signatures(one, 85).tolist():
            groups[sig >> 1 << 1].add(i)
    want = {(sig, i) for sig, who in groups.items() if len(who) > 1 for i in who}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_drop_similar_keeps_one_of_each_group(edge_docs):
    left = ngram_join.drop_similar(edge_docs, 5, 80)
    assert left.columns == edge_docs.columns
    texts = [t.translate(LOWER) for _, t in pairs_of(left)]
    filled = [t for t in texts if t.split()]
    assert len(filled) == len(set(filled))
    assert len(texts) - len(filled) == 4 and len(filled) == 8


def brute_links(rows, width, percent):
    """Links per row, and the linked pairs of smallest ids of different sets."""
    sets = [shingles(t, width) for _, t in rows]
    least = defaultdict(list)
    for (i, _), s in zip(rows, sets):
        least[s].append(i)
    n, pairs = Counter(), set()
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                n[a] += 1
                n[b] += 1
                if sets[a] != sets[b]:
                    pairs.add((*sorted((min(least[sets[a]]), min(least[sets[b]]))), both))
    return Counter((i, n[k]) for k, (i, _) in enumerate(rows)), pairs


@pytest.mark.parametrize("block", [3, 2048])
def test_every_link_is_counted(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", block)
    rng, rows = random.Random(11), []
    for family in range(12):
        words = [f"f{family}w{rng.randrange(10 ** 6)}" for _ in range(rng.randint(150, 300))]
        for _ in range(rng.randint(1, 14)):
            own = list(words)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = f"x{rng.random()}"
            rows += [(len(rows), " ".join(own))] * rng.choice((1, 1, 1, 2))
    rows = [(k, t) for k, (_, t) in enumerate(rows)] + [(9000, ""), (9001, ""), (9002, "all alone here it stands")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    counts, pairs = brute_links(rows, 4, 85)
    got = ngram_join.similar_documents(docs)
    assert Counter((r["doc_id"], r["n_links"]) for r in got.collect()) == counts
    listed = [(*sorted((r["a_id"], r["b_id"])), r["common"]) for r in ngram_join.similar_pairs(docs).collect()]
    assert len(listed) == len(set(listed)) and set(listed) == pairs and len(pairs) > 100


def test_links_of_loose_families(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_PAIRS_PER_ROW", 1)
    # A chain: neighbours are similar, and a group holds few of the family's sets.
    words = [f"w{k}" for k in range(900)]
    rows = [(k, " ".join(words[3 * k:3 * k + 60])) for k in range(250)] + [(999, " ".join(words[30:90]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    counts, pairs = brute_links(rows, 4, 85)
    check_join(docs)
    assert Counter((r["doc_id"], r["n_links"]) for r in ngram_join.similar_documents(docs).collect()) == counts
    listed = {(*sorted((r["a_id"], r["b_id"])), r["common"]) for r in ngram_join.similar_pairs(docs).collect()}
    assert listed == pairs


@pytest.mark.parametrize("limit", [3, 40, 10 ** 6])
def test_rows_are_found_and_left_out_by_many_keys(spark, limit):
    rows = spark.range(4000).select(F.when(F.col("id") != 7, F.col("id")).alias("k"), F.col("id").alias("v"))
    keys = rows.filter("v % 9 = 7").select(F.col("k").alias("_k"))  # null is one of them
    n = keys.count()
    want = {v for v in range(4000) if v % 9 == 7}
    got = [r["v"] for r in joins.rows_of_keys(rows, "k", keys, n, limit).collect()]
    assert len(got) == len(set(got)) and want <= set(got) and len(got) < n + 200 and (n > limit or set(got) == want)
    left = [r["v"] for r in joins.rows_without_keys(rows, "k", keys, n, limit).collect()]
    assert sorted(left) == sorted(set(range(4000)) - want)


def test_texts_and_sets_stay_where_they_lie_beyond_the_broadcast_limit(spark, monkeypatch):
    rng = random.Random(21)
    rows = list(enumerate(t for _ in range(9) for t in edited_family(rng, 6, 120, 2)))
    rows += [(100 + k, rows[k][1]) for k in range(4)] + [(0, rows[0][1]), (0, rows[1][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    plans = defaultdict(list)

    def seen(df, label):
        plans[label].append(df._jdf.queryExecution().executedPlan().toString())
        return materialize(df, label)

    monkeypatch.setattr(ngram_join, "materialize", seen)
    monkeypatch.setattr(ngram_join, "MOVED_BYTES", 1)
    counts, _ = brute_links(rows, 4, 85)
    got = ngram_join.similar_documents(docs, broadcast_rows=7)
    assert Counter((r["doc_id"], r["n_links"]) for r in got.collect()) == counts
    assert plans["sets"] and not any("SortMergeJoin" in p for p in plans["sets"])
    # Blocks meet in rounds, of which each moves a part of the sets.
    assert len(plans["met"]) > 1
    few, many = ([r["doc_id"] for r in ngram_join.drop_similar(docs, broadcast_rows=n).collect()] for n in (2, 10 ** 6))
    assert Counter(few) == Counter(many) and len(few) == 9


def test_passing_tables_and_shuffles_are_removed(spark):
    def shuffles():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return set(re.findall(r"shuffle_\d+_\d+_0.data", files.mkString("\n")))

    rng = random.Random(22)
    docs = spark.createDataFrame(list(enumerate(edited_family(rng, 30, 80, 2))), "doc_id long, text string").repartition(4)
    docs = materialize(docs, "texts")
    before, tables = shuffles(), set(os.listdir(shared_dir(spark).removeprefix("file:")))
    materialize(ngram_join.drop_similar(docs, 4, 85), "left")
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(shared_dir(spark).removeprefix("file:"))) - tables}
    assert left <= {"linked", "repeated-ids", "near-copies", "away", "left"}
    # A few counts that are no written table's leave theirs.
    assert sum(1 for _ in shuffles() - before) < 25


@pytest.mark.parametrize("held", [3, 1 << 18])
@pytest.mark.parametrize("parts", [1, 2, 5])
def test_shingles_by_parts_of_the_sampled_domain(monkeypatch, held, parts):
    monkeypatch.setattr(ngram_join, "HELD_ROWS", held)
    sets = random_sets(16, 60, 700)
    low = ngram_join.as_binary(*as_rows(sets))
    rows = pa.record_batch([pa.array(np.arange(60)), low], ["key", "low"])
    alone = []
    for part in range(parts):
        alone += ngram_join._alone(9)(in_buckets(list(ngram_join._sampled(7, 1.0, part, parts)(iter([rows]))), 3))
    got = Counter()
    for batch in ngram_join._counted(in_buckets(alone, 2)):
        got.update(dict(zip(*batch.to_pydict().values())))
    holders = defaultdict(set)
    for k, one in enumerate(sets):
        for gram in one.tolist():
            holders[gram].add(k)
    assert got == Counter(min(v) for v in holders.values() if len(v) == 1)


def test_overlaps_of_many_sets():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60 if k % 2 else 4000, 40)) for k in range(150)]
    got = ngram_join.overlaps(np.concatenate(sets), np.array([len(s) for s in sets]))
    assert all(got[a, b] == len(np.intersect1d(sets[a], sets[b])) for a in range(150) for b in range(a))


@pytest.mark.parametrize("cut", [0, 70])
def test_overlaps_by_parts_of_the_hash_domain(monkeypatch, cut):
    rng = np.random.default_rng(4)
    pools = [rng.integers(-(1 << 63), (1 << 63) - 1, n) for n in (90, 3000)]
    sets = [np.unique(rng.choice(pools[k % 2], 60)) for k in range(150)] + [np.zeros(0, np.int64)]
    plain = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    monkeypatch.setattr(ngram_join, "PART_SHINGLES", 500)
    got = ngram_join.overlaps(np.concatenate(sets), np.array([len(g) for g in sets]), cut)
    if not cut:
        np.fill_diagonal(got, plain.diagonal())
    assert (got == (plain[:cut, cut:] if cut else plain)).all()


def test_full_blocks_meet_in_little_memory():
    # What one block of 2048 sets with 1024 shingles each holds while it meets another: 32 MB of shingles.
    rng = np.random.default_rng(5)
    base = rng.integers(-(1 << 63), (1 << 63) - 1, 1024)
    sets = np.tile(base, (4096, 1))
    sets[np.arange(4096)[:, None], rng.integers(0, 1024, (4096, 100))] = rng.integers(-(1 << 63), (1 << 63) - 1, (4096, 100))
    sizes = np.full(4096, 1024)
    grams = sets.ravel()
    tracemalloc.start()
    common = ngram_join.overlaps(grams, sizes, 2048)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert common[3, 5] == len(np.intersect1d(sets[3], sets[2053]))
    assert peak < 120e6


# -- substring dedup ----------------------------------------------------------------


def test_gear_is_the_rolling_hash():
    data = np.frombuffer(random.Random(2).randbytes(500), np.uint8)
    h, want = 0, []
    for b in data:
        h = (2 * h + int(substring_dedup.GEAR[b])) % (1 << 16)
        want.append(h)
    assert substring_dedup.gear(data).tolist() == want


def test_chunks_cover_texts_and_resist_insertions():
    rng = random.Random(3)
    text = " ".join(str(rng.randrange(10 ** 6)) for _ in range(3000))
    cut = lambda t: {t.encode()[a:b] for a, b in zip(*substring_dedup.chunks(Texts(pa.array([t])))[:2])}
    start, end, first = substring_dedup.chunks(Texts(pa.array([text, "", "é" * 900])))
    assert start[0] == 0 and (start[1:] == end[:-1]).all() and first.tolist()[1] == first.tolist()[2]
    assert len(cut(text) - cut(text[:9000] + "INSERTED" + text[9000:])) <= 3


def test_repeated_passages(spark, edge_docs, no_docs):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    passage = " ".join(word() for _ in range(60))
    texts = [" ".join(word() for _ in range(rng.randint(80, 200))) for _ in range(60)]
    planted = set(range(0, 60, 4))
    texts = [t[:k * 7] + " " + passage + " " + t[k * 7:] if k in planted else t for k, t in enumerate(texts)]
    texts[1] = ("again and again " * 300)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = substring_dedup.repeated_passages(docs).collect()
    assert {r["doc_id"] for r in got} == planted
    for r in got:
        assert texts[r["doc_id"]][r["start"]:r["start"] + r["length"]] in f" {passage} "
        assert r["n_docs"] == len(planted) and r["first_doc_id"] == 0 and r["copy"] == (r["doc_id"] > 0)
    assert substring_dedup.repeated_passages(no_docs).collect() == []
    assert {r["doc_id"] for r in substring_dedup.repeated_passages(edge_docs).collect()} >= {5, 7}
