"""Tree-wise encoding, the prefix trie and hard negatives against brute force and SQL."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from stratamem.llm import bpe_tree, catalog, hard_negatives, prefix_trie
from stratamem.llm.packing import vocabulary_path
from stratamem.sources.tables import read

SF = "/root/testdata/sf0.001"


# -- tree-wise encoding ---------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary_path())


@pytest.fixture(scope="module")
def tree():
    return bpe_tree.TreeEncoder(vocabulary_path())


def test_random_texts_encode_as_the_library_does(library, tree):
    rng = random.Random(2)
    bits = ["abc", "'s", "'re", "  ", "   ", "\n", "\n\n", "12", "é", "中", "文", "!", "'", "''", " ", "\xa0", " ", "x",
            "the", "<|endoftext|>", "<|end", "oftext|>", "՘", "😀"]
    for _ in range(2500):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))
        tree.leaf = rng.choice([1, 2, 3, 5, 8, 16])
        ids = tree.encode(text)
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text
        assert tree.decode(ids).decode() == library.decode(ids.tolist(), skip_special_tokens=False) == text


@pytest.mark.parametrize("base", ["a", "ab", "the", "'", " ", "\n", "é", "中文", "1", "aaaab", "-=", "\t ", "😀"])
def test_unsplit_runs(library, tree, base):
    for end in ("", "y", " z", "'s"):
        text = "x" + base * (9000 // len(base)) + end
        for leaf in (37, 1000):
            tree.leaf = leaf
            assert tree.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_joins_touch_windows_only(tree):
    text = "".join(random.Random(3).choice("abcdefgh") for _ in range(60_000))
    tree.leaf, tree.leaves, tree.windows = 1000, 0, 0
    tree.encode(text)
    assert tree.leaves == 64 and tree.windows < 63 * 12


def test_decoding_of_broken_sequences(library, tree):
    for ids in ([170, 100], [50256, 170], []):
        assert tree.decode(np.array(ids, np.uint32)).decode() == library.decode(ids, skip_special_tokens=False)


def test_documents_and_edges(spark, library, edge_docs, no_docs):
    for docs, spread in ((read(spark, SF, "documents"), 3000), (edge_docs, 700)):
        want = sorted((repr(r["doc_id"]), *digests(library, r["text"] or "")) for r in docs.collect())
        got = bpe_tree.encode_documents(docs, leaf_chars=300, spread_chars=spread).collect()
        assert sorted((repr(r["doc_id"]), *r[1:4]) for r in got) == want
    assert bpe_tree.encode_documents(no_docs).collect() == []


def digests(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    back = library.decode(ids, skip_special_tokens=False)
    return (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(back.encode()).hexdigest())


def test_one_run_of_a_megabyte_and_literals_across_parts(spark, library):
    run = "".join(random.Random(4).choice("abcdefghij") for _ in range(1_000_000))
    docs = spark.createDataFrame([(1, run), (2, "x<|endoftext|>" * 20_000), (3, " " * 300_000)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in bpe_tree.encode_documents(docs).collect()}
    for r in docs.collect():
        assert tuple(got[r["doc_id"]][1:4]) == digests(library, r["text"])


# -- the trie ---------------------------------------------------------------------------

CONVERSATIONS = "conv_id long, turn long, role string, text string"


def brute_trie(rows):
    """Nodes by their paths, from the definition."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0), key, role, text))
    turns = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    members, ended = defaultdict(list), defaultdict(list)
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(math.fmod(c, 5))
        path = tuple(turns.get(base, [])[:h] + turns[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ended[path].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ended[p]))).encode()).hexdigest())
                  for p, m in members.items())


def trie(frame, **options):
    return sorted((r["conv_id"], r["depth"], -1 if r["parent_conv_id"] is None else r["parent_conv_id"], r["n_convs"],
                   r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"])
                  for r in prefix_trie.prefix_trie(frame, **options).collect())


def many_conversations():
    rng = random.Random(6)
    rows = [(None, 1, "user", "x"), (3, None, None, None), (3, None, "user", "ä" * 50_000), (3, 1, "", ""), (3, 1, "", ""),
            (9_000_000_000_000_000_000, 0, "user", "far"), (-7, 0, "a", "b"), (-5, 0, "a", "c")]
    for c in range(10, 160):
        for t in range(rng.choice([1, 1, 2, 3, 12])):
            rows.append((c, t, rng.choice(["user", "assistant"]), "hot" if rng.random() < 0.7 else f"t{rng.randint(0, 99)}"))
    rows += [(200, t, "user", f"long {t % 7}") for t in range(300)]
    return rows + [(201, t, "user", f"long {t % 7}") for t in range(280)]


@pytest.mark.parametrize("key_turns,flush", [(256, 100_000), (9, 40)])
def test_trie_equals_brute_force(spark, key_turns, flush):
    rows = many_conversations()
    if key_turns == 9:
        rows = [r for r in rows if r[0] not in (200, 201)] + [(200, t, "u", "same") for t in range(50)]
    assert trie(spark.createDataFrame(rows, CONVERSATIONS), key_turns=key_turns, flush_turns=flush) == brute_trie(rows)


def test_trie_of_nothing_and_of_clashing_columns(spark):
    from pyspark.sql import functions as F
    assert trie(spark.createDataFrame([], CONVERSATIONS)) == []
    rows = [(1, 0, "user", "hi"), (2, 0, "user", "hi")]
    frame = spark.createDataFrame(rows, CONVERSATIONS)
    for name in ("key", "root", "depth", "hi", "lo", "kids", "shared", "own", "place", "size"):
        frame = frame.withColumn(name, F.lit("x"))
    assert trie(frame) == brute_trie(rows)


def test_radix_layouts_grow():
    tree = prefix_trie.RadixTree()
    for b in range(256):
        tree.insert(bytes([7, 7, b, 1]), (1, b, 0, 0, 0))
        kinds = {4: "Small", 16: "Small", 48: "Indexed", 256: "Full"}
        node = next(n for _, n, _ in tree.nodes() if len(list(n.below.items())) == b + 1 > 1) if b else None
        if node and b + 1 in kinds:
            assert type(node.below).__name__ == kinds[b + 1] and node.path == b"\x07"
    assert len(tree.nodes()) == 258


# -- hard negatives -----------------------------------------------------------------------


def brute_negatives(rows, positives=5, negatives=10):
    valid = [(i, (la + 1) % 10 if i % 7 == 0 else la, [math.floor(256 * x) for x in v]) for i, v, la in rows
             if la is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (a, la, q) in enumerate(valid):
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, p)), i, lb) for m, (i, lb, p) in enumerate(valid)
                        if m != n and len(p) == len(q))
        for s, p, _ in [x for x in scored if x[2] == la][:positives]:
            ok = [x for x in scored if x[2] != la and 30 * -s <= 100 * -x[0] <= 90 * -s]
            out += [(a, p, k + 1, x[1], -s, -x[0]) for k, x in enumerate(ok[:negatives])]
    return sorted(out)


VECTORS = "vec_id long, embedding array<double>, label int"


def mined(frame, **options):
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(frame, **options).collect())


@pytest.mark.parametrize("kind", ["spread", "close", "ties"])
def test_negatives_equal_brute_force(spark, kind):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(4, 6))
    rows = []
    for i in range(900):
        v = {"spread": rng.normal(size=6) * rng.choice([0.1, 1, 5]), "close": centres[i % 4] + 0.05 * rng.normal(size=6),
             "ties": centres[i % 4]}[kind]
        rows.append((i, [float(x) for x in v], int(rng.integers(0, 4))))
    # A hot vector, other lengths, what takes no part, and products beyond 2^53.
    rows += [(1000 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0], 1) for i in range(200)]
    rows += [(1700, [1.0, 2.0], 2), (1701, [2.0, 2.0], 3), (1702, [1.5, 2.0], 3), (1703, None, 1), (1704, [1.0] * 6, None),
             (1705, [float("nan")] * 6, 1), (1706, [None] * 6, 1), (1800, [], 1), (1801, [float("inf")] + [0.0] * 5, 1),
             (1900, [1e5, 2e5, 1e5 + 0.3], 1), (1901, [1e5, 2e5, 1e5 + 0.7], 1), (1902, [1e5, 1e5, 1e5], 2),
             (1902, [1e5, 1e5, 1e5], 2)]
    assert mined(spark.createDataFrame(rows, VECTORS), slice_rows=300, block_anchors=3, bucket_rows=40) == brute_negatives(rows)


def test_pruning_skips_rows_and_buckets(monkeypatch):
    import pyarrow as pa
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(4000, 8)) * np.exp(rng.normal(size=(4000, 1)))
    table = pa.table({"row": range(4000), "vec_id": range(4000), "label": [0] * 4000,
                      "embedding": pa.array(vectors.tolist(), pa.list_(pa.float64()))})
    rows = hard_negatives.by_dimension(table)[8]
    groups = hard_negatives.buckets(rows, rows.whole, np.arange(4000), 100)
    seen = []
    candidates = hard_negatives.Bucket.candidates
    monkeypatch.setattr(hard_negatives.Bucket, "candidates",
                        lambda *a: (lambda x: seen.append(100 if x is None else len(x)) or x)(candidates(*a)))
    best = hard_negatives.Best(5, -np.inf, np.inf)
    hard_negatives.search(rows, rows.whole, groups, rows.whole[0], rows.unit[0], rows.length[0], None, [best])
    want = np.sort(rows.whole @ rows.whole[0])[::-1][:5]
    assert best.score.tolist() == want.tolist() and len(seen) < 30 and sum(seen) < 1000


def test_negatives_of_nothing(spark):
    from pyspark.sql import functions as F
    assert mined(spark.createDataFrame([], VECTORS)) == []
    rows = [(0, [1.0, 1.0], 1), (1, [1.0, 0.9], 2), (2, [0.5, 0.3], 3), (3, [0.2, 0.4], 1)]
    frame = spark.createDataFrame(rows, VECTORS).withColumns({n: F.lit("x") for n in ("row", "slice", "block", "size", "place")})
    assert mined(frame) == brute_negatives(rows)


# -- the registered queries against SQL -----------------------------------------------------


@pytest.mark.parametrize("name", ["op12_prefix_trie", "op13_hard_negatives"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(names)} FROM ({catalog.ORACLE[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.select(names).collect()))) == sorted(map(repr, want)) and want
