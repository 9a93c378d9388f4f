"""Packing, mixing and the pipeline against brute force."""

import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from stratamem.llm import catalog, mixing, packing
from stratamem.sources.tables import read

SF = "/root/testdata/sf0.001"


# -- packing ------------------------------------------------------------------------


def plain_ids(text):
    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    tokenizer.encode_special_tokens = True
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]


def check_packing(docs, capacity=1024):
    rows = Counter()
    for r in docs.collect():
        ids = plain_ids(r["text"])
        for k, (at, n) in enumerate(packing.cut_points(len(ids), capacity)):
            rows[r["doc_id"], k, at, n, zlib.crc32(np.array(ids[at:at + n], "<u4").tobytes())] += 1
    got = packing.pack_documents(docs, capacity=capacity, group_pieces=50).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == rows
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        places.sort()
        assert [o for o, _ in places] == np.cumsum([0] + [n for _, n in places])[:-1].tolist()
        assert sum(n for _, n in places) <= capacity


def test_packing_documents(spark):
    check_packing(read(spark, SF, "documents").limit(60))


def test_packing_edges(edge_docs, no_docs):
    check_packing(edge_docs, 64)
    assert packing.pack_documents(no_docs).collect() == []


def test_cut_points():
    assert packing.cut_points(5, 10) == [(0, 5)] and packing.cut_points(10, 10) == [(0, 10)]
    assert packing.cut_points(25, 10) == [(0, 5), (5, 10), (15, 10)]


def test_sum_of_squares_takes_the_smallest_sum():
    rng, capacity = np.random.default_rng(1), 12
    lengths = rng.integers(1, capacity, 300)
    where, offset = packing.sum_of_squares(lengths, capacity)
    fill = Counter()
    for n, k, at in zip(lengths.tolist(), where.tolist(), offset.tolist()):
        def cost(chosen):
            gaps = Counter(capacity - v for j, v in fill.items() if j != chosen and v < capacity)
            if (left := capacity - fill[chosen] - n) > 0:
                gaps[left] += 1
            return sum(c * c for c in gaps.values())
        room = [j for j in list(fill) if fill[j] + n <= capacity]
        assert at == fill[k]
        if room:
            assert k in room and cost(k) == min(map(cost, room))
        else:
            assert fill[k] == 0
        fill[k] += n
    assert len(fill) <= math.ceil(lengths.sum() / capacity) * 1.25


def test_long_runs_are_tokenized_whole():
    encode = packing.encoder(packing.vocabulary_path())
    for text in (" " * 50_000 + "x", "a" * 20_000, "<|endoftext|> é"):
        assert encode(text) + [packing.END_ID] == plain_ids(text)


def test_added_tokens_have_the_ids_of_the_file(spark):
    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|><|endoftext|>  \n b" * 300,
             "<|endoftext|>" + " " * 50_000 + "x", "<|endoftext", "é 's  x"]
    want = Counter()
    for doc_id, text in enumerate(texts):
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [packing.END_ID]
        for k, (at, n) in enumerate(packing.cut_points(len(ids), 64)):
            want[doc_id, k, at, n, zlib.crc32(np.array(ids[at:at + n], "<u4").tobytes())] += 1
    assert want[0, 0, 0, 5, zlib.crc32(np.array([31373, 220, 50256, 995, packing.END_ID], "<u4").tobytes())] == 1
    got = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), capacity=64)
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got.collect()) == want


# -- mixing -------------------------------------------------------------------------


def fill(sizes, weights=(5, 2, 1), share=1.5, epochs=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, free, target = share * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] >= epochs * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = epochs * sizes[s]
            left -= target[s]
        free -= over
    return target


def check_mix(docs, **options):
    got = mixing.mix(docs, **options).collect()
    sizes = Counter()
    for r in docs.collect():
        sizes[r["source"]] += len((r["text"] or "").split())
    target = fill(sizes)
    taken = Counter()
    for r in got:
        assert r["size"] == len((r["text"] or "").split()) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert len(got) == docs.count()
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in sizes)


@pytest.mark.parametrize("broadcast_rows", [2, 10 ** 6])
def test_mixing(spark, broadcast_rows):
    rng = random.Random(1)
    rows = [(k, " ".join("w" for _ in range(rng.randint(0, 30))), rng.choice(["b", "a", "é", "Z", None, ""]))
            for k in range(400)]
    rows += [(1000 + k, "w w w", "hot") for k in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    check_mix(docs, broadcast_rows=broadcast_rows)


def test_mixing_edges(edge_docs, no_docs):
    again = [sorted(map(str, mixing.mix(edge_docs).select("doc_id", "source", "taken").collect())) for _ in range(2)]
    assert again[0] == again[1]
    check_mix(edge_docs.filter("doc_id <> 8"))
    assert mixing.mix(no_docs).collect() == [] and mixing.repeat(mixing.mix(no_docs)).collect() == []
    check_mix(edge_docs.filter("doc_id < 3"))


def test_repetitions_have_the_taken_words(spark):
    docs = read(spark, SF, "documents")
    mixed = mixing.mix(docs)
    taken = {r["doc_id"]: r["taken"] for r in mixed.collect()}
    words = Counter()
    rows = mixing.repeat(mixed)
    assert rows.columns == docs.columns
    for r in rows.collect():
        words[r["doc_id"]] += len(r["text"].split())
        assert r["n_chars"] == len(r["text"])
    assert all(words[i] == n for i, n in taken.items())


# -- the pipeline -------------------------------------------------------------------


def run_stages(spark, docs, base, tmp_path):
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, base)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == corpus_pipeline.COLUMNS
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(docs)
    return kept


def test_pipeline_stages_take_effect(spark, tmp_path):
    docs = read(spark, SF, "documents")
    clean, single, apart, mixed, packed = run_stages(spark, docs, SF, tmp_path)
    ids = lambda df: [r["doc_id"] for r in df.select("doc_id").collect()]
    assert set(ids(apart)) <= set(ids(single)) <= set(ids(clean)) <= set(ids(docs))
    texts = [r["text"].lower() for r in single.collect()]
    assert len(texts) == len(set(texts))
    assert set(ids(mixed)) <= set(ids(apart))
    # The brute-force packing of what came in.
    want = Counter()
    for r in mixed.collect():
        want[r["doc_id"]] += len(plain_ids(r["text"]))
    got = Counter()
    for r in packed.collect():
        got[r["doc_id"]] += r["length"]
    assert got == want
    assert {tuple(r) for r in corpus_pipeline.run(spark, SF).select("doc_id", "piece", "length", "ids_crc32").collect()} \
        == {tuple(r) for r in packed.select("doc_id", "piece", "length", "ids_crc32").collect()}


def test_pipeline_edges(spark, edge_docs, no_docs, tmp_path):
    run_stages(spark, edge_docs.select(corpus_pipeline.COLUMNS), SF, tmp_path / "a")
    assert run_stages(spark, no_docs, SF, tmp_path / "b")[-1].count() == 0


# -- registered queries -------------------------------------------------------------


@pytest.mark.parametrize("name", ["op10_exact_dedup", "op8_source_mixing"])  # the others: test_llm_sequences
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(catalog.ORACLE[name]).df()
    got = catalog.QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    key = list(want.columns)
    left, right = (d.sort_values(key).reset_index(drop=True).astype(str).values.tolist() for d in (got, want))
    assert left == right


COLUMNS = {
    "op1_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op2_ngram_jaccard": ["doc_id", "n_shingles", "component_id"],
    "op3_document_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                                  "near_edited", "near_next"],
    "op4_language": ["doc_id", "held_out", "lang_pred", "score"],
    "op5_license_scan": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    "op6_best_fit_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op7_substring_dedup": ["doc_id", "start", "length", "n_chunks", "n_docs", "first_doc_id", "copy"],
    "op8_source_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op9_secret_scan": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op10_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op11_bpe_tree": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op12_prefix_trie": ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"],
    "op13_hard_negatives": ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
}


def test_every_query_covers_all_documents(spark):
    assert set(catalog.QUERIES) == set(COLUMNS)
    ids = {r["doc_id"] for r in read(spark, SF, "documents").select("doc_id").collect()}
    for name, query in catalog.QUERIES.items():
        out = query(spark, SF)
        if COLUMNS[name][0] != "doc_id":  # no query over documents
            assert out.columns == COLUMNS[name]
            continue
        assert out.columns[:len(COLUMNS[name])] == COLUMNS[name]
        found = [r["doc_id"] for r in out.select("doc_id").collect()]
        if name == "op7_substring_dedup":
            assert set(found) <= ids and found
        else:
            assert set(found) == ids and (len(found) == len(ids) or name == "op6_best_fit_packing")
