"""Toxic spans and languages: the algorithms against brute force, held-out accuracy, edge cases."""

import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest

from stratamem.llm import language, toxicity
from stratamem.llm.batches import Texts
from stratamem.sources.tables import read

SF = "/root/testdata/sf0.01"


# -- toxicity -----------------------------------------------------------------------


@pytest.mark.parametrize("sizes", [[1, 4, 3, 0, 5], [130, 2, 200]])
def test_marginals_are_those_of_the_chain(sizes):
    rng = np.random.default_rng(len(sizes))
    n = sum(sizes)
    odds, trans, start = np.exp(rng.normal(size=n)), np.exp(rng.normal(size=4)), 0.7
    chain = np.concatenate([[0], np.cumsum(sizes)])
    f, b = toxicity.ratios(odds, chain, trans, start)
    p = f * b / (1 + f * b)
    assert np.isfinite(p).all()
    t = trans.reshape(2, 2)
    for a, z in zip(chain[:-1], chain[1:]):
        if 0 < z - a <= 8:
            total, ill = 0.0, np.zeros(z - a)
            for states in itertools.product((0, 1), repeat=int(z - a)):
                w = start if states[0] else 1.0
                for k, s in enumerate(states):
                    w *= (odds[a + k] if s else 1.0) * (t[states[k - 1], s] if k else 1.0)
                total += w
                ill += w * np.array(states)
            assert np.allclose(p[a:z], ill / total)


def test_gradient_of_the_chain_vanishes_at_its_optimum():
    texts = ["bad word here. good word there", "bad bad thing. fine thing", "all is fine. very fine"] * 10
    tokens = toxicity.tokenize_all(texts)
    words = [w for t in texts for w in t.replace(".", "").split()]
    y = np.array([w == "bad" for w in words], float)
    model = toxicity.Model(*toxicity.fit_chain(tokens, y), np.zeros(4))
    assert ((model.marginals(tokens) > 0.5) == (y > 0)).all()


def test_parts_of_a_sample_are_tokenized_as_one():
    texts = ["One two. Three", "", "four\nfive six", "7 8", "sieben áé!"] * 3
    one, many = toxicity.tokenize_all(texts), toxicity.tokenize_all(texts, upto=1)
    assert (one.first == many.first).all() and (one.chain == many.chain).all()
    assert (one.features == many.features).all()


def test_toxicity_on_held_out_documents(spark):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    got = {r["doc_id"]: r for r in toxicity.toxic_documents(docs, labels).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(got) == set(texts)
    right = wrong = 0
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
        for s in r["spans"]:
            assert 0 <= s["start"] < s["end"] <= len(texts[i]) and s["p"] >= 0.5
        if r["held_out"] and i in truth:
            right += truth[i] == r["predicted"]
            wrong += truth[i] != r["predicted"]
    assert right / (right + wrong) > 0.93


def test_toxicity_edges(spark, edge_docs, no_docs, no_labels):
    got = toxicity.toxic_documents(edge_docs, no_labels).collect()
    assert len(got) == edge_docs.count() and all(r["score"] < 0.01 and r["predicted"] == 0 for r in got)
    assert toxicity.toxic_documents(no_docs, no_labels).collect() == []
    one = spark.createDataFrame([(i, 1, 1) for i in range(13)], "doc_id long, quality int, toxic int")
    assert all(r["predicted"] == 1 for r in toxicity.toxic_documents(edge_docs, one).collect())
    both = spark.createDataFrame([(5, 1, 0), (7, 1, 1), (8, 0, None), (None, 0, 1), (10, 0, 1)],
                                 "doc_id long, quality int, toxic int")
    assert len(toxicity.toxic_documents(edge_docs, both).collect()) == edge_docs.count()
    left = toxicity.drop_toxic(edge_docs, no_labels)
    assert left.columns == edge_docs.columns and left.count() == edge_docs.count()


# -- language -----------------------------------------------------------------------


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = language.initial(3, rng, 4)
    codes = rng.integers(97, 104, (7, 5)).astype(np.uint8)
    target, weight = np.array([0, 1, 2, 0, 1]), np.ones((7, 5), np.float32)
    weight[5:, 2] = 0
    _, grad = language.gradients(net, codes, target, weight)
    for k, w in enumerate(net):
        at = (1, 5, int(codes[3, 2])) if k == 0 else tuple(rng.integers(0, s) for s in w.shape)
        sides = []
        for step in (0.01, -0.01):
            moved = [x.copy() for x in net]
            moved[k][at] += step
            sides.append(language.gradients(language.Network(*moved), codes, target, weight)[0])
        assert grad[k][at] == pytest.approx((sides[0] - sides[1]) / 0.02, rel=0.05, abs=2e-5)


def test_windows_cover_every_byte():
    texts = Texts(pa.array(["", "x" * 200, "ab", None, "c" * 64]))
    codes, have, text = language.windows(texts.data, texts.at)
    assert np.bincount(text, have, 5).tolist() == [0, 200, 2, 0, 64] and codes.shape[0] == language.WINDOW


def test_language_on_held_out_documents(spark):
    docs = read(spark, SF, "documents")
    truth = {r["doc_id"]: r for r in docs.collect()}
    got = language.detect_languages(docs).collect()
    assert {r["doc_id"] for r in got} == set(truth)
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang_pred"] == truth[r["doc_id"]]["lang"] for r in held) / len(held) > 0.98
    assert all(sum(r["positions"].values()) == len(truth[r["doc_id"]]["text"].encode()) for r in got)


def test_language_edges(edge_docs, no_docs):
    got = language.detect_languages(edge_docs).collect()
    assert len(got) == edge_docs.count()
    texts = {(r["doc_id"], r["text"]) for r in edge_docs.collect()}
    unknown = {i for i, t in texts if t is None or not any(c.isalpha() for c in t)}
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == unknown | {None}
    assert {r["lang_pred"] for r in got} <= {"en", "fr", "de", "und"} and all(0 <= r["score"] <= 1 for r in got)
    assert language.detect_languages(no_docs).collect() == []
    alone = language.detect_languages(edge_docs.filter("lang IS NULL OR lang = 'de'")).collect()
    assert {r["lang_pred"] for r in alone} <= {"de", "und"}
