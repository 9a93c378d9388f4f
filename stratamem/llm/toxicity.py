"""Toxic spans by a linear-chain conditional random field.

Chains are sentences, states are clean and toxic, emissions sum the weights of hashed
word and prefix features. Documents carry one label each, so tokens are labelled first:
in a toxic document those with a feature that toxic documents hold significantly more
often. Forward-backward marginals give the spans, and their sums the document score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratamem.llm.batches import Texts, mix, slices, span_hashes

# The model learns from at most this many labelled documents, none longer than this.
SAMPLE_DOCS = 4000
SAMPLE_CHARS = 10_000
# Documents that the weights are fitted on; all of the sample serves the other steps.
FIT_DOCS = 2000
THRESHOLD = 0.7
SEED = 7
BITS = 18
PREFIXES = (4, 5, 6, 7)
STEPS = 80
# A feature marks toxic tokens if its log-likelihood ratio and its share of toxic documents reach these.
MIN_RATIO = 20.0
MIN_SHARE = 0.8
LONG_CHAIN = 128

LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
STOP = np.zeros(256, bool)
STOP[[0x0A, 0x0D, 0x21, 0x2E, 0x3F]] = True
U64 = np.uint64


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % by


class Tokens(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray     # of each document, its first token; one more at the end
    chain: np.ndarray     # the same for each chain
    features: np.ndarray  # one row of slots per token


def tokenize(texts: Texts) -> Tokens:
    """Letter runs, their chains and feature slots; slot 0 stands for no feature."""
    start, end, first = texts.spans(LETTER)
    stops = np.flatnonzero(STOP[texts.data])
    sentence = np.searchsorted(stops, start)
    fresh = np.ones(len(start), bool)
    fresh[1:] = sentence[1:] != sentence[:-1]
    fresh[first[:-1][first[:-1] < len(start)]] = True
    chain = np.append(np.flatnonzero(fresh), len(start))
    slots = np.zeros((len(start), 1 + len(PREFIXES)), np.int32)
    mask = U64((1 << BITS) - 1)
    slots[:, 0] = mix(span_hashes(texts.data, start, end), 50) & mask
    for k, n in enumerate(PREFIXES):
        long = end - start >= n
        found = mix(span_hashes(texts.data, start[long], start[long] + n), 51 + k) & mask
        slots[long, k + 1] = np.maximum(found, U64(1))
    return Tokens(start, end, first, chain, slots)


def tokenize_all(texts: list[str], upto: int = 1 << 19) -> Tokens:
    """Tokens of a list of texts, made part by part so that little is held beside them."""
    parts, at, base = [], 0, 0
    while at < len(texts) or not parts:
        to, size = at, 0
        while to < len(texts) and (to == at or size < upto):
            size += len(texts[to])
            to += 1
        t = tokenize(Texts(pa.array(texts[at:to], pa.large_string()), lower=True))
        parts.append(t._replace(first=t.first[bool(parts):] + base, chain=t.chain[bool(parts):] + base))
        base += len(t.start)
        at = to
    return Tokens(*(np.concatenate(c) for c in zip(*parts)))


# -- Forward-backward ---------------------------------------------------------------


def ratios(odds: np.ndarray, chain: np.ndarray, trans: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray]:
    """For every token the forward and backward weights of toxic over clean.

    ``odds`` are the emissions' exponentials. Chains advance together, the longest
    first; very long ones are walked alone.
    """
    t00, t01, t10, t11 = (float(x) for x in trans)
    forward, backward = np.empty_like(odds), np.ones_like(odds)
    size = np.diff(chain)
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    for c in order[size[order] > LONG_CHAIN]:
        a, b = int(chain[c]), int(chain[c + 1])
        e = odds[a:b].tolist()
        f = [start * e[0]]
        for x in e[1:]:
            f.append(x * (t01 + f[-1] * t11) / (t00 + f[-1] * t10))
        g = [1.0]
        for x in reversed(e[1:]):
            x *= g[-1]
            g.append((t10 + t11 * x) / (t00 + t01 * x))
        forward[a:b], backward[a:b] = f, g[::-1]
    order = order[size[order] <= LONG_CHAIN]
    if len(order):
        begin, length = chain[order], size[order]
        live = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")
        now = start * odds[begin]
        forward[begin] = now
        for t in range(1, length[0]):
            n = live[t]
            now = odds[begin[:n] + t] * (t01 + now[:n] * t11) / (t00 + now[:n] * t10)
            forward[begin[:n] + t] = now
        for t in range(length[0] - 2, -1, -1):
            n = live[t + 1]
            at = begin[:n] + t
            x = odds[at + 1] * backward[at + 1]
            backward[at] = (t10 + t11 * x) / (t00 + t01 * x)
    return forward, backward


class Model(NamedTuple):
    weights: np.ndarray  # of the feature slots
    bias: float
    trans: np.ndarray    # exponentials of the four transition weights, from clean first
    start: float
    score: np.ndarray    # of the document score

    def marginals(self, tokens: Tokens) -> np.ndarray:
        # Clipped, so that odds and their products stay finite.
        z = np.clip(self.weights[tokens.features].sum(axis=1) + self.bias, -30, 30).astype(float)
        forward, backward = ratios(np.exp(z), tokens.chain, self.trans, self.start)
        both = forward * backward
        return both / (1 + both)

    def documents(self, p: np.ndarray, first: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-evidence(p, first) @ self.score))


def evidence(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per document: one, the log of the expected toxic tokens, the logit of the highest marginal, log length."""
    total = np.concatenate([[0.0], np.cumsum(p)])
    expected = total[first[1:]] - total[first[:-1]]
    highest = np.zeros(len(first) - 1)
    some = first[1:] > first[:-1]
    if some.any():
        highest[some] = np.maximum.reduceat(p, first[:-1][some])
    highest = np.clip(highest, 1e-6, 1 - 1e-6)
    return np.stack([np.ones(len(highest)), np.log(np.maximum(expected, 0) + 1e-3), np.log(highest / (1 - highest)) / 4,
                     np.log1p(np.diff(first)) / 4], axis=1)


# -- Learning -----------------------------------------------------------------------


def token_labels(tokens: Tokens, toxic: np.ndarray) -> np.ndarray:
    """Which tokens of toxic documents hold a feature that marks such documents."""
    n = 1 << BITS
    doc = np.repeat(np.arange(len(toxic)), np.diff(tokens.first))
    kinds = tokens.features.shape[1]
    marked = np.zeros(len(doc), bool)
    total, ill = float(len(toxic)), float(toxic.sum())
    base = ill / total
    for k in range(kinds):
        slot = tokens.features[:, k].astype(np.int64)
        held = np.unique(doc * n + slot)
        count = np.bincount(held % n, minlength=n).astype(float)
        bad = np.bincount((held % n)[toxic[held // n] > 0], minlength=n).astype(float)
        share = bad / np.maximum(count, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = 2 * (np.where(bad > 0, bad * np.log(share / base), 0)
                         + np.where(count > bad, (count - bad) * np.log((1 - share) / (1 - base)), 0))
        good = (ratio >= MIN_RATIO) & (share >= MIN_SHARE)
        good[0] = False
        marked |= good[slot]
    return marked & (toxic[doc] > 0)


def fit_chain(tokens: Tokens, y: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, float, np.ndarray, float]:
    """Weights that maximise the likelihood of the token labels, by Adam steps with decay."""
    n, kinds = 1 << BITS, tokens.features.shape[1]
    params = np.zeros(n + 6)
    params[n] = -3.0
    m, v = np.zeros_like(params), np.zeros_like(params)
    flat = tokens.features.ravel()
    head = tokens.chain[:-1]
    linked = np.ones(len(y), bool)
    linked[head] = False
    at = np.flatnonzero(linked)
    pair = np.bincount((2 * y[at - 1] + y[at]).astype(int), minlength=4).astype(float)
    for step in range(1, steps + 1):
        weights, bias, trans, start = params[:n], params[n], np.exp(params[n + 1:n + 5]), np.exp(params[n + 5])
        odds = np.exp(np.clip(weights.astype(np.float32)[tokens.features].sum(axis=1) + bias, -30, 30).astype(float))
        forward, backward = ratios(odds, tokens.chain, trans, start)
        both = forward * backward
        p = both / (1 + both)
        grad = np.zeros_like(params)
        miss = p - y
        grad[:n] = np.bincount(flat, np.repeat(miss, kinds), minlength=n)
        grad[0] = 0
        grad[n] = miss.sum()
        f, x = forward[at - 1], odds[at] * backward[at]
        cells = np.stack([np.full(len(at), trans[0]), trans[1] * x, trans[2] * f, trans[3] * f * x])
        grad[n + 1:n + 5] = (cells / cells.sum(axis=0)).sum(axis=1) - pair
        grad[n + 5] = miss[head].sum()
        grad += 0.05 * params
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad ** 2
        params -= 0.2 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
        params[0] = 0
    return params[:n].astype(np.float32), float(params[n]), np.exp(params[n + 1:n + 5]), float(np.exp(params[n + 5]))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Weights of a logistic regression, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (p - y) + ridge * w)
    return w


def _slice(tokens: Tokens, docs: np.ndarray) -> tuple[Tokens, np.ndarray]:
    """The tokens of some documents, and where they were."""
    where = np.concatenate([np.arange(tokens.first[d], tokens.first[d + 1]) for d in docs]).astype(np.int64) \
        if len(docs) else np.zeros(0, np.int64)
    head = np.zeros(len(tokens.start), bool)
    head[tokens.chain[:-1][tokens.chain[:-1] < len(head)]] = True
    first = np.concatenate([[0], np.cumsum(np.diff(tokens.first)[docs])]).astype(np.int64)
    return Tokens(tokens.start[where], tokens.end[where], first,
                  np.append(np.flatnonzero(head[where]), len(where)), tokens.features[where]), where


def train(texts: list[str], toxic: list[int]) -> Model:
    """A model from whole labelled texts; without both labels, one that gives their mean."""
    y = np.array(toxic, float)
    none = Model(np.zeros(1 << BITS, np.float32), -30.0, np.ones(4), 1.0, np.zeros(4))
    if not len(y) or y.min() == y.max():
        return none._replace(score=np.array([8.0 * (2 * y.mean() - 1) if len(y) else -8.0, 0, 0, 0]))
    tokens = tokenize_all(texts)
    label = token_labels(tokens, y)
    held = np.add.reduceat(np.append(label, False), np.minimum(tokens.first[:-1], len(label))) * (np.diff(tokens.first) > 0)
    # Toxic documents without a marked token teach the chain nothing, only the score.
    ill, well = np.flatnonzero((y > 0) & (held > 0)), np.flatnonzero(y == 0)
    docs = np.sort(np.concatenate([ill[:FIT_DOCS // 3], well[:FIT_DOCS - min(len(ill), FIT_DOCS // 3)]]))
    part, where = _slice(tokens, docs)
    if len(where):
        none = none._replace(**dict(zip(("weights", "bias", "trans", "start"),
                                        fit_chain(part, label[where].astype(float)))))
    return none._replace(score=logistic(evidence(none.marginals(tokens), tokens.first), y))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS,
                    seed: int = SEED) -> DataFrame:
    """At most ``rows`` labelled documents in a seeded order, none above ``chars`` characters."""
    chosen = labels.filter("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.filter(remainder(F.col("doc_id"), 3) != 1).orderBy(
        F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(rows)
    known = docs.select("doc_id", "text").filter(F.length("text") <= chars)
    return known.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id", "text").limit(
        rows).select("text", "toxic")


# -- Scoring ------------------------------------------------------------------------

_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))


def _score(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for batch in slices(whole):
                texts = Texts(batch.column("text"), lower=True)
                tokens = tokenize(texts)
                p = model.marginals(tokens)
                score = model.documents(p, tokens.first)
                # Neighbouring toxic tokens of a chain are one span.
                hit = p >= 0.5
                opens = hit.copy()
                opens[1:] &= ~hit[:-1]
                heads = tokens.chain[:-1][tokens.chain[:-1] < len(hit)]
                opens[heads] = hit[heads]
                at = np.flatnonzero(opens)
                number = np.cumsum(opens)[hit] - 1
                hits = np.flatnonzero(hit)
                last = np.zeros(len(at), np.int64)
                last[number] = hits
                chars = texts.char_at()
                doc = np.searchsorted(tokens.first, at, side="right") - 1
                base = chars[texts.at[:-1]][doc]
                peak = np.zeros(len(at))
                np.maximum.at(peak, number, p[hit])
                spans = pa.StructArray.from_arrays(
                    [pa.array(chars[tokens.start[at]] - base), pa.array(chars[tokens.end[last]] - base),
                     pa.array(peak)], ["start", "end", "p"])
                offsets = np.searchsorted(at, tokens.first).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(score), pa.ListArray.from_arrays(pa.array(offsets), spans)],
                    schema=pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("spans", _SPANS)]))
    return run


def toxic_documents(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_DOCS) -> DataFrame:
    """Score every whole text of ``docs`` (doc_id, text), learning from ``labels`` (doc_id, toxic).

    Only labels of documents whose crc32 remainder by 3 is not 1 are learned from, at most
    ``rows`` of them. Null and empty texts have no tokens and get the score of that; without
    labels of both kinds every score is near the one seen, or 0. Every row gives one row,
    repeated ones too, and an empty table an empty result; other columns are ignored.
    Returns doc_id, held_out, score, predicted, and spans (start, end in code points, p).
    """
    sample = labelled_sample(docs, labels, rows).toPandas()
    model = train(sample["text"].tolist(), sample["toxic"].tolist())
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = docs.select("doc_id", "text").mapInArrow(
        _score(shared), "doc_id long, score double, spans array<struct<start: long, end: long, p: double>>")
    return scored.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score",
                         F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"), "spans")


def drop_toxic(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_DOCS) -> DataFrame:
    """The rows of ``docs`` whose text is not predicted toxic, with all their columns."""
    sample = labelled_sample(docs, labels, rows).toPandas()
    shared = docs.sparkSession.sparkContext.broadcast(train(sample["text"].tolist(), sample["toxic"].tolist()))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for batch in slices(whole):
                tokens = tokenize(Texts(batch.column("text"), lower=True))
                score = model.documents(model.marginals(tokens), tokens.first)
                yield batch.filter(pa.array(score < THRESHOLD))
    return docs.mapInArrow(clean, docs.schema)
