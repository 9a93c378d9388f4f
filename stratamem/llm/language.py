"""Language by a bidirectional gated recurrent network over bytes.

Texts are read in windows of bytes; both directions run over a window, every position
gets a label, and a document's probabilities are pooled over its positions. The network
is trained here, by backpropagation through time on a bounded sample.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamem.llm.batches import LOWER, Texts, slices
from stratamem.llm.toxicity import LETTER, remainder

# The model learns from at most this many documents, none above this many characters.
SAMPLE_DOCS = 1200
SAMPLE_CHARS = 20_000
SEED = 3
HIDDEN = 8
WINDOW = 64
STEPS = 240
BATCH = 192
RATE = 0.02
# Windows that run side by side.
LANES = 2048
UNKNOWN = "und"


class Network(NamedTuple):
    """Both directions side by side: first axis 2; gates in the order update, reset, new.

    Update and reset weights are halved, so that sigmoid(x) is 0.5 + 0.5 tanh(x / 2).
    """
    inputs: np.ndarray   # (2, 3H, 256), the input weights of every byte with the gates' biases
    recur: np.ndarray    # (2, 3H, H)
    new_bias: np.ndarray  # (2, H, 1), inside the reset product
    out: np.ndarray      # (L, 2H)
    out_bias: np.ndarray  # (L, 1)


def initial(labels: int, rng: np.random.Generator, hidden: int = HIDDEN) -> Network:
    draw = lambda *shape, scale: (rng.normal(size=shape) * scale).astype(np.float32)
    return Network(draw(2, 3 * hidden, 256, scale=0.3), draw(2, 3 * hidden, hidden, scale=hidden ** -0.5),
                   np.zeros((2, hidden, 1), np.float32), draw(labels, 2 * hidden, scale=0.1),
                   np.zeros((labels, 1), np.float32))


def steps(net: Network, codes: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states (T, 2, H, B) of byte windows (T, B), the backward ones at their own places.

    A list in ``keep`` receives what backpropagation needs of every step.
    """
    length, lanes = codes.shape
    hidden = net.recur.shape[2]
    states = np.empty((length, 2, hidden, lanes), np.float32)
    h = np.zeros((2, hidden, lanes), np.float32)
    x = np.empty((2, 3 * hidden, lanes), np.float32)
    for t in range(length):
        np.take(net.inputs[0], codes[t], axis=1, out=x[0], mode="clip")
        np.take(net.inputs[1], codes[length - 1 - t], axis=1, out=x[1], mode="clip")
        r = np.matmul(net.recur, h)
        gates = np.tanh(x[:, :2 * hidden] + r[:, :2 * hidden])
        gates *= 0.5
        gates += 0.5
        inner = r[:, 2 * hidden:] + net.new_bias
        new = np.tanh(x[:, 2 * hidden:] + gates[:, hidden:] * inner)
        if keep is not None:
            keep.append((h, gates, inner, new))
        h = new + gates[:, :hidden] * (h - new)
        states[t, 0], states[length - 1 - t, 1] = h[0], h[1]
    return states


def position_logits(net: Network, states: np.ndarray) -> np.ndarray:
    """Logits (T, L, B) of every position."""
    length, _, hidden, lanes = states.shape
    return np.matmul(net.out, states.reshape(length, 2 * hidden, lanes)) + net.out_bias


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=-2, keepdims=True))
    return z / z.sum(axis=-2, keepdims=True)


def gradients(net: Network, codes: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, Network]:
    """Mean cross-entropy of all positions and its gradient, through time.

    ``target`` holds a label per window, ``weight`` (T, B) is 0 at padding.
    """
    length, lanes = codes.shape
    hidden = net.recur.shape[2]
    kept: list = []
    states = steps(net, codes, kept)
    p = softmax(position_logits(net, states))
    total = max(float(weight.sum()), 1.0)
    loss = -float((np.log(p[:, target, np.arange(lanes)] + 1e-9) * weight).sum()) / total
    d = p.copy()
    d[:, target, np.arange(lanes)] -= 1
    d *= (weight / total)[:, None, :]
    flat = states.reshape(length, 2 * hidden, lanes)
    g_out = np.einsum("tlb,thb->lh", d, flat)
    d_states = np.matmul(net.out.T, d).reshape(length, 2, hidden, lanes)
    g_in = np.zeros_like(net.inputs)
    g_recur, g_bias = np.zeros_like(net.recur), np.zeros_like(net.new_bias)
    back = np.zeros((2, hidden, lanes), np.float32)
    for t in range(length - 1, -1, -1):
        h, gates, inner, new = kept[t]
        dh = back.copy()
        dh[0] += d_states[t, 0]
        dh[1] += d_states[length - 1 - t, 1]
        z, r = gates[:, :hidden], gates[:, hidden:]
        d_new = dh * (1 - z) * (1 - new ** 2)
        d_gates = np.concatenate([dh * (h - new) * 2 * z * (1 - z), d_new * inner * 2 * r * (1 - r)], axis=1)
        d_inner = d_new * r
        d_x = np.concatenate([d_gates, d_new], axis=1)
        d_r = np.concatenate([d_gates, d_inner], axis=1)
        g_recur += np.matmul(d_r, h.transpose(0, 2, 1))
        g_bias += d_inner.sum(axis=2, keepdims=True)
        for k, at in ((0, t), (1, length - 1 - t)):
            seen = np.zeros((lanes, 256), np.float32)
            seen[np.arange(lanes), codes[at]] = 1
            g_in[k] += d_x[k] @ seen
        back = dh * z + np.matmul(net.recur.transpose(0, 2, 1), d_r)
    return loss, Network(g_in, g_recur, g_bias, g_out.astype(np.float32), d.sum(axis=(0, 2))[:, None])


def windows(data: np.ndarray, at: np.ndarray, length: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut each text [at[i], at[i+1]) into windows: bytes (T, W), lengths and texts of the windows."""
    size = np.diff(at)
    count = -(-size // length)
    text = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = at[:-1][text] + nth * length
    have = np.minimum(at[1:][text] - start, length)
    padded = np.append(data, np.zeros(length, np.uint8))
    codes = np.lib.stride_tricks.sliding_window_view(padded, length)[start].T if len(start) \
        else np.zeros((length, 0), np.uint8)
    return codes, have, text


class Model(NamedTuple):
    names: list[str]
    net: Network | None


def train(texts: list[str], languages: list[str], seed: int = SEED, steps_: int = STEPS) -> Model:
    """Adam steps over random windows of whole texts, languages drawn evenly."""
    names = sorted(set(languages))
    if len(names) < 2:
        return Model(names, None)
    slice_ = Texts(pa.array(texts, pa.large_string()))
    codes, have, text = windows(LOWER[slice_.data], slice_.at)
    label = np.searchsorted(np.array(names), np.array(languages))[text]
    rng = np.random.default_rng(seed)
    net = initial(len(names), rng)
    pools = [p for p in (np.flatnonzero(label == k) for k in range(len(names))) if len(p)]
    m, v = ([np.zeros_like(w) for w in net] for _ in range(2))
    for step in range(1, steps_ + 1):
        chosen = np.concatenate([rng.choice(p, max(1, BATCH // len(pools))) for p in pools])
        weight = (np.arange(WINDOW)[:, None] < have[chosen]).astype(np.float32)
        _, grad = gradients(net, codes[:, chosen], label[chosen], weight)
        norm = np.sqrt(sum(float((g ** 2).sum()) for g in grad))
        rate = RATE * min(1.0, 2 * (1 - step / (steps_ + 1)))
        for w, g, a, b in zip(net, grad, m, v):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            a += 0.1 * (g - a)
            b += 0.01 * (g ** 2 - b)
            w -= rate * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.99 ** step)) + 1e-7)
    return Model(names, net)


def classify(model: Model, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Per text the mean log probabilities (n, L), and how many positions have each label."""
    n_labels = len(model.names)
    codes, have, text = windows(LOWER[texts.data], texts.at)
    sums, counts = np.zeros((texts.n, n_labels)), np.zeros((texts.n, n_labels), np.int64)
    places = np.arange(WINDOW)[:, None]
    for at in range(0, codes.shape[1], LANES):
        part = slice(at, at + LANES)
        logits = position_logits(model.net, steps(model.net, np.ascontiguousarray(codes[:, part])))
        logits -= logits.max(axis=1, keepdims=True)
        inside = places < have[part]
        best = logits == 0
        norm = np.log(np.exp(logits).sum(axis=1))
        for k in range(n_labels):
            sums[:, k] += np.bincount(text[part], ((logits[:, k] - norm) * inside).sum(axis=0), texts.n)
            counts[:, k] += np.bincount(text[part], (best[:, k] & inside).sum(axis=0), texts.n).astype(np.int64)
    return sums / np.maximum(np.diff(texts.at), 1)[:, None], counts


_RESULT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()),
                     ("positions", pa.map_(pa.string(), pa.int64()))])


def _label(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        names = np.array(model.names or [UNKNOWN])
        for whole in batches:
            for batch in slices(whole):
                texts = Texts(batch.column("text"))
                if model.net is None:
                    pooled, counts = np.zeros((texts.n, len(names))), np.zeros((texts.n, len(names)), np.int64)
                    counts[:, 0] = np.diff(texts.at)
                else:
                    pooled, counts = classify(model, texts)
                letters = np.concatenate([[0], np.cumsum(has_letter(texts))])
                some = letters[texts.at[1:]] > letters[texts.at[:-1]]
                p = softmax((pooled * 8).T).T
                best = p.argmax(axis=1)
                label = np.where(some, names[best], UNKNOWN)
                score = np.where(some, p[np.arange(texts.n), best], 0.0)
                keys = pa.array(np.tile(names, texts.n))
                offsets = pa.array(np.arange(texts.n + 1) * len(names), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(label, pa.string()), pa.array(score),
                     pa.MapArray.from_arrays(offsets, keys, pa.array(counts.ravel()))], schema=_RESULT)
    return run


def has_letter(texts: Texts) -> np.ndarray:
    """Bytes that are letters or start a letter: ASCII by table, others by their character's class."""
    ascii_ = LETTER[texts.data] & (texts.data < 0x80)
    doubt = np.concatenate([[0], np.cumsum(ascii_)])
    found = ascii_.copy()
    # Texts whose only letters may be beyond ASCII are looked at as strings.
    for i in np.flatnonzero((doubt[texts.at[1:]] == doubt[texts.at[:-1]]) & (np.diff(texts.at) > 0)):
        raw = texts.data[texts.at[i]:texts.at[i + 1]]
        if (raw >= 0x80).any() and any(c.isalpha() for c in raw.tobytes().decode()):
            found[texts.at[i]] = True
    return found


def learning_sample(docs: DataFrame, rows: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS, seed: int = SEED) -> DataFrame:
    """At most ``rows`` documents with a language, in a seeded order, none above ``chars`` characters."""
    place = F.xxhash64("doc_id", F.lit(seed))
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL").filter(remainder(F.col("doc_id"), 4) != 2)
    chosen = known.select("doc_id", "lang", F.length("text").alias("n")).filter(F.col("n").between(1, chars)).orderBy(
        place, "doc_id", "lang").limit(rows).select("doc_id", "lang", "n").distinct()
    texts = known.withColumn("n", F.length("text")).join(F.broadcast(chosen), ["doc_id", "lang", "n"])
    return texts.orderBy(place, "doc_id", "lang", "text").limit(rows).select("text", "lang")


def detect_languages(docs: DataFrame, rows: int = SAMPLE_DOCS) -> DataFrame:
    """Predict the language of every whole text of ``docs`` (doc_id, text, lang).

    Learns from text and language of documents whose crc32 remainder by 4 is not 2, at most
    ``rows`` of them. Null texts and texts without a letter are ``und`` with score 0; with one
    known language all others get it, with none all are ``und``. Every row gives one row,
    repeated ones too, and an empty table an empty result; other columns are ignored. Returns
    doc_id, held_out, lang_pred, score, and positions (bytes labelled with each language).
    """
    sample = learning_sample(docs, rows).toPandas()
    shared = docs.sparkSession.sparkContext.broadcast(train(sample["text"].tolist(), sample["lang"].tolist()))
    labelled = docs.select("doc_id", "text").mapInArrow(
        _label(shared), "doc_id long, lang_pred string, score double, positions map<string, long>")
    return labelled.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score",
                           "positions")
