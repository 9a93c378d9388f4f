"""Document fingerprints: Merkle trees over sections, paragraphs and phrases.

Leaves are phrases of a few words and cover the text byte by byte; paragraphs are lines,
sections start at headings, after blank lines and at paragraphs that their own hash picks.
A node hashes its children, so equal roots mean equal texts, and two trees are compared
by going down where their branches differ.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratamem.llm.batches import SPACE, Texts, mix, sequence_hashes, span_hashes
from stratamem.session import materialize

LEAF_WORDS = 4
# One paragraph in so many starts a section whatever stands around it.
SECTION_PARAGRAPHS = 16
SLICE_CHARS = 1 << 20
U64 = np.uint64


class Trees(NamedTuple):
    """Trees of several texts; ``*_of`` give each text's first node, one more at the end."""
    leaf_start: np.ndarray
    leaf_end: np.ndarray
    leaves: np.ndarray
    leaf_of: np.ndarray
    paragraphs: np.ndarray
    paragraph_leaf: np.ndarray  # first leaf of each paragraph, one more at the end
    sections: np.ndarray
    section_paragraph: np.ndarray
    roots: np.ndarray           # (n, 2): 128 bits per text


def _firsts(members: np.ndarray, heads: np.ndarray) -> np.ndarray:
    return np.append(np.searchsorted(members, heads), len(members))


def build(texts: Texts) -> Trees:
    """The trees of a slice of texts."""
    data, at = texts.data, texts.at
    full = at[:-1][at[1:] > at[:-1]]
    breaks = np.flatnonzero(data == 0x0A) + 1
    para = np.union1d(full, breaks[breaks < len(data)]).astype(np.int64)
    word, word_end, _ = texts.spans(~SPACE)
    # A word starts a phrase if it is the 1st, 5th, ... of its sentence.
    fresh = np.zeros(len(word), bool)
    if len(word):
        fresh[0] = True
        fresh[1:] = np.isin(data[word_end[:-1] - 1], np.frombuffer(b".!?", np.uint8))
        head = np.searchsorted(word, para)
        fresh[head[head < len(word)]] = True
    sentence = np.flatnonzero(fresh)
    nth = np.arange(len(word)) - np.repeat(sentence, np.diff(np.append(sentence, len(word))))
    start = word[nth % LEAF_WORDS == 0]
    # The first phrase of a paragraph takes what stands before it.
    owner = np.searchsorted(para, start, side="right") - 1
    opens = np.ones(len(start), bool)
    opens[1:] = owner[1:] != owner[:-1]
    start = np.union1d(para, start[~opens]).astype(np.int64)
    end = np.append(start[1:], len(data))
    leaves = span_hashes(data, start, end)
    paragraph_leaf = _firsts(start, para)
    paragraphs = sequence_hashes(leaves, paragraph_leaf[:-1], paragraph_leaf[1:], 1)
    blank = np.zeros(len(para), bool)
    if len(para):
        para_end = np.append(para[1:], len(data))
        filled = np.concatenate([[0], np.cumsum(~SPACE[data])])
        blank[1:] = (filled[para_end] == filled[para])[:-1]
    heading = data[para] == 0x23 if len(para) else blank
    first = np.isin(para, full)
    chosen = first | blank | heading | (mix(paragraphs, 6) % U64(SECTION_PARAGRAPHS) == 0)
    section_at = np.flatnonzero(chosen)
    section_paragraph = np.append(section_at, len(para))
    sections = sequence_hashes(paragraphs, section_paragraph[:-1], section_paragraph[1:], 2)
    section_of = np.searchsorted(para[section_at], at) if len(section_at) else np.zeros(texts.n + 1, np.int64)
    roots = np.stack([sequence_hashes(sections, section_of[:-1], section_of[1:], s) for s in (3, 7)], axis=1)
    return Trees(start, end, leaves, np.searchsorted(start, at), paragraphs, paragraph_leaf, sections,
                 section_paragraph, roots)


def likeness(a: Trees, pick_a: np.ndarray, b: Trees, pick_b: np.ndarray) -> np.ndarray:
    """Share of both texts' bytes that lie in common leaves, for pairs of trees (0 to 1).

    Pairs with equal roots are equal; for the others the leaves are matched as multisets.
    """
    out = (a.roots[pick_a] == b.roots[pick_b]).all(axis=1).astype(float)
    differ = np.flatnonzero(out == 0)
    held, total = [], np.zeros(len(differ))
    for tree, pick in ((a, pick_a[differ]), (b, pick_b[differ])):
        count = tree.leaf_of[pick + 1] - tree.leaf_of[pick]
        pair = np.repeat(np.arange(len(differ)), count)
        leaf = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(tree.leaf_of[pick], count)
        size = (tree.leaf_end - tree.leaf_start)[leaf]
        total += np.bincount(pair, size, len(differ))
        key, at, n = np.unique(mix(tree.leaves[leaf] ^ mix(pair.astype(U64), 8), 9), return_index=True, return_counts=True)
        held.append((key, n, pair[at], size[at]))
    (key, n, pair, size), (other, m, _, _) = held
    _, i, j = np.intersect1d(key, other, assume_unique=True, return_indices=True)
    common = np.bincount(pair[i], np.minimum(n[i], m[j]) * size[i], len(differ))
    out[differ] = np.where(total > 0, 2 * common / np.maximum(total, 1), 0)
    return out


def _same(a: list[int], b: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """The differing stretches (a from, a to, b from, b to) of two lists of children, in order.

    Equal ends are dealt with first. Between them, children that both lists hold once
    are aligned along their longest increasing chain, and each gap is treated likewise.
    """
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
        if i == m and j == n:
            continue
        chain = []
        if i < m and j < n:
            times, others = Counter(a[i:m]), Counter(b[j:n])
            place = {h: k for k, h in enumerate(b[j:n], j) if others[h] == 1}
            pairs = [(k, place[h]) for k, h in enumerate(a[i:m], i) if times[h] == 1 and h in place]
            ends, last, before = [], [], []
            for at, (_, k) in enumerate(pairs):
                to = bisect_left(ends, k)
                before.append(last[to - 1] if to else -1)
                ends[to:to + 1] = [k]
                last[to:to + 1] = [at]
            at = last[-1] if last else -1
            while at >= 0:
                chain.append(pairs[at])
                at = before[at]
        if not chain:
            yield i, m, j, n
            continue
        for k, q in chain:  # from the last to the first, so that the first gap is taken next
            todo.append((k + 1, m, q + 1, n))
            m, n = k, q
        todo.append((i, m, j, n))


def changes(a: Trees, one: int, b: Trees, other: int) -> list[tuple[int, int, int, int]]:
    """Byte ranges (old start, old end, new start, new end) that differ between two texts.

    Children are aligned in order from the root down, and only differing branches are
    entered. What lies between the ranges is equal in both texts: an empty new range is a
    deletion, an empty old one an insertion, and a moved part is one of each.
    """
    if (a.roots[one] == b.roots[other]).all():
        return []
    sides, zero = [], []
    for tree, k in ((a, one), (b, other)):
        low, high = int(tree.leaf_of[k]), int(tree.leaf_of[k + 1])
        para = np.searchsorted(tree.paragraph_leaf, (low, high))
        section = np.searchsorted(tree.section_paragraph, para)
        sides.append((low, high, *para.tolist(), *section.tolist()))
        zero.append(int(tree.leaf_start[low]) if low < high else 0)
    found: list[tuple[int, int, int, int]] = []

    def byte(tree: Trees, leaf: int, side: int) -> int:
        if leaf < sides[side][1]:
            return int(tree.leaf_start[leaf]) - zero[side]
        return int(tree.leaf_end[leaf - 1]) - zero[side] if sides[side][1] > sides[side][0] else 0

    def descend(level: int, i: int, m: int, j: int, n: int) -> None:
        hashes = (a.sections, a.paragraphs, a.leaves)[level][i:m].tolist(), (
            b.sections, b.paragraphs, b.leaves)[level][j:n].tolist()
        for p, q, r, s in _same(*hashes):
            p, q, r, s = p + i, q + i, r + j, s + j
            if level == 2:
                at = byte(a, p, 0), byte(a, q, 0), byte(b, r, 1), byte(b, s, 1)
                if found and found[-1][1] == at[0] and found[-1][3] == at[2]:
                    at = found[-1][0], at[1], found.pop()[2], at[3]
                found.append(at)
            else:
                x, y = ((t.section_paragraph, t.paragraph_leaf)[level] for t in (a, b))
                descend(level + 1, int(x[p]), int(x[q]), int(y[r]), int(y[s]))
    descend(0, sides[0][4], sides[0][5], sides[1][4], sides[1][5])
    return found


def changed_ranges(old: str, new: str) -> list[tuple[int, int, int, int]]:
    """``changes`` between two texts."""
    both = build(Texts(pa.array([old, new], pa.large_string())))
    return changes(both, 0, both, 1)


def edits(old: str, new: str) -> list[tuple[int, int]]:
    """Byte ranges of ``new`` that differ from ``old``; a deletion is an empty range."""
    return [(start, end) for _, _, start, end in changed_ranges(old, new)]


# -- Documents and their successors -------------------------------------------------


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many of the next text, or all it has."""
    k = len(text) // 4
    return text[:len(text) - k] + following[:k]


_EDITS = pa.list_(pa.struct([(f, pa.int64()) for f in ("old_start", "old_end", "new_start", "new_end")]))
_ROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                  ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()),
                  ("near_next", pa.float64()), ("edits", _EDITS), ("role", pa.int32()), ("part", pa.int32()), ("text", pa.string())])
_ROW_DDL = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
            "near_edited double, near_next double, "
            "edits array<struct<old_start: long, old_end: long, new_start: long, new_end: long>>, role int, part int, text string")
DONE, HEAD, TAIL = 0, 1, 2


def _hex(roots: np.ndarray) -> list[str]:
    return [f"{a:016x}{b:016x}" for a, b in roots.tolist()]


def _compare(ids: list, texts: list[str], following: list[str]) -> pa.RecordBatch:
    """Finished rows for texts and the texts after them."""
    changed = [edited(t, f) for t, f in zip(texts, following)]
    own, new, after = (build(Texts(pa.array(c, pa.large_string()))) for c in (texts, changed, following))
    every = np.arange(len(texts))
    columns = [ids, [len(t) for t in texts], [hashlib.sha256(t.encode()).hexdigest() for t in changed],
               _hex(own.roots), _hex(new.roots), likeness(own, every, new, every), likeness(own, every, after, every),
               [[dict(zip(_EDITS.value_type.names, r)) for r in changes(own, k, new, k)] for k in range(len(texts))]]
    made = [pa.array(c, f.type) for c, f in zip(columns, _ROW)]
    rest = [pa.array(np.zeros(len(ids), np.int32)), pa.array(np.zeros(len(ids), np.int32)),
            pa.nulls(len(ids), pa.string())]
    return pa.RecordBatch.from_arrays(made + rest, schema=_ROW)


def _edge(doc_id, role: int, part: int, text: str) -> pa.RecordBatch:
    row = [doc_id, None, None, None, None, None, None, None, role, part, text]
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _ROW)], schema=_ROW)


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition; its first and last text go on to meet the neighbours'."""
    from pyspark import TaskContext
    part = TaskContext.get().partitionId()
    ids, texts, size, started = [], [], 0, False
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            text = text.as_py() or ""
            if not started:
                yield _edge(doc_id, HEAD, part, text)
                started = True
            ids.append(doc_id)
            texts.append(text)
            size += len(text)
            if size > SLICE_CHARS and len(ids) > 1:
                yield _compare(ids[:-1], texts[:-1], texts[1:])
                ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])
    if len(ids) > 1:
        yield _compare(ids[:-1], texts[:-1], texts[1:])
    if ids:
        yield _edge(ids[-1], TAIL, part, texts[-1])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            yield _compare(*(part.column(c).to_pylist() for c in ("doc_id", "text", "following")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint every whole text of ``docs`` (doc_id, text) and its edited text.

    Documents follow one another by ascending id, null ids first, equal ids by a hash of
    their texts; after the last comes the first, so a single document follows itself. Null
    texts are empty. The edited text takes its last quarter from the next document. Every
    row gives one row, repeated ones too, and an empty table an empty result; other columns
    are ignored. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, and edits: the byte ranges in which the edited text differs.
    """
    rows = docs.select("doc_id", "text").withColumn("_tie", F.xxhash64("text"))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(partitions, "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").select(
        "doc_id", "text")
    done = materialize(ordered.mapInArrow(_ordered, _ROW_DDL), "trees")
    # A row per partition: the part whose first text follows the part's last.
    parts = done.filter(F.col("role") == HEAD).select("part")
    by_part = Window.orderBy("part")
    after = parts.select("part", F.coalesce(F.lead("part").over(by_part), F.min("part").over(Window.partitionBy()))
                         .alias("next"))
    heads = done.filter(F.col("role") == HEAD).select(F.col("part").alias("next"), F.col("text").alias("following"))
    tails = done.filter(F.col("role") == TAIL).select("part", "doc_id", "text").join(after, "part").join(heads, "next")
    last = tails.select("doc_id", "text", "following").mapInArrow(_joined, _ROW_DDL)
    names = list(_ROW.names[:8])
    return done.filter(F.col("role") == DONE).select(names).unionByName(last.select(names))
