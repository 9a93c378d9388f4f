"""License scans: an exact set-similarity join of text blocks with license templates.

A template's tokens are ordered by their frequency in the whole corpus, rarest first. A
block that holds enough of a template must hold one of its first few tokens (prefix
filter), enough template tokens at all (length filter), and enough of them from the
shared one on (positional filter); what passes is counted exactly.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamem.llm.batches import ALNUM, Texts, ranges, slices, span_hashes

# The phrases of the base labels.
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
# Opening sentences and notices of common licenses.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "released under the mit license"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc", "this work is licensed under a creative commons attribution international license"),
    ("cc", "licensed under cc by nc"),
)
THRESHOLD = 0.8
# Blocks overlap by half, so every run of half a block's words lies within one.
BLOCK_WORDS = 64


def words_of(text: str) -> np.ndarray:
    texts = Texts(pa.array([text]), lower=True)
    start, end, _ = texts.spans(ALNUM)
    return span_hashes(texts.data, start, end)


class Index(NamedTuple):
    """Templates over a small vocabulary, whose numbers follow the corpus order."""
    hashes: np.ndarray        # sorted hashes of the vocabulary
    number: np.ndarray        # their places in the corpus order, rarest first
    labels: list[str]
    tokens: list[np.ndarray]  # of each template, sorted numbers
    need: list[int]           # least overlap
    phrases: dict[str, np.ndarray]


def vocabulary(templates=TEMPLATES) -> np.ndarray:
    return np.unique(np.concatenate([words_of(t) for _, t in templates]))


def build_index(frequency: dict[int, int], templates=TEMPLATES, phrases=None, threshold: float = THRESHOLD) -> Index:
    """``frequency`` counts the vocabulary's words in the corpus, by hash as a signed number."""
    hashes = vocabulary(templates)
    count = np.array([frequency.get(int(h), 0) for h in hashes.astype(np.int64)])
    number = np.empty(len(hashes), np.int64)
    number[np.lexsort((hashes, count))] = np.arange(len(hashes))
    tokens = [np.sort(number[np.searchsorted(hashes, np.unique(words_of(t)))]) for _, t in templates]
    return Index(hashes, number, [label for label, _ in templates], tokens,
                 [math.ceil(threshold * len(t) - 1e-9) for t in tokens],
                 {k: words_of(p) for k, p in (PHRASES if phrases is None else phrases).items()})


def known(words: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Positions of vocabulary words and their numbers."""
    place = np.minimum(np.searchsorted(index.hashes, words), len(index.hashes) - 1)
    at = np.flatnonzero(index.hashes[place] == words)
    return at, index.number[place[at]]


def matches(words: np.ndarray, first: np.ndarray, index: Index, block_words: int = BLOCK_WORDS):
    """Blocks with enough of a template: their texts, first words, templates and containments."""
    half = block_words // 2
    size = np.diff(first)
    # Block j of a text starts at word j * half; the last one may be short.
    blocks = np.maximum(1, -(-(size - half) // half)) * (size > 0)
    base = np.concatenate([[0], np.cumsum(blocks)])
    at, number = known(words, index)
    text = np.searchsorted(first, at, side="right") - 1
    j = (at - first[text]) // half
    rows = []
    for back in (0, 1):
        inside = (j - back >= 0) & (j - back < blocks[text])
        rows.append(np.stack([base[text[inside]] + j[inside] - back, number[inside]], axis=1))
    held = np.unique(np.concatenate(rows), axis=0)
    block, token = held[:, 0], held[:, 1]
    start = np.searchsorted(block, block, side="left")
    end = np.searchsorted(block, block, side="right")
    found = []
    for t, (tokens, need) in enumerate(zip(index.tokens, index.need)):
        prefix = tokens[:len(tokens) - need + 1]
        place = np.searchsorted(prefix, token)
        hit = np.flatnonzero((place < len(prefix)) & (prefix[np.minimum(place, len(prefix) - 1)] == token))
        hit = hit[(end - start)[hit] >= need]                                             # length
        left = np.minimum(len(tokens) - place[hit], end[hit] - hit)                        # positional
        before = np.minimum(place[hit], hit - start[hit])
        candidates = np.unique(block[hit[left + before >= need]])
        lo, hi = np.searchsorted(block, candidates), np.searchsorted(block, candidates, side="right")
        mine = np.isin(token[ranges(lo, hi - lo)], tokens)
        common = np.bincount(np.repeat(np.arange(len(candidates)), hi - lo), mine, len(candidates))
        good = common >= need
        owner = np.searchsorted(base, candidates[good], side="right") - 1
        found.append(np.stack([owner, (candidates[good] - base[owner]) * half, np.full(good.sum(), t),
                               common[good] / len(tokens)], axis=1))
    return np.concatenate(found)


def phrase_places(words: np.ndarray, first: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Where the phrase's words stand one after another within a text."""
    at = np.flatnonzero(words == phrase[0])
    text = np.searchsorted(first, at, side="right") - 1
    at = at[at + len(phrase) <= first[text + 1]]
    for k in range(1, len(phrase)):
        at = at[words[at + k] == phrase[k]]
    return at


def _count(hashes: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(hashes), np.int64)
        for whole in batches:
            for batch in slices(whole):
                texts = Texts(batch.column("text"), lower=True)
                start, end, _ = texts.spans(ALNUM)
                words = span_hashes(texts.data, start, end)
                place = np.minimum(np.searchsorted(hashes, words), len(hashes) - 1)
                counts += np.bincount(place[hashes[place] == words], minlength=len(hashes))
        yield pa.RecordBatch.from_arrays([pa.array(hashes.astype(np.int64)), pa.array(counts)], ["word", "n"])
    return run


_HIT = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("containment", pa.float64())]))
_DDL = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
        "labels string, score double, blocks array<struct<label: string, first_word: long, containment: double>>")
_SCHEMA = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")],
                     ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("blocks", _HIT)])


def _scan(shared, block_words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for whole in batches:
            for batch in slices(whole):
                texts = Texts(batch.column("text"), lower=True)
                start, end, first = texts.spans(ALNUM)
                words = span_hashes(texts.data, start, end)
                rows = [[n, 0, None, None, set(), set(), 0.0, []] for n in np.diff(first).tolist()]
                for label, phrase in index.phrases.items():
                    places = phrase_places(words, first, phrase)
                    owner = np.searchsorted(first, places, side="right") - 1
                    for i, at in zip(owner.tolist(), (places - first[owner]).tolist()):
                        row = rows[i]
                        row[1] += 1
                        row[2] = at if row[2] is None else min(at, row[2])
                        row[3] = at if row[3] is None else max(at, row[3])
                        row[4].add(label)
                        row[5].add(label)
                        row[6] = 1.0
                for i, at, t, share in matches(words, first, index, block_words).tolist():
                    row = rows[int(i)]
                    row[5].add(index.labels[int(t)])
                    row[6] = max(row[6], share)
                    row[7].append({"label": index.labels[int(t)], "first_word": int(at), "containment": share})
                for row in rows:
                    row[4], row[5] = (",".join(sorted(row[k])) for k in (4, 5))
                made = [pa.array(c, f.type) for c, f in zip(zip(*rows), list(_SCHEMA)[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], schema=_SCHEMA)
    return run


def scan_licenses(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD,
                  block_words: int = BLOCK_WORDS) -> DataFrame:
    """License phrases and template blocks in every whole text of ``docs`` (doc_id, text).

    Words are runs of letters and digits, A-Z lower-cased; null texts are empty. A block of
    ``block_words`` words matches a template if it holds ``threshold`` of its distinct words;
    no block is missed. Every row gives one row, repeated ones too, and an empty table an
    empty result; other columns are ignored. Returns doc_id, n_words, n_base, first_word,
    last_word, base_labels, labels, score (1 with a phrase, else the highest containment that
    reaches the threshold, else 0), and blocks (label, first_word, containment).
    """
    hashes = vocabulary(templates)
    counted = docs.select("text").mapInArrow(_count(hashes), "word long, n long").groupBy("word").agg(
        F.sum("n").alias("n")).collect()
    index = build_index({r["word"]: r["n"] for r in counted}, templates, threshold=threshold)
    shared = docs.sparkSession.sparkContext.broadcast(index)
    return docs.select("doc_id", "text").mapInArrow(_scan(shared, block_words), _DDL)
