"""Byte-level BPE encoding of long texts by tree concatenation, and decoding.

A text is halved down to leaves, at any code point, and the leaves are encoded apart from
each other. Going up the tree, two encodings are joined by encoding anew only a window of
text around the join, which grows until it agrees with both sides:

* With the left side it agrees from a split of the left text that no later text can move.
* With the right side it agrees at the first split, at or behind the join, that the window
  and the right text alone both have. Behind it the two run alike, since the splitting
  pattern never looks back.
* Inside a run that the pattern does not split, however long, windows of tokens grow until
  their encoding starts with the left side's token and ends with the right side's. A token
  sequence is the encoding of its bytes exactly if every two neighbours are the encoding of
  theirs: the first merge across any boundary would also happen between those two alone.
  So the joined tokens are the encoding of the whole run.

Texts beyond ``SPREAD_CHARS`` are cut once more, and their parts are encoded in different tasks.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamem.llm.batches import ranges, slices
from stratamem.llm.packing import vocabulary_path
from stratamem.session import materialize

LEAF_CHARS = 4096
SPREAD_CHARS = 1 << 16
# Code points from a split's start that decide where it ends at the least: the longest contraction.
REACH = 3
FIRST_WINDOW = 64
FIRST_TOKENS = 4
# Splits up to this many bytes are encoded at once; longer ones keep what the sides have.
SHORT_BYTES = 256

_RESULT = ("doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_leaves long, n_windows long")
_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                  ("decoded_sha256", pa.string()), ("n_leaves", pa.int64()), ("n_windows", pa.int64())])
_PARTS = "row string, doc_id long, seg int, part int, special long, text string"
_CUT = pa.schema([("row", pa.string()), ("doc_id", pa.int64()), ("seg", pa.int32()), ("part", pa.int32()),
                  ("special", pa.int64()), ("text", pa.string())])
_ENCODED = pa.schema([*_CUT, ("ids", pa.binary()), ("tail", pa.int64()), ("leaves", pa.int64()),
                      ("windows", pa.int64())])


def _byte_letters() -> list[str]:
    """The printable letter that a byte-level vocabulary writes for each byte."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, more = [], 0x100
    for b in range(256):
        out.append(chr(b) if b in kept else chr(more))
        more += b not in kept
    return out


class Part:
    """The encoding of text[lo:hi] alone; no later text moves the split that starts at ``tail``."""

    __slots__ = ("lo", "hi", "ids", "tail")

    def __init__(self, lo: int, hi: int, ids: np.ndarray, tail: int):
        self.lo, self.hi, self.ids, self.tail = lo, hi, ids, tail


class TreeEncoder:
    """Encodes with the merges of a byte-level BPE tokenizer file and decodes its ids."""

    def __init__(self, path: str, leaf: int = LEAF_CHARS):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        if (model.get("type") != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space")
                or not split.get("use_regex", True) or spec.get("normalizer")):
            raise ValueError(f"not a plain byte-level BPE file: {path}")
        self.library = Tokenizer.from_file(path)
        value = {c: b for b, c in enumerate(_byte_letters())}
        self.bytes_of = {i: bytes(value[c] for c in token) for token, i in model["vocab"].items()}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        # The reader of ranks merges by id, so the merges must be listed in the order of their ids.
        order = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if order != sorted(order):
            raise ValueError(f"merges and ids differ in order: {path}")
        plain = {raw: i for i, raw in self.bytes_of.items() if i not in set(self.added.values())}
        self.ranks = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=plain,
                                       special_tokens={})
        self.bytes_of |= {i: content.encode() for content, i in self.added.items()}
        top = max(self.bytes_of) + 1
        raws = [self.bytes_of.get(i, b"") for i in range(top)]
        self.size = np.array([len(r) for r in raws], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        self.flat = np.frombuffer(b"".join(raws), np.uint8)
        self.leaf = leaf
        self.leaves = self.windows = 0

    # -- decoding --------------------------------------------------------------------

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids, what is not UTF-8 replaced as the tokenizer's decoder does."""
        raw = self.flat[ranges(self.start[ids], self.size[ids])].tobytes() if len(ids) else b""
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()

    # -- encoding --------------------------------------------------------------------

    def segments(self, text: str) -> Iterator[tuple[str, int]]:
        """Stretches of ordinary text (with -1) and added tokens' literals (with their id), in order."""
        if not any(t in text for t in self.added):
            yield text, -1
            return
        at = 0
        while at < len(text):
            found = [(text.find(t, at), -len(t), t) for t in self.added if text.find(t, at) >= 0]
            if not found:
                break
            place, _, literal = min(found)
            if place > at:
                yield text[at:place], -1
            yield literal, self.added[literal]
            at = place + len(literal)
        if at < len(text):
            yield text[at:], -1

    def encode(self, text: str) -> np.ndarray:
        found = [np.array([special], np.uint32) if special >= 0 else self.tree(part).ids
                 for part, special in self.segments(text)]
        return np.concatenate(found) if found else np.zeros(0, np.uint32)

    def tree(self, text: str) -> Part:
        """Encode halves of halves and join them level by level."""
        n, level = len(text), 0
        while n > self.leaf << level:
            level += 1
        cuts = [(n * i) >> level for i in range((1 << level) + 1)]
        return self.joined(text, [self.whole(text, a, b, level > 0) for a, b in zip(cuts[:-1], cuts[1:])])

    def joined(self, text: str, parts: list[Part]) -> Part:
        while len(parts) > 1:
            parts = [self.join(text, *parts[i:i + 2]) if i + 1 < len(parts) else parts[i]
                     for i in range(0, len(parts), 2)]
        return parts[0]

    def whole(self, text: str, lo: int, hi: int, more: bool) -> Part:
        piece = text[lo:hi]
        self.leaves += 1
        try:
            ids = self.ranks.encode_ordinary(piece)
        except BaseException as e:  # its pattern matcher gives up on some very long runs
            if isinstance(e, (KeyboardInterrupt, SystemExit)):
                raise
            ids = self.library.encode(piece, add_special_tokens=False).ids
        return Part(lo, hi, np.array(ids, np.uint32), lo + self._tail(piece) if more else lo)

    def _tail(self, piece: str) -> int:
        """The last place where a split starts whatever follows the piece, or 0."""
        # Between an ASCII letter or digit and an ASCII space every text splits.
        last = len(piece) - REACH - 1
        for i in range(last, max(0, last - 200), -1):
            if piece[i] in " \n" and piece[i - 1].isascii() and piece[i - 1].isalnum():
                return i
        return self._certain(piece)[-1]

    def _spans(self, window: str) -> list[tuple[int, int]]:
        return [span for _, span in self.library.pre_tokenizer.pre_tokenize_str(window)]

    def _certain(self, window: str, ends: bool = False) -> list[int]:
        """Starts of the splits of a window that hold whatever follows it; all of them, and its end, if it ends there."""
        out = [0]
        for a, b in self._spans(window):
            if not ends and max(b, a + REACH) >= len(window):
                break
            out.append(b)
        return out

    def _piece(self, raw: bytes) -> np.ndarray:
        return np.array(self.ranks._encode_single_piece(raw), np.uint32)

    def join_tokens(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The encoding of an unsplit run from those of its two parts."""
        if not len(left) or not len(right):
            return left if len(left) else right
        w = FIRST_TOKENS
        while True:
            self.windows += 1
            a, b = left[-w:], right[:w]
            middle = self._piece(b"".join(self.bytes_of[int(i)] for i in (*a, *b)))
            if (len(a) == len(left) or middle[0] == a[0]) and (len(b) == len(right) or middle[-1] == b[-1]):
                return np.concatenate([left[:len(left) - len(a)], middle, right[len(b):]])
            w *= 2

    def join(self, text: str, left: Part, right: Part) -> Part:
        c, end = left.hi, right.hi
        reach = FIRST_WINDOW
        while True:
            stop = min(end, c + reach)
            self.windows += 1
            mine = self._certain(text[left.tail:stop], stop == end)
            theirs = {c + p for p in self._certain(text[c:stop], stop == end)}
            agreed = next((left.tail + p for p in mine if left.tail + p in theirs), None)
            if agreed is not None:
                break
            reach *= 4
        marks = [left.tail + p for p in mine if left.tail + p <= agreed]
        before = self._count(left.ids[::-1], text[left.tail:c], exact=True)
        after = self._count(right.ids, text[c:agreed], exact=True)
        middle = [self._split(text, a, b, left, right) for a, b in zip(marks[:-1], marks[1:])]
        ids = np.concatenate([left.ids[:len(left.ids) - before], *middle, right.ids[after:]])
        safe = [left.tail, *(m for m in marks if m + REACH < end)]
        # Close to the end even the agreed split may still move, and with it all behind it.
        tail = right.tail if agreed + REACH < end and right.tail >= agreed else safe[-1]
        return Part(left.lo, end, ids, tail)

    def _count(self, ids: np.ndarray, piece: str, exact: bool = False) -> int:
        """How many of the first tokens lie within the piece's bytes."""
        n = len(piece.encode())
        ends = np.cumsum(self.size[ids[:n]])
        found = int(np.searchsorted(ends, n, "right"))
        if exact and (ends[found - 1] if found else 0) != n:
            raise AssertionError("a split is not between two tokens")
        return found

    def _split(self, text: str, x: int, y: int, left: Part, right: Part) -> np.ndarray:
        """Tokens of one split text[x:y], from those that the sides have where it is long."""
        raw = text[x:y].encode()
        c = left.hi
        if len(raw) <= SHORT_BYTES or not x < c < y:
            return self._piece(raw)
        # The sides' tokens belong to splits of their own; of those, the ones at the join take part.
        first = max(x, left.tail + self._spans(text[left.tail:c])[-1][0])
        last = min(y, c + self._spans(text[c:y])[0][1])
        m = self._count(left.ids[::-1], text[first:c])
        k = self._count(right.ids, text[c:last])
        run_left, run_right = left.ids[len(left.ids) - m:], right.ids[:k]
        n_left = int(self.size[run_left].sum())
        n_right = int(self.size[run_right].sum())
        at = len(text[x:c].encode())
        found = self._piece(raw[:at - n_left]) if at > n_left else run_left[:0]
        for more in (run_left, run_right, self._piece(raw[at + n_right:]) if at + n_right < len(raw) else run_left[:0]):
            found = self.join_tokens(found, more)
        return found


_encoders: dict[tuple[str, int], TreeEncoder] = {}


def encoder(path: str, leaf: int = LEAF_CHARS) -> TreeEncoder:
    """One encoder per process and file."""
    if (path, leaf) not in _encoders:
        _encoders[path, leaf] = TreeEncoder(path, leaf)
    return _encoders[path, leaf]


def _result(e: TreeEncoder, doc_id, ids: np.ndarray, leaves: int, windows: int) -> tuple:
    return (doc_id, len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(),
            hashlib.sha256(e.decode(ids)).hexdigest(), leaves, windows)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _texts(path: str, leaf: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, leaf)
        for whole in batches:
            for batch in slices(whole):
                rows = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    e.leaves = e.windows = 0
                    ids = e.encode(text or "")
                    rows.append(_result(e, doc_id, ids, e.leaves, e.windows))
                yield _batch(rows, _OUT)
    return run


def _cut(path: str, leaf: int, spread: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        e, task, n, rows, held = encoder(path, leaf), TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                text, n = text.as_py(), n + 1
                for seg, (stretch, special) in enumerate(e.segments(text)):
                    for part, at in enumerate(range(0, len(stretch), spread)):
                        rows.append((f"{task}-{n}", doc_id.as_py(), seg, part, special, stretch[at:at + spread]))
                        held += len(rows[-1][-1])
                        if held > spread or len(rows) == 1000:
                            yield _batch(rows, _CUT)
                            rows, held = [], 0
        if rows:
            yield _batch(rows, _CUT)
    return run


def _encode_parts(path: str, leaf: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, leaf)
        for whole in batches:
            for batch in slices(whole):
                made = []
                for text, special in zip(batch.column("text").to_pylist(), batch.column("special").to_pylist()):
                    e.leaves = e.windows = 0
                    if special >= 0:
                        made.append((np.array([special], "<u4").tobytes(), 0, 0, 0))
                    else:
                        part = e.tree(text)
                        tail = part.tail or e._tail(text)
                        made.append((part.ids.astype("<u4").tobytes(), tail, e.leaves, e.windows))
                columns = [pa.array(c, f.type) for c, f in zip(zip(*made), list(_ENCODED)[len(_CUT):])]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], schema=_ENCODED)
    return run


def _join_parts(path: str, leaf: int):
    def run(table: pa.Table) -> pa.Table:
        e = encoder(path, leaf)
        rows = table.sort_by([("seg", "ascending"), ("part", "ascending")]).to_pylist()
        e.windows, found = 0, []
        for _, group in groupby(rows, key=itemgetter("seg")):
            parts, lo, seg = [], 0, list(group)
            for r in seg:
                hi = lo + len(r["text"])
                parts.append(Part(lo, hi, np.frombuffer(r["ids"], "<u4"), lo + r["tail"]))
                lo = hi
            found.append(e.joined("".join(r["text"] for r in seg), parts).ids)
        ids = np.concatenate(found)
        windows = e.windows + sum(r["windows"] for r in rows)
        return pa.Table.from_batches([_batch(
            [_result(e, rows[0]["doc_id"], ids, sum(r["leaves"] for r in rows), windows)], _OUT)])
    return run


def encode_documents(docs: DataFrame, tokenizer: str | None = None, leaf_chars: int = LEAF_CHARS,
                     spread_chars: int = SPREAD_CHARS) -> DataFrame:
    """Encode every whole text of ``docs`` (doc_id, text) and decode its ids again.

    Ids are those of the tokenizer file with add_special_tokens=False: an added token's
    literal is its id. Null is an empty text, which has no ids; every row gives one row,
    repeated ids and texts too, and other columns are ignored. Returns doc_id, n_tokens,
    ids_sha256 (ids as little-endian 32-bit numbers), decoded_sha256 (UTF-8), n_leaves and
    n_windows, the texts encoded apart and the windows encoded to join them.
    """
    path = tokenizer or vocabulary_path()
    rows = docs.select("doc_id", "text")
    long = F.coalesce(F.length("text"), F.lit(0)) > spread_chars
    short = rows.filter(~long).mapInArrow(_texts(path, leaf_chars), _RESULT)
    parts = materialize(rows.filter(long).mapInArrow(_cut(path, leaf_chars, spread_chars), _PARTS), "bpe-parts")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    encoded = parts.repartition(tasks, "row", "seg", "part").mapInArrow(
        _encode_parts(path, leaf_chars), _PARTS + ", ids binary, tail long, leaves long, windows long")
    return short.unionByName(encoded.groupBy("row").applyInArrow(_join_parts(path, leaf_chars), _RESULT))
