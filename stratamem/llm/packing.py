"""Packing token pieces into sequences by the sum-of-squares rule.

A piece goes where the sum over gaps of the squared number of open sequences with
that gap becomes smallest. Only lengths matter for it, so tokens stay where they were
made and narrow rows are packed, in groups of bounded size.
"""

from __future__ import annotations

import base64
import json
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratamem.llm.batches import slices
from stratamem.session import materialize

CAPACITY = 1024
END_ID = 2
VOCABULARY = "byte_bpe_50k"
# Pieces per group: a group wastes at most a few open sequences.
GROUP_PIECES = 200_000
_PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                     ("ids_crc32", pa.int64())])

_loaded: dict = {}


def vocabulary_path(name: str = VOCABULARY, suffix: str = ".json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name + suffix)


def encoder(path: str, added_tokens: bool = False) -> Callable[[str], list[int]]:
    """Ids of a text under the byte-level vocabulary of a tokenizer file, loaded once per process.

    Where the same vocabulary lies beside it as ranks, the faster reader of ranks is
    used; it gives the same ids. The literal of an added token in a text is ordinary text,
    or with ``added_tokens`` the token's own id, as the file has it unless told otherwise.
    """
    def plain():
        key = "plain", path, added_tokens
        if key not in _loaded:
            from tokenizers import Tokenizer
            tokenizer = Tokenizer.from_file(path)
            if not added_tokens:
                tokenizer.encode_special_tokens = True
            _loaded[key] = tokenizer
        return _loaded[key]

    if path not in _loaded:
        fast = None
        ranks = os.path.splitext(path)[0] + ".tiktoken"
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken
            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table,
                                     special_tokens={})
        _loaded[path] = fast
    fast = _loaded[path]
    literals: list[str] = []
    if added_tokens and fast is not None:
        if ("literals", path) not in _loaded:
            with open(path, encoding="utf-8") as file:
                _loaded["literals", path] = [t["content"] for t in json.load(file).get("added_tokens") or []]
        literals = _loaded["literals", path]

    def encode(text: str) -> list[int]:
        if fast is not None and not any(t in text for t in literals):
            try:
                return fast.encode_ordinary(text)
            except BaseException as e:  # the rank reader's regular expressions give up on some very long runs
                if isinstance(e, (KeyboardInterrupt, SystemExit)):
                    raise
        return plain().encode(text, add_special_tokens=False).ids
    return encode


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of a document's pieces; of several, the first may be shorter."""
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def _pieces(path: str, capacity: int, end_id: int, added_tokens: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, added_tokens)
        for whole in batches:
            for batch in slices(whole):
                rows = []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    ids = encode(text) if text else []
                    ids.append(end_id)
                    raw = memoryview(np.array(ids, "<u4").tobytes())
                    rows += [(doc_id, k, at, n, zlib.crc32(raw[4 * at:4 * (at + n)]))
                             for k, (at, n) in enumerate(cut_points(len(ids), capacity))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECES)], schema=_PIECES)
    return run


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset for each length, in the given order.

    Moving a sequence from gap g to g - n changes the sum of squares by
    2 (N(g-n) - N(g)) + 2, or by 1 - 2 N(g) if it becomes full. Of equal changes the
    smaller gap wins. A sequence is opened only where no open one has room: over lengths
    in decreasing order this needs as few sequences as best fit, 3 % fewer than letting
    the rule open sequences as well.
    """
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, np.int64)
    fill: list[int] = []
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, n in enumerate(lengths.tolist()):
        gaps = count[n:]
        change = np.where(gaps > 0, 2 * (count[:capacity + 1 - n] - gaps) + 2, np.int64(1 << 60))
        if gaps[0] > 0:
            change[0] = 1 - 2 * gaps[0]
        best = int(change.argmin())
        if gaps[best] > 0:
            gap = n + best
            k = open_at[gap].pop()
            count[gap] -= 1
        else:
            gap, k = capacity, len(fill)
            fill.append(0)
        where[i], offset[i] = k, fill[k]
        fill[k] += n
        if gap > n:
            open_at[gap - n].append(k)
            count[gap - n] += 1
    return where, offset


def _pack(capacity: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        where, offset = sum_of_squares(table.column("length").to_numpy(), capacity)
        base = TaskContext.get().partitionId() << 32
        out = table.append_column("sequence_id", pa.array(where + base)).append_column("offset", pa.array(offset))
        yield from out.to_batches(max_chunksize=50_000)
    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Add sequence_id and offset to a table with a ``length`` of 1 to ``capacity`` per row.

    Rows go to groups of about ``group_pieces`` by a hash and are packed there, longest
    first, so a rerun of a task gives the same places. Other columns stay.
    """
    full = pieces.filter(F.col("length") == capacity)
    short = pieces.filter(F.col("length") < capacity)
    n_groups = max(1, -(-short.count() // group_pieces))
    spread = F.xxhash64(*[c for c in ("doc_id", "piece") if c in pieces.columns] or ["length"])
    grouped = short.repartition(n_groups, spread).sortWithinPartitions(F.desc("length"), *[
        c for c in pieces.columns if c != "length"])
    schema = T.StructType([*pieces.schema, *[T.StructField(c, T.LongType()) for c in ("sequence_id", "offset")]])
    # Full pieces are sequences of their own, numbered below zero.
    alone = full.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn(
        "offset", F.lit(0).cast("long"))
    return grouped.mapInArrow(_pack(capacity), schema).unionByName(alone)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
                   group_pieces: int = GROUP_PIECES, added_tokens: bool = True) -> DataFrame:
    """Tokenize ``docs`` (doc_id, text) and pack them into sequences of at most ``capacity`` ids.

    A document is its ids and ``end_id``; null is empty. Ids are those of the tokenizer file
    with add_special_tokens=False and nothing else set, so an added token's literal in a text
    is its id; ``added_tokens=False`` reads it as ordinary text. Only documents beyond the
    capacity are cut. Every row is packed, repeated ids and texts too; other columns are
    ignored. Returns per piece doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    pieces = docs.select("doc_id", "text").mapInArrow(
        _pieces(tokenizer or vocabulary_path(), capacity, end_id, added_tokens), _PIECES_DDL)
    return pack(materialize(pieces, "pieces"), capacity, group_pieces)
