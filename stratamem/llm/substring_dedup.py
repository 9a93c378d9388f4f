"""Substring deduplication by content-defined chunks.

A gear rolling hash over the last bytes cuts a text wherever its top bits vanish and no
such place lies close before; cuts depend on nearby bytes only, so an insertion moves
no cut beyond its surroundings. Chunks with the digest of a chunk of another document
repeat, and runs of them are the repeated passages.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratamem.llm.batches import Texts, mix, ranges, slices, span_hashes
from stratamem.llm.joins import left_join_unique
from stratamem.operators.bounded import MAX_BROADCAST_ROWS
from stratamem.session import materialize

# The hash has 16 bits, so it sees the last 16 bytes; one place in 2^CUT_BITS is a cut.
CUT_BITS = 4
MIN_CHUNK = 16
MAX_CHUNK = 512
# A repeated passage has at least this many bytes in whole chunks.
MIN_RUN = 64
GEAR = mix(np.arange(256, dtype=np.uint64), 99).astype(np.uint16)


def gear(data: np.ndarray) -> np.ndarray:
    """h[i] = 2 h[i-1] + GEAR[data[i]] modulo 2^16, as sums over 2, 4, 8 and 16 bytes."""
    h = GEAR[data]
    for reach in (1, 2, 4, 8):
        if len(h) > reach:
            h[reach:] = h[reach:] + (h[:-reach] << np.uint16(reach))
    return h


def chunks(texts: Texts, max_chunk: int = MAX_CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every chunk, and each text's first chunk."""
    at = texts.at
    cut = np.flatnonzero(gear(texts.data) >> np.uint16(16 - CUT_BITS) == 0) + 1
    owner = np.searchsorted(at, cut, side="left") - 1
    # The hash must lie within the text, and no other place close before.
    inside = (cut - at[owner] >= MIN_CHUNK) & (cut < at[owner + 1])
    cut = cut[inside]
    far = np.ones(len(cut), bool)
    far[1:] = np.diff(cut) >= MIN_CHUNK
    start = np.union1d(at[:-1][at[1:] > at[:-1]], cut[far]).astype(np.int64)
    end = np.append(start[1:], len(texts.data))
    pieces = -(-(end - start) // max_chunk)
    nth = ranges(np.zeros(len(start), np.int64), pieces)
    start = np.repeat(start, pieces) + nth * max_chunk
    end = np.append(start[1:], len(texts.data))
    return start, end, np.searchsorted(start, at)


def _cut(max_chunk: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                texts = Texts(batch.column("text"))
                start, end, first = chunks(texts, max_chunk)
                digest = span_hashes(texts.data, start, end)
                # A second, independent half of the digest.
                check = mix(span_hashes(texts.data ^ np.uint8(0x5A), start, end), 12)
                count = np.diff(first)
                row = np.repeat(np.arange(texts.n), count)
                chars = texts.char_at()
                seen = np.ones(len(start), bool)
                order = np.lexsort((check, digest, row))
                a, b = order[:-1], order[1:]
                seen[b] = (row[a] != row[b]) | (digest[a] != digest[b]) | (check[a] != check[b])
                base = chars[texts.at[:-1]][row]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(pa.array(row)), batch.column("row").take(pa.array(row)),
                    pa.array((np.arange(len(row)) - first[row]).astype(np.int32)),
                    pa.array(digest.astype(np.int64)), pa.array(check.astype(np.int64)), pa.array(seen),
                    pa.array((chars[start] - base).astype(np.int64)), pa.array((chars[end] - chars[start]).astype(np.int64)),
                    pa.array((end - start).astype(np.int32))],
                    ["doc_id", "row", "nth", "digest", "check", "once", "start", "length", "size"])
    return run


_CHUNKS_DDL = ("doc_id long, row long, nth int, digest long, check long, once boolean, start long, length long, "
               "size int")


def repeated_passages(docs: DataFrame, min_run: int = MIN_RUN, max_chunk: int = MAX_CHUNK,
                      broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Runs of chunks of each text of ``docs`` (doc_id, text) that other documents hold too.

    A chunk repeats if two rows or more have its digest; runs of neighbouring repeated
    chunks with ``min_run`` bytes or more are passages. Repeats within one text alone do
    not count. Null and empty texts have no chunks; every row counts as a document,
    repeated ids too; an empty table gives an empty result; other columns are ignored.
    Returns one row per passage: doc_id, start and length in code points, n_chunks,
    n_docs (most documents that hold one of its chunks), first_doc_id (smallest id among
    those that hold its first chunk), and copy (another document, smaller by id, holds
    every chunk).
    """
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    pieces = materialize(rows.mapInArrow(_cut(max_chunk), _CHUNKS_DDL).withColumn(
        "digest", F.struct("digest", "check")).drop("check"), "chunks")
    held = pieces.groupBy("digest").agg(
        F.sum(F.col("once").cast("long")).alias("n_docs"), F.count(F.lit(1)).alias("places"),
        F.min("doc_id").alias("first_doc_id")).filter("n_docs > 1")
    held = materialize(held, "repeated-chunks")
    found = left_join_unique(pieces.drop("once"), held, "digest", "places", pieces.count(), broadcast_rows).filter(
        "n_docs IS NOT NULL")
    # Neighbours keep a constant distance between their number and their rank.
    rank = F.row_number().over(Window.partitionBy("row").orderBy("nth"))
    runs = found.withColumn("run", F.col("nth") - rank).groupBy("row", "run").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("length").alias("length"),
        F.count(F.lit(1)).alias("n_chunks"), F.sum("size").alias("size"), F.max("n_docs").alias("n_docs"),
        F.min(F.struct("nth", "first_doc_id"))["first_doc_id"].alias("first_doc_id"),
        F.min((F.col("first_doc_id") < F.col("doc_id")).cast("int")).alias("later"))
    return runs.filter(F.col("size") >= min_run).select(
        "doc_id", "start", "length", "n_chunks", "n_docs", "first_doc_id", (F.col("later") == 1).alias("copy"))
