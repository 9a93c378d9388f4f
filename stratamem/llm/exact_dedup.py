"""Exact deduplication by Grace hashing.

Records are partitioned by a hash of their content; every bucket is read into an
open-addressing table that compares complete contents. A bucket that outgrows its
table passes the records that found no place on to a spill table in the shared
folder, which is partitioned anew by the next level's hash, until nothing is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratamem.llm.batches import LOWER, slices
from stratamem.llm.joins import left_join_unique, rows_without_keys
from stratamem.operators.bounded import MAX_BROADCAST_ROWS, broadcast_if_small
from stratamem.session import materialize, settle

TABLE_BYTES = 32 << 20
OUT_BYTES = 4 << 20
MAX_LEVELS = 16

_PARTIAL = pa.schema([("digest", pa.binary()), ("content", pa.binary()), ("keep_id", pa.int64()),
                      ("copies", pa.int64()), ("spilled", pa.bool_())])
_PARTIAL_DDL = "digest binary, content binary, keep_id long, copies long, spilled boolean"


def normalise(text: bytes) -> bytes:
    return text.translate(LOWER.tobytes())


class ContentTable:
    """Open addressing with linear probing; equal means that all bytes are equal."""

    def __init__(self, limit: int):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.slots = np.full(1024, -1, np.int64)
        self.entries: list[list] = []
        self.bytes = 0

    def _slot(self, digest: bytes, content: bytes) -> int:
        mask = len(self.slots) - 1
        at = int.from_bytes(digest[:8], "little") & mask
        while (entry := self.slots[at]) >= 0:
            have = self.entries[entry]
            if have[0] == digest:
                if have[1] != content:
                    raise ValueError(f"different texts with the digest {digest.hex()}")
                return at
            at = (at + 1) & mask
        return at

    def add(self, digest: bytes, content: bytes, keep_id: int | None, copies: int) -> bool:
        """Count a record in; False if it is new and the table is full."""
        at = self._slot(digest, content)
        entry = self.slots[at]
        if entry >= 0:
            have = self.entries[entry]
            if keep_id is not None and (have[2] is None or keep_id > have[2]):
                have[2] = keep_id
            have[3] += copies
            return True
        if self.entries and self.bytes + len(content) > self.limit:
            return False
        self.slots[at] = len(self.entries)
        self.entries.append([digest, content, keep_id, copies])
        self.bytes += len(content)
        if 2 * len(self.entries) > len(self.slots):
            self._grow()
        return True

    def _grow(self) -> None:
        self.slots = np.full(2 * len(self.slots), -1, np.int64)
        mask = len(self.slots) - 1
        for i, (digest, *_) in enumerate(self.entries):
            at = int.from_bytes(digest[:8], "little") & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = i


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Record batches of about OUT_BYTES of content each."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[1] or b"") + 64
        if size > OUT_BYTES:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*held), _PARTIAL)], schema=_PARTIAL)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*held), _PARTIAL)], schema=_PARTIAL)


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    for text in batch.column("text").cast(pa.binary()):
        yield normalise(text.as_py() or b"")


def _gather(limit: int) -> Callable:
    """Per task: equal records of the task become one, so that no group travels copy by copy."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            table = ContentTable(limit)
            for batch in (part for whole in batches for part in slices(whole)):
                for doc_id, content in zip(batch.column("doc_id").to_pylist(), _texts(batch)):
                    digest = hashlib.sha256(content).digest()
                    if not table.add(digest, content, doc_id, 1):
                        yield from ((*e, False) for e in table.entries)
                        table.clear()
                        table.add(digest, content, doc_id, 1)
            yield from ((*e, False) for e in table.entries)
        return _batches(rows())
    return run


def _bucket(limit: int) -> Callable:
    """Per bucket: groups the table could hold, and the other records as they came."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            table = ContentTable(limit)
            for batch in (part for whole in batches for part in slices(whole, "content")):
                for row in zip(*(batch.column(c).to_pylist() for c in ("digest", "content", "keep_id", "copies"))):
                    if not table.add(*row):
                        yield (*row, True)
            # A group that the table holds is whole: its records never met a full table.
            yield from ((digest, None, keep_id, copies, False) for digest, _, keep_id, copies in table.entries)
        return _batches(rows())
    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [hashlib.sha256(t).digest() for t in _texts(batch)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], ["doc_id", "digest"])


def groups(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per distinct normalised text: digest, keep_id (largest doc_id), copies."""
    records = docs.select("doc_id", "text").mapInArrow(_gather(table_bytes), _PARTIAL_DDL)
    found = None
    for level in range(MAX_LEVELS):
        partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        bucketed = records.repartition(partitions, F.xxhash64("digest", F.lit(level)))
        done = materialize(bucketed.mapInArrow(_bucket(table_bytes), _PARTIAL_DDL), f"grace-{level}")
        fitted = done.filter("NOT spilled").select("digest", "keep_id", "copies")
        found = fitted if found is None else found.unionByName(fitted)
        records = done.filter("spilled")
        if records.isEmpty():
            return found
    raise RuntimeError(f"buckets still exceed {table_bytes} bytes after {MAX_LEVELS} levels")


def exact_duplicates(docs: DataFrame, table_bytes: int = TABLE_BYTES,
                     broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Decide for every row of ``docs`` (doc_id, text) which copy of its text stays.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of
    equal texts the row with the largest doc_id stays, null ids being the smallest; of
    rows that share id and text one stays. An empty table gives an empty result; other
    columns are ignored. Returns doc_id, keep_id, group_size, kept, text_sha256.
    """
    rows = materialize(
        docs.select("doc_id", "text").mapInArrow(_digests, "doc_id long, digest binary"), "digests")
    many = materialize(groups(docs, table_bytes).filter("copies > 1"), "copy-groups")
    keep = F.when(F.col("copies").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    out = left_join_unique(rows, many, "digest", "copies", rows.count(), broadcast_rows).select(
        "doc_id", keep.alias("keep_id"), F.coalesce("copies", F.lit(1)).alias("group_size"), "digest")
    stays = out.filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    # Rows that share id and text: the first of them stays.
    nth = F.row_number().over(Window.partitionBy("digest", "doc_id").orderBy("group_size"))
    columns = ("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
    return stays.withColumn("kept", nth == 1).select(*columns).unionByName(
        out.filter(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).withColumn("kept", F.lit(False)).select(*columns))


def _with_digest(names: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hashlib.sha256(t).hexdigest() for t in _texts(batch)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*names, "_sha256"])
    return run


def drop_copies(docs: DataFrame, table_bytes: int = TABLE_BYTES, broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Ids decide where they are not repeated, so texts are not moved again; rows of repeated
    ids are told apart by their digests.
    """
    found = settle(lambda: exact_duplicates(docs, table_bytes, broadcast_rows), "copies")
    twice = materialize(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        F.col("doc_id").alias("_id")), "repeated-ids")
    gone = found.filter("NOT kept").select(F.col("doc_id").alias("_id"))
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    n_twice = twice.count()
    away = materialize(gone.unionByName(twice).distinct(), "exact-copies")
    left = rows_without_keys(docs, "doc_id", away, away.count(), broadcast_rows)
    if not n_twice:
        return left
    ids = broadcast_if_small(twice, n_twice)
    again = docs.join(ids, same, "left_semi")
    marked = again.mapInArrow(_with_digest(docs.columns), T.StructType([*docs.schema, T.StructField("_sha256", T.StringType())]))
    kept = found.filter("kept").join(ids, same, "left_semi").select(
        F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_kept"))
    rows = marked.join(kept, same & (F.col("_sha256") == F.col("_kept")))
    nth = F.row_number().over(Window.partitionBy("_sha256").orderBy(F.xxhash64(*docs.columns)))
    return left.unionByName(rows.withColumn("_nth", nth).filter("_nth = 1").select(*docs.columns))
