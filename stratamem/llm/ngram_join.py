"""Self-join of documents on word shingles by Jaccard similarity, with PartEnum signatures.

Sets of similar size have a bounded Hamming distance when they are similar. The hash
domain is cut into partitions, each of those into finer ones, and every subset of a
fixed number of finer partitions gives one signature: two sets within the distance
share at least one. Sets that share a signature are compared exactly.

Before that, sets that no other can be similar to are set aside: those with too many
shingles that the corpus has nowhere else, counted over a part of the hash domain.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratamem.llm.batches import SPACE, Texts, as_list, mix, ranges, slices, span_hashes
from stratamem.llm.joins import components, left_join_unique, rows_of_keys, rows_without_keys
from stratamem.operators.bounded import MAX_BROADCAST_ROWS, broadcast_if_small
from stratamem.session import discard, materialize, settle

WIDTH = 4
PERCENT = 85
# Hashes that decide a signature, on average at least.
MIN_FEATURES = 4.0
# Share of sets that may have to emit signatures of empty partitions.
EMPTY_SHARE = 1e-5
# Rows (hash, set) a task holds before it combines those of one hash, and shingles whose sets are signed at a time.
HELD_ROWS = 1 << 18
# Cells of the hash domain, of all sets together, that are looked at at a time.
SIGNED_CELLS = 1 << 18
# Rows (hash, set) of one bucket, about, and at least so many where there are few.
BUCKET_ROWS = 1 << 19
LEAST_BUCKET_ROWS = 1 << 12
# Sampled shingles are looked at in up to so many parts of the hash domain, one after another, of so many bytes at least.
SAMPLE_PARTS = 4
SAMPLE_PART_BYTES = 1 << 25
# Bytes of shingles that are moved to their blocks at a time, at least; half of what all sets hold where that is more.
MOVED_BYTES = 1 << 28
# Bytes of text whose words are hashed at a time.
HASHED_BYTES = 1 << 17
# Sets, and shingles of all of them, that meet as many others at a time.
BLOCK_SETS = 2048
BLOCK_SHINGLES = 1 << 21
# Shingles of two blocks whose holders are found at a time.
PART_SHINGLES = 1 << 18
# Two sets that meet in a block cost about this part of two that meet as a row, which moves both sets' shingles.
BLOCK_PAIRS_PER_ROW = 64
U64 = np.uint64
_FACTORS = mix(np.arange(1, 65, dtype=U64), 77) | U64(1)


# -- Signatures ---------------------------------------------------------------------


class Plan(NamedTuple):
    """How the sets of one band and of the band below are cut."""
    instance: int
    outer: int
    inner: int
    chosen: np.ndarray  # subsets of the inner partitions, one row each
    spare: int


@lru_cache(maxsize=None)
def band_ends(percent: int, upto: int) -> tuple[int, ...]:
    """Largest set size of each band; a set's partners lie in its own and the next bands."""
    ends = [1]
    while ends[-1] < upto:
        ends.append(max(ends[-1] + 1, (ends[-1] + 1) * 100 // percent))
    return tuple(ends)


def _tail(n: int, p: float, k: int) -> float:
    return 1.0 - sum(math.comb(n, j) * p ** j * (1 - p) ** (n - j) for j in range(k + 1))


@lru_cache(maxsize=None)
def plan(percent: int, instance: int, low: int, high: int) -> Plan:
    """Partitions for sets of ``low`` to ``high`` shingles that may differ in ``most`` of them.

    Similarity s bounds the difference by (1-s)/(1+s) of both sizes together. With
    ``outer`` > most / (d+1) partitions, one has at most d differences, and one of its
    subsets of inner - d finer partitions has none. ``spare`` further partitions make up
    for those that say nothing because they are empty.
    """
    most = (100 - percent) * 2 * high // (100 + percent)
    best = None
    for d, inner in ((0, 1), (1, 2), (1, 3), (2, 4), (1, 4)):
        subsets = math.comb(inner, d)
        for spare in range(12):
            outer = most // (d + 1) + 1 + spare
            features = low / outer * (inner - d) / inner
            weak = min(1.0, subsets * math.exp(-features)) if outer * inner > 1 else 0.0
            if _tail(outer, weak, spare) < EMPTY_SHARE:
                break
        key = (features < MIN_FEATURES, -features if features < MIN_FEATURES else outer * subsets)
        if best is None or key < best[0]:
            best = key, d, inner, outer, spare
    _, d, inner, outer, spare = best
    return Plan(instance, outer, inner, np.array(list(combinations(range(inner), inner - d))), spare)


def signatures(grams: np.ndarray, percent: int) -> np.ndarray:
    """Signatures of one set of sorted, distinct hashes, for its band and the next."""
    return set_signatures(grams, np.array([0, len(grams)]), percent)[0]


def set_signatures(grams: np.ndarray, at: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of sets, and the number of the set of each; set i holds grams[at[i]:at[i+1]], sorted and distinct."""
    size = np.diff(at)
    ends = np.array(band_ends(percent, 4 << int(size.max(initial=1)).bit_length()))
    band = np.searchsorted(ends, size)
    sums = np.zeros(len(grams) + 1, U64)
    np.cumsum(mix(grams, 5), out=sums[1:])
    found, owners = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for instance in np.unique(np.concatenate([band, band + 1])).tolist():
        # Of the band below, those large enough for a set of this one.
        near = (band == instance - 1) & (size * 100 >= percent * (ends[instance - 1] + 1))
        who = np.flatnonzero((size > 0) & ((band == instance) | near))
        p = plan(percent, instance, int(ends[instance - 2]) + 1 if instance >= 2 else 1, int(ends[instance]))
        cells = p.outer * p.inner
        some = max(1, SIGNED_CELLS // (cells * len(p.chosen)))
        for part in (who[k:k + some] for k in range(0, len(who), some)):
            # Sorted hashes: every cell of the domain is a slice.
            place = ranges(at[part], size[part])
            cell = np.minimum(grams[place] // U64(((1 << 64) - 1) // cells), U64(cells - 1)).astype(np.int64)
            cell += np.repeat(np.arange(len(part)) * cells, size[part])
            filled = np.bincount(cell, minlength=len(part) * cells)
            edge = np.cumsum(filled) - filled
            edge += np.repeat(at[part] - np.cumsum(size[part]) + size[part], cells)
            value = (sums[edge + filled] - sums[edge]).reshape(len(part), p.outer, p.inner)
            filled = filled.reshape(value.shape)
            if p.inner > 1:
                value = (mix(value, 31) * _FACTORS[:p.inner])[:, :, p.chosen].sum(axis=3, dtype=U64)
                filled = filled[:, :, p.chosen].sum(axis=3)
            spot = np.arange(value[0].size, dtype=U64).reshape(value.shape[1:]) + U64(instance << 24)
            sig = mix(value ^ mix(spot, 13), 17)
            # Enough partitions without an empty subset: one of them is shared by any partner.
            empty = (filled == 0).any(axis=2).sum(axis=1) > p.spare
            kept = (filled > 0) | empty[:, None, None]
            found.append(sig[kept])
            owners.append(np.repeat(part, kept.sum(axis=(1, 2))))
    return np.concatenate(found), np.concatenate(owners)


# -- Sets ---------------------------------------------------------------------------


def shingle_sets(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hashes of all rows' texts; row i has those of [at[i], at[i+1]), sorted and distinct."""
    texts = Texts(batch.column("text"), lower=True)
    start, end, first = texts.spans(~SPACE)
    word = span_hashes(texts.data, start, end)
    grams = np.zeros(len(word), U64)
    full = max(len(word) - width + 1, 0)
    for k in range(width):
        grams[:full] += word[k:k + full] * _FACTORS[k]
    grams = mix(grams, width)
    n_words = np.diff(first)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            grams[a:b - width + 1].sort()
        elif b > a:
            whole = (word[a:b] * _FACTORS[8:8 + b - a]).sum(dtype=U64) + U64(b - a)
            grams[a] = mix(np.array([whole]), 3)[0]
    kept = np.ones(len(grams), bool)
    kept[1:] = grams[1:] != grams[:-1]
    kept[first[:-1][n_words > 0]] = True
    # No shingle starts at a text's last words, save the one of a text with fewer.
    for k in range(1, width):
        kept[first[1:][n_words > k] - k] = False
    return grams[kept], np.concatenate([np.zeros(1, np.int64), np.cumsum(kept)])[first]


def set_keys(grams: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit keys of every set."""
    keys = []
    for seed in (21, 22):
        sums = np.zeros(len(grams) + 1, U64)
        np.cumsum(mix(grams, seed), out=sums[1:])
        keys.append((sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(U64)).view(np.int64))
    return keys[0], keys[1]


def as_binary(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """Binary values: the i-th holds the bytes of values[at[i]:at[i+1]], 8 each."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [
        None, pa.py_buffer((at * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def of_binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """What as_binary was given, as 64-bit values; nulls are empty."""
    if not len(column):
        return np.zeros(0, U64), np.zeros(1, np.int64)
    column = pc.fill_null(column, b"").cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    if raw is None or at[0] == at[-1]:
        return np.zeros(0, U64), np.zeros(len(at), np.int64)
    return np.frombuffer(raw, U64, (at[-1] - at[0]) // 8, at[0]), (at - at[0]) // 8


def _describe(width: int, share: float) -> Callable:
    """Per row its set's size and keys, and the shingles of the lowest ``share`` of the hash domain.

    A task gives a set's shingles once.
    """
    top = U64(int(share * (1 << 64)) if share < 1 else (1 << 64) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for batch in slices(whole, limit=HASHED_BYTES):
                grams, at = shingle_sets(batch, width)
                key, check = set_keys(grams, at)
                fresh = np.zeros(len(key), bool)
                for k, value in enumerate(key.tolist()):
                    if value not in seen:
                        seen.add(value)
                        fresh[k] = True
                low = (grams < top) & np.repeat(fresh, np.diff(at))
                below = np.concatenate([np.zeros(1, np.int64), np.cumsum(low)])[at]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(np.diff(at)), pa.array(key), pa.array(check),
                     as_binary(grams[low], below)], ["doc_id", "n_shingles", "key", "check", "low"])
    return run


# Rows (hash, set) travel in buckets: a row holds those of a range of hashes that a task has, as two binary values.
_PACKED_DDL = "bucket long, hashes binary, sets binary, made boolean"


def _packed(value: np.ndarray, holder: np.ndarray | None, n_buckets: int, top: int, made: bool) -> pa.RecordBatch:
    """Rows of buckets, from hashes below ``top`` that ascend, and the set of each."""
    width = -(-top // n_buckets)
    edge = np.array([k * width for k in range(1, n_buckets) if k * width < top], U64)
    at = np.concatenate([[0], np.searchsorted(value, edge), [len(value)]])
    some = np.flatnonzero(np.diff(at))
    at = np.append(at[some], len(value))
    sets = as_binary(value[:0], at * 0) if holder is None else as_binary(holder, at)
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), as_binary(value, at), sets, pa.array(np.full(len(some), made))],
                                      ["bucket", "hashes", "sets", "made"])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes that ascend and their sets, bucket by bucket, from packed rows sorted by bucket."""
    def whole() -> tuple[np.ndarray, np.ndarray]:
        value, holder = (np.concatenate(c) for c in zip(*held))
        order = np.argsort(value, kind="stable")
        return value[order], holder[order] if len(holder) else holder

    held, last = [], None
    for batch in batches:
        bucket = batch.column("bucket").to_numpy()
        (value, at), (holder, _) = (of_binary(batch.column(c)) for c in ("hashes", "sets"))
        cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b > a:
                if held and bucket[a] != last:
                    yield whole()
                    held = []
                last = bucket[a]
                held.append((value[at[a]:at[b]], holder[at[a]:at[b]].view(np.int64)))
    if held:
        yield whole()


def _heads(value: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    return np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.zeros(0, np.int64)


def _sampled(n_buckets: int, share: float, part: int = 0, parts: int = 1) -> Callable:
    """Packed rows of the shingles that _describe gave, at most two sets of a shingle at a time.

    With ``parts`` those of one part of the sampled hash domain, counted from its start.
    """
    whole = int(share * (1 << 64)) if share < 1 else 1 << 64
    start = part * whole // parts
    top = (part + 1) * whole // parts - start

    def combine(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        gram, key = (np.concatenate(c) for c in zip(*held))
        order = np.argsort(gram, kind="stable")
        gram, key = gram[order], key[order]
        head = _heads(gram)
        least, most = np.minimum.reduceat(key, head), np.maximum.reduceat(key, head)
        n = np.where(least < most, 2, 1)
        pair = np.repeat(least, n)
        pair[np.cumsum(n) - 1] = most
        return _packed(np.repeat(gram[head], n), pair, n_buckets, top, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            grams, at = of_binary(batch.column("low"))
            key = batch.column("key").to_numpy()
            if parts > 1:
                inside = (grams >= U64(start)) & (grams <= U64(start + top - 1))
                at = np.concatenate([np.zeros(1, np.int64), np.cumsum(inside)])[at]
                grams = grams[inside] - U64(start)
            # Rows are taken until they hold enough.
            cuts = np.searchsorted(at, np.arange(0, at[-1] + HELD_ROWS, HELD_ROWS))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                b = min(b, len(key))
                if at[b] > at[a]:
                    held.append((grams[at[a]:at[b]], np.repeat(key[a:b], np.diff(at[a:b + 1]))))
                    n += len(held[-1][0])
                if n >= HELD_ROWS:
                    yield combine(held)
                    held, n = [], 0
        if n:
            yield combine(held)
    return run


def _alone(n_buckets: int) -> Callable:
    """Packed rows of sets, without a second value: a set's key once for each shingle that no other set has.

    They stay packed, so their number does not grow with the sets times the tasks.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone, held = [], 0
        for gram, key in _buckets(batches):
            head = _heads(gram)
            alone.append(key[head[np.minimum.reduceat(key, head) == np.maximum.reduceat(key, head)]].view(U64))
            held += len(alone[-1])
            if held > 4 * HELD_ROWS:
                yield _packed(np.sort(np.concatenate(alone)), None, n_buckets, 1 << 64, False)
                alone, held = [], 0
        if held:
            yield _packed(np.sort(np.concatenate(alone)), None, n_buckets, 1 << 64, False)
    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each set's key with how often it comes."""
    for key, _ in _buckets(batches):
        head = _heads(key)
        yield pa.RecordBatch.from_arrays([pa.array(key[head].view(np.int64)), pa.array(np.diff(np.append(head, len(key))))],
                                         ["key", "lone"])


def _sign(percent: int, n_buckets: int) -> Callable:
    """Packed rows (signature, set) of sets (id, grams).

    Of the sets that share a signature in what a task holds, only the first goes on under it;
    all of them are members (``made``) and dealt by a hash of the set. The first says by
    the lowest bit of its hash that it is one already.
    """
    top = 1 << 64

    def combine(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        sig, who = (np.concatenate(c) for c in zip(*held))
        sig &= ~U64(1)
        order = np.lexsort((who, sig))
        sig, who = sig[order], who[order]
        fresh = np.ones(len(sig), bool)
        fresh[1:] = (sig[1:] != sig[:-1]) | (who[1:] != who[:-1])
        sig, who = sig[fresh], who[fresh]
        head = _heads(sig)
        size = np.diff(np.append(head, len(sig)))
        yield _packed(sig[head] | (size > 1).astype(U64), who[head], n_buckets, top, False)
        several = np.repeat(size > 1, size)
        if several.any():
            spread = mix(who[several].view(U64) ^ sig[several], 41)
            order = np.argsort(spread)
            rows = _packed(spread[order], who[several][order], n_buckets, top, True)
            at = of_binary(rows.column("hashes"))[1]
            yield rows.set_column(1, "hashes", as_binary(sig[several][order], at))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            lists = batch.column("grams")
            at = lists.offsets.to_numpy().astype(np.int64)
            grams = lists.values.to_numpy().view(U64)
            ids = batch.column("id").to_numpy()
            a = 0
            while a < len(ids):
                b = max(a + 1, int(np.searchsorted(at, at[a] + HELD_ROWS, side="right")) - 1)
                sig, owner = set_signatures(grams[at[a]:at[b]], at[a:b + 1] - at[a], percent)
                held.append((sig, ids[a:b][owner]))
                n += len(sig)
                a = b
                if n >= HELD_ROWS:
                    yield from combine(held)
                    held, n = [], 0
        if n:
            yield from combine(held)
    return run


_MATCHED_DDL = "sig long, id long"


def _matched(sig: np.ndarray, who: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(sig), 1 << 17):
        yield pa.RecordBatch.from_arrays([pa.array(sig[at:at + (1 << 17)].view(np.int64)),
                                          pa.array(who[at:at + (1 << 17)].view(np.int64))], ["sig", "id"])


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of each group of two sets or more, each once, from packed rows sorted by bucket."""
    def firsts() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = batch.filter(batch.column("made"))
            if done.num_rows:
                members.append((of_binary(done.column("hashes"))[0], of_binary(done.column("sets"))[0]))
            yield batch.filter(pc.invert(batch.column("made")))

    members: list[tuple[np.ndarray, np.ndarray]] = []
    for value, who in _buckets(firsts()):
        while members:
            yield from _matched(*members.pop())
        sig = value & ~U64(1)
        head = _heads(sig)
        size = np.diff(np.append(head, len(sig)))
        new = np.repeat(size > 1, size) & (value == sig)
        yield from _matched(sig[new], who[new])
    while members:
        yield from _matched(*members.pop())


_SETS_DDL = "id long, doc_id long, key long, check long, grams array<long>"


def _sets(width: int) -> Callable:
    """Each row's set with an id of its own, random to the order of rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in slices(whole, limit=HASHED_BYTES):
                grams, at = shingle_sets(batch, width)
                key, check = set_keys(grams, at)
                ids = mix(np.arange(n, n + len(key), dtype=U64), 51).view(np.int64)
                n += len(key)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), batch.column("doc_id"), pa.array(key), pa.array(check),
                     as_list(pa.array(grams.view(np.int64)), np.diff(at))], ["id", "doc_id", "key", "check", "grams"])
    return run


# -- The join -----------------------------------------------------------------------


def _name() -> Column:
    """A class's name: both keys of its set, in an order that is random to its shape."""
    return F.concat(F.lpad(F.hex("key"), 16, "0"), F.lpad(F.hex("check"), 16, "0"))


def _fetch(docs: DataFrame, able: DataFrame, n: int, width: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """The classes with the id of a set, and sets (id, doc_id, key, check, grams) written where their texts lie.

    Each class has one of them; sets with other ids are of other rows and are left out by joins
    with the classes. No text or set is moved for it.
    """
    firsts = able.select(F.col("first_id").alias("_id")).distinct()
    texts = rows_of_keys(docs, "doc_id", firsts, n, limit).select("doc_id", "text")
    sets = materialize(texts.mapInArrow(_sets(width), _SETS_DDL), "sets")
    held = sets.select("id", "doc_id", _name().alias("name")).join(broadcast_if_small(able, n, limit), "name").filter(
        F.col("doc_id").eqNullSafe(F.col("first_id")))
    return held.groupBy("name", "n", "c", "weight", "first_id").agg(F.min("id").alias("id")), sets


def _dealt(packed: DataFrame) -> DataFrame:
    """Packed rows, each bucket in one task and sorted by bucket."""
    partitions = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return packed.repartition(partitions, "bucket").sortWithinPartitions("bucket")


def _n_buckets(spark: SparkSession, rows: float) -> int:
    """Buckets for so many rows: several per partition, none too large or without need small."""
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return int(max(min(16 * partitions, rows / LEAST_BUCKET_ROWS), rows / BUCKET_ROWS, 1))


def _sampled_share(percent: int) -> float:
    """A part of the hash domain that is large enough for a set with three fifths of its shingles alone in it to
    exceed what a link allows."""
    return min(1.0, (100 - percent) / 60)


def _lone(rows: DataFrame, percent: int) -> DataFrame:
    """Per set (key) how many shingles of a part of the hash domain no other set of the corpus has.

    Smallest and largest holder are kept per shingle in a task, so one that a third of the
    corpus holds is combined before it moves. Shingles move in parts of the hash domain, and
    a part's shuffle is gone before the next.
    """
    share = _sampled_share(percent)
    total = rows.agg(F.sum(F.length("low"))).first()[0] or 0
    parts = max(1, min(SAMPLE_PARTS, total // SAMPLE_PART_BYTES))
    n_buckets = _n_buckets(rows.sparkSession, total / 8 / parts)
    low = rows.filter(F.length("low") > 0).select("key", "low")
    alone = None
    for part in range(parts):
        packed = low.mapInArrow(_sampled(n_buckets, share, part, parts), _PACKED_DDL)
        found = materialize(_dealt(packed).mapInArrow(_alone(n_buckets), _PACKED_DDL), "alone")
        alone = found if alone is None else alone.unionByName(found)
    return _dealt(alone).mapInArrow(_counted, "key long, lone long")


def overlaps(grams: np.ndarray, sizes: np.ndarray, cut: int = 0) -> np.ndarray:
    """Common shingles of every two of several sets, whose shingles lie one after another.

    With ``cut`` only the first so many sets (rows) meet the others (columns). Counts add up
    over parts of the hash domain, so what is held beside the result stays small.
    """
    m = len(sizes)
    out = np.zeros((cut or m, m - cut), np.float32)
    ends, hashes = np.cumsum(sizes), grams.view(U64)
    n_parts = max(1, -(-len(grams) // PART_SHINGLES))
    for k in range(n_parts):
        inside = hashes >= U64(k * (1 << 64) // n_parts)
        if k + 1 < n_parts:
            inside &= hashes < U64((k + 1) * (1 << 64) // n_parts)
        at = np.flatnonzero(inside)
        del inside
        _add_overlaps(out, grams[at], np.searchsorted(ends, at, side="right"), m, cut)
    return out


def _add_overlaps(out: np.ndarray, grams: np.ndarray, owner: np.ndarray, m: int, cut: int) -> None:
    """Adds what the sets share of these shingles, given with the number of the set that holds each.

    Shingles of few holders are counted pair by pair, the others by a matrix product.
    """
    order = np.argsort(grams, kind="stable")
    value, owner = grams[order], owner[order]
    head = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.zeros(0, np.int64)
    holders = np.diff(np.append(head, len(value)))
    many = (holders > 1) & (holders * 32 > m)
    few = np.repeat((holders > 1) & ~many, holders)
    if few.any():
        who, column = owner[few], np.repeat(np.arange(len(holders)), holders)[few]
        for shift in range(1, int(holders[(holders > 1) & ~many].max())):
            same = column[shift:] == column[:-shift]
            left, right = who[:-shift][same], who[shift:][same]  # holders of a shingle ascend
            if cut:
                apart = (left < cut) & (right >= cut)
                left, right = left[apart], right[apart] - cut
            pair, n = np.unique(left * out.shape[1] + right, return_counts=True)
            out.ravel()[pair] += n
            if not cut:
                out[pair % m, pair // m] += n
    dense = np.repeat(many, holders)
    who, column = owner[dense], np.repeat(np.arange(int(many.sum())), holders[many])
    step = max(64, (1 << 22) // max(m, 1))
    for at in range(0, int(many.sum()), step):
        a, b = np.searchsorted(column, (at, at + step))
        part = np.zeros((m, int(column[b - 1]) - at + 1), np.float32)
        part[who[a:b], column[a:b] - at] = 1
        out += part[:cut or m] @ part[cut:].T


_MET = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("common", pa.int64()), ("links", pa.int64())])
_MET_DDL = "a long, b long, common long, links long"


def _meet(percent: int, listed: bool) -> Callable:
    """Compares all sets of a family's two blocks, from rows sorted by family and blocks.

    With ``listed`` every link becomes a row (a, b, common). Otherwise each set's linked
    documents are counted (a, links), and rows (a, b) join what links connect.
    """
    def group(family: list[tuple], two: bool) -> Iterator[pa.RecordBatch]:
        family.sort(key=lambda r: r[:2])
        block, ids, weight, sizes = (np.array(c, np.int64) for c in zip(*[(*r[:3], len(r[3])) for r in family]))
        m = len(ids)
        # Sets of one block meet where the block meets itself.
        cut = int(np.searchsorted(block, block[0], side="right")) if two else 0
        if cut == m:
            return
        grams = np.concatenate([r[3] for r in family])
        family.clear()  # the caller goes on with another
        common = overlaps(grams, sizes, cut)
        del grams
        parts = [slice(at, at + 256) for at in range(0, len(common), 256)]
        link = np.zeros(common.shape, bool)
        for part in parts:
            both = common[part].astype(np.int64)
            link[part] = both * 100 >= percent * (sizes[:len(common)][part, None] + sizes[cut:] - both)
        if not two:
            np.fill_diagonal(link, False)
        if listed:
            for part in parts:
                i, j = np.nonzero(link[part] if two else np.triu(link[part], part.start + 1))
                if len(i):
                    one, other = ids[i + part.start], ids[j + cut]
                    yield rows(np.minimum(one, other), np.maximum(one, other),
                               common[i + part.start, j].astype(np.int64), None)
            return
        if not link.any():
            return
        rows_of, columns_of = slice(0, len(common)), slice(cut, m)
        label = np.arange(m)
        while True:
            new = label.copy()
            for part in parts:
                held = np.where(link[part], label[columns_of], m).min(axis=1)
                new[rows_of][part] = np.minimum(new[rows_of][part], held)
                held = np.where(link[part], label[rows_of][part, None], m).min(axis=0)
                new[columns_of] = np.minimum(new[columns_of], held)
            new = new[new]
            if (new == label).all():
                break
            label = new
        count = np.zeros(m, np.int64)
        for part in parts:
            count[rows_of][part] += np.where(link[part], weight[columns_of], 0).sum(axis=1)
            if two:
                count[columns_of] += np.where(link[part], weight[rows_of][part, None], 0).sum(axis=0)
        linked = np.flatnonzero(count)
        yield rows(ids[linked], None, None, count[linked])
        away = np.flatnonzero(label != np.arange(m))
        yield rows(ids[label[away]], ids[away], None, None)

    def rows(*columns) -> pa.RecordBatch:
        n = len(columns[0])
        return pa.RecordBatch.from_arrays([pa.nulls(n, f.type) if c is None else pa.array(c, f.type)
                                           for c, f in zip(columns, _MET)], schema=_MET)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, at, made, n = [], None, [], 0
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("family", "low", "high", "block", "id", "weight")))
            for k, (name, low, high, *row) in enumerate(keys):
                if (name, low, high) != at:
                    if len(family) > 1:
                        for found in group(family, at[1] != at[2]):
                            made.append(found)
                            n += found.num_rows
                    family, at = [], (name, low, high)
                    if n > 50_000:
                        yield from pa.Table.from_batches(made).combine_chunks().to_batches()
                        made, n = [], 0
                family.append((*row, batch.column("grams")[k].values.to_numpy().copy()))
        if len(family) > 1:
            made += group(family, at[1] != at[2])
        if made:
            yield from pa.Table.from_batches(made).combine_chunks().to_batches()
    return run


def _fits(common: Column, total: Column, percent: int) -> Column:
    """Whether sets of so many shingles together can link if they share at most so many."""
    return common * 100 >= (total - common) * percent


def _blocks(sets: Column, shingles: Column) -> Column:
    return F.greatest(F.ceil(sets / BLOCK_SETS), F.ceil(shingles / BLOCK_SHINGLES), F.lit(1)).cast("int")


def _in_blocks(rows: DataFrame, sets: Column, shingles: Column) -> DataFrame:
    """Each row once per other block of its key, so that a key's blocks meet two by two."""
    blocks = _blocks(sets, shingles)
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    placed = rows.withColumn("_blocks", blocks).withColumn(
        "block", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int")).withColumn("_other", other)
    return placed.withColumn("low", F.least("block", "_other")).withColumn("high", F.greatest("block", "_other")).drop(
        "_blocks", "_other")


def _verify(sets: DataFrame, pairs: DataFrame, percent: int, label: str) -> DataFrame:
    """The pairs (a, b, common) of classes whose sets are similar enough, by exact overlap."""
    sides = [sets.select(F.col("id").alias(c), F.col("grams").alias(f"{c}_grams")) for c in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b").select(
        "a", "b", (F.size("a_grams") + F.size("b_grams")).alias("total"),
        F.size(F.array_intersect("a_grams", "b_grams")).cast("long").alias("common"))
    return materialize(both.filter(F.col("common") * 100 >= percent * (F.col("total") - F.col("common"))).select(
        "a", "b", "common"), label)


def _met(sets: DataFrame, node: DataFrame, n_nodes: int, size: DataFrame, percent: int, listed: bool,
         limit: int) -> DataFrame:
    """What _meet returns for the families that are compared as a whole.

    Blocks meet in rounds that move a bounded part of what the sets hold, and whose members
    (``node``) are few enough to be broadcast unless there are over 16 times as many.
    """
    spark = sets.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    moved, held = size.filter("whole").agg(F.sum(F.col("shingles") * _blocks(F.col("members"), F.col("shingles"))),
                                           F.sum("shingles")).first()
    slices_of = min(16, -(-n_nodes // limit))
    rounds = max(1, -(-8 * (moved or 0) // (slices_of * max(MOVED_BYTES, 4 * (held or 0)))))
    found = None
    for part in range(slices_of):
        own, n_own = node.filter("whole"), n_nodes
        if slices_of > 1:
            own = materialize(own.filter(F.pmod(F.xxhash64("family"), F.lit(slices_of)) == part), "own-members")
            n_own = own.count()
        # Where members are too many to be broadcast, only their sets move to meet them.
        near = rows_of_keys(sets.select("id", "grams"), "id", own.select(F.col("id").alias("_id")), n_own, limit) \
            if n_own > limit else sets.select("id", "grams")
        placed = _in_blocks(near.join(broadcast_if_small(own, n_own, limit), "id"), F.col("members"), F.col("shingles"))
        for turn in range(rounds):
            rows = placed.filter(F.pmod(F.xxhash64("family", "low", "high", F.lit(7)), F.lit(rounds)) == turn)
            met = materialize(rows.select("family", "low", "high", "block", "id", "weight", "grams").repartition(
                partitions, "family", "low", "high").sortWithinPartitions("family", "low", "high").mapInArrow(
                _meet(percent, listed), _MET_DDL), "met")
            found = met if found is None else found.unionByName(met)
    return found


def _compared(sets: DataFrame, grouped: DataFrame, classes: DataFrame, percent: int, listed: bool,
              limit: int = MAX_BROADCAST_ROWS) -> DataFrame | None:
    """What _meet returns, for every two classes that share a signature (sig, id).

    Groups with the same sets count once. Groups that share sets form a family; a family
    is compared as a whole, block by block, where that costs less than the pairs of its
    groups as rows would.
    """
    print_of = [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"_{k}") for k in (1, 2)]
    once = grouped.groupBy("sig").agg(F.count(F.lit(1)).alias("_0"), F.min("id").alias("first"), *print_of)
    once = once.groupBy("_0", "_1", "_2").agg(F.min("sig").alias("sig"), F.min("first").alias("first")).select(
        "sig", "first", F.col("_0").alias("members"))
    groups = materialize(grouped.join(once, "sig"), "groups")
    ties = materialize(groups.filter("id <> first").select(
        F.col("first").alias("a"), F.col("id").alias("b")).distinct(), "ties")
    families = components(ties, "families")
    if families is None:
        return None
    families = families.select(F.col("node").alias("id"), F.col("component").alias("family"))
    apart = groups.filter("id = first").join(families, "id").groupBy("family").agg(
        F.sum(F.col("members") * (F.col("members") - 1) / 2).alias("apart"))
    nodes = families.join(classes.select("id", "n", "c", "weight"), "id")
    size = nodes.groupBy("family").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles"))
    size = materialize(size.join(apart, "family").withColumn(
        "whole", F.col("members") * (F.col("members") - 1) / 2 <= F.col("apart") * BLOCK_PAIRS_PER_ROW), "family-sizes")
    n_families = size.count()
    node = materialize(nodes.join(broadcast_if_small(size, n_families), "family"), "family-members")
    n_nodes = node.count()
    met = _met(sets, node, n_nodes, size, percent, listed, limit)
    if size.filter("NOT whole").isEmpty():
        return met
    loose = groups.join(broadcast_if_small(node.filter("NOT whole").select("id", "n", "c"), n_nodes), "id")
    placed = materialize(_in_blocks(loose, F.col("members"), F.lit(0)), "loose")
    left, right = (placed.select("sig", "low", "high", *[F.col(c).alias(f"{s}_{c}") for c in ("id", "n", "c", "block")])
                   for s in "ab")
    apart = (F.col("low") == F.col("high")) | (F.col("a_block") != F.col("b_block"))
    pairs = left.join(right, ["sig", "low", "high"]).filter(
        (F.col("a_id") < F.col("b_id")) & apart & _fits(F.least("a_c", "b_c"), F.col("a_n") + F.col("b_n"), percent))
    pairs = materialize(pairs.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).distinct(), "pairs")
    links = _verify(sets, pairs, percent, "links")
    none = F.lit(None).cast("long")
    if listed:
        return met.unionByName(links.withColumn("links", none))
    weight = classes.select("id", "weight")
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counted = both.join(weight.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.sum("weight").alias("links"))
    return met.unionByName(links.withColumn("common", none).withColumn("links", none)).unionByName(counted.select(
        "a", none.alias("b"), none.alias("common"), "links"))


def _candidates(docs: DataFrame, width: int, percent: int, broadcast_rows: int, listed: bool
                ) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """The rows with their sets, the classes of equal sets, those that can link, and what _compared returns for these."""
    described = materialize(docs.mapInArrow(
        _describe(width, _sampled_share(percent)),
        "doc_id long, n_shingles long, key long, check long, low binary").select(
            "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("key")).alias("key"), _name().alias("name"),
            "low"), "described")
    rows = materialize(described.drop("low"), "shingled")
    lone = settle(lambda: _lone(described, percent), "lone")
    discard(described)
    classes = materialize(rows.filter("n_shingles > 0").groupBy("name", "key").agg(
        F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("class_size"),
        F.first("n_shingles").alias("n_shingles")), "classes")
    # Classes with too many shingles of their own link with none.
    able = classes.join(lone, "key", "left").withColumn("lone", F.coalesce("lone", F.lit(0))).filter(
        F.col("lone") * 100 <= (100 - percent) * F.col("n_shingles"))
    able = materialize(able.select("name", F.col("n_shingles").alias("n"), (F.col("n_shingles") - F.col(
        "lone")).alias("c"), F.col("class_size").alias("weight"), "first_id"), "able")
    n_able, shingles = able.agg(F.count(F.lit(1)), F.sum("n")).first()
    # Short ids go from step to step instead of names.
    named, sets = _fetch(docs, able, n_able, width, broadcast_rows)
    able = materialize(named, "able-sets")
    # A set has about as many signatures as shingles, or fewer.
    signed = sets.select("id", "grams").mapInArrow(
        _sign(percent, _n_buckets(docs.sparkSession, shingles or 0)), _PACKED_DDL)
    grouped = materialize(_dealt(signed).mapInArrow(_match, _MATCHED_DDL).join(
        broadcast_if_small(able.select("id"), n_able, broadcast_rows), "id", "left_semi"), "members")
    met = _compared(sets, grouped, able, percent, listed, broadcast_rows)
    discard(sets, grouped)
    return rows, classes, able, met


def _linked(docs: DataFrame, width: int, percent: int, broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """What similar_documents returns, with the names of each row's set and component."""
    docs = docs.select("doc_id", "text")
    rows, classes, able, met = _candidates(docs, width, percent, broadcast_rows, listed=False)
    named_classes = classes.select("name", "first_id", "class_size")
    joined = None
    if met is not None:
        joined = components(materialize(met.filter("b IS NOT NULL").select("a", "b"), "connections"))
    if joined is not None:
        n_edges = joined.count()
        counts = met.filter("links IS NOT NULL").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
        found = joined.withColumnRenamed("node", "id").join(counts, "id", "left").join(able.select("id", "name"), "id")
        linked = named_classes.join(broadcast_if_small(found.drop("id"), n_edges, broadcast_rows), "name", "left").withColumn(
            "component", F.coalesce(F.col("component").cast("string"), "name"))
        smallest = linked.groupBy("component").agg(F.min("first_id").alias("component_id"),
                                                   F.count(F.lit(1)).alias("classes"))
        small = broadcast_if_small(smallest.filter("classes > 1"), n_edges, broadcast_rows)
        named_classes = linked.join(small, "component", "left").select(
            "name", "component", F.coalesce("component_id", "first_id").alias("component_id"), "class_size",
            F.coalesce("classes", F.lit(1)).alias("classes"), F.coalesce("links", F.lit(0)).alias("links"))
    else:
        named_classes = named_classes.select("name", F.col("name").alias("component"),
                                             F.col("first_id").alias("component_id"), "class_size",
                                             F.lit(1).cast("long").alias("classes"), F.lit(0).cast("long").alias("links"))
    # Documents alone in class and component need no join.
    many = materialize(named_classes.filter("class_size > 1 OR classes > 1").drop("classes"), "components-of-classes")
    out = left_join_unique(rows, many, "name", "class_size", rows.count(), broadcast_rows)
    return out.select(
        "doc_id", "n_shingles", F.when(F.col("class_size").isNull(), F.col("doc_id")).otherwise(
            F.col("component_id")).alias("component_id"),
        F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"),
        F.coalesce(F.col("links") + F.col("class_size") - 1, F.lit(0).cast("long")).alias("n_links"), "name",
        F.when(F.col("n_shingles") > 0, F.coalesce("component", "name")).alias("component"))


def similar_pairs(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT,
                  broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Every link between classes of equal sets, as ``similar_documents`` defines both.

    Each pair of classes comes once. Returns a_id and b_id (smallest id of each class),
    a_size and b_size (rows of each class), and common (shingles in both).
    """
    docs = docs.select("doc_id", "text")
    _, _, able, met = _candidates(docs, width, percent, broadcast_rows, listed=True)
    sides = [able.select(F.col("id").alias(c), F.col("first_id").alias(f"{c}_id"),
                         F.col("weight").alias(f"{c}_size")) for c in "ab"]
    if met is None:
        return sides[0].join(sides[1], F.lit(False)).select(
            "a_id", "b_id", "a_size", "b_size", F.lit(None).cast("long").alias("common"))
    return met.join(sides[0], "a").join(sides[1], "b").select("a_id", "b_id", "a_size", "b_size", "common")


def similar_documents(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT,
                      broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Components of documents linked by the Jaccard similarity of their shingles.

    ``docs`` has doc_id and text; other columns are ignored. A set holds the distinct
    shingles of ``width`` words, A-Z lower-cased; shorter texts are one shingle, and texts
    without words (null too) are linked with nothing. Sets link at ``percent`` or more.
    Shingles and sets are told apart by 64 and 128 bits of hash. Equal sets form a class;
    every pair of classes with a common signature is compared. Every row gives one row,
    repeated ones too, and an empty table an empty result. Returns doc_id, n_shingles,
    component_id (smallest id reachable by links), class_size and n_links (other rows
    linked with this one, those of its class too).
    """
    return _linked(docs, width, percent, broadcast_rows).drop("name", "component")


def _named(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                keys = set_keys(*shingle_sets(batch, width))
                names = ["".join(f"{k & (1 << 64) - 1:016X}" for k in pair) for pair in zip(*(k.tolist() for k in keys))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names)], [*batch.schema.names, "_name"])
    return run


def drop_similar(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT,
                 broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of every component one with the smallest id.

    Texts without words are linked with nothing and stay. Ids decide where they are not
    repeated; rows of repeated ids are told apart by their shingle sets.
    """
    found = settle(lambda: _linked(docs, width, percent, broadcast_rows), "linked")
    twice = materialize(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        F.col("doc_id").alias("_id")), "repeated-ids")
    gone = materialize(found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(
        F.col("doc_id").alias("_id")), "near-copies")
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    ids = broadcast_if_small(twice, twice.count())
    # A repeated id goes its own way below, whatever its rows.
    away = materialize(gone.unionByName(twice).distinct(), "away")
    left = rows_without_keys(docs, "doc_id", away, away.count(), broadcast_rows)
    if twice.isEmpty():
        return left
    again = docs.join(ids, same, "left_semi")
    named = again.mapInArrow(_named(width), T.StructType([*docs.schema, T.StructField("_name", T.StringType())]))
    # The first row of each component that repeated ids alone could keep.
    stays = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "name")).alias("first"))
    stays = stays.filter("component IS NOT NULL").select(F.col("first.doc_id").alias("_id"),
                                                         F.col("first.name").alias("_first"))
    stays = stays.join(ids, "_id", "left_semi").unionByName(stays.filter("_id IS NULL"))
    kept = named.join(stays, same & (F.col("_name") == F.col("_first")))
    nth = F.row_number().over(Window.partitionBy("_name").orderBy(F.xxhash64(*docs.columns)))
    once = kept.withColumn("_nth", nth).filter("_nth = 1").select(docs.columns)
    empty = ~F.coalesce(F.rlike("text", F.lit("[^ \\t-\\r]")), F.lit(False))
    return left.unionByName(once).unionByName(again.filter(empty))
