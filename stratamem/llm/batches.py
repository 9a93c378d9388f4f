"""Whole texts of an Arrow batch as one byte array, with words and hashes as arrays.

Every function works on UTF-8 bytes and on all texts of a slice at once, so no
per-row string is built. Hashes are 64-bit; a word's hash depends on its bytes only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# A slice of a batch holds about this many bytes of text, or one longer text.
SLICE_BYTES = 1 << 19
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
# Words of letters and digits: 0-9, A-Z, a-z and every byte beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

U64 = np.uint64
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values, different for each seed."""
    x = x + U64((seed * 2 + 1) * _ODD & _MASK)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE_VALUE = mix(np.arange(256, dtype=U64), 11)
_BASE = 0xD6E8FEB86659FD93
_powers = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``n`` of them."""
    for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
        while len(_powers[k]) < n:
            have = _powers[k]
            _powers[k] = np.concatenate([have, have * U64(pow(base, len(have), 1 << 64))])
    return _powers[0], _powers[1]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end) of a byte array, equal for equal contents."""
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE_VALUE[data] * up[:len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U64))


def sequence_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of runs of 64-bit values, order included; empty runs share one hash."""
    up, down = _power_tables(len(values) + 1)
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(mix(values, seed + 1) * up[:len(values)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U64), seed + 2)


class Texts:
    """A slice of texts: ``data`` holds their bytes, text i lies at [at[i], at[i+1])."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        base, last = int(offsets[0]), int(offsets[-1])
        data = np.frombuffer(raw, np.uint8)[base:last] if raw is not None and last > base else np.zeros(0, np.uint8)
        self.data = LOWER[data] if lower else data
        self.at = offsets - base
        self.n = len(texts)

    def spans(self, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of bytes of a kind within a text: start, end, and the first run of each text."""
        if not len(self.data):
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(self.n + 1, np.int64)
        inside = kind[self.data]
        # A byte starts a run if it is inside and the byte before is not, or lies in another text.
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        after = np.zeros(len(inside) + 1, bool)
        after[1:] = inside
        after[1:-1] &= ~inside[1:]
        heads = self.at[:-1][self.at[:-1] < self.at[1:]]
        first[heads] = inside[heads]
        after[heads[heads > 0]] = inside[heads[heads > 0] - 1]
        start = np.flatnonzero(first)
        return start, np.flatnonzero(after), np.searchsorted(start, self.at)

    def char_at(self) -> np.ndarray:
        """For every byte position (and the end), how many code points of the slice start before it."""
        out = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=out[1:])
        return out


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``limit`` bytes of text (or one text)."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), np.int64)
    part = np.cumsum(size) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Concatenation of start[i], start[i]+1, ... with count[i] values each."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    skip = np.repeat(np.cumsum(count) - count, count)
    return np.arange(total, dtype=np.int64) - skip + np.repeat(start, count)


def as_list(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    """A list array whose i-th list takes the next counts[i] values."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)
