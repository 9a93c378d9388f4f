"""Splitting texts into chunks."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from stratamem import constants as K
from stratamem import schema
from stratamem.functions import text as text_fn

CHUNKS = T.ArrayType(schema.CHUNK)
CHUNKS_ARROW = to_arrow_type(CHUNKS)
SLICE_BYTES = 1 << 20


def char_windows(docs: DataFrame, content: str, keep: Sequence[str],
                 size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP) -> DataFrame:
    """One row per fixed character window, cut inside the JVM; the last one reaches the end.

    The text is cut once into pieces of one step, and a window is the first ``size``
    characters of a few neighbouring pieces. Taking substrings of the text instead
    would walk it from the start for every window.
    """
    step = max(1, size - overlap)
    span = -(-size // step)
    pieces = F.regexp_extract_all(F.col(content), F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    extra = F.greatest(F.ceil((F.char_length(content) - size) / step), F.lit(0)).cast("int")
    windows = F.transform(F.sequence(F.lit(0), F.col("_extra")), lambda i: F.substring(
        F.array_join(F.slice("_pieces", i + 1, F.lit(span)), ""), 1, size))
    return (docs.select(*keep, pieces.alias("_pieces"), extra.alias("_extra"))
            .select(*keep, (F.col("_extra") + 1).alias("chunk_total"),
                    F.posexplode(windows).alias("chunk_index", "chunk_text"))
            .filter(F.col("chunk_text") != "")
            .select(*keep, "chunk_index", "chunk_total", (F.col("chunk_index") * step).alias("start_pos"),
                    "chunk_text"))


def split_recursively(text: str, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP,
                      separators: Sequence[str] = K.SEPARATORS) -> list[tuple[str, int, int]]:
    """Chunks of one text as (text, start, end), split at the coarsest separator.

    A chunk is a run of pieces, found by bisection over the piece ends rather than
    by joining strings. Every chunk after the first opens with the tail of the one
    before it and may therefore run over ``size``. A lone oversized piece is split
    by the finer separators. Positions count separators and pieces as they are
    consumed; after an overlap they are estimates.
    """
    return _pieces(text, tuple(separators), 0, size, overlap) if text.strip() else []


def _fixed_windows(text: str, origin: int, size: int, overlap: int) -> list[tuple[str, int, int]]:
    step = max(1, size - overlap)
    last = max(0, -(-(len(text) - size) // step))
    return [(text[n * step:n * step + size], origin + n * step,
             origin + min(n * step + size, len(text))) for n in range(last + 1)]


def _pieces(text: str, separators: tuple[str, ...], origin: int, size: int,
            overlap: int) -> list[tuple[str, int, int]]:
    if len(text) <= size:
        return [(text, origin, origin + len(text))]
    usable = [n for n, s in enumerate(separators) if s in text]
    if not usable or not separators[usable[0]]:
        return _fixed_windows(text, origin, size, overlap)
    sep, finer = separators[usable[0]], separators[usable[0] + 1:]
    gap = len(sep)
    lengths = [len(piece) for piece in text.split(sep)]
    ends = list(accumulate(lengths, lambda end, n: end + gap + n))
    final = len(ends) - 1

    chunks: list[tuple[str, int, int]] = []
    at, first, lead, carried = origin, 0, "", False
    while first <= final:
        opening, taken = ends[first] - lengths[first], 1
        if not lead and not lengths[first]:
            carried = False
        elif carried or lengths[first] <= size or not finer:
            reach = bisect_right(ends, opening + size - len(lead), lo=first)
            taken = max(reach - first, 1)
            body = lead + text[opening:ends[first + taken - 1]]
            at += gap * (min(first + taken, final) - first)
            chunks.append((body, at, at + len(body)))
            tail = body[-overlap:] if overlap else ""
            lead, carried = tail and tail + sep, True
            if first + taken <= final:
                at += len(tail and sep) + lengths[first + taken]
            first += taken
            continue
        else:
            inner = _pieces(text[opening:ends[first]], finer, at, size, overlap)
            chunks += inner
            # A piece made of finer separators only has no chunk.
            at = inner[-1][2] if inner else at
        at += gap if first < final else 0
        first += taken
    return chunks


def text_slices(texts: pa.Array, limit: int | None = None) -> Iterator[pa.Array]:
    """A batch in runs of at most ``limit`` bytes of text, or of one longer text; an empty batch is one run."""
    limit = limit or SLICE_BYTES
    start = held = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if i > start and held + n > limit:
            yield texts.slice(start, i - start)
            start, held = i, 0
        held += n
    yield texts.slice(start)


def recursive_chunks(size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP,
                     separators: Sequence[str] = K.SEPARATORS):
    """An Arrow-batched function text -> array of chunks.

    A batch counts rows and may hold long texts, so it is cut in slices of about ``SLICE_BYTES``:
    what a task holds as Python objects is bounded by those.
    """

    @F.arrow_udf(CHUNKS)
    def chunk(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def one(value):
            if value is None:
                return []
            parts = split_recursively(value, size, overlap, separators)
            return [{"text": t, "start_pos": a, "end_pos": b, "index": i}
                    for i, (t, a, b) in enumerate(parts)]

        for batch in batches:
            for texts in text_slices(batch):
                yield pa.array([one(t) for t in texts.to_pylist()], CHUNKS_ARROW)

    return chunk


def chunk_long_texts(docs: DataFrame, content: str, keep: Sequence[str],
                     threshold: int = K.CHUNK_THRESHOLD, chunker=None) -> DataFrame:
    """One row per chunk; texts up to ``threshold`` characters stay whole.

    Short texts never leave the JVM: the Python side sees a null for them.
    """
    chunk = chunker or recursive_chunks()
    body = F.col(content)
    length = F.char_length(body)
    whole = F.array(F.struct(
        body.alias("text"), F.lit(0).alias("start_pos"), length.alias("end_pos"),
        F.lit(0).alias("index")))
    parts = F.when(length > threshold, chunk(F.when(length > threshold, body))).otherwise(whole)
    # Outer explode: the inner one would have its size check pushed below the chunker.
    return (docs.select(*keep, parts.alias("_parts"))
            .select(*keep, F.size("_parts").alias("chunk_total"), F.explode_outer("_parts").alias("c"))
            .filter(F.col("c").isNotNull())
            .select(*keep, F.col("c.index").alias("chunk_index"), "chunk_total",
                    F.col("c.start_pos").alias("start_pos"), F.col("c.end_pos").alias("end_pos"),
                    F.col("c.text").alias("chunk_text")))


def paragraph_groups(docs: DataFrame, content: str, keep: Sequence[str], separator: str = "\n\n",
                     group: int = K.PARAGRAPHS_PER_CHUNK) -> DataFrame:
    """Non-blank paragraphs joined ``group`` at a time, without leaving the row."""
    squeezed = text_fn.strip(text_fn.squeeze_blank_lines(F.col(content)))
    pieces = F.filter(F.transform(F.split(squeezed, separator), text_fn.strip), lambda p: p != "")
    last = (F.ceil(F.size("_p") / group) - 1).cast("int")
    starts = F.when(last >= 0, F.sequence(F.lit(0), last))
    return (docs.select(*keep, pieces.alias("_p"))
            .select(*keep, F.posexplode_outer(F.transform(starts, lambda g: F.array_join(
                F.slice("_p", g * group + 1, F.lit(group)), "\n\n"))).alias("group_index", "content"))
            .filter(F.col("content").isNotNull()))
