"""Hard negatives by exact inner-product search with length buckets and coordinate pruning.

Rows are ordered by the length of their vectors and cut into slices. In a task a slice
becomes buckets of rows of similar length; a bucket holds its longest length and, for every
coordinate, its unit vectors' values in sorted order. For an anchor that needs a score of t
or more, a bucket of longest length l asks for a cosine of t / (l * anchor's length):

* beyond 1 nothing in the bucket, nor in any shorter one, can reach it;
* otherwise the anchor's focus coordinates (its largest) each allow a range of values, found
  in the sorted lists; a row outside any of them cannot reach it.

What is left is verified by its exact integer product, and t rises with the best found. Every
slice meets the anchors in blocks; only its best rows per anchor leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamem.operators.topn import top_n_per_group
from stratamem.session import materialize

SCALE = 256
ANCHOR_EVERY = 100
POSITIVES, NEGATIVES = 5, 10
# A negative's score in hundredths of the positive's.
LOWEST, HIGHEST = 30, 90
SLICE_ROWS, BLOCK_ANCHORS = 100_000, 16_384
# Slices are smaller than SLICE_ROWS where the cores would idle otherwise, down to this.
LEAST_ROWS = 4096
BUCKET_ROWS = 2048
FOCUS = 5
SLACK = 1e-9
NO_ID = np.iinfo(np.int64).max

_POSITIVE = pa.schema([("anchor_row", pa.int64()), ("anchor_id", pa.int64()), ("positive_row", pa.int64()),
                       ("positive_id", pa.int64()), ("positive_score", pa.int64())])
_POSITIVE_DDL = "anchor_row long, anchor_id long, positive_row long, positive_id long, positive_score long"
_NEGATIVE = pa.schema([("anchor_row", pa.int64()), ("anchor_id", pa.int64()), ("place", pa.int32()),
                       ("positive_id", pa.int64()), ("positive_score", pa.int64()), ("negative_row", pa.int64()),
                       ("negative_id", pa.int64()), ("negative_score", pa.int64())])
_NEGATIVE_DDL = ("anchor_row long, anchor_id long, place int, positive_id long, positive_score long, "
                 "negative_row long, negative_id long, negative_score long")


class Rows:
    """Rows of one dimension in array form, components scaled to whole numbers."""

    def __init__(self, table: pa.Table, at: np.ndarray, dim: int):
        part = table.take(pa.array(at))
        self.row = part.column("row").to_numpy()
        ids = part.column("vec_id")
        self.id = ids.fill_null(NO_ID).to_numpy()
        self.label = part.column("label").to_numpy()
        flat = part.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        whole = np.floor(SCALE * flat.astype("float64").reshape(len(at), dim))
        self.length = np.sqrt((whole * whole).sum(axis=1))
        self.unit = np.divide(whole, self.length[:, None], out=np.zeros_like(whole), where=self.length[:, None] > 0)
        # Products are exact as doubles while they stay below 2^53, and as Python's integers beyond.
        self.largest = float(np.abs(whole).max(initial=0.0))
        self.whole = whole

    def exact(self, largest: float) -> np.ndarray:
        if self.largest * largest * max(1, self.whole.shape[1]) < 1 << 53:
            return self.whole
        return np.array([[int(x) for x in r] for r in self.whole.tolist()], object).reshape(self.whole.shape)


def by_dimension(table: pa.Table) -> dict[int, Rows]:
    sizes = table.column("embedding").combine_chunks().value_lengths().to_numpy()
    return {int(d): Rows(table, np.flatnonzero(sizes == d), int(d)) for d in np.unique(sizes)}


class Bucket:
    """Rows of similar length with the sorted values of every coordinate."""

    def __init__(self, rows: Rows, whole: np.ndarray, at: np.ndarray):
        self.at, self.whole, self.longest = at, whole[at], rows.length[at].max()
        self.unit = rows.unit[at]
        self.order = np.argsort(self.unit, axis=0, kind="stable").T
        self.sorted = np.take_along_axis(self.unit, self.order.T, axis=0).T.copy()

    def candidates(self, unit: np.ndarray, focus: np.ndarray, cosine: float) -> np.ndarray | None:
        """Rows whose focus coordinates all allow the cosine; None where every row may."""
        if cosine <= -1 + SLACK:
            return None
        cosine -= SLACK
        ranges = []
        for f in focus.tolist():
            q = float(unit[f])
            reach = np.sqrt(max(0.0, (1 - q * q) * (1 - cosine * cosine))) + SLACK
            low = -2.0 if q <= -cosine else q * cosine - reach
            high = 2.0 if q >= cosine else q * cosine + reach
            a, b = self.sorted[f].searchsorted([low, high])
            ranges.append((int(b - a), f, int(a), low, high))
        ranges.sort()
        n, f, a, *_ = ranges[0]
        if n == len(self.at):
            return None
        left = self.order[f][a:a + n]
        for _, f, _, low, high in ranges[1:]:
            values = self.unit[left, f]
            left = left[(values >= low) & (values < high)]
        return left


def buckets(rows: Rows, whole: np.ndarray, at: np.ndarray, size: int = BUCKET_ROWS) -> list[Bucket]:
    """Buckets of the rows ``at``, longest first."""
    at = at[np.argsort(-rows.length[at], kind="stable")]
    return [Bucket(rows, whole, at[i:i + size]) for i in range(0, len(at), size)]


class Best:
    """The best k of the rows seen so far by score, then id, then row; ``least`` is what counts at all."""

    def __init__(self, k: int, least: float, most: float):
        self.k, self.least, self.most = k, least, most
        self.score = np.zeros(0, object)
        self.row = self.id = np.zeros(0, np.int64)

    def add(self, score: np.ndarray, id_: np.ndarray, row: np.ndarray) -> None:
        fits = np.flatnonzero((score >= self.least) & (score <= self.most))
        if not len(fits):
            return
        if len(fits) > self.k and score.dtype != object:
            bar = np.partition(score[fits], len(fits) - self.k)[len(fits) - self.k]
            fits = fits[score[fits] >= bar]
        score = np.concatenate([self.score.astype(score.dtype), score[fits]])
        id_, row = np.concatenate([self.id, id_[fits]]), np.concatenate([self.row, row[fits]])
        order = np.lexsort((row, id_, -score))[:self.k]
        self.score, self.id, self.row = score[order], id_[order], row[order]
        if len(order) == self.k:
            self.least = max(self.least, self.score[-1])


def search(rows: Rows, whole: np.ndarray, groups: list[Bucket], vector: np.ndarray, unit: np.ndarray, length: float,
           barred: np.ndarray | None, wanted: list[Best]) -> None:
    """Bring the rows of the buckets, except barred ones, to the best lists that want them."""
    focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
    for bucket in groups:
        need = min(float(b.least) for b in wanted)
        scale = length * bucket.longest
        if need > 0 and need > scale * (1 + SLACK):
            return  # all later buckets are shorter still
        # Below a need of zero shorter rows of a bucket ask for a smaller cosine than its longest one.
        found = bucket.candidates(unit, focus, need / scale) if need > 0 else None
        at = bucket.at if found is None else bucket.at[found]
        score = (bucket.whole if found is None else bucket.whole[found]) @ vector
        if barred is not None:
            free = ~barred[at]
            at, score = at[free], score[free]
        for best in wanted:
            best.add(score, rows.id[at], rows.row[at])


def _table(columns: list[list], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _id(value: int) -> int | None:
    return None if value == NO_ID else int(value)


def _positives(k: int, size: int):
    def match(mine: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in _POSITIVE]
        if mine.num_rows and asked.num_rows:
            items, anchors = by_dimension(mine), by_dimension(asked)
            for dim in anchors.keys() & items.keys():
                rows, anchor = items[dim], anchors[dim]
                whole, vectors = rows.exact(anchor.largest), anchor.exact(rows.largest)
                for label in np.unique(anchor.label):
                    groups = buckets(rows, whole, np.flatnonzero(rows.label == label), size)
                    for i in np.flatnonzero(anchor.label == label):
                        best = Best(k, -np.inf, np.inf)
                        search(rows, whole, groups, vectors[i], anchor.unit[i], anchor.length[i],
                               rows.row == anchor.row[i], [best])
                        for values in zip(best.row, best.id, best.score):
                            for column, v in zip(out, (anchor.row[i], _id(anchor.id[i]), int(values[0]),
                                                       _id(values[1]), int(values[2]))):
                                column.append(v)
        return _table(out, _POSITIVE)
    return match


def _negatives(k: int, lowest: int, highest: int, size: int):
    def match(mine: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in _NEGATIVE]
        if mine.num_rows and asked.num_rows:
            items, anchors = by_dimension(mine), by_dimension(asked)
            lists = dict(zip(asked.column("row").to_pylist(), asked.column("positives").to_pylist()))
            for dim in anchors.keys() & items.keys():
                rows, anchor = items[dim], anchors[dim]
                whole, vectors = rows.exact(anchor.largest), anchor.exact(rows.largest)
                groups = buckets(rows, whole, np.arange(len(rows.row)), size)
                same = {label: rows.label == label for label in np.unique(anchor.label)}
                for i in range(len(anchor.row)):
                    chosen = lists[int(anchor.row[i])]
                    wanted = [(p, Best(k, -(-lowest * p["score"] // 100), highest * p["score"] // 100)) for p in chosen]
                    wanted = [(p, b) for p, b in wanted if b.least <= b.most]
                    if not wanted:
                        continue
                    search(rows, whole, groups, vectors[i], anchor.unit[i], anchor.length[i],
                           same[anchor.label[i]], [b for _, b in wanted])
                    for p, best in wanted:
                        for values in zip(best.row, best.id, best.score):
                            for column, v in zip(out, (anchor.row[i], _id(anchor.id[i]), p["place"], p["id"], p["score"],
                                                       int(values[0]), _id(values[1]), int(values[2]))):
                                column.append(v)
        return _table(out, _NEGATIVE)
    return match


def _meet(items: DataFrame, anchors: DataFrame, slices: int, blocks: int, match, ddl: str) -> DataFrame:
    """Every slice of the items with every block of the anchors, each pair in one task."""
    left = items.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = anchors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")).withColumn(
        "slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    return left.groupBy("slice", "block").cogroup(right.groupBy("slice", "block")).applyInArrow(
        match, ddl)


def hard_negatives(vectors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   anchor_every: int = ANCHOR_EVERY, lowest: int = LOWEST, highest: int = HIGHEST,
                   slice_rows: int = SLICE_ROWS, block_anchors: int = BLOCK_ANCHORS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Hard negatives for every anchor of ``vectors`` (vec_id, embedding, label) and each of its positives.

    Rows with a null label, a null vector or a null or non-finite component take no part, and
    labels of ids divisible by 7 move on by one, modulo 10. Anchors are the rows whose id is
    divisible by ``anchor_every``. Scores are whole numbers, exact at any size; one beyond 64
    bits ends the job. Only vectors with as many components as the anchor's meet it; the empty
    vector scores 0 with its like. A row is never its own positive, but another row of the same
    id or vector may be; rows without an id follow all others of their score. Other columns are
    ignored. Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    spark = vectors.sparkSession
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.col("label").cast("long")
    valid = (vectors.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & sound)
             .select("vec_id", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
                     "embedding"))
    n = valid.count()
    cores = spark.sparkContext.defaultParallelism
    slices = max(1, -(-n // slice_rows), min(2 * cores, n // LEAST_ROWS))
    size = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    items = materialize(
        valid.withColumn("row", F.monotonically_increasing_id()).withColumn("size", size)
        .repartitionByRange(slices, F.col("size").desc(), "row")
        .select("row", "vec_id", "label", "embedding", F.spark_partition_id().alias("slice")), "vectors")
    slices = (items.agg(F.max("slice").alias("slices")).first()["slices"] or 0) + 1
    # Written, since a cogroup needs two inputs that share no columns.
    anchors = materialize(items.filter(F.col("vec_id") % anchor_every == 0).drop("slice"), "anchor-rows")
    blocks = max(1, -(-anchors.count() // block_anchors))
    close = _meet(items, anchors, slices, blocks, _positives(positives, bucket_rows), _POSITIVE_DDL)
    nearest = top_n_per_group(close, ["anchor_row"], [
        F.col("positive_score").desc(), F.col("positive_id").asc_nulls_last(), F.col("positive_row")], positives,
        rank_col="place")
    lists = nearest.groupBy(F.col("anchor_row").alias("row")).agg(F.sort_array(F.collect_list(F.struct(
        "place", F.col("positive_id").alias("id"), F.col("positive_score").alias("score")))).alias("positives"))
    asked = materialize(anchors.join(lists, "row"), "anchors")
    far = _meet(items, asked, slices, blocks, _negatives(negatives, lowest, highest, bucket_rows), _NEGATIVE_DDL)
    ranked = top_n_per_group(far, ["anchor_row", "place"], [
        F.col("negative_score").desc(), F.col("negative_id").asc_nulls_last(), F.col("negative_row")], negatives,
        rank_col="rank")
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id",
                         "positive_score", "negative_score")
