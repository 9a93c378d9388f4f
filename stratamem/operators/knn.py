"""Exact filtered nearest-neighbour search for a batch of queries.

The items are read once, however many queries there are. A set of queries of checked
size is shipped to every task: each multiplies its Arrow batches with the query matrix
and keeps only its own best rows per query and group, so item-query pairs are never
rows and nothing is shuffled but those few winners. Larger query sets stay a table:
the items and the queries of a tenant are both cut into slices of bounded size, and
every pair of slices meets in one task, so a tenant holding a third of the rows is
spread over many of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratamem.functions.vector import rank_key
from stratamem.operators.bounded import broadcast_if_small
from stratamem.operators.topn import top_n_per_group
from stratamem.session import MAX_BLOCK_ROWS, materialize

FILTERS = ("session_id", "project", "item_type")
SALTS = 16
QUERY_SLICE = 256
# Items of a tenant that meet a block of its queries in one task.
SLICE_ITEMS = 50_000
MERGE_ROWS = 200_000
KEYS = ["query_id", "grp"]


@dataclass(frozen=True)
class QueryBlock:
    """A bounded set of queries in array form, sorted by tenant."""

    ids: np.ndarray
    users: np.ndarray
    vectors: np.ndarray
    wanted: dict[str, np.ndarray]  # filter -> code per query, -1 for no filter
    codes: dict[str, dict[str, int]]  # filter -> value -> code


def _encode(rows: pd.DataFrame, filters: Sequence[str]) -> QueryBlock:
    rows = rows.sort_values(["user_id", "query_id"]).reset_index(drop=True)
    wanted, codes = {}, {}
    for name in filters:
        values = rows[name].where(rows[name].notna() & (rows[name] != ""), None)
        codes[name] = {v: i for i, v in enumerate(sorted(set(values.dropna())))}
        wanted[name] = values.map(codes[name]).fillna(-1).to_numpy("int64")
    vectors = np.array(rows["embedding"].tolist(), dtype="float64")
    return QueryBlock(rows["query_id"].to_numpy(), rows["user_id"].to_numpy(),
                      _unit(vectors), wanted, codes)


def _by_length(rows: pd.DataFrame, filters: Sequence[str]) -> list[QueryBlock]:
    """Blocks of queries with vectors of one length each; only items of that length match."""
    lengths = rows["embedding"].map(len)
    return [_encode(part, filters) for _, part in rows.groupby(lengths)]


def _unit(matrix: np.ndarray) -> np.ndarray:
    length = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers that hold a vector of the right length, and their unit vectors."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == dim)
    flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
    return rows, _unit(flat.astype("float64").reshape(len(rows), dim))


def _best(hits: pd.DataFrame, k: int) -> pd.DataFrame:
    hits = hits.sort_values([*KEYS, "key", "id"], ascending=[True, True, False, True])
    return hits[hits.groupby(KEYS, sort=False).cumcount() < k]


def _searcher(block: QueryBlock, k: int, threshold: float, schema: pa.Schema,
              unfiltered: Mapping[str, Sequence[str]]):
    dim = block.vectors.shape[1]
    tenants = {u: np.flatnonzero(block.users == u) for u in np.unique(block.users)}

    def allowed(items: pd.DataFrame, queries: np.ndarray, grp: str) -> np.ndarray | None:
        """Mask of item-query pairs that pass the optional filters."""
        mask = None
        for name, wanted in block.wanted.items():
            want = wanted[queries]
            if name in unfiltered.get(grp, ()) or (want < 0).all():
                continue
            have = items[name].map(block.codes[name]).fillna(-2).to_numpy("int64")
            same = (want < 0)[None, :] | (have[:, None] == want[None, :])
            mask = same if mask is None else mask & same
        return mask

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors: dict[str, np.ndarray] = {}
        found: list[pd.DataFrame] = []
        waiting = 0

        def merge() -> None:
            nonlocal found, waiting
            best = _best(pd.concat(found, ignore_index=True), k)
            for grp, part in best.groupby("grp", sort=False):
                full = part.groupby("q")["key"].agg(["size", "min"])
                full = full[full["size"] >= k]
                floors[grp][full.index.to_numpy()] = full["min"].to_numpy()
            found, waiting = [best], 0

        for batch in batches:
            rows, vectors = _matrix(batch.column("embedding"), dim)
            items = batch.drop_columns(["embedding"]).to_pandas().iloc[rows].reset_index(drop=True)
            for (grp, user), part in items.groupby(["grp", "user_id"], sort=False):
                mine = tenants.get(user, ())
                floor = floors.setdefault(grp, np.full(len(block.ids), threshold))
                at = part.index.to_numpy()
                for lo in range(0, len(mine), QUERY_SLICE):
                    queries = mine[lo:lo + QUERY_SLICE]
                    sims = vectors[at] @ block.vectors[queries].T
                    keys = np.floor(sims * 1e9 + 0.5) / 1e9
                    mask = allowed(part, queries, grp)
                    if mask is not None:
                        keys = np.where(mask, keys, -np.inf)
                    bar = floor[queries]
                    if len(at) > k:
                        bar = np.maximum(bar, np.partition(keys, len(at) - k, axis=0)[len(at) - k])
                    i, j = np.nonzero(keys >= bar)
                    found.append(pd.DataFrame({
                        "query_id": block.ids[queries[j]], "grp": grp,
                        "id": part["id"].to_numpy()[i], "semantic": sims[i, j],
                        "key": keys[i, j], "q": queries[j]}))
                    waiting += len(i)
                    if waiting > MERGE_ROWS:
                        merge()
        if found:
            merge()
            yield pa.RecordBatch.from_pandas(found[0][schema.names], schema, preserve_index=False)

    return search


def _sliced(source: DataFrame, asked: DataFrame, search: Callable, out: T.StructType, block: int,
            slice_items: int) -> DataFrame:
    """Hits of query sets of any size: slices of a tenant's items meet slices of its queries."""
    users = source.groupBy("user_id").agg(F.count(F.lit(1)).alias("_items")).join(
        asked.groupBy("user_id").agg(F.count(F.lit(1)).alias("_queries")), "user_id").select(
        "user_id", F.ceil(F.col("_items") / slice_items).alias("_parts"), F.ceil(F.col("_queries") / block).alias("_blocks"))
    users = materialize(users, "tenants")
    known = broadcast_if_small(users, users.count())
    part = F.pmod(F.xxhash64("id"), F.col("_parts")).alias("_part")
    own = F.pmod(F.xxhash64("query_id"), F.col("_blocks")).alias("_block")
    left = source.join(known, "user_id").select(
        *source.columns, part, F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"))
    right = asked.join(known, "user_id").select(
        *asked.columns, own, F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    keys = ["user_id", "_part", "_block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, out)


def knn(items: DataFrame, queries: DataFrame, k: int, group: str | None = "memory_layer",
        threshold: float = 0.0, filters: Sequence[str] = ("session_id", "project"),
        unfiltered: Mapping[str, Sequence[str]] | None = None,
        max_block: int = MAX_BLOCK_ROWS, salts: int = SALTS, slice_items: int = SLICE_ITEMS) -> DataFrame:
    """The ``k`` most similar live items of the query's user, per ``group`` value.

    ``items``: id, user_id, embedding, is_deprecated, the filter columns and the
    group column. ``queries``: query_id (unique), user_id, embedding and the filter
    columns, where null or empty means no filter. ``unfiltered`` names filters that
    do not apply to a group. Items whose vector has another length than a query's are
    not found by it. Up to ``max_block`` queries are fetched, after they were counted;
    more stay a table. Returns query_id, group, id, semantic and rank from 1.
    """
    if set(filters) - set(FILTERS):
        raise ValueError(f"filters must come from {FILTERS}: {filters}")
    live = items.filter(~F.col("is_deprecated") & F.col("embedding").isNotNull())
    source = live.select("id", (F.col(group) if group else F.lit("")).alias("grp"), "user_id",
                         *filters, "embedding")
    out = T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField("grp", T.StringType()),
        T.StructField("id", items.schema["id"].dataType),
        T.StructField("semantic", T.DoubleType()),
    ])
    arrow = pa.schema([
        (f.name, {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(),
                  "double": pa.float64()}[f.dataType.simpleString()]) for f in out])
    asked = queries.filter(F.size("embedding") > 0).select("query_id", "user_id", "embedding", *filters)
    free = dict(unfiltered or {})
    if asked.count() <= max_block:
        blocks = _by_length(asked.toPandas(), filters)
        parts = [source.mapInArrow(_searcher(b, k, threshold, arrow, free), out) for b in blocks]
        hits = reduce(DataFrame.unionAll, parts) if parts else items.sparkSession.createDataFrame([], out)
    else:
        def match(mine: pa.Table, wanted: pa.Table) -> pa.Table:
            found = []
            if mine.num_rows and wanted.num_rows:
                batches = mine.drop_columns(["_part", "_block"]).to_batches(max_chunksize=10_000)
                for b in _by_length(wanted.to_pandas(), filters):
                    found += _searcher(b, k, threshold, arrow, free)(iter(batches))
            return pa.Table.from_batches(found, arrow)

        hits = _sliced(source, asked, match, out, max_block, slice_items)
    best = top_n_per_group(hits, KEYS, [rank_key(F.col("semantic")).desc(), F.col("id")], k,
                           rank_col="rank", salts=salts, salt_on=["id"])
    return best.withColumnRenamed("grp", group) if group else best.drop("grp")
