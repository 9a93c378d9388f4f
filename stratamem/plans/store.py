"""Storing content: sanitize, chunk, embed and describe as memory items."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import zlib
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratamem import schema
from stratamem.functions import text
from stratamem.operators.chunking import chunk_long_texts

VECTOR = T.ArrayType(T.FloatType())
EMBED_DIM = 64


def merge_maps(left: Column, right: Column) -> Column:
    """Union of two maps in which the right side wins."""
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k)), right)


def hashed_embedder(dim: int = EMBED_DIM) -> Callable[[Column], Column]:
    """An offline embedder: a text's words hashed into a unit vector of ``dim`` numbers."""

    @F.pandas_udf(VECTOR)
    def embed(texts: pd.Series) -> pd.Series:
        def one(value):
            if value is None:
                return None
            slots = [zlib.crc32(w.encode()) % dim for w in value.lower().split()]
            counts = np.bincount(slots, minlength=dim).astype("float32")
            length = np.sqrt((counts * counts).sum())
            return counts / length if length else counts

        return texts.map(one)

    return embed


def store(contents: DataFrame, as_of: Column, embedder: Callable[[Column], Column] | None = None,
          chunker=None) -> DataFrame:
    """Memory items for rows of user_id, session_id, memory_layer, importance,
    is_pinned, metadata, confidence and content.

    Long content of the vector layers is chunked, each chunk being an item of its
    own with its place in the metadata; working memory stays whole and without a
    vector. Blank chunks are not valid items and are left out. Rows that carry a
    ``request`` (any text that no other row has) give items of their own even where the
    content is stored already; without it, equal rows are one item.
    """
    keep = ["user_id", "session_id", "memory_layer", "importance", "is_pinned", "request", "metadata"]
    if "request" not in contents.columns:
        contents = contents.withColumn("request", F.lit(None).cast("string"))
    base = merge_maps(F.coalesce("metadata", F.create_map().cast(schema.STR_MAP)), F.create_map(
        F.lit("confidence"), F.coalesce("confidence", F.lit(1.0)).cast("string")))
    clean = contents.select(
        *keep[:-1], base.alias("metadata"), text.sanitize(F.col("content")).alias("_clean"))
    working = F.col("memory_layer") == "L1"
    chunks = chunk_long_texts(clean.filter(~working), "_clean", keep, chunker=chunker)
    place = F.create_map(
        F.lit("chunk_index"), F.col("chunk_index").cast("string"),
        F.lit("chunk_total"), F.col("chunk_total").cast("string"),
        F.lit("start_pos"), F.col("start_pos").cast("string"),
        F.lit("end_pos"), F.col("end_pos").cast("string"))
    embed = embedder or hashed_embedder()
    vectors = (chunks.withColumn("metadata", merge_maps(F.col("metadata"), place))
               .withColumn("content", text.strip(F.col("chunk_text")))
               .withColumn("embedding", embed(F.col("chunk_text"))))
    plain = clean.filter(working).withColumn("content", F.col("_clean")).withColumn(
        "embedding", F.lit(None).cast(VECTOR))
    cols = [*keep, "content", "embedding"]
    rows = vectors.select(*cols).unionByName(plain.select(*cols)).filter(F.col("content") != "")
    project = F.nullif(F.col("metadata")["project"], F.lit(""))
    return rows.select(
        text.stable_id(F.col("user_id"), F.col("session_id"), F.col("memory_layer"), F.col("content"),
                       F.to_json(F.map_from_entries(F.sort_array(F.map_entries("metadata")))),
                       F.col("request")).alias("id"),
        "user_id", "session_id", project.alias("project"), F.lit(None).cast("string").alias("item_type"),
        "content", "memory_layer", "importance", "is_pinned", F.lit(False).alias("is_deprecated"),
        F.lit(None).cast("timestamp").alias("deprecated_at"), F.lit(None).cast("string").alias("deprecated_reason"),
        "embedding", "metadata", as_of.alias("created_at"),
        F.lit(None).cast("timestamp").alias("last_accessed_at"))


def checkpoint(rows: DataFrame) -> DataFrame:
    """Input rows of ``store`` for named checkpoints: pinned, fully important, L3.

    ``rows``: name, content, user_id, session_id, project.
    """
    named = F.create_map(F.lit("checkpoint_name"), F.col("name"))
    owned = F.create_map(F.lit("project"), F.col("project"))
    with_project = F.when(F.coalesce("project", F.lit("")) != "", F.map_concat(named, owned)).otherwise(named)
    return rows.select(
        "user_id", "session_id", F.lit("L3").alias("memory_layer"), F.lit(1.0).alias("importance"),
        F.lit(True).alias("is_pinned"), with_project.alias("metadata"), F.lit(1.0).alias("confidence"),
        F.concat(F.lit("[Checkpoint: "), F.col("name"), F.lit("]\n\n"), F.col("content")).alias("content"))


def skill_points(skills: DataFrame, embedder: Callable[[Column], Column] | None = None) -> DataFrame:
    """Vector rows of skills: the name as content, embedded with its description."""
    embed = embedder or hashed_embedder()
    facts = F.create_map(
        F.lit("skill_id"), F.col("id").cast("string"), F.lit("name"), F.col("name"),
        F.lit("slug"), F.col("slug"), F.lit("project"), F.col("project"), F.lit("type"), F.lit("skill"))
    return skills.select(
        F.col("id").cast("string").alias("id"), "user_id", F.lit(None).cast("string").alias("session_id"),
        "project", F.lit("skill").alias("item_type"), F.col("name").alias("content"),
        F.lit("L3").alias("memory_layer"), F.lit(0.8).alias("importance"), F.lit(False).alias("is_pinned"),
        F.lit(False).alias("is_deprecated"), F.lit(None).cast("timestamp").alias("deprecated_at"),
        F.lit(None).cast("string").alias("deprecated_reason"),
        embed(F.concat_ws(": ", "name", "description")).alias("embedding"), facts.alias("metadata"),
        F.lit(None).cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("last_accessed_at"))


def audit(rows: DataFrame, action: str, as_of: Column, payload: Sequence[str]) -> DataFrame:
    """Audit rows with the named columns as payload."""
    pairs = [x for name in payload for x in (F.lit(name), F.col(name).cast("string"))]
    return rows.select("user_id", F.lit(action).alias("action"), F.create_map(*pairs).alias("payload"),
                       as_of.alias("created_at"))


def append(items: DataFrame, path: str) -> None:
    """Append items under their collection, the unit that the tool engine prunes by."""
    from stratamem.operators.lifecycle import with_collection
    with_collection(items).write.mode("append").partitionBy("collection").parquet(path)
