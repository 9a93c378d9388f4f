"""Explicit schemas of the model tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from stratamem import constants as K


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


S, I, L, D, B, TS = (
    T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()
)
STR_MAP = T.MapType(S, S)

MEMORY_ITEMS = _struct(
    ("id", S), ("user_id", S), ("session_id", S), ("project", S), ("item_type", S),
    ("content", S), ("memory_layer", S), ("importance", D), ("is_pinned", B),
    ("is_deprecated", B), ("deprecated_at", TS), ("deprecated_reason", S),
    ("embedding", T.ArrayType(T.FloatType())), ("metadata", STR_MAP),
    ("created_at", TS), ("last_accessed_at", TS),
)
MEMORY_EVENTS = _struct(
    ("seq", L), ("op", S), ("id", S), ("ts", TS), ("reason", S), ("item", MEMORY_ITEMS)
)
TASKS = _struct(
    ("id", S), ("user_id", S), ("title", S), ("description", S), ("status", S),
    ("priority", S), ("project", S), ("created_at", TS), ("updated_at", TS),
)
SKILLS = _struct(
    ("id", S), ("name", S), ("slug", S), ("description", S), ("content", S),
    ("frontmatter", STR_MAP), ("project", S), ("user_id", S),
    ("created_at", TS), ("updated_at", TS),
)
KEY_ENTITY = _struct(("name", S), ("type", S), ("value", S), ("confidence", D))
SESSIONS = _struct(
    ("session_id", S), ("user_id", S), ("status", S), ("summary", S),
    ("key_entities", T.ArrayType(KEY_ENTITY)), ("token_count", L), ("message_count", L),
    ("metadata", STR_MAP), ("created_at", TS), ("updated_at", TS), ("summarized_at", TS),
)
USER_PROFILES = _struct(("user_id", S), ("profile", STR_MAP), ("updated_at", TS))
AUDIT_LOG = _struct(("user_id", S), ("action", S), ("payload", STR_MAP), ("created_at", TS))
GC_LOG = _struct(
    ("run_id", S), ("item_id", S), ("collection", S), ("memory_layer", S),
    ("action", S), ("reason", S), ("created_at", TS),
)
SECTION = _struct(("content", S), ("title", S), ("metadata", STR_MAP))
CHUNK = _struct(("text", S), ("start_pos", I), ("end_pos", I), ("index", I))


def layer_dim(spark: SparkSession) -> DataFrame:
    """The four layers with order, budget and description."""
    rows = [(n, i, K.LAYER_BUDGET[n], K.LAYER_NAME[n]) for i, n in enumerate(K.LAYERS)]
    return spark.createDataFrame(rows, "memory_layer string, ord int, budget int, description string")
