"""Ingesting sections of any source into memory items, with per-source counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratamem.functions import text
from stratamem.plans import store as store_plan
from stratamem.plans.store import merge_maps
from stratamem.sources.documents import failed


def ingest_rows(sections: DataFrame, source: str, memory_layer: str = "L3", importance: float = 0.8,
                project: str | None = None) -> DataFrame:
    """Input rows of ``store`` for sections (source column, user_id, session_id,
    content, title, metadata). Blank sections are passed over.
    """
    facts = F.create_map(F.lit("source"), F.col(source))
    if project:
        facts = F.map_concat(facts, F.create_map(F.lit("project"), F.lit(project)))
    titled = F.when(F.coalesce("title", F.lit("")) != "", F.map_concat(
        facts, F.create_map(F.lit("section"), F.col("title")))).otherwise(facts)
    return sections.filter(~text.is_blank(F.col("content"))).select(
        "user_id", "session_id", F.lit(memory_layer).alias("memory_layer"),
        F.lit(importance).alias("importance"), F.lit(False).alias("is_pinned"),
        merge_maps(F.col("metadata"), titled).alias("metadata"), F.lit(1.0).alias("confidence"), "content")


def ingest(sections: DataFrame, source: str, as_of: Column, embedder=None, **options) -> DataFrame:
    return store_plan.store(ingest_rows(sections, source, **options), as_of, embedder)


def ingest_result(sections: DataFrame, source: str) -> DataFrame:
    """Sections stored, failed and in total per source.

    A section that sanitizing leaves blank cannot be stored and counts as failed, and so
    does a source that could not be parsed; blank sections count in the total only.
    """
    content = F.col("content")
    blank = text.is_blank(content)
    empty = text.is_blank(text.sanitize(content))
    return sections.groupBy(source).agg(
        F.count_if(~empty).alias("chunks_stored"),
        F.count_if((~blank & empty) | failed(F.col("metadata"))).alias("chunks_failed"),
        F.count(F.lit(1)).alias("total_chunks"))
