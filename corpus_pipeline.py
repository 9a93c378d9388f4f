"""The corpus pipeline: toxicity, exact and near copies, source mixing, packing.

Every stage reads what the stage before kept, as written Parquet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratamem.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from stratamem.session import discard, settle
from stratamem.sources.tables import read

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, base: str) -> DataFrame:
    """Documents predicted toxic go."""
    return toxicity.drop_toxic(docs.select(COLUMNS), read(spark, base, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, base: str) -> DataFrame:
    """One document stays of every group of equal texts."""
    return exact_dedup.drop_copies(docs.select(COLUMNS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, base: str) -> DataFrame:
    """One document stays of every group that similar shingle sets link."""
    return ngram_join.drop_similar(docs.select(COLUMNS), width=NEAR_WIDTH, percent=NEAR_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, base: str) -> DataFrame:
    """Documents repeat or go so that the sources meet their target weights."""
    return mixing.repeat(mixing.mix(docs.select(COLUMNS)))


def pack_sequences(spark: SparkSession, docs: DataFrame, base: str) -> DataFrame:
    """The places of every piece of every document in sequences of 1024 tokens."""
    return packing.pack_documents(docs)


NEAR_WIDTH = 5
NEAR_PERCENT = 80

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("n-gram jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

# The first and third stage learn and search in ways that SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = read(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = settle(lambda docs=docs, stage=stage: stage(spark, docs, sf_dir), name.replace(" ", "-"))
        # A stage's rows, and what it wrote on the way, go once the next has its own.
        discard(*written)
        written = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
