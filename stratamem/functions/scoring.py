"""Relevance signals and their combination."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratamem import constants as K
from stratamem.functions import text


def round4(x: Column) -> Column:
    """Four decimals, halves up, computed the same way by every engine."""
    return F.floor(x * 1e4 + 0.5) / 1e4


def clamp01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def age_days(then: Column, as_of: Column) -> Column:
    micros = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))
    return micros / F.lit(K.SECONDS_PER_DAY * 1e6)


def recency(created_at: Column, as_of: Column) -> Column:
    """1 for a new item, one half after a day, falling hyperbolically."""
    return 1.0 / (1.0 + F.greatest(age_days(created_at, as_of), F.lit(0.0)))


def importance(value: Column, is_pinned: Column) -> Column:
    return F.when(is_pinned, F.least(value + K.PIN_BOOST, F.lit(1.0))).otherwise(value)


def user_signal(query_words: Column, content_words: Column) -> Column:
    """Share of the distinct query words that occur in the content."""
    shared = F.size(F.array_intersect(query_words, content_words))
    return F.when(F.size(query_words) > 0, shared / F.size(query_words)).otherwise(F.lit(0.0))


def user_signal_of_text(query: Column, content: Column) -> Column:
    return user_signal(text.word_set(query), text.word_set(content))


def combined(rec: Column, semantic: Column, imp: Column, signal: Column) -> Column:
    return (
        K.W_RECENCY * rec + K.W_SEMANTIC * semantic + K.W_IMPORTANCE * imp + K.W_SIGNAL * signal
    )


def fused(semantic: Column, lexical: Column) -> Column:
    return K.W_DENSE * semantic + K.W_LEXICAL * lexical


def final_score(fused_score: Column, combined_score: Column) -> Column:
    return round4(K.W_DENSE * fused_score + (1 - K.W_DENSE) * combined_score)


def idf(total: Column, df: Column) -> Column:
    return F.ln((total - df + 0.5) / (df + 0.5) + 1.0)


def bm25_term(idf_value: Column, tf: Column, doc_len: Column, avg_len: Column) -> Column:
    """Contribution of one query term to one document."""
    length_norm = 1.0 - K.BM25_B + K.BM25_B * doc_len / F.nullif(avg_len, F.lit(0.0))
    return idf_value * (tf * (K.BM25_K1 + 1.0)) / (tf + K.BM25_K1 * length_norm)
