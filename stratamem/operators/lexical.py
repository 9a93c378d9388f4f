"""Term statistics, BM25 and sparse term vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratamem.functions import scoring
from stratamem.operators.bounded import join_by_frequency
from stratamem.session import materialize


def exploded_terms(docs: DataFrame, tokens: Column | str, keep: Sequence[Column | str] = ()) -> DataFrame:
    """One row per token.

    An inner explode would make Catalyst push a size check below the tokenizer and
    so run it twice; the outer form with a filter behind it tokenizes once.
    """
    return docs.select(*keep, F.explode_outer(tokens).alias("term")).filter(F.col("term").isNotNull())


def term_frequency(docs: DataFrame, key: str, tokens: str = "tokens") -> DataFrame:
    """Occurrences per (key, term).

    A text's tokens sit in one row, so the map-side combine already yields the
    final counts and the shuffle carries each pair once.
    """
    return (exploded_terms(docs, tokens, [key])
            .groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf")))


def document_frequency(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Texts per term; one shuffle on the term after a map-side combine."""
    return (exploded_terms(docs, F.array_distinct(tokens))
            .groupBy("term").agg(F.count(F.lit(1)).alias("df")))


def corpus_stats(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """One row: number of texts and average tokens per text."""
    size = F.size(tokens)
    return docs.agg(F.count(F.lit(1)).alias("total_docs"),
                    F.coalesce(F.avg(size), F.lit(0.0)).alias("avg_doc_len"))


def _occurrences(tokens: str, term: str) -> Column:
    return F.size(F.filter(tokens, lambda t: t == term))


def bm25_against_corpus(docs: DataFrame, key: str, query_tokens: list[str],
                        tokens: str = "tokens") -> DataFrame:
    """BM25 of one query for every text of a corpus.

    The query's terms are literals, so the texts are read once and never shuffled;
    their counts, a few numbers per text, are written and yield both the statistics
    (one row) and the scores.
    """
    if not query_tokens:
        return docs.select(key, F.lit(0.0).alias("bm25"))
    terms = list(dict.fromkeys(query_tokens))
    counted = materialize(docs.select(
        key, F.size(tokens).alias("doc_len"),
        *[_occurrences(tokens, t).alias(f"tf{i}") for i, t in enumerate(terms)]), "term-counts")
    seen = [F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))]
    stats = counted.agg(F.count(F.lit(1)).alias("total"), F.avg("doc_len").alias("avg_len"), *seen)
    rows = counted.withColumn("s", stats.select(F.struct("*").alias("s")).scalar())
    score = F.lit(0.0)
    for i, term in enumerate(terms):
        weight = scoring.bm25_term(scoring.idf(F.col("s.total"), F.col(f"s.df{i}")), F.col(f"tf{i}"),
                                   F.col("doc_len"), F.col("s.avg_len"))
        score = score + F.when(F.col(f"tf{i}") > 0, query_tokens.count(term) * weight).otherwise(0.0)
    return rows.select(key, score.alias("bm25"))


def query_terms(queries: DataFrame, key: str, tokens: str) -> DataFrame:
    """Each query's terms with their repetitions: key, term, repeats."""
    return exploded_terms(queries, tokens, [key]).groupBy(key, "term").agg(
        F.count(F.lit(1)).alias("repeats"))


def bm25_within_groups(rows: DataFrame, terms: DataFrame, keys: list[str], query: str = "query_id",
                       id_col: str = "id", tokens: str = "tokens") -> DataFrame:
    """BM25 of each row for its group's query, with the group as the corpus.

    ``terms`` comes from ``query_terms``; repeated query terms count repeatedly.
    Returns keys, id and bm25 for the rows that share a term with their query. A
    group is the bounded candidate set of one query.
    """
    group = Window.partitionBy(*keys)
    sized = (rows.select(*keys, id_col, tokens, F.size(tokens).alias("doc_len"))
             .withColumn("total", F.count(F.lit(1)).over(group))
             .withColumn("avg_len", F.avg("doc_len").over(group)))
    facts = [*keys, id_col, "doc_len", "total", "avg_len"]
    tf = (exploded_terms(sized, tokens, facts).join(terms, [query, "term"])
          .groupBy(*facts, "term", "repeats").agg(F.count(F.lit(1)).alias("tf")))
    weight = F.col("repeats") * scoring.bm25_term(
        scoring.idf(F.col("total"), F.col("df")), F.col("tf"), F.col("doc_len"), F.col("avg_len"))
    return (tf.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy(*keys, "term")))
            .groupBy(*keys, id_col).agg(F.sum(weight).alias("bm25")))


def max_normalized(score: Column, keys: list[str]) -> Column:
    """Divide by the group's maximum; a maximum of zero counts as one."""
    top = F.max(score).over(Window.partitionBy(*keys))
    return score / F.when(top == 0, F.lit(1.0)).otherwise(top)


def sparse_vectors(docs: DataFrame, key: str, tokens: str = "tokens") -> DataFrame:
    """BM25 weight of every term of every text: key, term, weight.

    Kept in long form so that a long text never becomes one oversized row; texts
    without tokens have no rows, which stands for the empty vector. The texts are
    tokenized once; their term counts are written and everything else derives from
    them. Terms found in a large share of the texts take part in no shuffle.
    """
    tf = materialize(
        exploded_terms(docs, tokens, [key, F.size(tokens).alias("doc_len")])
        .groupBy(key, "term", "doc_len").agg(F.count(F.lit(1)).alias("tf")), "term-frequency")
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total = docs.agg(F.count(F.lit(1)).alias("total")).scalar()
    avg_len = (tf.agg(F.sum("tf")).scalar() / total)
    weight = scoring.bm25_term(scoring.idf(F.col("total"), F.col("df")), F.col("tf"),
                               F.col("doc_len"), F.col("avg_len"))
    return (join_by_frequency(tf, df, "term", "df", tf.count())
            .withColumn("total", total).withColumn("avg_len", avg_len)
            .select(key, "term", weight.alias("weight")))


def sparse_vector_map(tokens: Column, idf_of: Column, avg_len: Column) -> Column:
    """Term-weight map of one short token array, given a term -> idf map."""
    terms = F.array_distinct(tokens)
    weights = F.transform(terms, lambda t: scoring.bm25_term(
        F.coalesce(idf_of[t], F.lit(0.0)), F.size(F.filter(tokens, lambda x: x == t)),
        F.size(tokens), avg_len))
    return F.map_from_arrays(terms, weights)


def sparse_norms(vectors: DataFrame, key: str, docs: DataFrame) -> DataFrame:
    """Terms and length of every text's sparse vector; the empty vector has neither."""
    sums = vectors.groupBy(key).agg(F.count(F.lit(1)).alias("terms"),
                                    F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length"))
    return docs.select(key).join(sums, key, "left").select(
        key, F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("length", F.lit(0.0)).alias("length"))


def sparse_similarity(vectors: DataFrame, key: str, query: DataFrame, docs: DataFrame) -> DataFrame:
    """Cosine of the sparse vector of every text of ``docs`` with one query vector (term, weight).

    A text's norm and its product with the query come from one aggregation over
    the long form.
    """
    q = query.select("term", F.col("weight").alias("q_weight"))
    q_norm = query.agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("q_norm"))
    sums = (vectors.join(q, "term", "left")
            .groupBy(key).agg(F.sum(F.col("weight") * F.coalesce("q_weight", F.lit(0.0))).alias("product"),
                              F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length")))
    scale = F.col("length") * q_norm.scalar()
    return docs.select(key).join(sums, key, "left").select(
        key, F.coalesce(F.when(scale > 0, F.col("product") / scale), F.lit(0.0)).alias("similarity"))
