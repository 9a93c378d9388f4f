"""Registered queries of the subpackage and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamem.llm import (
    bpe_tree,
    exact_dedup,
    hard_negatives,
    language,
    license_scan,
    merkle,
    mixing,
    ngram_join,
    packing,
    prefix_trie,
    secret_scan,
    substring_dedup,
    toxicity,
)
from stratamem.sources.tables import read


def op1_toxicity(spark: SparkSession, base: str) -> DataFrame:
    return toxicity.toxic_documents(read(spark, base, "documents"), read(spark, base, "labels")).select(
        "doc_id", "held_out", "score", "predicted", F.size("spans").cast("long").alias("n_spans"))


def op2_ngram_jaccard(spark: SparkSession, base: str) -> DataFrame:
    return ngram_join.similar_documents(read(spark, base, "documents"))


def op3_document_fingerprints(spark: SparkSession, base: str) -> DataFrame:
    return merkle.fingerprints(read(spark, base, "documents"))


def op4_language(spark: SparkSession, base: str) -> DataFrame:
    return language.detect_languages(read(spark, base, "documents")).select(
        "doc_id", "held_out", "lang_pred", "score")


def op5_license_scan(spark: SparkSession, base: str) -> DataFrame:
    return license_scan.scan_licenses(read(spark, base, "documents")).withColumn(
        "n_blocks", F.size("blocks").cast("long")).drop("blocks")


def op6_best_fit_packing(spark: SparkSession, base: str) -> DataFrame:
    return packing.pack_documents(read(spark, base, "documents"))


def op7_substring_dedup(spark: SparkSession, base: str) -> DataFrame:
    return substring_dedup.repeated_passages(read(spark, base, "documents"))


def op8_source_mixing(spark: SparkSession, base: str) -> DataFrame:
    return mixing.mix(read(spark, base, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op9_secret_scan(spark: SparkSession, base: str) -> DataFrame:
    return secret_scan.find_secrets(read(spark, base, "documents")).drop("secrets")


def op10_exact_dedup(spark: SparkSession, base: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read(spark, base, "documents"))


def op11_bpe_tree(spark: SparkSession, base: str) -> DataFrame:
    return bpe_tree.encode_documents(read(spark, base, "documents"))


def op12_prefix_trie(spark: SparkSession, base: str) -> DataFrame:
    return prefix_trie.prefix_trie(read(spark, base, "conversations"))


def op13_hard_negatives(spark: SparkSession, base: str) -> DataFrame:
    return hard_negatives.hard_negatives(read(spark, base, "embeddings"))


OP8 = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
    md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS draw
  FROM documents), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY ALL), weighted AS (
  SELECT *, 2e0 * source_size AS cap,
    (['5', '2', '1'])[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)]::DOUBLE AS weight
  FROM sources), levels AS (
  SELECT *, (1.5e0 * sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0e0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0e0)) AS level
  FROM weighted WINDOW before AS (ORDER BY cap / weight, source NULLS LAST
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), filled AS (
  SELECT *, first_value(level) OVER (ORDER BY level * weight < cap DESC, cap / weight) AS first_level,
    bool_or(level * weight < cap) OVER () AS any_free
  FROM levels), plan AS (
  SELECT source, source_size, CASE WHEN any_free THEN least(cap, first_level * weight) ELSE cap END AS target
  FROM filled), parts AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(CAST(floor(target / source_size) AS BIGINT), 2) END AS whole
  FROM plan)
SELECT s.doc_id, s.size, p.source_size, p.target, CAST(p.whole * s.size + greatest(0, least(s.size,
    round(p.target - p.whole * p.source_size) - coalesce(sum(s.size) OVER (PARTITION BY s.source
      ORDER BY s.draw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS taken
FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP10 = f"""
WITH keyed AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, text_sha256
FROM keyed WINDOW same AS (PARTITION BY text_sha256)"""

# Paths are strings of digests; crc32 goes bit by bit over the decimal digits.
OP12 = """
WITH t AS (
  SELECT conv_id, coalesce(text, '') AS x,
    sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS pos
  FROM conversations WHERE conv_id IS NOT NULL), h AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, xor(list_reduce(list_prepend(4294967295, list_transform(
      string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)),
      lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t)), rebuilt AS (
  SELECT h.conv_id, 0 AS own, t.pos, id, strlen(x) AS bytes FROM h JOIN t ON t.conv_id = h.base AND t.pos <= h.h
  UNION ALL SELECT h.conv_id, 1, t.pos, id, strlen(x) FROM h JOIN t ON t.conv_id = h.conv_id AND t.pos > h.h), paths AS (
  SELECT conv_id, row_number() OVER sofar AS d, string_agg(id, '') OVER sofar AS path, bytes FROM rebuilt
  WINDOW sofar AS (PARTITION BY conv_id ORDER BY own, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  UNION ALL SELECT conv_id, 0, '', 0 FROM h), ends AS (
  SELECT path, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256
  FROM (SELECT conv_id, arg_max(path, d) AS path FROM paths GROUP BY conv_id) GROUP BY path), nodes AS (
  SELECT path, d, min(conv_id) AS conv_id, count(*) AS n, any_value(bytes) AS bytes,
    CASE WHEN d > 0 THEN left(path, 64 * (d - 1)) END AS up
  FROM paths GROUP BY path, d), kids AS (
  SELECT up AS path, count(*) AS k FROM nodes WHERE d > 0 GROUP BY up), below AS (
  SELECT a.path, count(*) FILTER (WHERE k.k IS NULL) AS n_leaves, CAST(sum((v.n - 1) * v.bytes) AS BIGINT) AS saved
  FROM nodes a JOIN nodes v ON starts_with(v.path, a.path) LEFT JOIN kids k ON k.path = v.path GROUP BY a.path)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(k.k, 0) AS n_children,
  b.n_leaves, b.saved AS saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM nodes n JOIN below b ON b.path = n.path LEFT JOIN nodes p ON p.path = n.up LEFT JOIN kids k ON k.path = n.path
LEFT JOIN ends e ON e.path = n.path"""

OP13 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0), scored AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id,
    CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER best AS INTEGER) AS rank, s.vec_id AS negative_id,
  p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
WINDOW best AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER best <= 10"""

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_document_fingerprints": op3_document_fingerprints,
    "op4_language": op4_language,
    "op5_license_scan": op5_license_scan,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_source_mixing": op8_source_mixing,
    "op9_secret_scan": op9_secret_scan,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_bpe_tree": op11_bpe_tree,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLE = {"op8_source_mixing": OP8, "op10_exact_dedup": OP10, "op12_prefix_trie": OP12,
          "op13_hard_negatives": OP13}
