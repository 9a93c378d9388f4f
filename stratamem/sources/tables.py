"""Model tables derived from the analytic tables.

Documents become chunked memory items, conversations the working memory,
benchmark passages the queries, orders the tasks and parts the skills. Every row
and the whole of every text take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratamem.functions import text
from stratamem.operators.chunking import char_windows

AS_OF = "2024-02-01 00:00:00"
TENANTS = ("en", "fr", "de", "es")
SESSIONS = 20
# No text is long enough for as many windows, no conversation for as many turns.
IDS_PER_DOC = 1 << 24
TURNS_PER_CONVERSATION = 1 << 24
SPLIT_BYTES = 128 << 20
SMALL_SLICE = 64 << 10


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def days_before(days: Column) -> Column:
    return as_of() - F.make_dt_interval(days.cast("int"))


_schemas: dict[str, T.StructType] = {}


def read(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A table; its footer is looked up once per process."""
    path = f"{base}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def read_texts(spark: SparkSession, base: str, name: str, key: str) -> DataFrame:
    """A table whose rows are costly to process, spread over the cores when small.

    A small file is one input split, which would leave a single task with all the
    work. A table above one split per core is read as it is laid out.
    """
    df = read(spark, base, name)
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > cores * SPLIT_BYTES:
        return df
    return df.repartition(max(1, min(2 * cores, size // SMALL_SLICE)), key)


def tenant(number: Column) -> Column:
    names = F.array(*[F.lit(t) for t in TENANTS])
    return F.get(names, F.pmod(number, F.lit(len(TENANTS))).cast("int"))


def session_name(number: Column) -> Column:
    return F.concat(F.lit("src"), F.pmod(number, F.lit(SESSIONS)).cast("string"))


def document_rows(spark: SparkSession, base: str) -> DataFrame:
    """Documents with retention attributes, one row per document."""
    labels = read(spark, base, "labels").select("doc_id", "quality", "toxic")
    d, quality, toxic = F.col("doc_id"), F.coalesce("quality", F.lit(0)), F.coalesce("toxic", F.lit(0))
    deprecated = toxic == 1
    return (read_texts(spark, base, "documents", "doc_id").select("doc_id", "text", "lang", "source")
            .join(labels, "doc_id", "left")
            .select(
                "doc_id", "text", F.col("lang").alias("user_id"), F.col("source").alias("session_id"),
                F.when(d % 4 != 3, F.col("source")).alias("project"),
                F.when(d % 3 == 0, "L2").when(d % 3 == 1, "L3").otherwise("L4").alias("memory_layer"),
                F.when(d % 23 == 0, 1.0).otherwise(0.5 + 0.4 * quality).alias("importance"),
                (d % 17 == 0).alias("is_pinned"),
                deprecated.alias("is_deprecated"),
                days_before((d * 7) % 400).alias("created_at"),
                F.when(d % 5 == 0, days_before(d % 50)).alias("last_accessed_at"),
                F.when(deprecated, days_before(d % 60)).alias("deprecated_at"),
                F.when(d % 29 == 0, "skill").alias("item_type"),
                F.when(d % 11 == 0, F.concat(F.lit("cp-"), d.cast("string"))).alias("checkpoint_name"),
            ))


ITEM_COLUMNS = (
    "doc_id", "user_id", "session_id", "project", "memory_layer", "importance", "is_pinned",
    "is_deprecated", "created_at", "last_accessed_at", "deprecated_at", "item_type", "checkpoint_name",
)


def memory_items(spark: SparkSession, base: str, embedded: bool = False) -> DataFrame:
    """One item per character window of every document.

    With ``embedded`` each item also carries a vector, found by an equi-join on
    its number modulo the number of vectors.
    """
    windows = char_windows(document_rows(spark, base), "text", ITEM_COLUMNS)
    content = text.strip(F.col("chunk_text"))
    items = (windows.select((F.col("doc_id") * IDS_PER_DOC + F.col("chunk_index")).alias("id"),
                            *ITEM_COLUMNS, "chunk_index", "chunk_total", content.alias("content"))
             .filter(F.col("content") != ""))
    if not embedded:
        return items
    vectors = read(spark, base, "embeddings").select("vec_id", "embedding")
    count = read(spark, base, "embeddings").agg(F.count(F.lit(1)).alias("n")).scalar()
    slot = F.pmod(F.col("doc_id") * 7 + F.col("chunk_index"), count)
    return items.withColumn("vec_id", slot).join(vectors, "vec_id").drop("vec_id")


def retrieval_queries(spark: SparkSession, base: str) -> DataFrame:
    """One query per benchmark passage with the vector of its number modulo their count.

    Two in four name a session and one of those a project too.
    """
    i = F.col("item_id")
    vectors = read(spark, base, "embeddings").select("vec_id", "embedding")
    count = vectors.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (read(spark, base, "benchmark").withColumn("vec_id", F.pmod("item_id", count))
            .join(vectors, "vec_id")
            .select(i.alias("query_id"), tenant(i).alias("user_id"),
                    F.when(i % 8 >= 4, session_name(i)).alias("session_id"),
                    F.when(i % 8 >= 6, session_name(i)).alias("project"),
                    F.col("text").alias("query_text"), "embedding"))


def l1_messages(spark: SparkSession, base: str) -> DataFrame:
    """Working-memory messages in arrival order, a minute apart within a session."""
    c, t = F.col("conv_id"), F.col("turn")
    seq = c * TURNS_PER_CONVERSATION + t
    return read(spark, base, "conversations").select(
        (-seq - 1).alias("id"), tenant(c).alias("user_id"), session_name(c).alias("session_id"),
        seq.alias("seq"), "role", text.strip(F.col("text")).alias("content"),
        F.when(F.col("role") == "system", 0.9).otherwise(0.5).alias("importance"),
        (F.col("role") == "system").alias("is_pinned"),
        (as_of() - F.make_dt_interval((c % 30).cast("int"), F.lit(0), (t * 7 % 60).cast("int")))
        .alias("created_at"),
    ).filter(F.col("content") != "")


def tasks(spark: SparkSession, base: str) -> DataFrame:
    status = (F.when(F.col("o_orderstatus") == "O", "pending")
              .when(F.col("o_orderstatus") == "P", "in_progress")
              .when(F.col("o_orderkey") % 10 == 0, "cancelled").otherwise("done"))
    rank = F.substring("o_orderpriority", 1, 1)
    priority = F.when(rank.isin("1", "2"), "high").when(rank == "3", "medium").otherwise("low")
    return read(spark, base, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"),
        F.col("o_orderpriority").alias("description"), status.alias("status"),
        priority.alias("priority"), session_name(F.col("o_orderkey")).alias("project"),
        F.col("o_orderdate").alias("created_at"))


def skills(spark: SparkSession, base: str) -> DataFrame:
    p = F.col("p_partkey")
    name = F.concat(F.initcap("p_name"), F.lit(" #"), p.cast("string"))
    return read(spark, base, "part").select(
        p.alias("id"), name.alias("name"), text.skill_slug(name).alias("slug"),
        F.col("p_type").alias("description"),
        F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("content"),
        F.col("p_brand").alias("project"), tenant(p).alias("user_id"),
        days_before(p % 365).alias("created_at"))


def access_events(spark: SparkSession, base: str) -> DataFrame:
    """User events, with the document each one refers to."""
    return read(spark, base, "events").select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("actor"), "event_type",
        F.col("ts").cast("timestamp").alias("ts"), "value", "props")
