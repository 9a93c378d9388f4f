"""Tables kept in buckets of their key: folds and lookups that move requests, never the log.

A log of changes is written once, hashed by key into a fixed number of buckets. Folding it to
the newest state needs no shuffle, since all changes of a key lie in one bucket, and a lookup
joins bucket by bucket: only the requests travel to where their keys are.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamem.session import scratch_path

FOUND, DENIED, MISSING = "found", "denied", "missing"


@dataclass(frozen=True)
class KeyedLog:
    """Changes of one kind of record: ``key``, ``owner``, ``seq`` and its other columns."""

    table: str
    spark: SparkSession
    key: str
    seq: str

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def newest(self) -> DataFrame:
        """The newest change of every key; no row of the log leaves its bucket."""
        rows = self.rows()
        rest = [c for c in rows.columns if c != self.key]
        folded = rows.groupBy(self.key).agg(F.max_by(F.struct(*rest), self.seq).alias("_row"))
        return folded.select(self.key, *[F.col(f"_row.{c}").alias(c) for c in rest])

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def write_keyed(rows: DataFrame, key: str, seq: str = "seq", buckets: int | None = None, path: str | None = None) -> KeyedLog:
    """Write a log in buckets of its key, below the shared folder unless ``path`` says otherwise."""
    spark = rows.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"stratamem_keyed_{uuid.uuid4().hex}"
    # Partitioned as the buckets are, every task writes whole buckets: one file each.
    (rows.repartition(n, key).write.format("parquet").bucketBy(n, key).sortBy(key)
     .option("path", path or scratch_path(spark, "keyed")).saveAsTable(name))
    return KeyedLog(name, spark, key, seq)


def lookup(log: KeyedLog, requests: DataFrame, key: str = "key", user: str = "user_id", owner: str = "owner",
           public: Column | None = None) -> DataFrame:
    """Each request with the outcome and, where it is found, the newest record's columns.

    A record is found by its owner alone, or by anyone where ``public`` (over the record's
    columns) holds; to others it is denied and shows nothing. Requests of one key may repeat.
    """
    records = log.newest().withColumnRenamed(log.key, "_key")
    held = [c for c in records.columns if c != "_key"]
    records = records.withColumn("_there", F.lit(True))
    joined = requests.join(records, F.col(key) == F.col("_key"), "left")
    mine = F.coalesce(F.col(owner) == F.col(user), F.lit(False))
    mine = mine if public is None else mine | F.coalesce(public, F.lit(False))
    outcome = F.when(F.col("_there").isNull(), MISSING).when(mine, FOUND).otherwise(DENIED)
    shown = [F.when(F.col("outcome") == FOUND, F.col(c)).alias(c) for c in held]
    return joined.withColumn("outcome", outcome).select(*[requests[c] for c in requests.columns], "outcome", *shown)
