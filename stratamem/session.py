"""Session helpers: a tuned local session, scratch locations and size checks."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Query blocks up to this many rows are shipped to every task; larger sets are
# processed block by block.
MAX_BLOCK_ROWS = 4096
# Spark then removes the shuffle files of a query at its end, not when the driver happens to collect its garbage.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# The tables written since settle began.
_passing: ContextVar[list[DataFrame] | None] = ContextVar("passing", default=None)


def local_session(cpus: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("stratamem")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        # Small shuffles of costly rows should still use every core.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only where the setting is absent and the session is local is a temporary
    folder chosen and recorded in the setting.
    """
    configured = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", ""
    )
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    chosen = tempfile.mkdtemp(prefix="stratamem-")
    spark.conf.set("spark.checkpoint.dir", chosen)
    return chosen


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def _freed_shuffles(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_FREE_SHUFFLES, "false")
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)


def write_table(df: DataFrame, path: str) -> None:
    """Write ``df`` to ``path``, which must not exist; the shuffles behind it go as soon as it is written."""
    with _freed_shuffles(df.sparkSession):
        df.write.mode("errorifexists").parquet(path)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, cutting its lineage.

    The written table survives the loss of executors, unlike cached blocks; the shuffles
    behind it go as soon as it is written.
    """
    path = scratch_path(df.sparkSession, label)
    write_table(df, path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.scratch = path
    if (passing := _passing.get()) is not None:
        passing.append(table)
    return table


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``materialize`` wrote and that nothing reads any more."""
    for table in tables:
        remove(table.sparkSession, table.scratch)


def settle(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """``materialize`` what ``make`` returns, and remove the tables that were written for it."""
    mark = _passing.set([])
    try:
        table = materialize(make(), label)
        passing = _passing.get()
    finally:
        _passing.reset(mark)
    discard(*passing[:-1])
    if (outer := _passing.get()) is not None:
        outer.append(table)
    return table


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    folder, system = _folder(spark, path)
    return system.exists(folder)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the engine's own, wherever it is stored; nothing happens if it is absent."""
    folder, system = _folder(spark, path)
    system.delete(folder, True)


def env_cpus(default: int = 8) -> int:
    return int(os.environ.get("BENCH_CPUS", default))
