"""Session helpers that the rest of the package shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path
from weakref import WeakKeyDictionary

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(cpus: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and bound the Arrow batches by rows and bytes."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join([ROOT, *paths])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share.

    The cluster names that folder in spark.checkpoint.dir. Where it is unset, a
    local master gets a temporary folder; any other master is refused, for its
    executors wouldn't see such a folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"{tempfile.gettempdir()}/checkpoints/granary"
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    _made.add(path)
    return path


#: Folders of materialised frames, for `discard`, those written inside the caller's `scratch` block, and all that were named and not yet deleted.
_folders: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)
_made: set[str] = set()


@atexit.register
def _clear() -> None:
    """Delete what is left when the driver ends, if its session still runs; results are lazy, so no query can do it before."""
    if SparkContext._active_spark_context is not None and (spark := SparkSession.getActiveSession()) is not None:
        for path in list(_made):
            delete(spark, path)


def materialize(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = shared_folder(spark)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    if (made := _scratch.get()) is not None:
        made.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    _folders[out] = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    _made.discard(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Delete the folder of a materialised frame that nothing will read again."""
    if path := _folders.pop(df, None):
        delete(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession):
    """Delete at the end whatever this caller materialised inside; results must be written by then. Another thread's block is its own."""
    mine: list[str] = []
    token = _scratch.set(mine)
    try:
        yield
    finally:
        _scratch.reset(token)
        for path in mine:
            delete(spark, path)


def dealt(df: DataFrame) -> DataFrame:
    """A scan's rows, dealt evenly where it gives fewer tasks than there are cores (a few huge row groups, say)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
