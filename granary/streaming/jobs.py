"""Jobs that advance chunk by chunk, stop at a cancel flag, and go on where they stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.sources import history

CONTROL = "cancel boolean"


class Cancelled(Exception):
    """A chunk that wasn't begun because its job was cancelled."""


def control(spark: SparkSession, path: str, cancel: bool, at: str) -> None:
    """Ask a job to stop, or let it go on; the newest word counts."""
    rows = spark.createDataFrame([(cancel,)], CONTROL)
    n = history.commits(spark, f"{path}/control").count()
    history.append(rows, f"{path}/control", f"c{n:09d}", at)


def cancelled(spark: SparkSession, path: str) -> bool:
    said = history.read(spark, f"{path}/control", CONTROL).orderBy(F.desc("version")).limit(1).collect()
    return bool(said and said[0].cancel)


def progress(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """outcome, n of all chunks that are done: sums over marked chunks, so a chunk that ran twice counts once."""
    return history.read(spark, f"{path}/results", schema).groupBy("outcome").agg(F.count("*").alias("n"))


def advance(stream: DataFrame, path: str, step: Callable[[DataFrame], DataFrame], now: Callable[[], str], name: str = "job") -> str:
    """Process what is pending, a chunk at a time, and return done or cancelled.

    `step` gives a chunk's results with a column outcome; they become a version of the table under path/results. Before each chunk the
    control table is read. A chunk that was cut off is done again by the next call, and its version replaces what was left of it.
    """
    spark = stream.sparkSession

    def chunk(batch: DataFrame, number: int) -> None:
        if cancelled(spark, path):
            raise Cancelled
        history.append(step(batch), f"{path}/results", f"b{number:09d}", now())

    query = stream.writeStream.queryName(name).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(chunk).start()
    try:
        query.awaitTermination()
    except StreamingQueryException:
        if cancelled(spark, path):
            return "cancelled"
        raise
    return "done"
