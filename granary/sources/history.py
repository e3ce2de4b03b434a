"""Tables with versions: appended parts that count from the moment they are marked, and what was known at a time.

A version is a folder of Parquet files that Spark writes and a marker that is written
after it, with the time and a summary. A job that dies in between leaves readers the table as
it was; writing the same version again replaces what it left. Nothing is changed or deleted afterwards: a row
that replaces another, or a key that is gone, is a new row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COMMITS = "version string, at timestamp, rows long, summary string"


def stage(rows: DataFrame, path: str, version: str, partition_by: list[str] = []) -> None:  # noqa: B006
    """Write a version's rows. Without a marker nobody sees them."""
    rows.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{path}/data/version={version}")


def commit(spark: SparkSession, path: str, version: str, at: str, summary: dict[str, str] | None = None) -> None:
    """Mark a version that was staged, in one file. A version that is marked already stays as it is."""
    if not commits(spark, path).filter(F.col("version") == version).isEmpty():
        return
    rows = spark.read.parquet(f"{path}/data/version={version}").count()
    texts = F.to_json(F.create_map(*[F.lit(x) for kv in sorted((summary or {}).items()) for x in kv])) if summary else F.lit("{}")
    marker = spark.range(1).select(F.lit(version).alias("version"), F.lit(at).cast("timestamp").alias("at"), F.lit(rows).cast("long").alias("rows"), texts.alias("summary"))
    marker.coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/of={version}")


def append(rows: DataFrame, path: str, version: str, at: str, summary: dict[str, str] | None = None, partition_by: list[str] = []) -> None:  # noqa: B006
    """Stage and mark. A version that is marked is never written again."""
    spark = rows.sparkSession
    if commits(spark, path).filter(F.col("version") == version).isEmpty():
        stage(rows, path, version, partition_by)
        commit(spark, path, version, at, summary)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def commits(spark: SparkSession, path: str, as_of: str | None = None) -> DataFrame:
    """version, at, rows, summary of what is marked, until a time (itself included). An unfinished marker has no rows."""
    if not exists(spark, f"{path}/commits"):
        return spark.createDataFrame([], COMMITS)
    found = spark.read.schema(COMMITS).parquet(f"{path}/commits").select("version", "at", "rows", "summary")
    return found.filter(F.col("at") <= F.lit(as_of).cast("timestamp")) if as_of else found


def read(spark: SparkSession, path: str, schema: str, as_of: str | None = None) -> DataFrame:
    """The rows of all marked versions with version and at (the marker's); only their folders are read."""
    marked = commits(spark, path, as_of).select("version", "at")
    if not exists(spark, f"{path}/data"):
        return spark.createDataFrame([], f"{schema}, version string, at timestamp")
    rows = spark.read.schema(f"{schema}, version string").option("basePath", f"{path}/data").parquet(f"{path}/data")
    return rows.join(F.broadcast(marked), "version")  # one row a version


def latest(history: DataFrame, keys: list[str], deleted: str | None = None) -> DataFrame:
    """The newest row of each key (by at, then version); keys whose newest row is marked as deleted are gone."""
    order = Window.partitionBy(*keys).orderBy(F.desc("at"), F.desc("version"))
    rows = history.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")
    return rows.filter(~F.coalesce(F.col(deleted), F.lit(False))) if deleted else rows


def latest_sets(history: DataFrame, owner: list[str]) -> DataFrame:
    """All rows of each owner's newest version: a version replaces an owner's rows as a whole."""
    newest = history.groupBy(*owner).agg(F.max(F.struct("at", "version")).alias("newest"))
    return history.join(newest, owner).filter((F.col("at") == F.col("newest.at")) & (F.col("version") == F.col("newest.version"))).drop("newest")
