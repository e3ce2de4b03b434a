"""Bulk changes of a table with versions: everything is checked first, then all rows are applied by one mark, or none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators.review import DECIDED, LOCK_MINUTES, SYSTEM_STATES
from granary.session import materialize
from granary.sources import history

#: Items of a bulk decision, actions, and the state that each leads to.
MOST = 100
ACTIONS = {"bulk_accept": "accepted", "bulk_defer": "deferred", "bulk_change_pt_group": "changed"}
ITEMS = "item_id long, methodology string, state string, locked_by string, locked_at timestamp, category string"


def request_error(action: str, methodology: str, to: str | None, n: int, most: int = MOST) -> str | None:
    """What is wrong with a request as a whole."""
    if not n:
        return "empty"
    if n > most:
        return "too_many"
    if action not in ACTIONS:
        return "unknown_action"
    if action == "bulk_change_pt_group":
        return "wrong_methodology" if methodology != "protein_tracker" else "missing_group" if to is None else "system_state" if to in SYSTEM_STATES else None
    return None


def item_errors(asked: DataFrame, items: DataFrame, methodology: str, me: str, at: str, action: str, to: str | None) -> DataFrame:
    """item_id, error: items that aren't there, are of the other methodology, are decided, are locked by another, or wouldn't change."""
    now = F.lit(at).cast("timestamp")
    found = asked.select("item_id").distinct().join(items, "item_id", "left")
    held = (F.col("locked_by") != me) & (F.col("locked_at") + F.expr(f"interval {LOCK_MINUTES} minutes") > now)
    error = (
        F.when(F.col("state").isNull(), "not_found").when(F.col("methodology") != methodology, "wrong_methodology").when(F.col("state").isin(DECIDED), "decided").when(held, "locked")
        .when(F.lit(action == "bulk_change_pt_group") & (F.col("category") == F.lit(to)), "same_category")
    )
    return found.select("item_id", error.alias("error")).filter("error is not null")


def decide(asked: DataFrame, path: str, version: str, action: str, methodology: str, me: str, at: str, to: str | None = None, most: int = MOST) -> DataFrame:
    """item_id, error. Without any the decision is applied to all items of the table under `path`: one version, one mark.

    A retry of an applied version finds its mark and changes nothing. A request that is wrong as a whole gives one row without an item.
    """
    spark = asked.sparkSession
    asked = materialize(asked.select("item_id").distinct())
    n = asked.limit(most + 1).count()
    none = spark.createDataFrame([], "item_id long, error string")
    if wrong := request_error(action, methodology, to, n, most):
        return spark.range(1).select(F.lit(None).cast("long").alias("item_id"), F.lit(wrong).alias("error"))
    if not history.commits(spark, path).filter(F.col("version") == version).isEmpty():
        return none
    items = history.latest(history.read(spark, path, ITEMS), ["item_id"]).drop("version", "at")
    errors = materialize(item_errors(asked, items, methodology, me, at, action, to))
    if errors.isEmpty():
        free = F.lit(None)
        category = F.lit(to) if action == "bulk_change_pt_group" else F.col("category")
        made = items.join(asked, "item_id", "left_semi").select("item_id", "methodology", F.lit(ACTIONS[action]).alias("state"), free.cast("string").alias("locked_by"), free.cast("timestamp").alias("locked_at"), category.alias("category"))
        history.append(made, path, version, at, {"action": action, "by": me, "items": str(n)})
    return errors


RECORDS = "product_id long, nutrient string, kind string, value double"


def planned(plan: DataFrame, records: DataFrame) -> DataFrame:
    """Add status and detail to a plan (product_id, value as text): error with what is wrong, skipped_existing_manual, skipped_existing_v1, skipped_existing_v2, or would_write.

    A product that has a manual record, one of version 2 or a value of version 1 of its protein keeps it.
    """
    own = records.filter("nutrient = 'protein_pct'").groupBy("product_id")
    has = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    flags = own.agg(has(F.col("kind") == "manual").alias("manual"), has(F.col("kind") == "v2").alias("v2"), has((F.col("kind") == "v1") & F.col("value").isNotNull()).alias("v1"))
    joined = plan.join(flags, "product_id", "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    number: Column = F.col("value").cast("string").try_cast("double")
    detail = F.when(F.col("product_id").isNull(), "invalid_product_id").when(number.isNull() | F.isnan(number), "invalid_value")
    status = F.when(detail.isNotNull(), "error").when(flag("manual"), "skipped_existing_manual").when(flag("v2"), "skipped_existing_v2").when(flag("v1"), "skipped_existing_v1").otherwise("would_write")
    return joined.select(*plan.columns, status.alias("status"), detail.alias("detail"))


def apply_plan(plan: DataFrame, path: str, version: str, at: str, write: bool) -> DataFrame:
    """The plan with status and detail; with `write`, rows that can be written are, by one mark, and their status is `written`.

    Rows with errors are reported and don't stop the others. A retry of a version that is marked writes nothing and reports what it wrote as written.
    """
    spark = plan.sparkSession
    records = history.read(spark, path, RECORDS).filter(F.col("version") != version)
    found = materialize(planned(plan, records))
    if not write:
        return found
    new = found.filter("status = 'would_write'").select("product_id", F.lit("protein_pct").alias("nutrient"), F.lit("v2").alias("kind"), F.col("value").cast("string").try_cast("double").alias("value"))
    history.append(new, path, version, at, {"rows": str(new.count())})
    return found.withColumn("status", F.when(F.col("status") == "would_write", "written").otherwise(F.col("status")))
