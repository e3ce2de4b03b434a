"""Comparison of runs, scenarios and recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators.protein import GROUPS

#: Percentage points from which a share has moved, and fractions for food groups.
MOVED_PP, MOVED_FRACTION = 0.1, 0.001
#: Kinds of operations of a scenario.
OPERATIONS = ["shift_protein_between_groups", "increase_plant_core_protein", "reduce_animal_core_protein", "improve_composite_split"]


def direction(delta: Column, least: float) -> Column:
    return F.when(delta > least, "up").when(delta < -least, "down").otherwise("flat")


def compared(before: DataFrame, after: DataFrame, key: str, value: str, least: float = MOVED_PP) -> DataFrame:
    """Full outer join of two runs; a key that one run lacks counts 0 there."""
    a = before.select(F.col(key), F.col(value).alias("before"))
    b = after.select(F.col(key), F.col(value).alias("after"))
    return moved(a.join(b, key, "full_outer"), least)


def by_run(rows: DataFrame, key: str, value: str, run: Column, before: object, after: object) -> DataFrame:
    """key, before, after: sums of a value in two runs whose rows lie in one table, in one pass. Keys without a row in either are missing."""
    total = lambda x: F.sum(F.when(run == F.lit(x), F.col(value))).cast("double")
    return rows.filter(run.isin(before, after)).groupBy(key).agg(total(before).alias("before"), total(after).alias("after"))


def moved(joined: DataFrame, least: float = MOVED_PP) -> DataFrame:
    """Add delta and direction to before and after; a missing one counts 0."""
    joined = joined.na.fill(0, ["before", "after"])
    delta = F.col("after") - F.col("before")
    return joined.withColumn("delta", delta).withColumn("direction", direction(F.col("delta"), least))


def operation_warning() -> Column:
    """Why an operation (operation_type, from_group, to_group, amount_kg, plant_pct, animal_pct, all text) is skipped; null if it counts."""
    amount, plant, animal = (F.col(c).try_cast("decimal(28,8)") for c in ("amount_kg", "plant_pct", "animal_pct"))
    kind, outside = F.col("operation_type"), lambda c: ~F.coalesce(F.col(c).isin(GROUPS), F.lit(False))
    moved = F.when(amount.isNull(), "unparseable_amount_kg").when(amount < 0, "negative_amount_kg")
    split = F.when(plant.isNull(), "unparseable_plant_pct").when(animal.isNull(), "unparseable_animal_pct").when((plant < 0) | (animal < 0), "negative_split").when(plant + animal != 100, "split_not_100")
    return (
        F.when(~F.coalesce(kind.isin(OPERATIONS), F.lit(False)), "unknown_operation_type")
        .when((kind == OPERATIONS[0]) & outside("from_group"), "invalid_from_group")
        .when((kind == OPERATIONS[0]) & outside("to_group"), "invalid_to_group")
        .when(kind == OPERATIONS[3], split)
        .otherwise(moved)
    )


def scenario(groups: DataFrame, operations: DataFrame) -> DataFrame:
    """Apply operations to the protein of the four groups: pt_group, base_kg, projected_kg, clamped, plant_fraction.

    A shift takes amount_kg from a group to another, an increase adds it to the plant core, a reduction takes it from the animal core, a
    split sets the plant share of composites (the last one by op_order counts). Operations with a warning are skipped. Amounts
    are additive, so they are summed, and groups are held at 0 once at the end (clamped tells which).
    """
    spark = groups.sparkSession
    valid = operations.filter(operation_warning().isNull())
    kind, amount = F.col("operation_type"), F.col("amount_kg").try_cast("decimal(28,8)")
    step = lambda g, x: F.struct(g.alias("pt_group"), x.alias("d"))
    parts = F.when(kind == OPERATIONS[0], F.array(step(F.col("from_group"), -amount), step(F.col("to_group"), amount)))
    parts = parts.when(kind == OPERATIONS[1], F.array(step(F.lit("plant_based_core"), amount))).when(kind == OPERATIONS[2], F.array(step(F.lit("animal_core"), -amount)))
    deltas = valid.select(F.inline(parts)).groupBy("pt_group").agg(F.sum("d").alias("d"))
    last = valid.filter(kind == OPERATIONS[3]).agg(F.max_by(F.col("plant_pct").try_cast("decimal(28,8)"), "op_order").alias("s"))
    every = spark.createDataFrame([(g,) for g in GROUPS], "pt_group string").join(groups.select("pt_group", F.col("protein_kg").cast("decimal(28,8)").alias("base_kg")), "pt_group", "left")
    joined = every.join(deltas, "pt_group", "left").crossJoin(F.broadcast(last))  # one row
    base = F.coalesce("base_kg", F.lit(0).cast("decimal(28,8)"))
    after = base + F.coalesce("d", F.lit(0).cast("decimal(28,8)"))
    fraction = F.when(F.col("pt_group") == "composite_products", F.coalesce(F.col("s").cast("double") / 100, F.lit(0.5))).when(F.col("pt_group").startswith("plant"), 1.0).otherwise(0.0)
    return joined.select("pt_group", base.alias("base_kg"), F.greatest(F.lit(0), after).alias("projected_kg"), (after < 0).alias("clamped"), fraction.alias("plant_fraction"))


def scenario_warnings(operations: DataFrame, projected: DataFrame) -> DataFrame:
    """subject (an operation's id or a group), warning: operations that were skipped and groups that were held at 0."""
    skipped = operations.select(F.col("op_id").cast("string").alias("subject"), operation_warning().alias("warning")).filter("warning is not null")
    return skipped.unionByName(projected.filter("clamped").select(F.col("pt_group").alias("subject"), F.lit("clamped_to_zero").alias("warning")))


#: Thresholds of recommendations in percent.
LOW_PLANT, HIGH_COMPOSITE, MANY_UNKNOWN, MANY_AI = 40.0, 30.0, 5.0, 30.0


def recommendations(summary: DataFrame, methodology: str = "protein_tracker") -> DataFrame:
    """generation, action_type, priority: the actions that a summary of a run calls for, in order; the first of each type stays.

    summary, one row for each run: unknown_pct and ai_pct (null without products), uncertainty, and for protein plant_share_pct,
    composite_share_pct and missing_protein, for food groups own_composites, step2_applied, branded_composites, fg1_share_pct and
    fg1_reference_pct. A null calls for nothing.
    """
    c = F.col
    if methodology == "protein_tracker":
        rules = [
            (c("plant_share_pct") < LOW_PLANT, "increase_plant_core_share", "high"),
            (c("composite_share_pct") >= HIGH_COMPOSITE, "improve_composite_breakdown", "medium"),
            (c("missing_protein") > 0, "enrich_missing_nutrition", "medium"),
        ]
    else:
        rules = [
            ((c("own_composites") > 0) & (c("step2_applied") < c("own_composites")), "collect_step2_ingredient_data", "high"),
            (c("branded_composites") > 0, "improve_data_quality", "low"),
            ((c("fg1_share_pct") > 0) & (c("fg1_share_pct") > c("fg1_reference_pct")), "promote_legume_products", "medium"),
        ]
    uncertain = c("uncertainty") == "high"
    rules += [
        (c("unknown_pct") >= MANY_UNKNOWN, "review_high_impact_unknowns", "high"),
        (c("ai_pct") >= MANY_AI, "improve_data_quality", "medium"),
        (uncertain, "improve_data_quality", "critical"),
        (uncertain, "create_category_target", "low"),
    ]
    made = F.array_compact(F.array(*[F.when(holds, F.struct(F.lit(k).alias("generation"), F.lit(a).alias("action_type"), F.lit(p).alias("priority"))) for k, (holds, a, p) in enumerate(rules)]))
    first = F.filter(made, lambda x, i: ~F.exists(F.slice(made, F.lit(1), i), lambda y: y["action_type"] == x["action_type"]))
    return summary.select(F.inline(first))


def upserted(old: DataFrame, new: DataFrame, keys: list[str], kept_status: tuple[str, ...]) -> DataFrame:
    """New content replaces old under the same keys, but a status that was promoted stays; rows only in one of both stay."""
    a = old.select(*keys, F.col("content").alias("old_content"), F.col("status").alias("old_status"))
    b = new.select(*keys, F.col("content").alias("new_content"), F.col("status").alias("new_status"))
    joined = a.join(b, keys, "full_outer")
    status = F.when(F.col("old_status").isin(*kept_status), F.col("old_status")).otherwise(F.coalesce("new_status", "old_status"))
    return joined.select(*keys, F.coalesce("new_content", "old_content").alias("content"), status.alias("status"))
