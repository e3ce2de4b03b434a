"""Choice among enrichment records, group averages and the cascade of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.operators import matching
from granary.session import materialize

#: Which source wins.
PRIORITY = {"manual": 0, "reference_a": 1, "reference_b": 2, "category_average": 3}
#: Grams of protein in 100 g that a group has on average.
CATEGORY_AVERAGE = {"plant_based_core": 15.0, "plant_based_non_core": 12.0, "composite_products": 10.0, "animal_core": 18.0}
#: How far such an average is trusted.
CATEGORY_CONFIDENCE = {"plant_based_core": 0.60, "plant_based_non_core": 0.60, "composite_products": 0.50, "animal_core": 0.60}


def priority(source: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv]), source), F.lit(len(PRIORITY)))


def category_averages(spark: SparkSession) -> DataFrame:
    """pt_group, nutrient, value, unit, confidence of each group that has an average."""
    rows = [(g, "protein_pct", v, "g_per_100g", CATEGORY_CONFIDENCE[g]) for g, v in CATEGORY_AVERAGE.items()]
    return spark.createDataFrame(rows, "pt_group string, nutrient string, value double, unit string, confidence double")


def eligible(records: DataFrame) -> DataFrame:
    """Records that may be chosen: enriched ones (where a status is given) with a value."""
    found = records.filter(F.col("value").isNotNull())
    return found.filter(F.col("status") == "enriched") if "status" in records.columns else found


def best_record(records: DataFrame, keys: tuple[str, ...] = ("product_id",)) -> DataFrame:
    """One eligible record for each key: the best source, then the newest (created_at), then the smallest record_id."""
    records = eligible(records)
    order = Window.partitionBy(*keys).orderBy(priority(F.col("source")), F.desc("created_at"), "record_id")
    return records.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def with_siblings(best: DataFrame, records: DataFrame, nutrients: tuple[str, ...] = ("plant_protein", "animal_protein")) -> DataFrame:
    """Add the newest eligible value of each sibling nutrient from the source that was chosen: all of them, or none."""
    some = eligible(records).filter(F.col("nutrient").isin(*nutrients))
    newest = some.groupBy("product_id", "source").agg(*[F.max_by(F.when(F.col("nutrient") == n, F.col("value")), F.when(F.col("nutrient") == n, F.col("created_at"))).alias(n) for n in nutrients])
    whole = newest.dropna(subset=list(nutrients))
    return best.join(whole, ["product_id", "source"], "left")


def group_averages(foods: DataFrame, places: int = 4) -> DataFrame:
    """food_group, avg_value, n, and the food nearest to the average (then the smallest code): half-even to some places."""
    sums = foods.groupBy("food_group").agg(F.avg("value").alias("m"), F.count("value").alias("n"))
    apart = foods.join(sums, "food_group").withColumn("d", F.abs(F.col("value") - F.col("m")))
    return apart.groupBy("food_group").agg(F.bround(F.first("m"), places).alias("avg_value"), F.first("n").alias("n"), F.min_by("code", F.struct("d", "code")).alias("representative"))


def cascade(products: DataFrame) -> DataFrame:
    """Pick a value from columns a_value, a_family_ok, b_value, group_value: A, else B, else the group, else nothing.

    A hit in A of the wrong family fails and stops: B isn't tried.
    """
    stopped = F.col("a_value").isNotNull() & ~F.coalesce("a_family_ok", F.lit(False))
    a = F.when(~stopped, F.col("a_value"))
    source = F.when(stopped, "failed_family").when(a.isNotNull(), "reference_a").when(F.col("b_value").isNotNull(), "reference_b").when(F.col("group_value").isNotNull(), "category_average").otherwise("no_match")
    return products.withColumn("source", source).withColumn("value", F.when(~stopped, F.coalesce(a, F.col("b_value"), F.col("group_value"))))


#: How far an exact hit in the first and the second reference is trusted.
EXACT_CONFIDENCE, SECOND_CONFIDENCE = 0.85, 0.80
CASCADE = ["product_id", "stage", "outcome", "match_type", "ref_code", "value", "confidence"]


def cascaded(
    products: DataFrame, first: DataFrame, second: DataFrame, compatible: Column, heads: list[tuple[str, str, list[str]]] = [], aliases: dict[str, list[str]] = {}, averages: DataFrame | None = None  # noqa: B006
) -> DataFrame:
    """product_id, stage, outcome, match_type, ref_code, value, confidence: where each product gets its protein from. A stage takes what the one before left open.

    Products have product_id, product_name, in_scope, own_value, family and (for averages: pt_group, value, confidence) pt_group; references code, name_en,
    name_nl, value, ord, family. Stages: 0 out of scope or with a value of its own, 1 exact name in the first reference, 2 its best reference by words, 3 exact name
    in the second, 4 average of the group, 5 nothing. A hit of stage 1 or 2 of a family that isn't compatible (a condition on family and ref_family) ends
    the search: wrong nutrition is worse than none. A best reference without a value leaves a product open.
    """
    done: list[DataFrame] = []

    def take(rows: DataFrame, stage: int, outcome: Column | str, match: Column | str | None, confidence: Column | float | None) -> None:
        made = rows.withColumn("stage", F.lit(stage)).withColumn("outcome", F.lit(outcome)).withColumn("match_type", F.lit(match).cast("string")).withColumn("confidence", F.lit(confidence).cast("double"))
        for c, t in (("ref_code", "string"), ("value", "double")):
            made = made.withColumn(c, F.col(c).cast(t) if c in made.columns else F.lit(None).cast(t))
        done.append(made.select(*CASCADE))

    def guarded(rows: DataFrame, stage: int, match: str, confidence: Column | float, outcome: str) -> None:
        fits = F.coalesce(compatible, F.lit(False))
        take(rows.filter(fits), stage, outcome, match, confidence)
        take(rows.filter(~fits).select("product_id"), stage, "no_match", "family_mismatch", None)

    skip = F.when(~F.coalesce("in_scope", F.lit(False)), "skipped_out_of_scope").when(F.col("own_value").isNotNull(), "skipped_own_value")
    rows = materialize(products.withColumn("skip", skip))
    take(rows.filter("skip is not null").select("product_id", "skip"), 0, F.col("skip"), None, None)

    families = first.groupBy(F.col("code").alias("ref_code")).agg(F.first("family").alias("ref_family"))
    found = materialize(matching.exact_match(rows.filter("skip is null").drop("skip"), first).drop("matched_on"))
    guarded(found.filter("ref_code is not null").withColumn("value", F.col("ref_value")).join(families, "ref_code"), 1, "exact", EXACT_CONFIDENCE, "first_matched")

    left = found.filter("ref_code is null").drop("ref_code", "ref_value")
    asked = matching.asked_words(left.withColumnRenamed("product_id", "left_id"), [(raw, kind) for raw, kind, _ in heads], aliases)
    named = first.select(F.col("code").alias("right_id"), F.lit("first").alias("source"), F.coalesce(F.nullif(F.col("name_en"), F.lit("")), F.col("name_nl")).alias("name"), "ord")
    best = matching.shortlist(asked, matching.with_heads(named, heads), 1, "ord").select(F.col("left_id").alias("product_id"), F.col("right_id").alias("ref_code"), "overlap")
    values = first.select(F.col("code").alias("ref_code"), "value").dropDuplicates(["ref_code"])
    found = materialize(left.join(best.join(values, "ref_code").filter("value is not null"), "product_id", "left"))
    guarded(found.filter("ref_code is not null").join(families, "ref_code"), 2, "fuzzy", matching.confidence(F.col("overlap")), "first_matched")

    left = found.filter("ref_code is null").drop("ref_code", "value", "overlap")
    found = materialize(matching.exact_match(left, second).drop("matched_on"))
    take(found.filter("ref_code is not null").withColumn("value", F.col("ref_value")), 3, "second_matched", "exact", SECOND_CONFIDENCE)

    left = found.filter("ref_code is null").drop("ref_code", "ref_value")
    if averages is not None:
        found = left.join(matching.small(averages), "pt_group", "left")
        take(found.filter("value is not null"), 4, "average", "group_average", F.col("confidence"))
        left = found.filter("value is null").select("product_id")
    take(left.select("product_id"), 5, "no_match", None, None)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def status(confidence: Column) -> Column:
    """How far a value is trusted."""
    return F.when(confidence >= 0.85, "high").when(confidence >= 0.70, "medium").when(confidence >= 0.50, "low").when(confidence >= 0.30, "very_low").otherwise("none")
