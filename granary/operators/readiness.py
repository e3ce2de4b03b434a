"""What a project still lacks: preflight counts, progress of jobs, uploads, companions, gates between versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.operators.protein import GROUPS, OUTSIDE
from granary.operators.review import priority, weight

#: Samples of reasons that a preflight shows, and contributors of each side.
SAMPLES, CONTRIBUTORS = 10, 10
INGREDIENTS = "array<struct<food_group:string,subgroup:string,ingredient_weight_kg_per_item:string>>"


def yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def samples(rows: DataFrame, order: Column) -> DataFrame:
    """rank, product_id, reasons of the first products that aren't ready."""
    short = rows.filter("not ready").orderBy(order, "product_id").limit(SAMPLES)
    return short.select(F.row_number().over(Window.orderBy(order, "product_id")).alias("rank"), "product_id", "reasons")  # of ten rows


def protein_states(products: DataFrame) -> DataFrame:
    """Each product with has_volume, has_weight, has_protein, has_split, classified, ready and reasons.

    products: product_id, items_purchased, weight_per_item_kg, protein_pct, plant_protein_pct, animal_protein_pct and pt_group (null without a
    classification), joined with their chosen enrichment (e_value, e_plant, e_animal).
    """
    c = F.col
    own, found = c("protein_pct").isNotNull(), c("protein_pct").isNull() & c("e_value").isNotNull()
    split = (c("plant_protein_pct").isNotNull() & c("animal_protein_pct").isNotNull()) | (found & c("e_plant").isNotNull() & c("e_animal").isNotNull())
    rows = products.withColumns({"classified": c("pt_group").isNotNull(), "has_volume": yes(c("items_purchased") > 0), "has_weight": yes(c("weight_per_item_kg") > 0), "has_protein": own | found, "has_split": split})
    ready = c("has_volume") & c("has_weight") & c("has_protein") & yes(c("pt_group") != "unknown")
    lacks = [(~c("has_volume"), "no volume"), (~c("has_weight"), "no weight"), (~c("has_protein"), "no protein data"), (c("pt_group") == "unknown", "classification=unknown")]
    reasons = F.when(~c("classified"), F.array(F.lit("missing classification"))).otherwise(F.array_compact(F.array(*[F.when(h, F.lit(t)) for h, t in lacks])))
    return rows.withColumns({"ready": ready & c("classified"), "reasons": reasons})


def protein_preflight(states: DataFrame) -> DataFrame:
    """One row of counts over protein_states. What a product without classification has counts for volume and weight alone."""
    c, n, known = F.col, F.count_if, F.col("classified")
    return states.agg(
        F.count("*").alias("total_products"), n(known).alias("classified_products"), n("has_volume").alias("products_with_volume"), n("has_weight").alias("products_with_weight"),
        n(known & c("has_protein")).alias("products_with_total_protein"), n(known & c("has_split")).alias("products_with_plant_animal_split"), n("ready").alias("products_ready_for_calculation"),
        n(known & ~c("ready") & ~c("has_protein")).alias("products_missing_nutrition"), n(known & ~c("ready") & ~(c("has_volume") & c("has_weight"))).alias("products_missing_volume_or_weight"),
        n(~known).alias("products_missing_classification"), n(yes(c("pt_group").isin(OUTSIDE))).alias("products_out_of_scope"),
    )


def food_states(products: DataFrame) -> DataFrame:
    """As protein_states, for food groups: product_id, weight_per_item_kg and food_group (null without a classification)."""
    c = F.col
    usable = yes(c("food_group").rlike("^FG[1-7]$"))
    rows = products.withColumns({"classified": c("food_group").isNotNull(), "has_weight": yes(c("weight_per_item_kg") > 0), "usable": usable})
    lacks = F.array_compact(F.array(F.when(~c("usable"), "classification unknown or out of scope"), F.when(~c("has_weight"), "no weight")))
    return rows.withColumns({"ready": c("usable") & c("has_weight"), "reasons": F.when(~c("classified"), F.array(F.lit("missing classification"))).otherwise(lacks)})


def food_preflight(states: DataFrame) -> DataFrame:
    """One row of counts over food_states. Weight stands for volume; nutrition isn't needed."""
    c, n, known = F.col, F.count_if, F.col("classified")
    return states.agg(
        F.count("*").alias("total_products"), n(known).alias("classified_products"), n("has_weight").alias("products_with_volume"), n("has_weight").alias("products_with_weight"), n("ready").alias("products_ready_for_calculation"),
        n(known & ~c("ready") & ~c("has_weight")).alias("products_missing_volume_or_weight"), n(~known).alias("products_missing_classification"), n(yes(c("food_group") == "out_of_scope")).alias("products_out_of_scope"),
    )


def progress(products: DataFrame, classifications: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row of a job's counters over its upload's products (product_id), protein classifications and review items (product_id, reason)."""
    mine = products.select("product_id").distinct()
    group = F.col("pt_group")
    known = mine.join(classifications, "product_id").agg(F.count_if(group != "unknown").alias("categorized_total"), F.count_if(group == "unknown").alias("unknown_total"), F.count_if(group == "out_of_scope").alias("out_of_scope_total"))
    held = reviews.join(mine, "product_id", "left_semi").agg(F.count("*").alias("review_required_total"), F.count_if(F.col("reason").isin("ai_parse_failed", "ai_provider_error")).alias("failed_total"))
    return known.crossJoin(held).withColumn("accepted_total", F.greatest(F.lit(0), F.col("categorized_total") - F.col("review_required_total")))  # one row each


def upload_totals(uploads: DataFrame) -> DataFrame:
    """Totals over the uploads that have a validation report (total_rows, rows_with_errors, error_count, warning_count); null before the first."""
    seen = uploads.filter("total_rows is not null")
    sums = seen.agg(F.sum("total_rows").alias("total_uploaded"), F.sum(F.col("total_rows") - F.col("rows_with_errors")).alias("total_valid"), F.sum("error_count").alias("total_errors"), F.sum("warning_count").alias("total_warnings"))
    return sums.withColumn("invalid_rows", F.col("total_uploaded") - F.col("total_valid"))


def same_upload(uploads: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted (project_id, checksum) the newest upload with that content: upload_id, created_at; null if there is none."""
    newest = uploads.groupBy("project_id", "checksum").agg(F.max_by(F.struct("upload_id", "created_at"), F.struct("created_at", "upload_id")).alias("x"))
    return wanted.join(newest, ["project_id", "checksum"], "left").select("project_id", "checksum", "x.upload_id", "x.created_at")


def review_list(queue: DataFrame, products: DataFrame, classifications: DataFrame, level: str | None = None) -> DataFrame:
    """Queued items with their product and, where there is one, its classification under the item's methodology; level keeps one computed priority."""
    rows = queue.join(products, "product_id").join(classifications, ["product_id", "methodology"], "left")
    rows = rows.withColumn("priority", priority(weight(F.col("reason"))))
    return rows.filter(F.col("priority") == level) if level else rows


def in_run(products: DataFrame, rows: DataFrame) -> DataFrame:
    """The products that a run has rows of."""
    return products.join(rows, "product_id", "left_semi")


def named(rows: DataFrame, products: DataFrame) -> DataFrame:
    """Rows with product_name and retailer_category; a product that is gone is called by the first eight characters of its id."""
    joined = rows.join(products.select("product_id", "product_name", "retailer_category"), "product_id", "left")
    return joined.withColumn("product_name", F.coalesce("product_name", F.concat(F.lit("Produit "), F.substring(F.col("product_id").cast("string"), 1, 8))))


def food_side(group: Column, is_composite: Column, bucket: Column, subgroup: Column, animal: list[str]) -> Column:
    """positive, watchout or null: composites by their bucket, then food groups; dairy, fats, FG6 and an unknown FG1 are on neither side."""
    composite = F.when(bucket.isin("vegan", "vegetarian"), "positive").when(bucket.isin("meat_based", "seafood_based"), "watchout")
    whole = F.when((group == "FG1") & subgroup.isNotNull(), F.when(subgroup.isin(animal), "watchout").otherwise("positive")).when(group.isin("FG4", "FG5"), "positive").when(group == "FG7", "watchout")
    return F.when(yes(is_composite) & bucket.isNotNull(), composite).otherwise(whole)


def food_contributors(rows: DataFrame, animal: list[str], k: int = CONTRIBUTORS) -> DataFrame:
    """The k heaviest rows in scope of each side, then by product id."""
    side = food_side(F.col("food_group"), F.col("is_composite"), F.col("bucket"), F.col("subgroup"), animal)
    found = rows.filter("in_scope and weight_kg > 0").withColumn("side", side).filter("side is not null")
    order = Window.partitionBy("side").orderBy(F.desc("weight_kg"), "product_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def workbook_protein(rows: DataFrame) -> DataFrame:
    """label, kg: protein by group in reporting order, groups without any left out, then the plant and the animal sum; half-even to one place."""
    known = rows.filter("total_kg is not null")
    label = F.coalesce("pt_group", F.lit("unknown"))
    by = known.groupBy(label.alias("label")).agg(F.sum(F.col("total_kg").cast("double")).alias("kg")).filter(F.col("label").isin(*GROUPS, *OUTSIDE) & (F.col("kg") != 0))
    sides = known.agg(*[F.coalesce(F.sum(F.col(f"{s}_kg").cast("double")), F.lit(0.0)).alias(s) for s in ("plant", "animal")])
    two = sides.select(F.inline(F.array(*[F.struct(F.lit(s).alias("label"), F.col(s).alias("kg")) for s in ("plant", "animal")])))
    return by.unionByName(two).withColumn("kg", F.bround("kg", 1))


def assumed_split(products: DataFrame) -> DataFrame:
    """product_id, nutrient, value: the split that a classification implies where a reference gives the total (value) alone.

    All plant for plant groups, all animal for the animal core, none for composites and what isn't classified.
    """
    plant = F.when(F.col("pt_group").startswith("plant_based"), F.col("value")).when(F.col("pt_group") == "animal_core", F.lit(0))
    animal = F.when(F.col("pt_group").startswith("plant_based"), F.lit(0)).when(F.col("pt_group") == "animal_core", F.col("value"))
    both = F.array(*[F.struct(F.lit(f"{n}_protein_pct").alias("nutrient"), v.cast("double").alias("value")) for n, v in (("plant", plant), ("animal", animal))])
    return products.withColumn("x", both).filter(plant.isNotNull()).select("product_id", F.inline("x"))


def specificity(tokens1: Column, tokens2: Column) -> Column:
    """Which of two names says more: the one whose words are a proper superset of the other's; null if neither."""
    above = lambda a, b: (F.size(F.array_except(b, a)) == 0) & (F.size(F.array_distinct(a)) > F.size(F.array_distinct(b)))
    return F.when(above(tokens2, tokens1), "v2_more_specific").when(above(tokens1, tokens2), "v1_more_specific")


def gates(metrics: DataFrame) -> DataFrame:
    """Whether version 2 may replace version 1 by (accuracy, wrong_accepted of both, v2_unknown_readable), and for references by false positives and forbidden ones."""
    c = F.col
    forbidden = (c("forbidden_total") == 0) | (c("forbidden_rejected") == c("forbidden_total"))
    tests = {"v2_accuracy_ge_v1": c("v2_accuracy") >= c("v1_accuracy"), "v2_wrong_accepted_le_v1": c("v2_wrong_accepted") <= c("v1_wrong_accepted"), "unknown_readable_zero": c("v2_unknown_readable") == 0}
    tests |= {"high_confidence_false_positives_zero": c("false_positive_count") == 0, "forbidden_rejection_100": forbidden}
    out = metrics.select("*", *[yes(t).alias(k) for k, t in tests.items()])
    return out.withColumn("passed", F.forall(F.array(*tests), lambda x: x))


def companion_checks(companions: DataFrame, products: DataFrame) -> DataFrame:
    """What is wrong with each product's entry in companions (json: a map of product ids), and its residual weight.

    products: external_product_id, weight_per_item_kg, is_own_brand, enabled, food_group (null if not classified), is_composite. Returns
    external_product_id, error (null if none), ingredient_count, attributed_kg, overweight (an own brand's parts weigh more
    than it does), residual_kg (of own brands: what is left, 0 if overweight).
    """
    raw = companions.select(F.explode(F.from_json("json", "map<string,string>")).alias("external_product_id", "entry"))
    c = F.col
    listed = F.get_json_object("entry", "$.ingredients")
    rows = raw.select("external_product_id", "entry", listed.alias("listed"), F.from_json(listed, INGREDIENTS).alias("items")).join(products, "external_product_id", "left")
    error = (
        F.when(c("enabled").isNull(), "unknown_product")
        .when(~yes(c("entry").startswith("{")), "not_object")
        .when(c("listed").isNull(), "missing_ingredients")
        .when(~c("listed").startswith("["), "not_list")
        .when(F.size("items") == 0, "empty_list")
        .when(~c("enabled"), "not_enabled")
        .when(c("food_group").isNull(), "unclassified")
        .when(~yes(c("is_composite")), "not_composite")
    )
    kg = F.transform("items", lambda x: F.coalesce(x["ingredient_weight_kg_per_item"].try_cast("decimal(18,8)"), F.lit(0).cast("decimal(18,8)")))
    total = F.aggregate(kg, F.lit(0).cast("decimal(28,8)"), lambda a, x: (a + F.when(x > 0, x).otherwise(0)).cast("decimal(28,8)"))
    out = rows.withColumn("error", error).withColumn("attributed_kg", F.when(error.isNull(), total).otherwise(F.lit(0).cast("decimal(28,8)")))
    over = c("is_own_brand") & (c("attributed_kg") > c("weight_per_item_kg"))
    residual = F.when(c("error").isNull() & c("is_own_brand"), F.greatest(F.lit(0).cast("decimal(28,8)"), c("weight_per_item_kg").cast("decimal(28,8)") - c("attributed_kg")))
    return out.select("external_product_id", "error", F.greatest(F.lit(0), F.coalesce(F.size("items"), F.lit(0))).alias("ingredient_count"), "attributed_kg", (c("error").isNull() & yes(over)).alias("overweight"), residual.alias("residual_kg"))
