"""Plant and animal protein of purchases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.numeric import q8, share_pct

#: The groups of the methodology, in reporting order, and the two outside it.
GROUPS = ["plant_based_core", "plant_based_non_core", "composite_products", "animal_core"]
OUTSIDE = ["out_of_scope", "unknown"]
#: Fixed value: a split is used if its sum differs from the protein by so much at most.
TOLERANCE = "0.0001"


def resolved(products: DataFrame, enrichment: DataFrame | None = None) -> DataFrame:
    """Fill missing protein from enrichment (product_id, protein_pct, source[, plant_protein_pct, animal_protein_pct]).

    Adds protein_origin: own, the enrichment's source, or null if nothing is known.
    """
    own = products
    for c in ("plant_protein_pct", "animal_protein_pct"):
        if c not in own.columns:
            own = own.withColumn(c, F.lit(None).cast("decimal(18,10)"))
    if enrichment is None:
        return own.withColumn("protein_origin", F.when(F.col("protein_pct").isNotNull(), "own"))
    extra = enrichment.select(F.col("product_id"), F.col("protein_pct").alias("e_pct"), F.col("source").alias("e_source"), *[F.col(c).alias(f"e_{c}") if c in enrichment.columns else F.lit(None).cast("decimal(18,10)").alias(f"e_{c}") for c in ("plant_protein_pct", "animal_protein_pct")])
    joined = own.join(extra, "product_id", "left").withColumn("protein_origin", F.when(F.col("protein_pct").isNotNull(), "own").otherwise(F.col("e_source")))
    unsplit = F.col("plant_protein_pct").isNull() & F.col("animal_protein_pct").isNull() & F.col("protein_pct").isNull()
    for c in ("plant_protein_pct", "animal_protein_pct"):
        joined = joined.withColumn(f"n_{c}", F.when(unsplit, F.col(f"e_{c}")).otherwise(F.col(c)))
    joined = joined.drop("plant_protein_pct", "animal_protein_pct").withColumnsRenamed({"n_plant_protein_pct": "plant_protein_pct", "n_animal_protein_pct": "animal_protein_pct"})
    return joined.withColumn("protein_pct", F.coalesce("protein_pct", "e_pct")).drop("e_pct", "e_source", "e_plant_protein_pct", "e_animal_protein_pct")


def part_of(volume: Column, pct: Column) -> Column:
    return q8(volume.cast("decimal(18,8)") * pct.cast("decimal(18,10)") / 100)


def run_rows(products: DataFrame, split: bool = True, tolerance: str = TOLERANCE) -> DataFrame:
    """Volume and protein of each row with known protein, rounded half-even to eight places before anything is summed.

    Needs pt_group, items_purchased, weight_per_item_kg, protein_pct and the two split percentages.
    """
    volume = q8(F.col("items_purchased").cast("decimal(18,2)") * F.col("weight_per_item_kg").cast("decimal(18,14)"))
    rows = products.filter(F.col("protein_pct").isNotNull()).withColumn("volume_kg", volume)
    in_scope = F.col("pt_group").isin(GROUPS)
    rows = rows.withColumn("in_scope", in_scope).withColumn("full_protein_kg", part_of(F.col("volume_kg"), F.col("protein_pct")))
    fits = F.abs(F.col("plant_protein_pct") + F.col("animal_protein_pct") - F.col("protein_pct")) <= F.lit(tolerance).cast("decimal(10,6)")
    used = F.lit(split) & (F.col("pt_group") == "composite_products") & F.coalesce(fits, F.lit(False))
    return (
        rows.withColumn("used_split", used)
        .withColumn("plant_protein_kg", F.when(used, part_of(F.col("volume_kg"), F.col("plant_protein_pct"))))
        .withColumn("animal_protein_kg", F.when(used, part_of(F.col("volume_kg"), F.col("animal_protein_pct"))))
        .withColumn("protein_kg", F.when(in_scope, F.col("full_protein_kg")).otherwise(F.lit(0).cast("decimal(28,8)")))
    )


def group_totals(rows: DataFrame) -> DataFrame:
    """pt_group, volume_kg, protein_kg, item_count: always the four groups, zeros where nothing was bought."""
    spark = rows.sparkSession
    spine = spark.createDataFrame([(k, g) for k, g in enumerate(GROUPS)], "group_order int, pt_group string")
    sums = rows.filter("in_scope").groupBy("pt_group").agg(F.sum("volume_kg").alias("volume_kg"), F.sum("full_protein_kg").alias("protein_kg"), F.count("*").alias("item_count"))
    zero = F.lit(0).cast("decimal(38,8)")
    joined = F.broadcast(spine).join(sums, "pt_group", "left")  # four rows
    return joined.select("group_order", "pt_group", F.coalesce("volume_kg", zero).alias("volume_kg"), F.coalesce("protein_kg", zero).alias("protein_kg"), F.coalesce("item_count", F.lit(0)).alias("item_count"))


def headline(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Plant and animal protein and their shares: unsplit composites count half and half. Null shares without protein."""
    total = lambda holds, c: F.coalesce(F.sum(F.when(holds, F.col(c))), F.lit(0)).cast("decimal(38,8)")
    group = F.col("pt_group")
    sums = rows.groupBy(*keys).agg(
        total(group.isin("plant_based_core", "plant_based_non_core"), "full_protein_kg").alias("p"),
        total(group == "animal_core", "full_protein_kg").alias("a"),
        total(F.col("used_split"), "plant_protein_kg").alias("sp"),
        total(F.col("used_split"), "animal_protein_kg").alias("sa"),
        total((group == "composite_products") & ~F.col("used_split"), "full_protein_kg").alias("pool"),
    )
    half = q8(F.col("pool").cast("decimal(28,8)") * F.lit("0.5").cast("decimal(2,1)"))
    out = sums.select(*keys, q8(F.col("p") + F.col("sp") + half).alias("plant_protein_kg"), q8(F.col("a") + F.col("sa") + half).alias("animal_protein_kg"))
    whole = F.col("plant_protein_kg") + F.col("animal_protein_kg")
    return out.withColumn("total_protein_kg", q8(whole)).withColumn("plant_share_pct", share_pct(F.col("plant_protein_kg"), whole)).withColumn("animal_share_pct", share_pct(F.col("animal_protein_kg"), whole))


def counters(products: DataFrame, rows: DataFrame) -> DataFrame:
    """One row of quality counts. Rows without protein are skipped before the scope counts, as in the run itself."""
    c = lambda holds: F.count_if(F.coalesce(holds, F.lit(False)))
    own = F.col("protein_origin") == "own"
    counts = rows.agg(
        c(own & (F.col("protein_source") == "label")).alias("rows_label"),
        c(own & (F.coalesce("protein_source", F.lit("")) != "label")).alias("rows_reference"),
        c(F.col("pt_group") == "out_of_scope").alias("out_of_scope_count"),
        c(F.col("pt_group") == "unknown").alias("unknown_count"),
        c(~own).alias("enriched_count"),
        c(F.col("used_split")).alias("rows_with_split"),
    )
    return counts.crossJoin(products.agg(c(F.col("protein_pct").isNull()).alias("missing_protein_count")))  # one row each
