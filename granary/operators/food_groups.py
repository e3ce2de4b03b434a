"""Weight by food group, composite buckets and the plant and animal weight of a whole diet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.numeric import q8, share_pct

#: Food groups and their share in a reference diet, in percent (none for the last).
REFERENCE_SHARE = {"FG1": 16, "FG2": 19, "FG3": 4, "FG4": 39, "FG5": 18, "FG6": 4, "FG7": None}
#: Subgroups of the first group that come from animals, and composite buckets.
ANIMAL_FG1 = ["red_meat", "poultry", "processed_meats_alternatives", "seafood", "eggs"]
BUCKETS = ["meat_based", "seafood_based", "vegetarian", "vegan"]
CHEESE_FACTOR = 10


def dairy_equivalent(weight: Column, subgroup: Column) -> Column:
    """Cheese counts ten times its weight."""
    return F.when(subgroup == "cheese", q8(weight.cast("decimal(28,8)") * CHEESE_FACTOR)).otherwise(weight)


def polarity(group: Column, subgroup: Column, ingredient: bool = False) -> Column:
    """plant, animal, or null for neither. A fat without subgroup is animal in a product and neither in an ingredient."""
    fat = F.when(subgroup == "plant_based_fat", "plant").when((subgroup == "animal_based_fat") | F.lit(not ingredient), "animal")
    return (
        F.when(group == "FG1", F.when(F.coalesce(subgroup.isin(ANIMAL_FG1), F.lit(False)), "animal").otherwise("plant"))
        .when(group == "FG2", F.when(F.coalesce(subgroup == "dairy_alternative_plant", F.lit(False)), "plant").otherwise("animal"))
        .when(group == "FG3", fat)
        .when(group.isin("FG4", "FG5", "FG6"), "plant")
        .when(group == "FG7", F.when(F.coalesce(subgroup == "plant_based_snack", F.lit(False)), "plant").otherwise("animal"))
    )


def run_rows(products: DataFrame) -> DataFrame:
    """Weight of each row. Needs food_group, subgroup, is_composite, bucket, items_sold, weight_per_item_kg."""
    weight = q8(F.col("items_sold").cast("decimal(18,2)") * F.col("weight_per_item_kg").cast("decimal(18,14)"))
    rows = products.withColumn("weight_kg", weight).withColumn("in_scope", F.col("food_group").isin(list(REFERENCE_SHARE)))
    return rows.withColumn("weight_kg_dairy", F.when(F.col("food_group") == "FG2", dairy_equivalent(F.col("weight_kg"), F.col("subgroup"))))


def ingredient_rows(rows: DataFrame, ingredients: DataFrame) -> DataFrame:
    """Weights of the ingredients (product_id, food_group, subgroup, weight_kg_per_item) of own-brand composites in scope."""
    own = rows.filter("is_composite and is_own_brand and in_scope").select("product_id", "items_sold")
    joined = own.join(ingredients, "product_id")
    weight = q8(F.col("weight_kg_per_item").cast("decimal(18,14)") * F.col("items_sold").cast("decimal(18,2)"))
    return joined.select("product_id", "food_group", "subgroup", weight.alias("weight_kg"))


def contributions(rows: DataFrame, ingredients: DataFrame | None = None) -> DataFrame:
    """food_group, subgroup, weight_kg, from_ingredient: what counts for a food group. Composites count by ingredients alone."""
    whole = rows.filter("in_scope and not is_composite").select("food_group", "subgroup", "weight_kg", F.lit(False).alias("from_ingredient"))
    if ingredients is None:
        return whole
    return whole.unionByName(ingredient_rows(rows, ingredients).select("food_group", "subgroup", "weight_kg", F.lit(True).alias("from_ingredient")))


def group_shares(rows: DataFrame, ingredients: DataFrame | None = None) -> DataFrame:
    """Weight and share of all seven groups; the whole weight in scope, composites too, is the denominator."""
    spark = rows.sparkSession
    spine = spark.createDataFrame(list(REFERENCE_SHARE.items()), "food_group string, reference_share_pct int")
    parts = contributions(rows, ingredients)
    dairy = F.sum(F.when(F.col("food_group") == "FG2", dairy_equivalent(F.col("weight_kg"), F.col("subgroup"))))
    sums = parts.groupBy("food_group").agg(F.sum("weight_kg").alias("w"), dairy.alias("d"))
    total = rows.filter("in_scope").agg(F.coalesce(F.sum("weight_kg"), F.lit(0).cast("decimal(38,8)")).alias("total"))
    joined = F.broadcast(spine).join(sums, "food_group", "left").crossJoin(F.broadcast(total))  # seven rows and one
    weight = F.coalesce("w", F.lit(0).cast("decimal(38,8)"))
    dairy_kg = F.when(F.col("food_group") == "FG2", F.coalesce("d", F.lit(0).cast("decimal(38,8)")))
    return joined.select("food_group", weight.alias("weight_kg"), dairy_kg.alias("weight_kg_dairy"), F.coalesce(share_pct(weight, F.col("total")), F.lit(0)).alias("share_pct"), "reference_share_pct")


def bucket_totals(rows: DataFrame) -> DataFrame:
    """One row: the weight of composites in each bucket and in all."""
    of = [F.coalesce(F.sum(F.when(F.col("bucket") == b, F.col("weight_kg"))), F.lit(0).cast("decimal(38,8)")).alias(f"{b}_kg") for b in BUCKETS]
    return rows.filter("in_scope and is_composite").agg(F.coalesce(F.sum("weight_kg"), F.lit(0).cast("decimal(38,8)")).alias("composites_kg"), *of)


def whole_diet(rows: DataFrame, ingredients: DataFrame | None = None) -> DataFrame:
    """One row: plant and animal weight; animal dairy counts in equivalents."""
    parts = contributions(rows, ingredients)
    group, subgroup = F.col("food_group"), F.col("subgroup")
    side = F.when(F.col("from_ingredient"), polarity(group, subgroup, True)).otherwise(polarity(group, subgroup))
    counted = F.when((group == "FG2") & (side == "animal"), dairy_equivalent(F.col("weight_kg"), subgroup)).otherwise(F.col("weight_kg"))
    sums = parts.select(side.alias("side"), counted.alias("kg")).agg(*[F.coalesce(F.sum(F.when(F.col("side") == s, F.col("kg"))), F.lit(0).cast("decimal(38,8)")).alias(f"{s}_kg") for s in ("plant", "animal")])
    whole = F.col("plant_kg") + F.col("animal_kg")
    return sums.withColumn("plant_share_pct", share_pct(F.col("plant_kg"), whole)).withColumn("animal_share_pct", share_pct(F.col("animal_kg"), whole))
