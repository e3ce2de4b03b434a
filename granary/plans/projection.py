"""How the star-schema tables stand in for catalogue tables: one projection, which the SQL repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.session import table

PT_GROUP = {"ECONOMY": "plant_based_core", "STANDARD": "plant_based_non_core", "MEDIUM": "composite_products", "LARGE": "animal_core", "PROMO": "out_of_scope"}
FG1_SUB = ["red_meat", "legumes"]

#: The same rows in SQL, in whole numbers: grams is weight times count, pct the protein in percent (null if missing).
BASE = """
base AS (
  SELECT l_orderkey, l_linenumber, l_partkey AS product_id, l_suppkey, l_returnflag, l_shipdate, p_name, p_brand, p_type, p_size,
         CASE p_type WHEN 'ECONOMY' THEN 'plant_based_core' WHEN 'STANDARD' THEN 'plant_based_non_core' WHEN 'MEDIUM' THEN 'composite_products'
                     WHEN 'LARGE' THEN 'animal_core' WHEN 'PROMO' THEN 'out_of_scope' ELSE 'unknown' END AS pt_group,
         CAST(l_quantity AS BIGINT) * p_size AS grams,
         CASE WHEN l_discount > 0 THEN CAST(round(l_discount * 100) AS BIGINT) END AS pct,
         'FG' || CAST(1 + l_partkey % 7 AS VARCHAR) AS food_group, p_size % 5 = 0 AS is_composite, l_suppkey % 2 = 0 AS is_own_brand,
         CASE l_partkey % 4 WHEN 0 THEN 'meat_based' WHEN 1 THEN 'seafood_based' WHEN 2 THEN 'vegetarian' ELSE 'vegan' END AS bucket,
         CASE l_partkey % 7 WHEN 0 THEN CASE WHEN l_partkey % 2 = 0 THEN 'red_meat' ELSE 'legumes' END
              WHEN 1 THEN CASE l_partkey % 3 WHEN 0 THEN 'cheese' WHEN 1 THEN 'other_dairy_animal' ELSE 'dairy_alternative_plant' END
              WHEN 2 THEN CASE WHEN l_partkey % 2 = 0 THEN 'plant_based_fat' ELSE 'animal_based_fat' END
              WHEN 6 THEN CASE WHEN l_partkey % 2 = 0 THEN 'plant_based_snack' ELSE 'animal_based_snack' END END AS subgroup
  FROM lineitem JOIN part ON p_partkey = l_partkey)
"""


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A product row for each order line."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag", "l_shipdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    group = F.lit("unknown")
    for kind, g in PT_GROUP.items():
        group = F.when(F.col("p_type") == kind, g).otherwise(group)
    key = F.col("l_partkey")
    bucket = F.when(key % 4 == 0, "meat_based").when(key % 4 == 1, "seafood_based").when(key % 4 == 2, "vegetarian").otherwise("vegan")
    even = key % 2 == 0
    subgroup = (
        F.when(key % 7 == 0, F.when(even, "red_meat").otherwise("legumes"))
        .when(key % 7 == 1, F.when(key % 3 == 0, "cheese").when(key % 3 == 1, "other_dairy_animal").otherwise("dairy_alternative_plant"))
        .when(key % 7 == 2, F.when(even, "plant_based_fat").otherwise("animal_based_fat"))
        .when(key % 7 == 6, F.when(even, "plant_based_snack").otherwise("animal_based_snack"))
    )
    kg = (F.col("p_size").cast("decimal(9,0)") * F.lit("0.001").cast("decimal(4,3)")).cast("decimal(18,14)")
    return line.join(part, line.l_partkey == part.p_partkey).select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_shipdate", "p_type", "p_size", key.alias("product_id"), F.col("p_name").alias("product_name"), F.col("p_brand").alias("brand"),
        group.alias("pt_group"), kg.alias("weight_per_item_kg"), F.col("l_quantity").cast("decimal(18,2)").alias("items_purchased"), F.col("l_quantity").cast("decimal(18,2)").alias("items_sold"),
        F.when(F.col("l_discount") > 0, F.round(F.col("l_discount") * 100).cast("decimal(18,10)")).alias("protein_pct"),
        F.when(even, "label").otherwise("reference_db").alias("protein_source"), F.concat(F.lit("FG"), (1 + key % 7).cast("string")).alias("food_group"), subgroup.alias("subgroup"),
        (F.col("p_size") % 5 == 0).alias("is_composite"), (F.col("l_suppkey") % 2 == 0).alias("is_own_brand"), bucket.alias("bucket"),
    )


def step2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ingredients for each own part: legumes of 10 g and cheese of 5 g, read from a JSON companion."""
    from granary.sources.catalogue_csv import parse_companion

    part = table(spark, sf_dir, "part").filter("p_size % 5 = 0")
    item = lambda g, s, kg: F.struct(F.lit(g).alias("food_group"), F.lit(s).alias("subgroup"), F.lit(kg).alias("ingredient_weight_kg_per_item"))
    made = F.to_json(F.create_map(F.col("p_partkey").cast("string"), F.struct(F.array(item("FG1", "legumes", "0.010"), item("FG2", "cheese", "0.005")).alias("ingredients"))))
    return parse_companion(part.select(made.alias("json")), "json").select(F.col("external_product_id").cast("long").alias("product_id"), "place", "food_group", "subgroup", F.col("weight_kg_per_item").cast("decimal(18,14)").alias("weight_kg_per_item"))


STEP2 = """
ingredient AS (
  SELECT l_orderkey, l_linenumber, product_id, i.place, i.food_group, i.subgroup, grams / p_size * i.g AS g
  FROM base CROSS JOIN (VALUES (0, 'FG1', 'legumes', 10), (1, 'FG2', 'cheese', 5)) AS i(place, food_group, subgroup, g)
  WHERE is_composite AND is_own_brand)
"""
