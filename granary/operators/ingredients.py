"""Checks of the ingredients of own composites, one by one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Groups that an ingredient may have, and the subgroups of those that have any.
GROUPS = ["FG1", "FG2", "FG3", "FG4", "FG5", "FG6"]
SUBGROUPS = {
    "FG1": ["red_meat", "poultry", "processed_meats_alternatives", "seafood", "eggs", "nuts_seeds", "legumes", "alternative_protein_sources", "meat_egg_seafood_alternatives"],
    "FG2": ["cheese", "other_dairy_animal", "dairy_alternative_plant"],
    "FG3": ["plant_based_fat", "animal_based_fat"],
    "FG5": ["whole_grain", "refined_grain"],
}
NEEDED = ["FG1", "FG2"]


def items_of(companions: DataFrame, column: str = "json") -> DataFrame:
    """external_product_id, place (from 0), item (its JSON) of companions, which map product ids to their ingredients."""
    entries = companions.select(F.explode(F.from_json(column, "map<string,string>")).alias("external_product_id", "entry"))
    listed = F.from_json(F.get_json_object("entry", "$.ingredients"), "array<string>")
    return entries.select("external_product_id", F.posexplode(listed).alias("place", "item"))


def field(name: str) -> Column:
    return F.get_json_object("item", f"$.{name}")


def ingredient_checks(items: DataFrame, own_brand: Column | None = None) -> DataFrame:
    """external_product_id, place, food_group, subgroup, weight_kg, field, code, warnings of items (external_product_id, place, item).

    field and code tell what is wrong first, in the order group, subgroup, weight; they are null for a valid ingredient. Groups without subgroups
    lose theirs. Warnings: fg3_without_subgroup, and duplicate for an ingredient whose group and subgroup stood before in its product; only of own brands.
    """
    group, sub, weight = field("food_group"), field("subgroup"), field("ingredient_weight_kg_per_item")
    kg = weight.try_cast("decimal(18,10)")
    wrong = lambda f, c: F.struct(F.lit(f).alias("field"), F.lit(c).alias("code"))
    listed = F.lit(False)
    for g, some in SUBGROUPS.items():
        listed = listed | ((group == g) & sub.isin(some))
    error = (
        F.when(~F.coalesce(F.ltrim("item").startswith("{"), F.lit(False)), wrong("ingredient", "not_object"))
        .when(group.isNull(), wrong("food_group", "required"))
        .when(group == "FG7", wrong("food_group", "not_decomposed"))
        .when(~group.isin(GROUPS), wrong("food_group", "invalid_enum"))
        .when(group.isin(NEEDED) & sub.isNull(), wrong("subgroup", "required"))
        .when(group.isin(list(SUBGROUPS)) & sub.isNotNull() & ~listed, wrong("subgroup", "invalid_enum"))
        .when(weight.isNull(), wrong("ingredient_weight_kg_per_item", "required"))
        .when(kg.isNull(), wrong("ingredient_weight_kg_per_item", "invalid_type"))
        .when(kg <= 0, wrong("ingredient_weight_kg_per_item", "non_positive"))
    )
    own = F.lit(True) if own_brand is None else F.coalesce(own_brand, F.lit(False))
    checked = items.withColumn("error", error).withColumn("ok", F.col("error").isNull() & own)
    valid = F.col("error").isNull()
    checked = checked.select(
        "external_product_id", "place", "ok", F.when(valid, group).alias("food_group"), F.when(valid & group.isin(list(SUBGROUPS)), sub).alias("subgroup"), F.when(valid, kg).alias("weight_kg"), "error.field", "error.code"
    )
    # a product's ingredients are few; items that aren't valid are told apart by their place
    same = Window.partitionBy("external_product_id", "ok", "food_group", "subgroup").orderBy("place")
    warnings = F.array_compact(
        F.array(F.when(F.col("ok") & (F.row_number().over(same) > 1), "duplicate"), F.when(F.col("ok") & (F.col("food_group") == "FG3") & F.col("subgroup").isNull(), "fg3_without_subgroup"))
    )
    return checked.withColumn("warnings", warnings).drop("ok")
