"""Rows of text to typed products: parsing, checks and the methodologies that a product can serve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import numeric
from granary.functions.numeric import to_boolean, to_list, trimmed
from granary.functions.text import fold

#: Names of retail channels.
CHANNELS = {
    "fresh": "fresh",
    "frais": "fresh",
    "frais & traiteur": "fresh",
    "produits frais": "fresh",
    "chilled": "fresh",
    "refrigerated": "fresh",
    "refrigere": "fresh",
    "grocery_ambient": "grocery_ambient",
    "grocery ambient": "grocery_ambient",
    "grocery/ambient": "grocery_ambient",
    "grocery-ambient": "grocery_ambient",
    "ambient": "grocery_ambient",
    "ambient grocery": "grocery_ambient",
    "grocery": "grocery_ambient",
    "epicerie": "grocery_ambient",
    "epicerie seche": "grocery_ambient",
    "sec": "grocery_ambient",
    "ambiant": "grocery_ambient",
    "shelf-stable": "grocery_ambient",
    "shelf stable": "grocery_ambient",
    "dry goods": "grocery_ambient",
    "frozen": "frozen",
    "frozen food": "frozen",
    "surgele": "frozen",
    "surgeles": "frozen",
    "produits surgeles": "frozen",
    "congele": "frozen",
}
#: Columns of a raw file that may be absent.
RAW = [
    "external_product_id", "product_name", "brand", "retailer_category", "retailer_subcategory", "ingredients_text", "labels", "language", "country", "is_own_brand", "retail_channel",
    "weight_per_item_kg", "weight_per_item_g", "weight_per_item_lb", "weight_per_item_oz", "items_purchased", "items_sold", "protein_pct", "protein_g_per_100ml", "density_g_per_ml",
    "protein_g_per_serving", "serving_g", "plant_protein_pct", "animal_protein_pct", "protein_source",
]


def channel(raw: Column) -> Column:
    word = F.regexp_replace(fold(F.trim(raw)), r"\s+", " ")
    return F.element_at(F.create_map(*[F.lit(x) for kv in CHANNELS.items() for x in kv]), word)


def problem(holds: Column, field: str, code: str) -> Column:
    return F.when(F.coalesce(holds, F.lit(False)), F.struct(F.lit(field).alias("field"), F.lit(code).alias("code")))


#: Columns that hold numbers, and those that give energy where protein is wanted.
NUMBERS = [
    "weight_per_item_kg", "weight_per_item_g", "weight_per_item_lb", "weight_per_item_oz", "items_purchased", "items_sold", "protein_pct", "protein_g_per_100g", "protein_g_per_100ml", "density_g_per_ml",
    "protein_g_per_serving", "serving_g", "plant_protein_pct", "animal_protein_pct",
]
ENERGY = ["protein_kj", "protein_kcal"]
#: Short names that are read as well.
SHORT = {"protein_per_100ml": "protein_g_per_100ml", "density": "density_g_per_ml", "protein_per_serving": "protein_g_per_serving"}


def parse(rows: DataFrame, row_number: str = "row_number", upload: str = "00000000") -> DataFrame:
    """Typed columns, errors and warnings (arrays of field and code). A row with errors is invalid; warnings let it pass.

    A missing id becomes AUTO-<upload>-<row>, with a warning. Counts lose their fraction with a warning. A kilogram column with 50 to
    5000 in it looks like grams and is an error; one of 5 kg or more, and a gram column of less than 5 g, are warnings.
    Numbers are read once, in a projection of their own; what is derived from them refers to it.
    """
    rows = rows.withColumnsRenamed({a: b for a, b in SHORT.items() if b not in rows.columns})
    for c in [*RAW, *NUMBERS, *ENERGY]:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    c = F.col
    words = {"__name": trimmed(c("product_name")), "__id": trimmed(c("external_product_id")), "__own": to_boolean(c("is_own_brand")), "__channel": channel(c("retail_channel"))}
    read, n = numeric.numbers(rows, NUMBERS)
    read = read.select("*", *[e.alias(k) for k, e in words.items()])
    kg, weight_code = numeric.weight_of(kg=n["weight_per_item_kg"], g=n["weight_per_item_g"], lb=n["weight_per_item_lb"], oz=n["weight_per_item_oz"])
    energy = numeric.either(*[trimmed(c(e)).isNotNull() for e in ENERGY])
    pct, protein_code = numeric.protein_of(*[n[x] for x in ("protein_pct", "protein_g_per_100ml", "density_g_per_ml", "protein_g_per_serving", "serving_g")], energy, n["protein_g_per_100g"])
    read = read.select("*", kg.alias("__kg"), weight_code.alias("__weight_code"), pct.alias("__pct"), protein_code.alias("__protein_code"))
    raw_kg, raw_g, ok = n["weight_per_item_kg"].value, n["weight_per_item_g"].value, c("__weight_code").isNull()
    grams = (c("__weight_code") == "weight_too_large") & raw_kg.between(50, 5000)
    heavy = ok & (raw_kg >= 5)
    counted, split = ("items_purchased", "items_sold"), ("plant_protein_pct", "animal_protein_pct")
    field = lambda name, code: F.struct(F.lit(name).alias("field"), code.alias("code"))
    fraction = lambda x: n[x].value != F.floor(n[x].value)
    errors = [
        problem(c("__name").isNull(), "product_name", "missing_required"),
        F.when(grams, field("weight_per_item_kg", F.lit("weight_unit_likely_grams"))).when(~ok, field("weight_per_item_kg", c("__weight_code"))),
        F.when(c("__protein_code").isNotNull(), field("protein_pct", c("__protein_code"))),
        *[F.when(n[x].bad, field(x, F.lit("invalid_type"))).when(n[x].value < 0, field(x, F.lit("invalid_range"))) for x in counted],
        *[F.when(n[x].bad, field(x, F.lit("invalid_type"))).when(~n[x].value.between(0, 100), field(x, F.lit("invalid_range"))) for x in split],
        problem(trimmed(c("is_own_brand")).isNotNull() & c("__own").isNull(), "is_own_brand", "invalid_type"),
        problem(trimmed(c("retail_channel")).isNotNull() & c("__channel").isNull(), "retail_channel", "invalid_enum"),
        problem(trimmed(c("language")).isNotNull() & ~F.trim(c("language")).rlike("^[A-Za-z]{2}$"), "language", "invalid_code"),
        problem(trimmed(c("country")).isNotNull() & ~F.trim(c("country")).rlike("^[A-Za-z]{2}$"), "country", "invalid_code"),
    ]
    warnings = [
        problem(c("__id").isNull(), "external_product_id", "auto_generated"),
        problem(heavy, "weight_per_item_kg", "weight_unit_likely_grams_warning"),
        problem(~F.coalesce(heavy, F.lit(False)) & ok & (raw_g < 5) & (c("__kg") < F.lit("0.005").cast("decimal(6,3)")), "weight_per_item_g", "weight_unit_likely_kg_warning"),
        *[problem((n[x].value >= 0) & fraction(x), x, "non_integer_count") for x in counted],
    ]
    auto = F.format_string(f"AUTO-{upload[:8]}-%04d", c(row_number).cast("int"))
    return read.select(
        c(row_number).alias("row_number"), F.coalesce("__id", auto).alias("external_product_id"), c("__name").alias("product_name"),
        *[trimmed(c(x)).alias(x) for x in ("brand", "retailer_category", "retailer_subcategory", "ingredients_text")], to_list(c("labels")).alias("labels"),
        F.lower(trimmed(c("language"))).alias("language"), F.upper(trimmed(c("country"))).alias("country"), c("__own").alias("is_own_brand"), c("__channel").alias("retail_channel"),
        c("__kg").cast("decimal(18,14)").alias("weight_per_item_kg"), *[F.floor(F.when(n[x].value >= 0, n[x].value)).cast("decimal(18,0)").alias(x) for x in counted], c("__pct").cast("decimal(18,10)").alias("protein_pct"),
        *[n[x].value.cast("decimal(18,10)").alias(x) for x in split], F.coalesce(F.lower(trimmed(c("protein_source"))), F.lit("reference_db")).alias("protein_source"),
        F.array_compact(F.array(*errors)).alias("errors"), F.array_compact(F.array(*warnings)).alias("warnings"),
    )


def satisfiable(products: DataFrame) -> DataFrame:
    """Add methodologies (those that a product has the fields for) and notes: what it lacks for others, and missing protein."""
    c = F.col
    pt = c("items_purchased").isNotNull()
    lacks = [(c("items_sold").isNull(), "missing_items_sold"), (c("retail_channel").isNull(), "missing_channel"), (c("is_own_brand").isNull(), "missing_own_brand")]
    fg = ~(lacks[0][0] | lacks[1][0] | lacks[2][0])
    out = products.withColumn("methodologies", F.array_compact(F.array(F.when(fg, "food_groups"), F.when(pt, "protein_tracker"))))
    notes = [F.when(~pt, "missing_items_purchased"), *[F.when(h, code) for h, code in lacks], F.when(~pt & ~fg, "no_methodology_satisfiable"), F.when(pt & c("protein_pct").isNull(), "enrichment_needed")]
    return out.withColumn("notes", F.array_compact(F.array(*notes)))


def report(parsed: DataFrame) -> DataFrame:
    """kind, field, code, n_rows: how many row numbers have each error and warning, in one pass."""
    of = lambda kind: F.transform(kind, lambda x: F.struct(F.lit(kind[:-1]).alias("kind"), x["field"].alias("field"), x["code"].alias("code")))
    return parsed.select("row_number", F.inline(F.concat(of("errors"), of("warnings")))).groupBy("kind", "field", "code").agg(F.count_distinct("row_number").alias("n_rows"))
