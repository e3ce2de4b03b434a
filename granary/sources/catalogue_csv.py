"""Reading loosely structured catalogue files: headers, column mapping, forbidden columns, companions."""

from __future__ import annotations

import csv
import re
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Limits of a file, and what no file may carry on.
MAX_ROWS, MAX_BYTES = 200_000, 50 * 1024 * 1024
FORBIDDEN = {"sales_value", "revenue", "margin", "cost_price", "supplier_id", "supplier_name", "contract_terms", "store_id", "store_name", "store_region"}
FORBIDDEN_PREFIXES = ("promotion_", "confidential_", "internal_", "store_", "supplier_")
#: Headers that mean a column.
SYNONYMS = {
    "external_product_id": ["product_id", "sku", "ean", "gtin", "id", "code_produit"],
    "product_name": ["name", "product", "nom_produit", "libelle", "description"],
    "brand": ["marque", "brand_name"],
    "retailer_category": ["category", "categorie", "rayon"],
    "retailer_subcategory": ["subcategory", "sous_categorie"],
    "ingredients_text": ["ingredients", "liste_ingredients"],
    "labels": ["claims", "label"],
    "language": ["langue", "lang"],
    "country": ["pays"],
    "is_own_brand": ["own_brand", "brand_type", "private_label", "mdd"],
    "retail_channel": ["channel", "canal"],
    "weight_per_item_kg": ["weight_kg", "poids_kg"],
    "weight_per_item_g": ["weight_g", "pack_weight_g", "poids_g", "poids"],
    "weight_per_item_lb": ["weight_lb"],
    "weight_per_item_oz": ["weight_oz"],
    "items_purchased": ["purchased", "units_purchased", "quantite_achetee"],
    "items_sold": ["sold", "units_sold", "quantite_vendue"],
    "protein_pct": ["protein", "proteines", "protein_total_g_per_100g"],
    "plant_protein_pct": ["protein_plant_g_per_100g"],
    "animal_protein_pct": ["protein_animal_g_per_100g"],
    "protein_source": [],
    "protein_g_per_100g": ["protein_per_100g", "proteines_100g"],
    "protein_g_per_100ml": ["protein_per_100ml", "proteines_100ml"],
    "density_g_per_ml": ["density", "densite"],
    "protein_g_per_serving": ["protein_per_serving", "proteines_portion"],
    "serving_g": ["serving_size_g", "portion_g"],
    "protein_kj": [],
    "protein_kcal": [],
}
#: What this library's own results are called; a file that holds them again isn't asked about them.
OUTPUTS = {
    "deterministic_label", "ai_label", "final_label", "explanation", "confidence", "source", "match", "script_version", "model", "pt_group", "wwf_group", "review_status", "processing_status",
    "classification", "label", "predicted_label", "predicted_category", "output", "result",
}
#: Parts of headers that speak of quantities.
QUANTITIES = {"items_purchased": ["purchase", "achete"], "items_sold": ["sold", "vendu", "ventes"]}
WEIGHTS = [c for c in SYNONYMS if c.startswith("weight_per_item_")]
REQUIRED = {"protein_tracker": ["product_name", "items_purchased"], "food_groups": ["product_name", "items_sold", "is_own_brand", "retail_channel"]}
INGREDIENTS = "map<string,struct<note:string,ingredients:array<struct<food_group:string,subgroup:string,ingredient_weight_kg_per_item:decimal(18,10)>>>>"


def file_problem(name: str, size: int, content_type: str = "text/csv") -> str | None:
    """What is wrong with a file before it is read, if anything."""
    if not size:
        return "empty"
    if size > MAX_BYTES:
        return "too_large"
    if not name.lower().endswith((".csv", ".tsv", ".txt")):
        return "extension"
    return None if content_type in ("text/csv", "text/plain", "text/tab-separated-values", "application/vnd.ms-excel") else "content_type"


def header(text: str) -> str:
    """A header as a name: no accents, lower case, runs of other characters as one underscore."""
    plain = unicodedata.normalize("NFKD", text.strip()).encode("ascii", "ignore").decode().lower()
    return re.sub(r"[^a-z0-9]+", "_", plain).strip("_")


def forbidden(names: list[str]) -> list[str]:
    return sorted(n for n in names if n in FORBIDDEN or n.startswith(FORBIDDEN_PREFIXES))


def mapping(names: list[str], synonyms: dict[str, list[str]] = SYNONYMS, confirmed: dict[str, str] = {}) -> dict[str, tuple[str, str]]:  # noqa: B006
    """For each header its column and how it was found: confirmed, exact, synonym, ignored or none.

    `synonyms` may be a longer list than the short one here. What was confirmed (header to column, or to `ignore`) holds before all else. Names of own results
    are ignored. A header that speaks of purchased or sold quantities is never a weight.
    """
    known = {header(s): c for c, some in synonyms.items() for s in some}
    out = {}
    for n in names:
        if n in confirmed:
            out[n] = (n, "ignored") if confirmed[n] == "ignore" else (confirmed[n], "confirmed")
            continue
        column, how = (n, "exact") if n in synonyms else (known.get(n, ""), "synonym" if n in known else "ignored" if n in OUTPUTS else "none")
        if how == "none" or column in WEIGHTS:
            column, how = next(((target, "synonym") for target, words in QUANTITIES.items() if any(w in n for w in words)), (column, how))
        out[n] = (column or n, how)
    return out


def missing(columns: list[str], methodology: str) -> list[str]:
    """Required columns that no header maps to; any unit of weight satisfies weight."""
    lacks = [c for c in REQUIRED[methodology] if c not in columns]
    return lacks + ([] if set(WEIGHTS) & set(columns) else ["weight_per_item_kg"])


def read_csv(
    spark: SparkSession, path: str, sep: str = ",", max_rows: int = MAX_ROWS, synonyms: dict[str, list[str]] = SYNONYMS, confirmed: dict[str, str] = {}  # noqa: B006
) -> tuple[DataFrame, dict]:
    """All columns as text under normalised names, and a report: dropped, duplicate and mapped headers.

    Lines whose first cell begins with # are comments. Short lines end in empty cells. Of
    headers that map to one column, the last wins. Too many rows are an error, never cut.
    """
    raw = spark.read.csv(path, sep=sep, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8", mode="PERMISSIVE", enforceSchema=True)
    first = next(csv.reader([spark.read.text(path).first()[0]], delimiter=sep), [])  # Spark renames headers that repeat
    named = [header(c.removeprefix("\ufeff")) or f"column_{k}" for k, c in enumerate([*first, *raw.columns[len(first) :]][: len(raw.columns)])]
    raw = raw.toDF(*[f"c{k}" for k in range(len(named))])
    raw = raw.filter(~F.coalesce(F.ltrim("c0").startswith("#"), F.lit(False)))
    dropped, found = forbidden(named), mapping(named, synonyms, confirmed)
    target = {found[n][0]: f"c{k}" for k, n in enumerate(named) if n not in dropped and found[n][1] != "ignored"}
    if raw.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"more than {max_rows} rows")
    report = {"dropped": dropped, "duplicates": sorted({n for n in named if named.count(n) > 1}), "mapping": found}
    return raw.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for n, c in target.items()]), report


def checksum(column: str = "content"):
    """SHA-256 of a file's bytes (as read by the binaryFile source), by which an upload that repeats is found."""
    return F.sha2(column, 256)


def read_companion(spark: SparkSession, path: str) -> DataFrame:
    """external_product_id, place, food_group, subgroup, weight_kg_per_item of each ingredient in a JSON companion."""
    return parse_companion(spark.read.text(path, wholetext=True), "value")


def parse_companion(rows: DataFrame, column: str, *keep: str) -> DataFrame:
    parsed = rows.select(*keep, F.explode(F.from_json(column, INGREDIENTS)).alias("external_product_id", "entry"))
    items = parsed.select(*keep, "external_product_id", F.posexplode("entry.ingredients").alias("place", "i"))
    return items.select(*keep, "external_product_id", "place", "i.food_group", "i.subgroup", F.col("i.ingredient_weight_kg_per_item").alias("weight_kg_per_item"))


def read_reference(spark: SparkSession, path: str) -> DataFrame:
    """Foods of a reference table: its separator is found out, decimal commas are read, `-` is null, `< x` marks what is below detection.

    Lines without a code are skipped; a negative protein makes the food's three values null.
    """
    first = spark.read.text(path).first()[0]
    sep = max("|;,", key=first.count)
    raw = spark.read.csv(path, sep=sep, header=True, quote='"', escape='"')
    raw = raw.toDF(*[header(c) for c in raw.columns])
    number = lambda c: F.regexp_replace(F.regexp_replace(F.trim(c), r"^<\s*", ""), ",", ".").try_cast("decimal(18,6)")
    values = [c for c in raw.columns if c.endswith("_g_per_100g")]
    bad = F.lit(False)
    for c in values:
        bad = bad | F.coalesce(number(F.col(c)) < 0, F.lit(False))
    rows = raw.filter(F.coalesce(F.trim("code"), F.lit("")) != "")
    below = F.lit(False)
    for c in values:
        below = below | F.coalesce(F.trim(c).startswith("<"), F.lit(False))
    return rows.select(*[c for c in raw.columns if c not in values], *[F.when(~bad, number(F.col(c))).alias(c) for c in values], below.alias("is_below_detection"))
