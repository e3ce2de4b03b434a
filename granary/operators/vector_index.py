"""A vector index that embeds each distinct text once: keys by content, a cache with versions, and only misses are embedded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.text import hashed_vector
from granary.session import materialize
from granary.sources import history

#: What must never be embedded, and the lines that a product's text has.
FORBIDDEN = {
    "items_purchased", "items_sold", "weight_per_item_kg", "weight_per_item_g", "weight_per_item_lb", "weight_per_item_oz", "pack_weight_g", "sales_value", "sales_volume", "margin",
    "cost_price", "unit_price", "price", "revenue",
}
FORBIDDEN_PREFIXES = ("price", "sales", "margin", "cost", "weight", "volume")
LINES = {"product_name": "Name", "retailer_category": "Retailer category", "ingredients_text": "Ingredients", "labels": "Labels"}
EXAMPLE_LINES = {
    "protein_tracker": {"pt_group": "Protein Tracker group"},
    "wwf": {"wwf_food_group": "WWF food group", "wwf_subgroup": "WWF subgroup", "wwf_composite_step1_bucket": "WWF composite bucket"},
}
#: Columns of a reference that its loader keeps.
DESCRIPTORS = ["code", "name_en", "name_nl", "food_group"]
CACHE = "prefix string, key string, vector array<double>"


def forbidden(columns: list[str]) -> list[str]:
    """Columns that mustn't reach a text that leaves the house."""
    return sorted(c for c in columns if c.lower() in FORBIDDEN or c.lower().startswith(FORBIDDEN_PREFIXES))


def allowed_only(rows: DataFrame, allowed: list[str]) -> DataFrame:
    """The rows, if all their columns are known ones; else an error that names the others."""
    if unknown := sorted(set(rows.columns) - set(allowed)):
        raise ValueError(f"columns that no policy allows: {', '.join(unknown)}")
    return rows


def descriptor_text(rows: DataFrame, examples: str | None = None) -> Column:
    """A line for each field of a product that isn't blank, then those of a labelled example of a methodology. Commercial columns are an error."""
    if found := forbidden(rows.columns):
        raise ValueError(f"must never be embedded: {', '.join(found)}")
    lines = LINES | (EXAMPLE_LINES[examples] if examples else {})
    value = lambda c: F.nullif(F.trim(F.array_join(c, ", ") if dict(rows.dtypes)[c].startswith("array") else F.col(c).cast("string")), F.lit(""))
    return F.concat_ws("\n", *[F.concat(F.lit(f"{label}: "), value(c)) for c, label in lines.items() if c in rows.columns])


def load_references(spark: SparkSession, path: str) -> DataFrame:
    """Descriptor columns of a reference, from JSON lines or a CSV file with a header; what else it holds is never read."""
    rows = spark.read.json(path) if path.endswith((".json", ".jsonl")) else spark.read.csv(path, header=True, quote='"', escape='"')
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast("string").alias(c) for c in DESCRIPTORS])


def content_key(text: Column, model: str, kind: str, width: int) -> Column:
    """SHA-256 of what a vector depends on: model, kind (document or query), width and text."""
    return F.sha2(F.concat_ws("\x1f", F.lit(model), F.lit(kind), F.lit(str(width)), text), 256)


def misses(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct texts (prefix, key, text) that a cache lacks."""
    return texts.dropDuplicates(["key"]).join(cache.select("prefix", "key"), ["prefix", "key"], "left_anti")


def build(
    rows: DataFrame, path: str, version: str, at: str, model: str = "hashed", kind: str = "document", width: int = 64, embed: Callable[[Column, int], Column] = hashed_vector
) -> tuple[DataFrame, dict[str, int]]:
    """id, key, vector of rows (id, text), and counts: rows, texts (distinct), hits, embedded.

    New vectors are a version of the cache under `path`; one that died before its mark is embedded again. Null texts count as empty.
    """
    spark = rows.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = rows.select("id", text.alias("text"), content_key(text, model, kind, width).alias("key"))
    keyed = materialize(keyed.withColumn("prefix", F.substring("key", 1, 1)))
    cache = history.read(spark, path, CACHE).dropDuplicates(["key"])
    new = materialize(misses(keyed.select("prefix", "key", "text"), cache).select("prefix", "key", embed(F.col("text"), width).alias("vector")))
    embedded, texts = new.count(), keyed.select("key").distinct().count()
    if embedded:
        history.append(new, path, version, at, {"model": model, "embedded": str(embedded)}, ["prefix"])
    known = cache.select("prefix", "key", "vector").unionByName(new)
    found = keyed.drop("text").join(known.dropDuplicates(["key"]), ["prefix", "key"]).select("id", "key", "vector")
    return found, {"rows": keyed.count(), "texts": texts, "hits": texts - embedded, "embedded": embedded}
