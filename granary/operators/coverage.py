"""Coverage of a run: counts, percentages, uncertainty, contributors and facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.numeric import clamped_pct


#: Percentages from which a run is highly, or at least moderately, uncertain.
HIGH_UNKNOWN, HIGH_PENDING, MED_AI, MED_MISSING_PROTEIN, MED_MISSING_WEIGHT = 10, 5, 30, 10, 10


def pct(part: Column, total: Column) -> Column:
    """Percent to two places, half up; null without a total."""
    return F.round(F.try_divide(part.cast("decimal(18,0)") * 100, total.cast("decimal(18,0)")), 2).cast("double")


def coverage(rows: DataFrame) -> DataFrame:
    """One row of counts and percentages, in one pass, and the uncertainty of the run.

    rows: a product each, with pt_group, protein_pct, volume_kg, and where there are such: source (what classified it), pending (waits for
    review), protein_origin, is_composite. errors, a count of blocking upload errors, is taken from a column of that name (its largest value).
    """
    has = lambda c: F.col(c) if c in rows.columns else F.lit(None)
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    group, source, known = F.col("pt_group"), has("source").cast("string"), F.col("protein_pct").isNotNull()
    scope = group.isin("plant_based_core", "plant_based_non_core", "composite_products", "animal_core")
    counts = rows.agg(
        F.count("*").alias("n_rows"), n(group != "unknown").alias("n_classified"), n(group == "unknown").alias("n_unknown"), n(group == "out_of_scope").alias("n_out_of_scope"), n(scope).alias("n_in_scope"),
        n(known).alias("n_protein"), n(scope & ~known).alias("n_missing_protein"), n(F.coalesce(F.col("volume_kg"), F.lit(0)) <= 0).alias("n_zero_weight"),
        *[n(source == s).alias(f"n_{s}") for s in ("rule", "ai", "manual")], n(has("pending").cast("boolean")).alias("n_pending"), n(has("is_composite").cast("boolean")).alias("n_composite"),
        n(known & (has("protein_origin").cast("string") != "own")).alias("n_enriched"), F.coalesce(F.max(has("errors").cast("long")), F.lit(0)).alias("n_errors"),
        F.coalesce(F.sum("volume_kg"), F.lit(0)).cast("double").alias("volume"), F.coalesce(F.sum(F.when(known, F.col("volume_kg"))), F.lit(0)).cast("double").alias("volume_with_protein"),
    )
    shares = {"classified": "n_classified", "unknown": "n_unknown", "out_of_scope": "n_out_of_scope", "protein": "n_protein", "missing_protein": "n_missing_protein", "zero_weight": "n_zero_weight", "ai": "n_ai", "pending": "n_pending", "enriched": "n_enriched"}
    out = counts.select("*", *[pct(F.col(c), F.col("n_rows")).alias(f"{name}_pct") for name, c in shares.items()], clamped_pct(F.col("volume_with_protein"), F.col("volume")).alias("volume_pct"))
    return out.withColumn("uncertainty", uncertainty(*[F.col(c) for c in ("unknown_pct", "n_pending", "pending_pct", "ai_pct", "missing_protein_pct", "zero_weight_pct", "n_errors")]))


def uncertainty(unknown_pct: Column, pending: Column, pending_pct: Column, ai_pct: Column, missing_protein_pct: Column, missing_weight_pct: Column, errors: Column) -> Column:
    """high for errors, many unknown or many pending; medium for many from a model, without protein or weight, or any pending; else low. A null doesn't count."""
    any_of = lambda *cs: F.exists(F.array(*cs), lambda x: F.coalesce(x, F.lit(False)))
    high = any_of(errors > 0, unknown_pct >= HIGH_UNKNOWN, (pending > 0) & (pending_pct >= HIGH_PENDING))
    medium = any_of(ai_pct >= MED_AI, missing_protein_pct >= MED_MISSING_PROTEIN, missing_weight_pct >= MED_MISSING_WEIGHT, pending > 0)
    return F.when(high, "high").when(medium, "medium").otherwise("low")


def sources(products: DataFrame, classifications: DataFrame) -> DataFrame:
    """How many products each source classified; without one, unclassified."""
    joined = products.join(classifications, "product_id", "left")
    return joined.groupBy(F.coalesce("source", F.lit("unclassified")).alias("source")).agg(F.count("*").alias("n"))


def contributors(rows: DataFrame, side: Column, value: str, k: int = 10) -> DataFrame:
    """The k largest rows of each side, then by product id, without rows of no side."""
    order = Window.partitionBy("side").orderBy(F.desc(value), "product_id")
    return rows.withColumn("side", side).filter("side is not null").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def facets(rows: DataFrame, *columns: str) -> DataFrame:
    """facet, value, n for several columns in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("value")) for c in columns])
    return rows.select(F.inline(pairs)).groupBy("facet", "value").agg(F.count("*").alias("n"))


def unclassified(products: DataFrame, classifications: DataFrame, any_counts: bool = False) -> DataFrame:
    """Products that still need a group: one that is unknown doesn't count, unless any classification does."""
    known = classifications if any_counts else classifications.filter("pt_group <> 'unknown'")
    return products.join(known.select("product_id").distinct(), "product_id", "left_anti")
