"""Tables and report parts put together from products, classifications, records and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators.enrichment import best_record, status


def classification_table(products: DataFrame, classifications: DataFrame, reviews: DataFrame) -> DataFrame:
    """A row for each product and methodology that it has a classification or review in, with both beside each other.

    classifications and reviews are keyed by (product_id, methodology); a product without either has one row of nulls.
    """
    both = classifications.join(reviews, ["product_id", "methodology"], "full_outer")
    return products.join(both, "product_id", "left")


def filtered(rows: DataFrame, source: str | None = None, group: str | None = None, least: float | None = None, most: float | None = None, review: str | None = None, search: str | None = None) -> DataFrame:
    """Optional conditions, all of which must hold; source unknown means no classification, bounds of confidence drop nulls."""
    out = rows
    if source is not None:
        out = out.filter(F.col("source").isNull() if source == "unknown" else F.col("source") == source)
    if group is not None:
        out = out.filter(F.col("pt_group") == group)
    if least is not None:
        out = out.filter(F.col("confidence") >= least)
    if most is not None:
        out = out.filter(F.col("confidence") <= most)
    if review is not None:
        out = out.filter(F.col("review_status") == review)
    if search:
        out = out.filter(F.contains(F.lower("product_name"), F.lit(search.lower())))
    return out


def nutrition_table(products: DataFrame, records: DataFrame) -> DataFrame:
    """value, origin and trust of each product's protein: the retailer's own value, else the best record."""
    best = best_record(records.filter("nutrient = 'protein'")).select("product_id", F.col("value").alias("r_value"), F.col("source").alias("r_source"), F.col("confidence").alias("r_confidence"))
    joined = products.join(best, "product_id", "left")
    own = F.col("protein_pct").isNotNull()
    trust = F.when(own, F.lit(1.0)).otherwise(F.coalesce("r_confidence", F.lit(0.0)))
    return joined.select("product_id", F.when(own, F.col("protein_pct").cast("double")).otherwise(F.col("r_value")).alias("value"), F.when(own, "retailer").otherwise(F.coalesce("r_source", F.lit("missing"))).alias("origin"), status(trust).alias("status"))


def ordered_counts(rows: DataFrame, column: Column, order: list[str]) -> DataFrame:
    """place, label, n in a fixed order, without labels that no row has."""
    places = F.create_map(*[x for k, o in enumerate(order) for x in (F.lit(o), F.lit(k))])
    return rows.groupBy(column.alias("label")).agg(F.count("*").alias("n")).withColumn("place", F.element_at(places, F.col("label"))).filter("place is not null")


def caveats(summary: DataFrame) -> Column:
    """Lines that a report must carry, from counts in one row of a summary."""
    line = lambda holds, text, *c: F.when(holds, F.format_string(text, *[F.col(x) for x in c]))
    return F.array_compact(
        F.array(
            line(F.col("unknown_count") > 0, "%d products have no known group", "unknown_count"),
            line(F.col("missing_protein_count") > 0, "%d products have no protein value and are left out", "missing_protein_count"),
            line(F.col("enriched_count") > 0, "%d protein values come from enrichment", "enriched_count"),
            line(F.col("branded_composites") > 0, "%d branded composites are counted whole", "branded_composites"),
        )
    )


def latest_finished(runs: DataFrame, keys: list[str]) -> DataFrame:
    """The run of each key that finished last; unfinished runs don't count."""
    last = runs.filter("finished_at is not null").groupBy(*keys).agg(F.max_by(F.struct("run_id", "finished_at"), F.struct("finished_at", "run_id")).alias("x"))
    return last.select(*keys, "x.run_id", "x.finished_at")


def counted_projects(projects: DataFrame, products: DataFrame, runs: DataFrame) -> DataFrame:
    """Projects with how many products and runs they have; zeros where there are none."""
    p = products.groupBy("project_id").agg(F.count("*").alias("n_products"))
    r = runs.groupBy("project_id").agg(F.count("*").alias("n_runs"))
    return projects.join(p, "project_id", "left").join(r, "project_id", "left").na.fill(0, ["n_products", "n_runs"])


def without_upload(tables: dict[str, DataFrame], products: DataFrame, upload_id: Column) -> dict[str, DataFrame]:
    """Tables keyed by product_id without the products of an upload; runs aren't among them."""
    gone = products.filter(upload_id).select("product_id").distinct()
    return {name: t.join(gone, "product_id", "left_anti") for name, t in tables.items()}


def bulk_errors(asked: DataFrame, queue: DataFrame, most: int, batch: str = "batch") -> DataFrame:
    """batch, item_id, error for items of bulk decisions (batch, item_id) that aren't queued, aren't pending, or lie in a batch of more than `most`; without any a batch may be applied."""
    sizes = asked.groupBy(batch).agg(F.count_distinct("item_id").alias("__n"))
    joined = asked.join(sizes, batch).join(queue.select("item_id", "state"), "item_id", "left")
    error = F.when(F.col("__n") > most, "too_many").when(F.col("state").isNull(), "not_queued").when(F.col("state") != "in_queue", "not_pending")
    return joined.select(batch, "item_id", error.alias("error")).filter("error is not null")


def skips(rows: DataFrame, guards: list[tuple[str, Column]], whole: list[tuple[str, bool]]) -> DataFrame:
    """Add skip_reason: the first guard of a row that holds, else the first that holds for the whole plan, else null."""
    reason = F.lit(next((name for name, holds in whole if holds), None)).cast("string")
    for name, holds in reversed(guards):
        reason = F.when(F.coalesce(holds, F.lit(False)), name).otherwise(reason)
    return rows.withColumn("skip_reason", reason)


def conservative(base_rank: Column, other_rank: Column, same_family: Column, base_accepted: Column) -> Column:
    """Whether to switch to another retrieval: only on a strict improvement within the family, never from an accepted match."""
    return (
        F.when(base_accepted, "keep_accepted")
        .when(other_rank.isNull(), "keep_not_found")
        .when(~same_family, "keep_family_mismatch")
        .when(base_rank.isNull() | (other_rank < base_rank), "switch")
        .otherwise("keep_not_better")
    )


def split_proposal(group: Column, total: Column) -> Column:
    """plant and animal grams that a group implies; null for composites and what lies outside."""
    plant = F.when(group.startswith("plant"), total).when(group == "animal_core", F.lit(0.0))
    return F.when(plant.isNotNull(), F.struct(plant.alias("plant"), (total - plant).alias("animal")))


def duplicates(records: DataFrame, keys: list[str]) -> DataFrame:
    return records.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def backfill(records: DataFrame, desired: DataFrame) -> DataFrame:
    """record_id, status: whether a record's metadata (a map) already has what is wanted of its product."""
    first = desired.groupBy("product_id").agg(F.min_by("name", "ord").alias("name"), F.min_by("code", "ord").alias("code"))
    joined = records.join(first, "product_id", "left")
    want = F.map_filter(F.create_map(F.lit("name"), F.col("name"), F.lit("code"), F.col("code")), lambda k, v: v.isNotNull())
    has = F.forall(F.map_entries(want), lambda e: F.coalesce(F.element_at("metadata", e["key"]) == e["value"], F.lit(False)))
    return joined.select("record_id", F.when(F.col("name").isNull() & F.col("code").isNull(), "no_reference").when(has, "up_to_date").otherwise("would_update").alias("status"))


#: States of a project and those that each leads to.
LIFECYCLE = {
    "created": ["waiting_for_upload"],
    "waiting_for_upload": ["uploaded"],
    "uploaded": ["validation"],
    "validation": ["classification", "review_required"],
    "classification": ["review_required", "calculation"],
    "review_required": ["calculation", "waiting_for_upload"],
    "calculation": ["report_draft"],
    "report_draft": ["report_under_review", "calculation"],
    "report_under_review": ["report_approved", "report_draft"],
    "report_approved": ["delivered"],
    "delivered": ["archived"],
    "archived": [],
}


def may_move(before: Column, after: Column, edges: dict[str, list[str]] = LIFECYCLE) -> Column:
    """Whether a project may go from one state to another."""
    return F.coalesce(F.concat_ws(">", before, after).isin([f"{a}>{b}" for a, some in edges.items() for b in some]), F.lit(False))
