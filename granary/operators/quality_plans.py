"""Plans of nutrition matches that people review: actions, priorities, buckets, packages, and comparison with what is stored."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A confidence from which a match is taken by itself, and from which an alternative is worth a look.
AUTO_HIGH = 0.97
#: Actions that take a match back for nutrition's sake, and reasons that mean a generic proxy.
DOWNGRADES = ["skip_state_mismatch", "skip_proxy_too_broad", "skip_no_nutrition_value"]
GENERIC = ["generic snack proxy", "blend/margarine", "wrong oil type"]
#: Parts of column names that no plan may carry.
SENSITIVE = [
    "volume", "sales", "revenue", "turnover", "price", "margin", "units sold", "quantity sold", "market share", "sellout", "sell in", "sell through", "store count", "distribution", "velocity",
]
#: Decisions of a review package, and what an empty one counts as.
DECISIONS = ["approve", "reject", "replace", "needs_more_info", "pending"]
#: Families that a product's family may take a reference from, beside its own. Unknown food takes any but non-food.
FAMILIES = {
    "meat": ["prepared_meal"],
    "fish": ["prepared_meal"],
    "egg": ["prepared_meal"],
    "dairy": ["sweet_bakery"],
    "legume": ["nuts_seeds"],
    "nuts_seeds": ["legume"],
    "tofu_substitute": ["legume", "dairy"],
    "cereal_bread_pasta": ["sweet_bakery"],
    "fruit_veg": ["prepared_meal"],
    "sweet_bakery": ["dairy", "cereal_bread_pasta"],
    "prepared_meal": ["meat", "fish", "egg", "dairy", "cereal_bread_pasta", "fruit_veg"],
}


def family_compatible(product: Column, candidate: Column) -> Column:
    """Whether a product's family may take a candidate's. The relation isn't symmetric, and non-food meets non-food alone."""
    pairs = [f"{a}>{b}" for a, some in FAMILIES.items() for b in some]
    allowed = (product == candidate) | F.concat_ws(">", product, candidate).isin(pairs) | (product == "unknown_food")
    return F.when((product == "non_food") | (candidate == "non_food"), product == candidate).otherwise(allowed)


def candidate_family(group: Column, keywords: list[tuple[str, list[str]]], by_name: Column) -> Column:
    """The first family one of whose keywords a reference's group holds; without one, the family of its name."""
    low = F.lower(group)
    found = F.lit(None).cast("string")
    for family, words in reversed(keywords):
        holds = F.lit(False)
        for w in words:
            holds = holds | F.contains(low, F.lit(w))
        found = F.when(F.coalesce(holds, F.lit(False)), family).otherwise(found)
    return F.coalesce(found, by_name)


def product_policy(concept: Column, words: Column, pet: list[str], non_food: list[str]) -> Column:
    """food, pet or non_food: a known food concept wins, then the markers of pets and households; the rest counts as food."""
    some = lambda marks: F.arrays_overlap(words, F.array(*map(F.lit, marks)))
    return F.when(concept.isNotNull(), "food").when(F.coalesce(some(pet), F.lit(False)), "pet").when(F.coalesce(some(non_food), F.lit(False)), "non_food").otherwise("food")


def review_columns(rows: DataFrame) -> DataFrame:
    """Add suggested_action, review_priority and review_bucket to plan rows.

    Rows have policy, safety_action, safety_reason, matcher_outcome, confidence and has_candidates. A product that is no food and was
    matched all the same comes first (P0).
    """
    c = F.col
    generic = F.lit(False)
    for reason in GENERIC:
        generic = generic | F.contains(F.coalesce("safety_reason", F.lit("")), F.lit(reason))
    listed, no_food = F.coalesce("has_candidates", F.lit(False)), c("policy").isin("pet", "non_food")
    action = (
        F.when(c("policy") == "pet", "reject_policy_excluded").when(c("policy") == "non_food", "reject_non_food").when(c("safety_action") == "would_enrich", "approve_auto_candidate")
        .when(c("safety_action") == "skip_state_mismatch", "review_state_mismatch").when(c("safety_action") == "skip_proxy_too_broad", "review_proxy_too_broad")
        .when((c("safety_action") == "route_to_review") & generic, "review_generic_proxy").when((c("safety_action") == "skip_no_match") & listed, "review_no_match").otherwise("needs_manual_search")
    )
    rows = rows.withColumn("suggested_action", action)
    a = c("suggested_action")
    priority = (
        F.when(no_food, F.when(c("matcher_outcome") != "no_match", "P0").otherwise("P3")).when(a == "approve_auto_candidate", F.when(F.coalesce("confidence", F.lit(0.0)) >= AUTO_HIGH, "P2").otherwise("P1"))
        .when(a.isin("review_no_match", "needs_manual_search"), F.when(listed, "P1").otherwise("P2")).otherwise("P1")
    )
    bucket = (
        F.when(a.isin("reject_non_food", "reject_policy_excluded"), "non_food_policy").when(a == "approve_auto_candidate", "auto_ready").when(a == "review_state_mismatch", "state_mismatch")
        .when(a == "review_proxy_too_broad", "proxy_too_broad").when(a == "review_generic_proxy", "needs_review").when(a == "review_no_match", "no_match")
        .otherwise(F.when(c("matcher_outcome") == "no_match", "no_match").otherwise("needs_review"))
    )
    return rows.withColumn("review_priority", priority).withColumn("review_bucket", bucket)


def batch_bucket(outcome: Column, action: Column, policy: Column) -> Column:
    """What a batch does with a match; enriching what is no food is the only true risk."""
    auto = (outcome == "auto_accept") & (action == "would_enrich")
    return (
        F.when(auto, F.when(policy == "non_food", "true_high_risk").otherwise("auto_ready")).when(outcome.isin("no_match", "policy_excluded") | (action == "skip_no_match"), "no_match")
        .when(action.isin(DOWNGRADES), "safety_downgrade").otherwise("needs_review")
    )


def diff_bucket(action: Column, confidence: Column) -> Column:
    """What becomes of a product whose match in a batch differs from the stored one."""
    kept = ~F.coalesce(action == "would_enrich", F.lit(False))
    return F.when(kept, "safety_downgraded_current_batch").when(F.coalesce(confidence.try_cast("double"), F.lit(0.0)) >= AUTO_HIGH, "current_batch_better").otherwise("needs_manual_review")


def sensitive_columns(names: list[str]) -> dict[str, str]:
    """Columns that a plan mustn't carry, and the part of the name that says so."""
    plain = {n: re.sub("[^a-z0-9]+", " ", n.lower()).strip() for n in names}
    return {n: next(x for x in SENSITIVE if x in p) for n, p in plain.items() if any(x in p for x in SENSITIVE)}


def against_stored(batch: DataFrame, stored: DataFrame, total_version: str, split_version: str) -> DataFrame:
    """The batch (product_id, code) with has_total, has_split, stored_code and matches: true, false, or unknown where a code is missing.

    stored: product_id, record_id, version, nutrient, code. Of several totals the first record counts.
    """
    total = (F.col("version") == total_version) & (F.col("nutrient") == "protein_pct")
    has = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    facts = stored.groupBy("product_id").agg(has(total).alias("has_total"), has(F.col("version") == split_version).alias("has_split"), F.min_by(F.when(total, F.struct("code")), F.when(total, F.col("record_id"))).alias("x"))
    joined = batch.join(facts, "product_id", "left")
    mine, theirs = F.nullif(F.col("code"), F.lit("")), F.nullif(F.col("x.code"), F.lit(""))
    known = F.coalesce("has_total", F.lit(False)) & theirs.isNotNull() & mine.isNotNull()
    matches = F.when(~known, "unknown").when(mine == theirs, "true").otherwise("false")
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return joined.select(*batch.columns, flag("has_total"), flag("has_split"), theirs.alias("stored_code"), matches.alias("matches"))


def package_summary(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, total_rows, a count for each decision, error_count, blocked_count, apply_ready_count, recommendation of review packages.

    Rows have manual_decision (empty or null: pending) and errors (array). One error blocks the package, one open row keeps it incomplete.
    """
    decision = F.coalesce(F.nullif(F.lower(F.trim("manual_decision")), F.lit("")), F.lit("pending"))
    bad = F.size(F.coalesce("errors", F.array().cast("array<string>")))
    ready = (bad == 0) & decision.isin("approve", "replace")
    n = lambda c, name: F.count_if(c).alias(name)
    counts = rows.groupBy(*keys).agg(F.count("*").alias("total_rows"), *[n(decision == d, f"{d}_count") for d in DECISIONS], F.sum(bad).alias("error_count"), n(bad > 0, "blocked_count"), n(ready, "apply_ready_count"))
    open_rows = F.col("pending_count") + F.col("needs_more_info_count") > 0
    return counts.withColumn("recommendation", F.when(F.col("error_count") > 0, "blocked_by_errors").when(open_rows, "review_incomplete").otherwise("ready_for_apply_planning"))


def case_deltas(v1: DataFrame, v2: DataFrame) -> DataFrame:
    """case_id, expected, v1, v2, kind for cases that both versions have (case_id, expected, predicted)."""
    right = lambda c: F.coalesce(F.col(c) == F.col("expected"), F.lit(False))
    joined = v1.select("case_id", "expected", F.col("predicted").alias("v1")).join(v2.select("case_id", F.col("predicted").alias("v2")), "case_id")
    kind = F.when(right("v1") & right("v2"), "both_correct").when(right("v2"), "improvement").when(right("v1"), "regression").otherwise("both_wrong")
    return joined.withColumn("kind", kind)
