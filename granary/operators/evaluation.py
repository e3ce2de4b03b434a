"""Quality of classification and retrieval against truth, agreement of versions, and deduplication by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.text import short_key


def classification_metrics(cases: DataFrame) -> DataFrame:
    """One row over (expected, predicted, accepted): accuracy, accuracy of what was accepted, review rate, wrongly accepted."""
    right = F.col("expected") == F.col("predicted")
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    counts = cases.agg(F.count("*").alias("n_cases"), n(right).alias("n_right"), n(F.col("accepted")).alias("n_accepted"), n(F.col("accepted") & right).alias("n_accepted_right"))
    share = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0)), 6)
    return counts.select(
        "n_cases", share("n_right", "n_cases").alias("accuracy"), share("n_accepted_right", "n_accepted").alias("accepted_accuracy"),
        F.round(1 - share("n_accepted", "n_cases"), 6).alias("review_rate"), (F.col("n_accepted") - F.col("n_accepted_right")).alias("wrong_accepted"),
    )


def full_metrics(cases: DataFrame, least: float = 0.90) -> DataFrame:
    """One row of all figures over cases (expected, predicted, confidence, review, name[, expected_composite, composite, expected_bucket, bucket]); cases without truth don't count.

    A case is accepted by itself from a confidence on, unless it is for review. One without a prediction abstains: unknown_readable if it has a name, else failed.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    n = lambda c, name: F.count_if(yes(c)).alias(name)
    c = F.col
    for x, t in (("expected_composite", "boolean"), ("composite", "boolean"), ("expected_bucket", "string"), ("bucket", "string")):
        if x not in cases.columns:
            cases = cases.withColumn(x, F.lit(None).cast(t))
    none, right = F.coalesce(c("predicted"), F.lit("")) == "", c("expected") == c("predicted")
    auto, named = (c("confidence") >= least) & ~yes(c("review")), F.length(F.trim(F.coalesce("name", F.lit("")))) > 0
    is_composite = yes(c("expected_composite"))
    counts = cases.filter("expected is not null").agg(
        F.count("*").alias("total"), n(right, "correct"), n(none, "abstained"), n(none & named, "unknown_readable"), n(none & ~named, "failed"), n(c("review"), "review_count"), n(auto, "auto_accepted"),
        n(auto & yes(right), "auto_correct"), n(auto & ~yes(right) & ~none, "wrong_accepted"), n(is_composite == yes(c("composite")), "composite_flag_correct"), n(is_composite, "composite_buckets"),
        n(is_composite & c("bucket").eqNullSafe(c("expected_bucket")), "composite_bucket_correct"),
    )
    share = lambda a, b: F.round(F.coalesce(F.try_divide(c(a).cast("double"), c(b).cast("double")), F.lit(0.0)), 6)
    return counts.withColumn("accuracy", share("correct", "total")).withColumn("auto_accept_accuracy", share("auto_correct", "auto_accepted")).withColumn("review_rate", share("review_count", "total"))


def match_quality(cases: DataFrame, least: float = 0.90) -> DataFrame:
    """One row of figures over matches (should_match, expected, matched, confidence, review, forbidden: actions of the gate on forbidden candidates).

    precision: of matches sure enough to be taken, those that are right. A sure match that is wrong, a match that shouldn't be, and a forbidden candidate that
    the gate accepts are false positives.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    n = lambda c, name: F.count_if(yes(c)).alias(name)
    c = F.col
    asked, found = yes(c("should_match")) & c("expected").isNotNull(), c("matched").isNotNull()
    sure, right = (c("confidence") >= least) & ~yes(c("review")), c("matched") == c("expected")
    taken = F.filter(F.coalesce("forbidden", F.array().cast("array<string>")), lambda a: a.startswith("accepted"))
    counts = cases.agg(
        F.count("*").alias("total"), n(asked, "should_match_total"), n(asked & found & yes(right), "matched_correct"), n(asked & found & sure, "high_confidence_total"), n(asked & found & sure & yes(right), "high_confidence_correct"),
        n((asked & found & sure & ~yes(right)) | (~yes(c("should_match")) & found & ~yes(c("review"))), "wrong_matches"), F.coalesce(F.sum(F.size(F.coalesce("forbidden", F.array().cast("array<string>")))), F.lit(0)).alias("forbidden_total"),
        F.coalesce(F.sum(F.size(taken)), F.lit(0)).alias("forbidden_accepted"), n((asked & ~found) | (~yes(c("should_match")) & ~(found & ~yes(c("review")))), "abstained"),
    )
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), 6)
    counts = counts.withColumn("false_positives", F.col("wrong_matches") + F.col("forbidden_accepted")).withColumn("precision", share(c("high_confidence_correct"), c("high_confidence_total")))
    return counts.withColumn("forbidden_rejection", share(c("forbidden_total") - c("forbidden_accepted"), c("forbidden_total"))).drop("wrong_matches", "forbidden_accepted")


def retrieval_metrics(ranks: DataFrame, at: tuple[int, ...] = (1, 5, 10, 20)) -> DataFrame:
    """One row over (case_id, rank; null if not found): coverage, recall at some ranks, mean rank."""
    share = lambda c: F.round(F.coalesce(F.avg(F.coalesce(c, F.lit(False)).cast("double")), F.lit(0.0)), 6)
    return ranks.agg(F.count("*").alias("n_cases"), share(F.col("rank").isNotNull()).alias("coverage"), *[share(F.col("rank") <= k).alias(f"recall_at_{k}") for k in at], F.round(F.avg("rank"), 6).alias("mean_rank"))


def change(before: Column, after: Column, same_candidate: Column) -> Column:
    """How a rank changed between two retrievals; null is not found."""
    lost, gained = after.isNull() & before.isNotNull(), before.isNull() & after.isNotNull()
    return F.when(gained | (after < before), "improved").when(lost | (after > before), "regressed").when(~F.coalesce(same_candidate, F.lit(True)), "changed_candidate").otherwise("same")


def agreement(v1: Column, v2: Column, concept1: Column, concept2: Column) -> Column:
    """How the codes that two versions matched agree (null: no match), and else the concepts of their names."""
    found = F.when(v1.isNull() & v2.isNull(), "both_no_match").when(v2.isNull(), "v1_only").when(v1.isNull(), "v2_only")
    return found.when(v1.cast("string") == v2.cast("string"), "same_code").when(concept1 == concept2, "same_concept").otherwise("disagreement_needs_review")


def risk(agreed: Column, v2: Column, review_required: Column, consistent: Column, v1_off_concept: Column, specificity: Column | None = None) -> Column:
    """What a pair of matches means: agreement is safe, a match for review is a person's, a consistent one of version 2 beats version 1.

    specificity: which name says more, v1_more_specific or v2_more_specific, where the concepts are the same.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    more = F.coalesce(specificity if specificity is not None else F.lit(None).cast("string"), F.lit("safe_agreement"))
    kept = yes(consistent) & v2.isNotNull()
    out = F.when(agreed.isin("same_code", "both_no_match"), "safe_agreement").when(agreed == "same_concept", more).when(yes(review_required), "v2_review_only")
    out = out.when(kept & (yes(v1_off_concept) | agreed.isin("v2_only", "disagreement_needs_review")), "v2_better_than_v1")
    return out.when(v2.isNotNull() & ~kept, "v2_potential_false_positive").otherwise("manual_inspection_needed")


def recommendation(false_positives: Column, better: Column) -> Column:
    """Whether version 2 may be turned on: one potential false positive keeps it off, a gain makes it a candidate."""
    return F.when(false_positives > 0, "keep_off").when(better > 0, "admin_opt_in_candidate").otherwise("internal_shadow_ok")


def members(rows: DataFrame, parts: list[str], id_col: str) -> DataFrame:
    """key, id: the group of each row, by its normalised parts. Nulls count as empty. A group is rows, never an array."""
    text = F.concat_ws("|", *[F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))) for c in parts])
    return rows.select(short_key(text).alias("key"), F.col(id_col).alias("id"))


def canonical_groups(rows: DataFrame, parts: list[str], id_col: str) -> DataFrame:
    """key, group_size, first_id: rows whose normalised parts are equal."""
    return members(rows, parts, id_col).groupBy("key").agg(F.count("*").alias("group_size"), F.min("id").alias("first_id"))


def failure(rank: Column, in_index: Column, has_text: Column) -> Column:
    """Why a retrieval case failed."""
    return F.when(~has_text, "no_text").when(~in_index, "not_indexed").when(rank.isNull(), "not_retrieved").when(rank == 1, "ok").when(rank <= 5, "ranked_low").when(rank <= 20, "ranked_very_low").otherwise("missed")


def split_audit(records: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """product_id, plant, animal, total, status: whether plant and animal protein add up to the total."""
    wide = records.groupBy("product_id").pivot("nutrient", ["plant_protein", "animal_protein", "protein"]).agg(F.sum("value"))
    off = F.abs(F.col("plant_protein") + F.col("animal_protein") - F.col("protein"))
    return wide.withColumn("status", F.when(off.isNull(), "missing").when(off > tolerance, "invalid").otherwise("ok"))
