"""Rule trees compiled to boolean columns, verdicts and contradictions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def condition(node: Mapping[str, Any]) -> Column:
    """A boolean Column, never null, of a condition tree.

    A node has one key: any_of or all_of with nodes (an empty all_of is false), or a leaf
    with words: name_or_category_contains, ingredients_contains, labels_contains, brand_in,
    language_in, country_in, taxonomy_equals.
    """
    ((kind, value),) = node.items()
    if kind in ("any_of", "all_of"):
        parts = [condition(n) for n in value]
        out = parts[0] if parts else F.lit(False)
        for p in parts[1:]:
            out = out | p if kind == "any_of" else out & p
        return out
    words = [str(w).lower() for w in ([value] if isinstance(value, str) else value)]
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    if kind == "name_or_category_contains":
        text = F.concat_ws(" ", low("product_name"), low("retailer_category"), low("retailer_subcategory"))
        holds = F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))
    elif kind == "ingredients_contains":
        holds = F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low("ingredients_text"), w))
    elif kind == "labels_contains":
        holds = F.arrays_overlap(F.transform(F.col("labels"), F.lower), F.array(*map(F.lit, words)))
    else:
        column = {"brand_in": "brand", "language_in": "language", "country_in": "country", "taxonomy_equals": "taxonomy"}[kind]
        holds = low(column).isin(words)
    return F.coalesce(holds, F.lit(False))


def ordered(rules: Sequence[Mapping[str, Any]]) -> list[Mapping[str, Any]]:
    """Rules by priority and id; an id given twice is an error."""
    ids = [r["id"] for r in rules]
    if len(set(ids)) < len(ids):
        raise ValueError("a rule id occurs twice")
    return sorted(rules, key=lambda r: (r["priority"], r["id"]))


def fired(rules: Sequence[Mapping[str, Any]]) -> Column:
    """The rules that hold for a row: array of id and category, in order."""
    return F.array_compact(F.array(*[F.when(condition(r["when"]), F.struct(F.lit(r["id"]).alias("id"), F.lit(r["category"]).alias("category"))) for r in ordered(rules)]))


def contradiction(claims: Column, text: Column, animal: Sequence[str], plant_claims: Sequence[str] = ("vegan", "vegetarian", "plant-based")) -> Column:
    """The alphabetically first animal word in a text that a plant claim contradicts; null without one."""
    claimed = F.arrays_overlap(F.transform(claims, F.lower), F.array(*map(F.lit, plant_claims)))
    return F.when(claimed, F.array_min(F.filter(F.array(*map(F.lit, sorted(animal))), lambda w: F.contains(F.lower(text), w))))


def verdicts(products: DataFrame, rules: Sequence[Mapping[str, Any]], contradicts: Column | None = None) -> DataFrame:
    """Add verdict (contradiction, pass_through, matched, collision), category, and rule_ids joined by commas in order."""
    hits = products.withColumn("fired", fired(rules))
    kinds = F.size(F.array_distinct(F.transform("fired", lambda x: x["category"])))
    verdict = F.when(contradicts.isNotNull() if contradicts is not None else F.lit(False), "contradiction").when(F.size("fired") == 0, "pass_through").when(kinds == 1, "matched").otherwise("collision")
    return hits.withColumn("verdict", verdict).withColumn("category", F.when(F.col("verdict") == "matched", F.col("fired")[0]["category"])).withColumn("rule_ids", F.array_join(F.transform("fired", lambda x: x["id"]), ",")).drop("fired")


#: Confidences from which a class is accepted, and the most that a row which a guard corrected may have.
THRESHOLDS, GUARDED = {"protein_tracker": 0.70, "food_groups": 0.70, "single_call": 0.80}, 0.69


def routed(confidence: Column, verdict: Column, threshold: float, guarded: Column | None = None) -> Column:
    """accepted, review or queued: confident answers pass, contradictions and collisions queue, and what a guard corrected is reviewed."""
    sure = F.least(confidence, F.when(F.coalesce(guarded, F.lit(False)), F.lit(GUARDED)).otherwise(F.lit(1.0))) if guarded is not None else confidence
    return F.when(verdict.isin("contradiction", "collision"), "queued").when(sure >= threshold, "accepted").otherwise("review")
