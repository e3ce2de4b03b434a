"""Small policies and names: columns, families, failures, traces, file names, companions."""

import datetime
import hashlib
import json

from pyspark.sql import functions as F

from granary.functions import text
from granary.operators import evaluation, quality_plans, reporting, rules
from granary.sources import catalogue_csv, exports


def test_sensitive_columns():
    names = ["product_name", "Unit-Price (EUR)", "Units__Sold", "Sales volume", "brand", "sell-in"]
    assert quality_plans.sensitive_columns(names) == {"Unit-Price (EUR)": "price", "Units__Sold": "units sold", "Sales volume": "volume", "sell-in": "sell in"}


def test_families_and_policies(spark):
    keywords = [("non_food", ["household"]), ("meat", ["meat", "poultry"]), ("dairy", ["dairy"])]
    df = spark.createDataFrame([("Meat, poultry", "x"), ("HOUSEHOLD meat", "x"), ("Soups", "prepared_meal"), (None, "fish")], "g string, by_name string")
    assert [r.f for r in df.select(quality_plans.candidate_family(F.col("g"), keywords, F.col("by_name")).alias("f")).collect()] == ["meat", "non_food", "prepared_meal", "fish"]
    rows = spark.createDataFrame([("milk", ["cat", "milk"]), (None, ["cat", "food"]), (None, ["soap"]), (None, ["bread"]), (None, None)], "concept string, words array<string>")
    got = rows.select(quality_plans.product_policy(F.col("concept"), F.col("words"), ["cat"], ["soap"]).alias("p")).collect()
    assert [r.p for r in got] == ["food", "pet", "non_food", "food", "food"]
    pairs = spark.createDataFrame([("meat", "prepared_meal", True), ("meat", "dairy", False), ("unknown_food", "fish", True), ("unknown_food", "non_food", False), ("non_food", "non_food", True), ("tofu_substitute", "dairy", True), ("dairy", "tofu_substitute", False)], "a string, b string, fits boolean")
    assert pairs.filter(quality_plans.family_compatible(F.col("a"), F.col("b")) != F.col("fits")).count() == 0


def test_routes_moves_failures_and_traces(spark):
    rows = spark.createDataFrame([(0.95, "matched", False), (0.95, "matched", True), (0.6, "matched", None), (0.95, "collision", False), (0.70, "matched", None)], "c double, v string, g boolean")
    assert [r.r for r in rows.select(rules.routed(F.col("c"), F.col("v"), 0.70, F.col("g")).alias("r")).collect()] == ["accepted", "review", "review", "queued", "accepted"]
    moves = spark.createDataFrame([("created", "uploaded", False), ("report_draft", "calculation", True), ("archived", "created", False), (None, "created", False)], "a string, b string, ok boolean")
    assert moves.filter(reporting.may_move(F.col("a"), F.col("b")) != F.col("ok")).count() == 0
    cases = spark.createDataFrame([(1, True, True, "ok"), (4, True, True, "ranked_low"), (15, True, True, "ranked_very_low"), (99, True, True, "missed"), (None, True, True, "not_retrieved"), (None, False, True, "not_indexed"), (None, False, False, "no_text")], "r int, i boolean, t boolean, want string")
    assert cases.filter(evaluation.failure(F.col("r"), F.col("i"), F.col("t")) != F.col("want")).count() == 0
    traced = spark.createDataFrame([(5,), (50,), (None,)], "n int").select(text.all_matches([("small", F.col("n") < 10), ("odd", F.col("n") % 2 == 1), ("large", F.col("n") > 20)]).alias("m")).collect()
    assert [r.m for r in traced] == [["small", "odd"], ["large"], []]


def test_names_checksums_and_companions(spark, tmp_path):
    df = spark.createDataFrame([("Shop & Co", "protein_tracker", "2024/H1", datetime.date(2024, 7, 1))], "p string, m string, r string, d date")
    assert df.select(exports.file_name(F.col("p"), F.col("m"), F.col("r"), F.col("d")).alias("n")).first().n == "shop-co_protein_tracker_2024-h1_20240701.csv"
    file = tmp_path / "c.json"
    file.write_text(json.dumps({"p1": {"ingredients": [{"food_group": "FG1", "subgroup": "legumes", "ingredient_weight_kg_per_item": 0.01}, {"food_group": "FG4", "subgroup": None, "ingredient_weight_kg_per_item": 0.02}]}}))
    got = catalogue_csv.read_companion(spark, str(file)).orderBy("place").collect()
    assert [(r.external_product_id, r.place, r.food_group, r.subgroup, float(r.weight_kg_per_item)) for r in got] == [("p1", 0, "FG1", "legumes", 0.01), ("p1", 1, "FG4", None, 0.02)]
    read = spark.read.format("binaryFile").load(str(file)).select(catalogue_csv.checksum().alias("c")).first().c
    assert read == hashlib.sha256(file.read_bytes()).hexdigest()
