"""Exports of runs as files, and checks of ingredients."""

import csv
import io
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from granary.functions import numeric
from granary.operators import ingredients, protein
from granary.plans import catalogue
from granary.sources import run_exports

RUN = {"run_id": "r1", "methodology": "protein_tracker", "reporting_period_label": "2024, half"}


def pt(spark):
    kind = "product_id long, pt_group string, w string, n string, p string, protein_source string"
    rows = spark.createDataFrame([(1, "plant_based_core", "0.4", "2000", "9", "label"), (2, "out_of_scope", "1", "3", "5", "reference_db"), (3, "composite_products", "0.5", "10", None, "label")], kind)
    d = lambda c, t: F.col(c).cast(t)
    products = protein.resolved(rows.select("product_id", "pt_group", "protein_source", d("w", "decimal(18,14)").alias("weight_per_item_kg"), d("n", "decimal(18,2)").alias("items_purchased"), d("p", "decimal(18,10)").alias("protein_pct")))
    masters = spark.createDataFrame([(1, "E1", 'Tofu "soft", 400 g\nnew', None)], "product_id long, external_product_id string, product_name string, brand string")
    meta = spark.createDataFrame([(1, "deterministic", "1", "r9")], "product_id long, classification_source string, c string, classification_rule_id string")
    meta = meta.withColumn("classification_confidence", F.col("c").cast("decimal(18,8)")).drop("c")
    run_rows = protein.run_rows(products)
    return run_exports.cells(run_rows.withColumnRenamed("used_split", "used_per_product_split"), run_exports.PT_COLUMNS, RUN, masters, meta), products, run_rows


def test_pt_csv_file(spark, tmp_path):
    export, _, _ = pt(spark)
    assert len(run_exports.PT_COLUMNS) == 26 and len(run_exports.WWF_COLUMNS) == 27
    run_exports.write_csv(export, run_exports.PT_COLUMNS, str(tmp_path / "csv"))
    raw = b"".join(p.read_bytes() for p in sorted(Path(tmp_path / "csv").glob("part-*")))
    assert raw.startswith(b"\xef\xbb\xbfrun_id,methodology,")
    rows = {r["product_id"]: r for r in csv.DictReader(io.StringIO(raw.decode("utf-8-sig"), newline=""))}
    assert set(rows) == {"1", "2"} and rows["1"]["product_name"] == 'Tofu "soft", 400 g\nnew' and rows["1"]["reporting_period_label"] == "2024, half"
    first, second = rows["1"], rows["2"]
    assert (first["volume_kg"], first["protein_kg"], first["used_per_product_split"], first["plant_protein_kg"], first["classification_confidence"]) == ("800.00000000", "72.00000000", "false", "", "1.00000000")
    assert (second["protein_kg"], second["external_product_id"], second["classification_source"]) == ("0.00000000", "", "")


def test_lines_write_a_product_once(spark):
    """The lines are those of all cells joined to each row, and hold a product's text once a product: before, every row's cells were searched for quotes."""
    kind = "product_id long, n decimal(18,8), pt_group string, brand string"
    numbers = ["0", "0.00000001", "-0.00000099", "-0.000001", "1.5", "-2", None, "9999999999.99999999"]
    rows = spark.createDataFrame([(k % 5 if k % 5 else None, n, ['a,"b"', "c\nd\r", None][k % 3], "own") for k, n in enumerate(numbers * 3)], kind.replace("decimal(18,8)", "string")).withColumn("n", F.col("n").cast("decimal(18,8)"))
    rows = rows.select("product_id", "pt_group", "brand", F.col("n").alias("volume_kg"), F.col("n").alias("protein_pct"), (F.col("n") > 0).alias("used_per_product_split"))
    masters = spark.createDataFrame([(1, 'x, "y"', None), (2, "z\n", "B"), (None, "none", "none"), (9, "unused", "B")], "product_id long, product_name string, brand string")
    meta = spark.createDataFrame([(1, "ai", 0.5), (3, "manual, too", None)], "product_id long, classification_source string, c double").select("product_id", "classification_source", F.col("c").cast("decimal(18,8)").alias("classification_confidence"))
    both = (rows, run_exports.PT_COLUMNS, RUN, masters, meta)
    want = run_exports.cells(*both).select(run_exports.csv_line(run_exports.PT_COLUMNS).alias("line"))
    lines = run_exports.csv_lines(*both)
    assert sorted(r.line for r in lines.collect()) == sorted(r.line for r in want.collect()) and lines.count() == 24
    read = list(csv.reader(io.StringIO("\n".join(r.line for r in lines.filter("line like '%manual%'").collect()), newline="")))
    at = run_exports.PT_COLUMNS.index
    assert read and {len(r) for r in read} == {26} and {r[at("classification_source")] for r in read} == {"manual, too"} and {r[at("reporting_period_label")] for r in read} == {"2024, half"}


def test_small_decimals_as_text(spark):
    cases = {"0": "0.00000000", "0.00000001": "0.00000001", "-0.00000099": "-0.00000099", "-0.000001": "-0.00000100", "0.0000005": "0.00000050", "-12.5": "-12.50000000", "0.000000004": "0.00000000", "-0.000000004": "-0.00000000", "99999999999.123456789": "99999999999.12345679"}
    got = spark.createDataFrame([(c,) for c in cases], "c string").select("c", numeric.plain_text(F.col("c").cast("decimal(28,12)")).alias("t")).collect()
    assert {r.c: r.t for r in got} == cases


@pytest.mark.parametrize("name", ["export_pt_csv", "export_wwf_csv"])
def test_exports_join_lines_with_products_once(spark, name):
    """Each line meets its part, and then all that is known of the product at once: before, every side was joined to the lines."""
    node, joins = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan(), 0
    while node.children().size():  # the lines are on the left of every join
        joins += node.children().size() == 2
        node = node.children().apply(0)
    assert joins == 2


def test_pt_json(spark, tmp_path):
    export, products, rows = pt(spark)
    summary = run_exports.pt_summary(protein.headline(rows), protein.group_totals(rows), protein.counters(products, rows), "draft")
    run_exports.write_json(run_exports.json_rows(export, run_exports.PT_COLUMNS), summary, RUN, str(tmp_path / "json"))
    read = lambda name: [json.loads(x) for p in sorted(Path(tmp_path / "json" / name).glob("part-*")) for x in p.read_text().splitlines()]
    (envelope,), found = read("envelope"), {r["product_id"]: r for r in read("rows")}
    assert envelope["run"] == {"id": "r1", "methodology": "protein_tracker", "reporting_period_label": "2024, half"}
    assert envelope["summary"]["by_group"]["plant_based_core"] == {"item_count": 1, "volume_kg": "800.00000000", "protein_kg": "72.00000000"}
    assert envelope["summary"]["out_of_scope_rows"] == 1 and envelope["summary"]["plant_share_pct"] == "100.00000000" and len(envelope["summary"]["by_group"]) == 4
    assert found["1"]["classification"] == {"source": "deterministic", "confidence": "1.00000000", "rule_id": "r9", "ai_model": None, "reviewer_user_id": None}
    assert found["2"]["classification"] is None and found["2"]["product_name"] is None and found["1"]["used_per_product_split"] is False


CASES = [
    ({"food_group": "FG1", "subgroup": "legumes", "ingredient_weight_kg_per_item": 0.07}, None, None, []),
    ({"food_group": "FG1", "subgroup": "legumes", "ingredient_weight_kg_per_item": "0.02"}, None, None, ["duplicate"]),
    ({"food_group": "FG3", "subgroup": None, "ingredient_weight_kg_per_item": 0.01}, None, None, ["fg3_without_subgroup"]),
    ({"food_group": "FG4", "subgroup": "anything", "ingredient_weight_kg_per_item": 0.01}, None, None, []),
    ({"food_group": "FG5", "subgroup": "whole_grain", "ingredient_weight_kg_per_item": 0.01}, None, None, []),
    ({"food_group": "FG5", "subgroup": "rye", "ingredient_weight_kg_per_item": 0.01}, "subgroup", "invalid_enum", []),
    ({"food_group": "FG2", "ingredient_weight_kg_per_item": 0.01}, "subgroup", "required", []),
    ({"food_group": "FG2", "subgroup": "legumes", "ingredient_weight_kg_per_item": 0.01}, "subgroup", "invalid_enum", []),
    ({"food_group": "FG7", "ingredient_weight_kg_per_item": 0.01}, "food_group", "not_decomposed", []),
    ({"food_group": "meat"}, "food_group", "invalid_enum", []),
    ({}, "food_group", "required", []),
    ("text", "ingredient", "not_object", []),
    ({"food_group": "FG4"}, "ingredient_weight_kg_per_item", "required", []),
    ({"food_group": "FG4", "ingredient_weight_kg_per_item": "many"}, "ingredient_weight_kg_per_item", "invalid_type", []),
    ({"food_group": "FG4", "ingredient_weight_kg_per_item": -1}, "ingredient_weight_kg_per_item", "non_positive", []),
]


def test_ingredients_one_by_one(spark):
    df = spark.createDataFrame([(json.dumps({"p1": {"ingredients": [c for c, *_ in CASES]}, "p2": {"ingredients": []}, "p3": {}}),)], "json string")
    got = {r.place: (r.field, r.code, r.warnings) for r in ingredients.ingredient_checks(ingredients.items_of(df)).collect()}
    assert got == {k: (f, c, w) for k, (_, f, c, w) in enumerate(CASES)}
    branded = ingredients.ingredient_checks(ingredients.items_of(df), F.lit(False)).collect()
    assert not any(r.warnings for r in branded)
    kept = {r.place: (r.food_group, r.subgroup) for r in ingredients.ingredient_checks(ingredients.items_of(df)).collect()}
    assert kept[3] == ("FG4", None) and kept[0] == ("FG1", "legumes") and kept[5] == (None, None)
