"""Catalogue operators: golden figures, parsing, units, streams, and every query against DuckDB."""

import os
import time
from decimal import Decimal

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from granary.functions import numeric, text
from granary.operators import comparison, coverage, enrichment, evaluation, food_groups, ingest, matching, protein, review, rules
from granary.plans import catalogue
from granary.sources import catalogue_csv, exports
from granary.streaming import limits

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
PT = "external_product_id string, pt_group string, w string, items_purchased long, p string, protein_source string, plant string, animal string"


def pt_products(spark, rows):
    df = spark.createDataFrame([(*r, *[None] * (8 - len(r))) for r in rows], PT)
    d = lambda c, t: F.col(c).cast(t)
    return df.select(
        F.col("external_product_id").alias("product_id"), "pt_group", d("w", "decimal(18,14)").alias("weight_per_item_kg"), "items_purchased", d("p", "decimal(18,10)").alias("protein_pct"), "protein_source",
        d("plant", "decimal(18,10)").alias("plant_protein_pct"), d("animal", "decimal(18,10)").alias("animal_protein_pct"),
    )


def test_golden_split(spark):
    own = [("1", 0.4, 2000, 9.0, 2.7, 6.3), ("2", 0.45, 1800, 8.5, 1.7, 6.8), ("3", 0.35, 1100, 7.0, 4.9, 2.1), ("4", 0.22, 4500, 12.0, None, None), ("5", 0.4, 900, 8.8, 0.9, 7.9), ("6", 0.35, 700, 6.0, 5.4, 0.6)]
    products = pt_products(spark, [(i, "composite_products", str(w), n, str(p), "label", a and str(a), b and str(b)) for i, w, n, p, a, b in own])
    products = protein.resolved(products)
    rows = protein.run_rows(products)
    r = protein.headline(rows).first()
    assert [str(x) for x in r] == ["130.10500000", "202.87500000", "332.98000000", "39.07291729", "60.92708271"]
    assert {x.product_id: str(x.protein_kg) for x in rows.collect()} == {"1": "72.00000000", "2": "68.85000000", "3": "26.95000000", "4": "118.80000000", "5": "31.68000000", "6": "14.70000000"}
    groups = {g.pt_group: (str(g.volume_kg), g.item_count) for g in protein.group_totals(rows).collect()}
    assert groups["composite_products"] == ("3590.00000000", 6) and len(groups) == 4 and groups["animal_core"][1] == 0
    c = protein.counters(products, rows).first()
    assert (c.rows_label, c.rows_reference, c.rows_with_split) == (6, 0, 5)
    half = protein.headline(protein.run_rows(products, split=False)).first()
    assert half.plant_protein_kg == half.animal_protein_kg and half.plant_share_pct == 50


def test_golden_step2(spark):
    rows = [("1", "vegan", True, "0.4", 2000), ("2", "meat_based", True, "0.35", 3500), ("3", "vegetarian", True, "0.4", 1500), ("4", "seafood_based", True, "0.3", 1200), ("5", "meat_based", False, "0.38", 4200), ("6", "vegan", True, "0.35", 1800)]
    df = spark.createDataFrame(rows, "product_id string, bucket string, is_own_brand boolean, w string, items_sold long")
    products = df.select("product_id", "bucket", "is_own_brand", "items_sold", F.col("w").cast("decimal(18,14)").alias("weight_per_item_kg"), F.lit("FG1").alias("food_group"), F.lit("legumes").alias("subgroup"), F.lit(True).alias("is_composite"))
    json = '{"1": {"ingredients": [{"food_group": "FG1", "subgroup": "alternative_protein_sources", "ingredient_weight_kg_per_item": 0.070}, {"food_group": "FG2", "subgroup": "cheese", "ingredient_weight_kg_per_item": 0.020}]}, "5": {"ingredients": [{"food_group": "FG4", "subgroup": null, "ingredient_weight_kg_per_item": 0.1}]}}'
    parts = catalogue_csv.parse_companion(spark.createDataFrame([(json,)], "j string"), "j").withColumnRenamed("external_product_id", "product_id")
    run = food_groups.run_rows(products)
    b = food_groups.bucket_totals(run).first()
    assert [str(x) for x in b] == ["5211.00000000", "2821.00000000", "360.00000000", "600.00000000", "1430.00000000"]
    shares = {r.food_group: r for r in food_groups.group_shares(run, parts).collect()}
    assert len(shares) == 7 and str(shares["FG1"].weight_kg) == "140.00000000" and str(shares["FG2"].weight_kg) == "40.00000000"
    assert str(shares["FG2"].weight_kg_dairy) == "400.00000000" and shares["FG4"].weight_kg == 0  # a branded composite has no second step
    d = food_groups.whole_diet(run, parts).first()
    assert (str(d.plant_kg), str(d.animal_kg)) == ("140.00000000", "400.00000000")


def test_nothing_in_scope(spark):
    rows = protein.run_rows(protein.resolved(pt_products(spark, [("1", "unknown", "1", 5, "10", "label")])))
    r = protein.headline(rows).first()
    assert r.total_protein_kg == 0 and r.plant_share_pct is None
    assert sum(g.item_count for g in protein.group_totals(rows).collect()) == 0


def test_half_even(spark):
    got = spark.sql("select cast('0.000000005' as decimal(12,9)) a, cast('0.000000015' as decimal(12,9)) b").select(numeric.q8(F.col("a")), numeric.q8(F.col("b"))).first()
    assert [str(Decimal(x).quantize(Decimal("1e-8"))) for x in got] == ["0E-8", "2E-8"]


def test_numbers(spark):
    cases = {"1,234": "1.234", "1.234,5": "1234.5", "12.5": "12.5", "": None, " ": None, "abc": None, "1,234.5": None, None: None, "-3": "-3", "1.234.567,8": "1234567.8"}
    got = spark.createDataFrame([(k,) for k in cases], "x string").select(numeric.to_decimal(F.col("x")).alias("d"), numeric.unreadable(F.col("x")).alias("u"), "x").collect()
    for r in got:
        assert (r.d is None) == (cases[r.x] is None) and (r.d is None or r.d == Decimal(cases[r.x])), r
        assert r.u == (r.x in ("abc", "1,234.5"))


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.decimals(-(10**9), 10**9, allow_nan=False, places=4), min_size=20, max_size=40))
def test_numbers_round_trip(spark, values):
    rows = [(str(v), str(v).replace(".", ",")) for v in values]
    got = spark.createDataFrame(rows, "a string, b string").select(numeric.to_decimal(F.col("a")).alias("a"), numeric.to_decimal(F.col("b")).alias("b"), numeric.plain_text(numeric.to_decimal(F.col("a"))).alias("t")).collect()
    assert all(r.a == v and r.b == v and Decimal(r.t) == v and "E" not in r.t for r, v in zip(got, values, strict=True))


def test_units(spark):
    row = spark.createDataFrame([("1", None, None, None), (None, "500", None, None), (None, None, "2", None), ("1", "2", None, None), (None, None, None, None), ("-1", None, None, None), ("51", None, None, None), ("x", None, None, None)], "kg string, g string, lb string, oz string")
    kg, code = numeric.weight_kg(kg=F.col("kg"), g=F.col("g"), lb=F.col("lb"), oz=F.col("oz"))
    got = row.select(kg.cast("string"), code).collect()
    assert [c for _, c in got] == [None, None, None, "mixed_weight_units", None, "weight_non_positive", "weight_too_large", "invalid_type"]
    assert [float(k) for k, _ in got[:3]] == [1, 0.5, 0.90718474]


def test_csv(spark, tmp_path):
    file = tmp_path / "a.csv"
    file.write_text('﻿Code Produit,Nom Produit,Poids (g),Units Purchased,Promotion_X,Libellé\n# note,,,,,\n1,"a, ""b""",500,10,secret,\n2,"line\nbreak","1,5",,x,\n')
    df, report = catalogue_csv.read_csv(spark, str(file))
    assert report["dropped"] == ["promotion_x"] and report["mapping"]["units_purchased"] == ("items_purchased", "synonym")
    rows = df.orderBy("external_product_id").collect()
    assert [r.external_product_id for r in rows] == ["1", "2"] and "promotion_x" not in df.columns
    assert catalogue_csv.header("  Été – Protéines (%) ") == "ete_proteines" and catalogue_csv.missing(["product_name"], "protein_tracker") == ["items_purchased", "weight_per_item_kg"]
    with pytest.raises(ValueError):
        catalogue_csv.read_csv(spark, str(file), max_rows=1)
    twice = tmp_path / "b.csv"
    twice.write_text("Name,Brand,Name\na,x,b\nc\n")
    df, report = catalogue_csv.read_csv(spark, str(twice))
    assert report["duplicates"] == ["name"] and sorted(map(tuple, df.select("product_name", "brand").collect())) == [("", ""), ("b", "x")]
    assert catalogue_csv.file_problem("a.csv", 5) is None and catalogue_csv.file_problem("a.exe", 5) == "extension" and catalogue_csv.file_problem("a.csv", 0) == "empty"


def test_reference_table(spark, tmp_path):
    file = tmp_path / "r.csv"
    file.write_text("code;name_en;protein_g_per_100g;plant_protein_g_per_100g\n1;Tofu;12,5;12,5\n;none;1;1\n2;Milk;< 0,5;-\n3;Odd;-1;2\n")
    rows = {r.code: r for r in catalogue_csv.read_reference(spark, str(file)).collect()}
    assert sorted(rows) == ["1", "2", "3"] and rows["1"].protein_g_per_100g == Decimal("12.5") and not rows["1"].is_below_detection
    assert rows["2"].protein_g_per_100g == Decimal("0.5") and rows["2"].plant_protein_g_per_100g is None and rows["2"].is_below_detection
    assert rows["3"].protein_g_per_100g is None and rows["3"].plant_protein_g_per_100g is None


def test_parse(spark):
    df = spark.createDataFrame([(1, " Soup ", "400", "12.7", "vegan| |organic", "oui", "EN"), (2, "", "x", "-1", None, None, "eng")], "row_number int, product_name string, weight_per_item_g string, items_purchased string, labels string, is_own_brand string, language string")
    a, b = ingest.parse(df, upload="abcdef0123").orderBy("row_number").collect()
    assert a.errors == [] and a.external_product_id == "AUTO-abcdef01-0001" and a.labels == ["vegan", "organic"] and a.is_own_brand and a.language == "en" and a.items_purchased == 12
    assert {(w.field, w.code) for w in a.warnings} == {("items_purchased", "non_integer_count"), ("external_product_id", "auto_generated")}
    assert {(e.field, e.code) for e in b.errors} == {("product_name", "missing_required"), ("weight_per_item_kg", "invalid_type"), ("items_purchased", "invalid_range"), ("language", "invalid_code")}


def test_rules_and_text(spark):
    with pytest.raises(ValueError):
        rules.ordered([{"id": "a", "priority": 1}, {"id": "a", "priority": 2}])
    row = spark.createDataFrame([("Crème brûlée 4x125 g pack", "Œufs frais")], "a string, b string")
    forms = [("brulee", "dessert"), ("creme", "cream")]
    got = row.select(text.without_packaging(F.col("a")), text.fold(F.col("b")), text.earliest_concept(text.fold(F.col("a")), forms), text.any_word(F.col("b"), ["oeuf"]), F.size(text.hashed_vector(F.col("a"))))
    assert list(got.first()) == ["Crème brûlée", "oeufs frais", "cream", False, 64]
    note = row.select(rules.contradiction(F.array(F.lit("Vegan")), F.lit("milk and beef"), ["milk", "beef"])).first()[0]
    assert note == "beef"


def test_enrichment_ties(spark):
    rows = [(1, "reference_b", 1.0, "2024-01-02", 9), (1, "reference_a", 2.0, "2024-01-01", 8), (1, "reference_a", 3.0, "2024-01-03", 7), (1, "reference_a", 4.0, "2024-01-03", 6)]
    best = enrichment.best_record(spark.createDataFrame(rows, "product_id int, source string, value double, created_at string, record_id int")).collect()
    assert [r.record_id for r in best] == [6]


def test_locks_and_edges(spark):
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    got = spark.sql("select timestamp'2024-01-01 11:50:00' a, timestamp'2024-01-01 11:45:00' b, cast(null as timestamp) c").select(*[review.expired(F.col(c), now) for c in "abc"]).first()
    assert list(got) == [False, True, True]
    assert matching.BROADCAST_ROWS <= 1_000_000


def test_exports(spark, tmp_path):
    df = spark.sql("select cast(0 as decimal(18,8)) a, cast(-1.5 as decimal(18,8)) b, cast(null as string) c")
    assert list(exports.as_text(df, ["a", "b", "c", "d"]).first()) == ["0.00000000", "-1.50000000", "", ""]
    exports.write_csv(df, str(tmp_path / "x"), ["a", "c"])
    exports.write_json(df, str(tmp_path / "j"))
    assert spark.read.option("header", True).csv(str(tmp_path / "x")).count() == spark.read.json(str(tmp_path / "j")).count() == 1
    assert exports.markdown(df, ["a"]) == "| a |\n| --- |\n| 0.00000000 |"


def test_rate_limit_stream(spark, tmp_path):
    rows = [("k", n, f"2024-01-01 00:00:{n * 5:02d}") for n in range(12)]
    spark.createDataFrame(rows, "key string, event_id long, t string").select("key", "event_id", F.to_timestamp("t").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = limits.rate_limited(spark.readStream.schema("key string, event_id long, ts timestamp").parquet(str(tmp_path / "in")), limit=3, window_s=20)
    run = stream.writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(90)
    times, want = [], []
    for n in range(12):
        times, ok = limits.admit(times, n * 5.0, 3, 20.0)
        want.append(ok)
    assert [r.accepted for r in spark.table("limited").orderBy("event_id").collect()] == want and not all(want)


def test_windows_and_chunks(spark, tmp_path):
    source = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    source.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = limits.consume(stream, str(tmp_path / "cp"), lambda b: b.select("event_id"), str(tmp_path / "out"))
    run.awaitTermination(90)
    done = spark.read.parquet(str(tmp_path / "out"))
    assert done.count() == source.count() and done.select("batch").distinct().count() == 2
    again = limits.consume(stream, str(tmp_path / "cp"), lambda b: b.select("event_id"), str(tmp_path / "out"), "again")
    again.awaitTermination(90)
    assert spark.read.parquet(str(tmp_path / "out")).count() == source.count()
    assert limits.windowed(source, "1 day", None, "1 hour", "event_type").agg(F.sum("n")).first()[0] == source.count()
    assert limits.inactive_sessions(source).agg(F.sum("n")).first()[0] == source.count()
    once = limits.first_of_each(stream, ["user_id"], "1000 days").writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    once.awaitTermination(90)
    assert spark.table("once").count() == source.select("user_id").distinct().count()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def sorted_rows(frame, columns):
    plain = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted(repr([plain(v) for v in row]) for row in frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist())


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), duck.sql(catalogue.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and sorted_rows(got, columns) == sorted_rows(want, columns)


def test_result_does_not_depend_on_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append([sorted(map(str, catalogue.QUERIES[q](spark, SF).collect())) for q in ("pt_headline_share", "top_contributors", "enrichment_best_source")])
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1 and set(e.oracle_sql()) <= set(e.queries())
    assert time.time() > 0 and os.path.isdir(SF)


def test_vector_top_k_in_blocks(spark):
    """Any number of queries is answered, and as in one block."""
    import random

    from granary.operators import matching

    rng = random.Random(6)
    rows = [(k, [float(rng.randrange(-3, 4)) for _ in range(4)]) for k in range(90)] + [(90, [0.0] * 4), (91, [1.0, 1.0, 0.0, 0.0]), (92, [1.0, 1.0, 0.0, 0.0])]
    q = spark.createDataFrame(rows[::2] + rows[-1:], "query_id long, q array<double>")
    r = spark.createDataFrame(rows, "ref_id long, r array<double>")
    whole, blocks = matching.vector_top_k(q, r, 5), matching.vector_top_k(q, r, 5, block=(7, 13))
    assert blocks.schema.simpleString() == whole.schema.simpleString()
    got = sorted(tuple(x) for x in blocks.select("query_id", "ref_id", "rank").collect())
    assert got == sorted(tuple(x) for x in whole.select("query_id", "ref_id", "rank").collect())
    assert {x[0] for x in got} == {x[0] for x in rows[::2] + rows[-1:] if any(x[1])}
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    for i, v in rows[::2] + rows[-1:]:
        if any(v) and i != 92:  # that query is asked twice
            near = sorted((-round(float(unit(v) @ unit(w)), 12), j) for j, w in rows if any(w))[:5]
            assert [j for _, j in near] == [j for a, j, _ in sorted(got, key=lambda x: (x[0], x[2])) if a == i]
    odd = spark.createDataFrame([(1, None), (2, []), (3, [1.0]), (4, [float("nan"), 1.0])], "query_id long, q array<double>")
    assert matching.vector_top_k(odd, r, 3).count() == matching.vector_top_k(q, r.limit(0), 3).count() == 0


def test_commercial_columns_are_dropped():
    """The columns that no upload may carry on, by name and by prefix."""
    names = ["product_name", "sales_value", "revenue", "margin", "cost_price", "supplier_id", "supplier_name", "contract_terms", "store_id", "store_name", "store_region", "promotion_week", "confidential_x", "internal_notes", "store_x", "supplier_code", "brand"]
    assert set(names) - set(catalogue_csv.forbidden(names)) == {"product_name", "brand"}


@pytest.mark.parametrize("word,own", [("o", True), ("Own Brand", True), ("own_brand", True), ("House  brand", True), ("PL", True), ("marque distributeur", True), ("Marque propre", True), ("mdd", True), ("branded", False), ("Marque nationale", False), ("marque", False), ("t", None), ("f", None), ("own", None), ("", None)])
def test_brand_words(spark, word, own):
    assert spark.range(1).select(numeric.to_boolean(F.lit(word))).first()[0] is own


def test_weight_warnings_go_by_column(spark):
    """Grams in a kilogram column, kilograms in a gram column, and no warning for other units."""
    rows = [(1, "133", None, None), (2, "5", None, None), (3, None, "4.9", None), (4, None, None, "12"), (5, None, "5000", None), (6, "60000", None, None), (7, None, "5", None), (8, None, None, None), (9, "1", "1", None), (10, "x", "1", None)]
    df = spark.createDataFrame(rows, "row_number int, weight_per_item_kg string, weight_per_item_g string, weight_per_item_lb string").withColumn("product_name", F.lit("a")).withColumn("external_product_id", F.lit("b"))
    got = {r.row_number: ([(e.field, e.code) for e in r.errors], [(w.field, w.code) for w in r.warnings]) for r in ingest.parse(df).collect()}
    kg, g = "weight_per_item_kg", "weight_per_item_g"
    assert got == {
        1: ([(kg, "weight_unit_likely_grams")], []), 2: ([], [(kg, "weight_unit_likely_grams_warning")]), 3: ([], [(g, "weight_unit_likely_kg_warning")]), 4: ([], []), 5: ([], []),
        6: ([(kg, "weight_too_large")], []), 7: ([], []), 8: ([], []), 9: ([(kg, "mixed_weight_units")], []), 10: ([(kg, "invalid_type")], []),
    }


def test_protein_codes(spark):
    rows = [(1, "10", None, None, None, None, None), (2, None, "10", None, None, None, None), (3, "10", "10", None, None, None, None), (4, None, None, "10", None, None, None), (5, None, None, None, "5", None, None), (6, None, None, None, "5", "50", None), (7, None, None, None, None, None, "400"), (8, "101", None, None, None, None, None)]
    names = "row_number int, protein_pct string, protein_g_per_100g string, protein_per_100ml string, protein_per_serving string, serving_g string, protein_kj string"
    df = spark.createDataFrame(rows, names).withColumn("product_name", F.lit("a"))
    got = {r.row_number: ([e.code for e in r.errors], r.protein_pct and float(r.protein_pct)) for r in ingest.parse(df).collect()}
    assert got == {1: ([], 10.0), 2: ([], 10.0), 3: (["mixed_protein_inputs"], None), 4: (["missing_density"], None), 5: (["missing_serving_g"], None), 6: ([], 10.0), 7: (["energy_not_protein"], None), 8: (["protein_out_of_range"], None)}


def test_existing_values_are_never_overwritten(spark):
    rows = [(1, "v1", "protein_pct", 3.0), (2, "v1", "protein_pct", None), (3, "v1", "fat", 3.0), (4, "v2", "protein_pct", None), (5, "manual", "protein_pct", None), (5, "v2", "protein_pct", 1.0)]
    got = review.disposition(spark.createDataFrame(rows, "product_id int, kind string, nutrient string, value double")).collect()
    assert {(r.product_id, r.disposition) for r in got} == {(1, "skip_v1"), (2, "write"), (3, "write"), (4, "skip_v2"), (5, "skip_manual")}


def test_enrichment_needs_a_value_and_both_siblings(spark):
    rows = [(1, "manual", "protein", None, "enriched", "1", 1), (1, "reference_a", "protein", 5.0, "failed", "1", 2), (1, "reference_b", "protein", 7.0, "enriched", "1", 3), (1, "reference_b", "plant_protein", 7.0, "enriched", "1", 4)]
    records = spark.createDataFrame(rows, "product_id int, source string, nutrient string, value double, status string, created_at string, record_id int")
    best = enrichment.best_record(records.filter("nutrient = 'protein'"))
    assert [(r.source, r.value, r.plant_protein, r.animal_protein) for r in enrichment.with_siblings(best, records).collect()] == [("reference_b", 7.0, None, None)]
    more = records.unionByName(spark.createDataFrame([(1, "reference_b", "animal_protein", 0.0, "enriched", "1", 5)], records.schema))
    assert [(r.plant_protein, r.animal_protein) for r in enrichment.with_siblings(best, more).collect()] == [(7.0, 0.0)]
    assert {(r.pt_group, r.value, r.confidence) for r in enrichment.category_averages(spark).collect()} == {("plant_based_core", 15.0, 0.6), ("plant_based_non_core", 12.0, 0.6), ("composite_products", 10.0, 0.5), ("animal_core", 18.0, 0.6)}


def test_review_levels_and_edges(spark):
    reasons = ["contradiction_detected", "ai_parse_failed", "ai_provider_error", "rule_collision", "low_confidence", "requested", "whatever"]
    got = spark.createDataFrame([(r,) for r in reasons], "r string").select(review.priority(review.weight(F.col("r")))).collect()
    assert [r[0] for r in got] == ["critical", "critical", "critical", "high", "medium", "low", "low"]
    pairs = {(a, b) for a, _, b in review.EDGES}
    assert ("accepted", "in_queue") not in pairs and ("changed", "in_queue") not in pairs and {("deferred", "in_queue"), ("in_queue", "accepted"), ("reviewing", "in_queue")} <= pairs


@pytest.mark.parametrize("case,level", [((0, 0, 0, 0, 0, 0, 1), "high"), ((10, 0, 0, 0, 0, 0, 0), "high"), ((9.99, 1, 5, 0, 0, 0, 0), "high"), ((0, 1, 4.9, 0, 0, 0, 0), "medium"), ((0, 0, 0, 30, 0, 0, 0), "medium"), ((0, 0, 0, 29, 10, 0, 0), "medium"), ((0, 0, 0, 0, 0, 10, 0), "medium"), ((9, 0, 0, 29, 9, 9, 0), "low"), ((None,) * 7, "low")])
def test_uncertainty(spark, case, level):
    assert spark.range(1).select(coverage.uncertainty(*[F.lit(x).cast("double") for x in case])).first()[0] == level


def test_coverage_of_nothing_has_no_percentages(spark):
    row = coverage.coverage(spark.createDataFrame([], "pt_group string, protein_pct double, volume_kg double")).first()
    assert row.n_rows == 0 and row.classified_pct is None and row.ai_pct is None and row.uncertainty == "low"


def test_scenario(spark):
    """Amounts in kilograms; what can't be read, is negative or doesn't add up is skipped with a warning; groups are held at 0."""
    groups = spark.createDataFrame([("plant_based_core", 40.0), ("composite_products", 20.0), ("animal_core", 40.0)], "pt_group string, protein_kg double")
    ops = [("a", 1, "shift_protein_between_groups", "animal_core", "plant_based_core", "10", None, None), ("b", 2, "reduce_animal_core_protein", None, None, "100", None, None), ("c", 3, "improve_composite_split", None, None, None, "70", "30"), ("d", 4, "improve_composite_split", None, None, None, "70", "40"), ("e", 5, "frobnicate", None, None, "1", None, None), ("f", 6, "increase_plant_core_protein", None, None, "-1", None, None)]
    frame = spark.createDataFrame(ops, "op_id string, op_order int, operation_type string, from_group string, to_group string, amount_kg string, plant_pct string, animal_pct string")
    got = comparison.scenario(groups, frame)
    assert {(r.pt_group, float(r.projected_kg), r.clamped, r.plant_fraction) for r in got.collect()} == {("plant_based_core", 50.0, False, 1.0), ("plant_based_non_core", 0.0, False, 1.0), ("composite_products", 20.0, False, 0.7), ("animal_core", 0.0, True, 0.0)}
    assert {(r.subject, r.warning) for r in comparison.scenario_warnings(frame, got).collect()} == {("d", "split_not_100"), ("e", "unknown_operation_type"), ("f", "negative_amount_kg"), ("animal_core", "clamped_to_zero")}


def test_recommendations(spark):
    """Thresholds include their own value, the first of an action type stays."""
    row = spark.createDataFrame([(39.9, 30.0, 1, 5.0, 30.0, "high")], "plant_share_pct double, composite_share_pct double, missing_protein int, unknown_pct double, ai_pct double, uncertainty string")
    assert [(r.action_type, r.priority) for r in comparison.recommendations(row).collect()] == [("increase_plant_core_share", "high"), ("improve_composite_breakdown", "medium"), ("enrich_missing_nutrition", "medium"), ("review_high_impact_unknowns", "high"), ("improve_data_quality", "medium"), ("create_category_target", "low")]
    row = spark.createDataFrame([(40.0, 29.9, 0, 4.9, 29.9, "medium")], row.schema)
    assert comparison.recommendations(row).count() == 0
    foods = spark.createDataFrame([(3, 2, 1, 20.0, 13.5, None, None, "low")], "own_composites int, step2_applied int, branded_composites int, fg1_share_pct double, fg1_reference_pct double, unknown_pct double, ai_pct double, uncertainty string")
    assert [(r.action_type, r.priority) for r in comparison.recommendations(foods, "food_groups").collect()] == [("collect_step2_ingredient_data", "high"), ("improve_data_quality", "low"), ("promote_legume_products", "medium")]


def test_agreement(spark):
    rows = [(None, None, "a", "a"), ("1", None, "a", "a"), (None, "1", "a", "a"), ("1", "1", "a", "b"), ("1", "2", "a", "a"), ("1", "2", None, None)]
    found = spark.createDataFrame(rows, "a string, b string, c string, d string").select(evaluation.agreement(*[F.col(x) for x in "abcd"]).alias("x"))
    assert [r.x for r in found.collect()] == ["both_no_match", "v1_only", "v2_only", "same_code", "same_concept", "disagreement_needs_review"]
    assert list(spark.range(1).select(*[evaluation.recommendation(F.lit(a), F.lit(b)) for a, b in ((1, 9), (0, 1), (0, 0))]).first()) == ["keep_off", "admin_opt_in_candidate", "internal_shadow_ok"]
    assert list(spark.range(1).select(*[matching.confidence(F.lit(n)) for n in (5, 3, 2, 1, 0)]).first()) == [0.82, 0.82, 0.72, 0.55, None]
