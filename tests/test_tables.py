"""Tables with versions, bulk changes, the index with its cache, salvage of damaged answers, and ingest of files as they are."""

import pytest
from pyspark.sql import functions as F

from granary.operators import bulk, ingest, salvage, vector_index
from granary.sources import catalogue_csv, history

KIND = "key long, value string, gone boolean"


def test_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    df = lambda *rows: spark.createDataFrame(list(rows), KIND)
    now = lambda at=None: {r.key: r.value for r in history.latest(history.read(spark, path, KIND, at), ["key"], "gone").collect()}
    assert now() == {} and history.commits(spark, path).count() == 0
    history.append(df((1, "a", False), (2, "b", False)), path, "v1", "2024-01-01", {"by": "ann"})
    history.append(df((2, "B", False), (3, "c", False)), path, "v2", "2024-01-02")
    history.stage(df((1, "lost", False)), path, "v3")  # the job died here
    assert now() == {1: "a", 2: "B", 3: "c"}
    history.append(df((1, "again", False), (3, None, True)), path, "v3", "2024-01-03")  # and was run again
    assert now() == {1: "again", 2: "B"} and now("2024-01-02") == {1: "a", 2: "B", 3: "c"} and now("2023-01-01") == {}
    history.append(df((9, "x", False)), path, "v1", "2024-02-01")  # marked already: nothing changes
    assert now("2024-01-01") == {1: "a", 2: "b"} and 9 not in now()
    marks = {r.version: (r.rows, r.summary) for r in history.commits(spark, path).collect()}
    assert marks == {"v1": (2, '{"by":"ann"}'), "v2": (2, "{}"), "v3": (2, "{}")}


def test_sets_are_replaced_as_a_whole(spark, tmp_path):
    path, kind = str(tmp_path / "t"), "owner long, part string"
    history.append(spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], kind), path, "v1", "2024-01-01")
    history.append(spark.createDataFrame([(1, "d")], kind), path, "v2", "2024-01-02")
    got = sorted((r.owner, r.part) for r in history.latest_sets(history.read(spark, path, kind), ["owner"]).collect())
    assert got == [(1, "d"), (2, "c")]


def queue(spark, path):
    rows = [(1, "protein_tracker", "in_queue", None, None, "animal_core"), (2, "protein_tracker", "reviewing", "bob", "2024-01-01 00:10:00", "animal_core"), (3, "protein_tracker", "accepted", None, None, "animal_core"), (4, "wwf", "in_queue", None, None, "FG1")]
    df = spark.createDataFrame(rows, "item_id long, methodology string, state string, locked_by string, locked_at string, category string")
    history.append(df.withColumn("locked_at", F.col("locked_at").cast("timestamp")), path, "v0", "2024-01-01")


def test_bulk_decisions_apply_all_or_nothing(spark, tmp_path):
    path = str(tmp_path / "q")
    queue(spark, path)
    ask = lambda *ids: spark.createDataFrame([(i,) for i in ids], "item_id long")
    state = lambda: {r.item_id: (r.state, r.category) for r in history.latest(history.read(spark, path, bulk.ITEMS), ["item_id"]).collect()}
    errors = lambda *a, **k: {(r.item_id, r.error) for r in bulk.decide(*a, **k).collect()}
    before, at = state(), "2024-01-01 00:12:00"
    assert errors(ask(1, 2, 3, 4, 5), path, "v1", "bulk_accept", "protein_tracker", "ann", at) == {(2, "locked"), (3, "decided"), (4, "wrong_methodology"), (5, "not_found")}
    assert errors(ask(1, 3), path, "v1", "bulk_accept", "protein_tracker", "ann", at) == {(3, "decided")} and state() == before
    assert errors(ask(1), path, "v1", "bulk_change_pt_group", "protein_tracker", "ann", at, "animal_core") == {(1, "same_category")}
    whole = [(ask(), "bulk_accept", None, "empty"), (ask(1), "dance", None, "unknown_action"), (ask(1), "bulk_change_pt_group", None, "missing_group"), (ask(1), "bulk_change_pt_group", "unknown", "system_state")]
    for asked, action, to, code in whole:
        assert errors(asked, path, "v1", action, "protein_tracker", "ann", at, to) == {(None, code)}
    assert errors(ask(4), path, "v1", "bulk_change_pt_group", "wwf", "ann", at, "x") == {(None, "wrong_methodology")}
    assert errors(ask(1, 2, 2), path, "v1", "bulk_accept", "protein_tracker", "bob", at, most=1) == {(None, "too_many")} and state() == before
    for _ in range(2):  # the second one is a retry
        assert errors(ask(1, 2), path, "v1", "bulk_change_pt_group", "protein_tracker", "bob", at, "plant_based_core") == set()
    assert state() == before | {1: ("changed", "plant_based_core"), 2: ("changed", "plant_based_core")}
    assert errors(ask(1), path, "v2", "bulk_defer", "protein_tracker", "bob", at) == {(1, "decided")}
    assert [r.version for r in history.commits(spark, path).orderBy("version").collect()] == ["v0", "v1"]


def test_plan_apply(spark, tmp_path):
    path = str(tmp_path / "r")
    records = [(1, "protein_pct", "manual", 1.0), (2, "protein_pct", "v2", None), (3, "protein_pct", "v1", 2.0), (4, "protein_pct", "v1", None), (5, "plant_protein", "manual", 1.0)]
    history.append(spark.createDataFrame(records, bulk.RECORDS), path, "v0", "2024-01-01")
    plan = spark.createDataFrame([(k, "7.5", "note") for k in range(1, 7)] + [(None, "1", "x"), (8, "abc", "x"), (9, None, "x"), (10, "NaN", "x")], "product_id long, value string, note string")
    want = {1: "skipped_existing_manual", 2: "skipped_existing_v2", 3: "skipped_existing_v1", 4: "would_write", 5: "would_write", 6: "would_write", None: "error", 8: "error", 9: "error", 10: "error"}
    run = lambda write: {r.product_id: r.status for r in bulk.apply_plan(plan, path, "p1", "2024-01-02", write).collect()}
    assert run(False) == want and history.commits(spark, path).count() == 1
    written = {k: "written" if v == "would_write" else v for k, v in want.items()}
    assert run(True) == written and run(True) == written
    rows = history.read(spark, path, bulk.RECORDS).filter("version = 'p1'").collect()
    assert sorted((r.product_id, r.kind, r.value) for r in rows) == [(k, "v2", 7.5) for k in (4, 5, 6)]


def test_index_embeds_each_text_once(spark, tmp_path):
    path, asked = str(tmp_path / "c"), []
    df = lambda *texts: spark.createDataFrame(list(enumerate(texts)), "id long, text string")

    def run(rows, version):
        found, counts = vector_index.build(rows, path, version, "2024-01-01")
        asked.append(counts["embedded"])
        return {r.id: tuple(r.vector) for r in found.collect()}

    first = run(df("red ring", "red ring", "blue gear", None), "a")
    assert run(df("red ring", "red ring", "blue gear", None), "b") == first and first[0] == first[1] != first[2]
    changed = run(df("red ring", "green ring", "blue gear", ""), "c")
    assert changed[0] == first[0] and changed[1] != first[1] and changed[3] == first[3] and asked == [3, 0, 1]
    _, other = vector_index.build(df("red ring"), path, "d", "2024-01-01", kind="query")
    assert other == {"rows": 1, "texts": 1, "hits": 0, "embedded": 1}


def test_index_that_died_before_its_mark(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "c")
    df = spark.createDataFrame([(1, "a ring"), (2, "a gear")], "id long, text string")

    def dies(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(history, "commit", dies)
        vector_index.build(df, path, "a", "2024-01-01")
    found, counts = vector_index.build(df, path, "b", "2024-01-01")
    assert counts["embedded"] == 2 and found.count() == 2 and vector_index.build(df, path, "c", "2024-01-01")[1]["embedded"] == 0


def test_texts_to_embed(spark, tmp_path):
    rows = spark.createDataFrame([("Tofu", " ", ["bio", "vegan"], "plant_based_core")], "product_name string, ingredients_text string, labels array<string>, pt_group string")
    assert rows.select(vector_index.descriptor_text(rows).alias("t")).first().t == "Name: Tofu\nLabels: bio, vegan"
    assert rows.select(vector_index.descriptor_text(rows, "protein_tracker").alias("t")).first().t.endswith("\nProtein Tracker group: plant_based_core")
    for c in ("items_sold", "Price_eur", "margin"):
        with pytest.raises(ValueError, match=c):
            vector_index.descriptor_text(rows.withColumn(c, F.lit(1)))
    with pytest.raises(ValueError, match="pt_group"):
        vector_index.allowed_only(rows, ["product_name", "ingredients_text", "labels"])
    (tmp_path / "r.csv").write_text("code,name_en,secret\n1,Milk,x\n")
    (tmp_path / "r.json").write_text('{"code": "2", "food_group": "Dairy", "secret": "y"}\n')
    got = [tuple(vector_index.load_references(spark, str(tmp_path / f)).first()) for f in ("r.csv", "r.json")]
    assert got == [("1", "Milk", None, None), ("2", None, None, "Dairy")]


ROWS = '[{"id": "1", "pt_group": "a", "confidence": 0.9}, {"id": "2", "pt_group": "b", "confidence": 1}]'


@pytest.mark.parametrize(
    "text, how, ids",
    [
        ('{"results": %s}' % ROWS, "strict", "12"),
        (ROWS, "strict", "12"),
        ("﻿ ```json\n{\"results\": %s}\n``` " % ROWS, "strict", "12"),
        ("Sure! {\"items\": %s} Done." % ROWS, "sliced", "12"),
        ('{"note": [1], "products": %s}' % ROWS, "strict", "12"),
        ('{"zeta": %s, "alpha": [1]}' % ROWS, "strict", "12"),
        ('{"id": "7", "wwf_food_group": "FG1"}', "strict", "7"),
        ('{"results": %s}' % ROWS.replace("}, {", "} {").replace('"a", "', '"a""'), "repaired", "12"),
        ('{"results": [{"id": "1", "n": 3"x": 1}]}', "repaired", "1"),
        ('{"results": [{"id": "1", "x": 1}, {"id": "2", "x"', "partial", "1"),
        ('{"results": [{"id": "1" "x": 1}, {"id": "2", "x": [}', "partial", "1"),
        ('{"results": {"a": 1}}', "failed", ""),
        ("no json at all", "failed", ""),
        ("", "failed", ""),
        (None, "failed", ""),
        ("42", "failed", ""),
        ('{"results": []}', "strict", ""),
    ],
)
def test_salvage(spark, text, how, ids):
    found = salvage.salvaged(spark.createDataFrame([(1, text)], "n long, t string"), "t")
    got = found.select("how", F.array_join(F.transform("rows", lambda r: salvage.fields(r, {"id": "string"})["id"]), "").alias("ids")).first()
    assert tuple(got) == (how, ids)


def test_salvage_needs_no_python(spark):
    plan = salvage.salvaged(spark.createDataFrame([(ROWS,)], "t string"), "t")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def parsed(spark, **columns):
    df = spark.createDataFrame([("1", "Milk", *columns.values())], ["row_number", "product_name", *columns])
    r = ingest.parse(df.withColumn("row_number", F.col("row_number").cast("int"))).first()
    return r, [e.code for e in r.errors]


@pytest.mark.parametrize(
    "columns, pct, codes",
    [
        ({"protein_g_per_100ml": "10", "density_g_per_ml": "1.25"}, 8.0, []),
        ({"protein_g_per_100ml": "10"}, None, ["missing_density"]),
        ({"protein_g_per_serving": "5", "serving_g": "50"}, 10.0, []),
        ({"protein_g_per_serving": "5"}, None, ["missing_serving_g"]),
        ({"protein_g_per_100g": "12,5"}, 12.5, []),
        ({"protein_g_per_100ml": "10", "density_g_per_ml": "1", "protein_pct": "3"}, None, ["mixed_protein_inputs"]),
        ({"protein_kcal": "10"}, None, ["energy_not_protein"]),
    ],
)
def test_protein_inputs_of_real_files(spark, columns, pct, codes):
    row, found = parsed(spark, **columns)
    assert (row.protein_pct if pct is None else float(row.protein_pct)) == pct and found == codes


def test_channels_of_real_files(spark):
    cases = {"Grocery/Ambient": "grocery_ambient", "Épicerie  sèche": "grocery_ambient", "Frais & Traiteur": "fresh", "réfrigéré": "fresh", "Dry Goods": "grocery_ambient", "Produits surgelés": "frozen", "Congelé": "frozen", "shelf-stable": "grocery_ambient", "garden": None}
    df = spark.createDataFrame(list(cases.items()), "raw string, want string").select("want", ingest.channel(F.col("raw")).alias("got"))
    assert all(r.want == r.got for r in df.collect())


def test_mapping_of_real_files(spark, tmp_path):
    got = catalogue_csv.mapping(["protein_per_100ml", "densite", "serving_g", "confidence", "poids", "unit_purchased", "quantites_vendues_g", "mystery"], confirmed={"mystery": "brand", "poids": "ignore"})
    assert {n: c for n, (c, how) in got.items() if how != "ignored"} == {
        "protein_per_100ml": "protein_g_per_100ml", "densite": "density_g_per_ml", "serving_g": "serving_g", "unit_purchased": "items_purchased", "quantites_vendues_g": "items_sold", "mystery": "brand",
    }
    assert {n for n, (_, how) in got.items() if how == "ignored"} == {"confidence", "poids"}
    file = tmp_path / "f.csv"
    file.write_text("name,AI Label,Protein per 100ml,Density\nMilk,x,3.5,1.03\n")
    df, report = catalogue_csv.read_csv(spark, str(file))
    assert df.columns == ["product_name", "protein_g_per_100ml", "density_g_per_ml"] and report["mapping"]["ai_label"] == ("ai_label", "ignored")
    row = ingest.parse(df.withColumn("row_number", F.lit(1))).first()
    assert round(float(row.protein_pct), 4) == round(3.5 / 1.03, 4)
