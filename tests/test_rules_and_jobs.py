"""Rules as tables, catalogue fingerprints, and jobs that stop and go on."""

import json
import random

import pytest
from pyspark.sql import functions as F

from granary.operators import fingerprint, rule_tables, rules
from granary.sources import history
from granary.streaming import jobs

PRODUCTS = "product_id long, product_name string, retailer_category string, retailer_subcategory string, ingredients_text string, labels array<string>, brand string, language string"


def products(spark, n=80):
    rng = random.Random(n)
    word = lambda: rng.choice(["tofu", "tofus", "milk", "oat milk", "beef", "to", "b", "cheese", "Übung"])
    some = lambda: " ".join(word() for _ in range(rng.randint(1, 3)))
    rows = [(k, some(), rng.choice([None, some()]), None, rng.choice([None, "", some()]), rng.choice([None, [], ["Bio"], ["vegan", "bio"]]), rng.choice([None, "Acme", "acme", "Other"]), rng.choice(["en", "fr", None])) for k in range(n)]
    return spark.createDataFrame(rows, PRODUCTS)


def tree(rng, depth):
    kind = rng.choice(["any_of", "all_of", "leaf", "leaf"]) if depth else "leaf"
    if kind != "leaf":
        return {kind: [tree(rng, depth - 1) for _ in range(rng.randint(0 if kind == "all_of" else 1, 3))]}
    leaf = rng.choice(["name_or_category_contains", "ingredients_contains", "labels_contains", "brand_in", "language_in"])
    words = {"labels_contains": ["bio", "vegan"], "brand_in": ["ACME", "other"], "language_in": ["en", "fr"]}.get(leaf, ["tofu", "Milk", "oat milk", "b", "to", "übung", "none of these", "beef cheese"])
    return {leaf: rng.sample(words, rng.randint(1, 2))}


def test_rule_tables_equal_compiled_rules(spark):
    rng = random.Random(5)
    some = [{"id": f"r{k}", "priority": rng.randint(1, 5), "category": rng.choice(["x", "y"]), "when": tree(rng, 3)} for k in range(25)]
    df = products(spark)
    want = {r.product_id: (r.verdict, r.category, r.rule_ids) for r in rules.verdicts(df.withColumn("country", F.lit("")).withColumn("taxonomy", F.lit("")), some).collect()}
    got = {r.product_id: (r.verdict, r.category and json.loads(r.category), r.rule_ids) for r in rule_tables.verdicts(df, some).collect()}
    assert got == want and {v[0] for v in want.values()} >= {"matched", "collision"}
    assert {r.verdict for r in rule_tables.verdicts(df, []).collect()} == {"pass_through"} and rule_tables.verdicts(df.limit(0), some).count() == 0


def test_categories_agree_as_a_whole(spark):
    df = spark.createDataFrame([(1, "oat milk"), (2, "milk")], "product_id long, product_name string")
    rule = lambda k, word, category: {"id": k, "priority": 1, "category": category, "when": {"name_or_category_contains": word}}
    both = [rule("a", "milk", {"group": "FG2", "sub": "milk"}), rule("b", "oat", {"sub": "milk", "group": "FG2"})]
    assert [(r.verdict, r.rule_ids) for r in rule_tables.verdicts(df, both).orderBy("product_id").collect()] == [("matched", "a,b"), ("matched", "a")]
    other = [both[0], rule("b", "oat", {"sub": "oat", "group": "FG2"})]
    assert [r.verdict for r in rule_tables.verdicts(df, other).orderBy("product_id").collect()] == ["collision", "matched"]


def test_plan_doesnt_grow_with_rules(spark):
    df = products(spark, 10)
    lines = []
    for n in (10, 5000):
        many = [{"id": f"r{k:05d}", "priority": 1, "category": "x", "when": {"any_of": [{"name_or_category_contains": [f"word{k}", "tofu"] if k == 3 else [f"word{k}"]}]}} for k in range(n)]
        out = rule_tables.verdicts(df, many)
        lines.append(len(out._jdf.queryExecution().optimizedPlan().toString().splitlines()))
        assert {r.rule_ids for r in out.collect()} <= {"", "r00003"}
    assert lines[0] == lines[1]


def test_rules_from_files(spark, tmp_path):
    rule = lambda k, p, m="protein_tracker", when=None: {"id": k, "priority": p, "methodology": m, "category": "x", "when": when or {"brand_in": ["a"]}}
    (tmp_path / "deep" / "er").mkdir(parents=True)
    put = lambda name, what: (tmp_path / name).write_text(json.dumps(what))
    put("a.json", [rule("b", 2), rule("a", 2)])
    put("deep/er/c.json", [rule("z", 1), rule("w", 1, "wwf")])
    (tmp_path / "notes.txt").write_text("no rule")
    (tmp_path / "empty.json").write_text("")
    assert {m: [r["id"] for r in found] for m, found in rule_tables.load(spark, str(tmp_path)).items()} == {"protein_tracker": ["z", "a", "b"], "wwf": ["w"]}
    for wrong, said in (([rule("a", 9)], "twice"), ({"id": 1}, "not a list"), ([rule("q", 1, when={"dance": []})], "unknown condition"), ([{"id": "q"}], "lacks")):
        put("wrong.json", wrong)
        with pytest.raises(ValueError, match=said):
            rule_tables.load(spark, str(tmp_path))


def test_fingerprints(spark):
    known = [("demo", f"P{k}", f"Product  {k}") for k in range(30)] + [("half", f"P{k}", f"Product {k}") for k in range(15)]
    same = [(f"P{k}", f" PRODUCT-{k}") for k in range(30)]
    uploads = {
        "same": same, "permuted": same[::-1], "renamed": [(i, n + " new") for i, n in same], "less": same[1:], "more": [*same, ("P99", "x")], "twice": [*same[:-1], same[0]], "doubled": same + same,
        "null": [*same[:-1], (None, "x")], "swapped": [(same[k][0], same[(k + 1) % 30][1]) for k in range(30)], "half": same[:15], "other": [("Q" + i, n) for i, n in same],
    }
    up = spark.createDataFrame([(u, i, n) for u, rows in uploads.items() for i, n in rows], "upload string, id string, name string")
    cat = spark.createDataFrame(known, "catalogue string, id string, name string")
    got = {(r.upload, r.catalogue): r.how for r in fingerprint.recognised(up, cat).collect()}
    assert got == {("same", "demo"): "lines", ("permuted", "demo"): "lines", ("renamed", "demo"): "ids", ("swapped", "demo"): "ids", ("half", "half"): "lines"}
    assert fingerprint.recognised(up.limit(0), cat).count() == 0
    a, b = (fingerprint.fingerprints(up.filter(F.col("upload") == u).withColumnRenamed("upload", "catalogue")).drop("catalogue").first() for u in ("same", "permuted"))
    assert a == b


def test_job_stops_at_a_cancel_flag_and_goes_on(spark, tmp_path):
    source, path, done = str(tmp_path / "in"), str(tmp_path / "job"), []
    for k in range(4):  # a file is a chunk
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(source)
    kind, now = "id long, outcome string", lambda: "2024-01-01 00:00:00"

    def step(batch):
        done.append(batch.count())
        if len(done) == 2:  # somebody cancels while the second chunk is worked on
            jobs.control(spark, path, True, now())
        return batch.withColumn("outcome", F.when(F.col("id") % 2 == 0, "accepted").otherwise("review"))

    assert jobs.advance(stream(), path, step, now, "one") == "cancelled"
    counts = lambda: {r.outcome: r.n for r in jobs.progress(spark, path, kind).collect()}
    assert len(done) == 2 and counts() == {"accepted": 10, "review": 10}
    assert jobs.advance(stream(), path, step, now, "two") == "cancelled" and len(done) == 2
    jobs.control(spark, path, False, now())

    def dies(batch):  # after it wrote a part of a chunk
        history.stage(batch.limit(3).withColumn("outcome", F.lit("accepted")), f"{path}/results", "b000000002")
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        jobs.advance(stream(), path, dies, now, "three")
    assert counts() == {"accepted": 10, "review": 10}
    assert jobs.advance(stream(), path, step, now, "four") == "done" and counts() == {"accepted": 20, "review": 20}
    assert jobs.advance(stream(), path, step, now, "five") == "done" and len(done) == 4
