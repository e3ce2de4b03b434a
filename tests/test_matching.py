"""Ordered folds, rate limits, the shortlist, the concept gate and the chained cascade, against plain loops."""

import random
import time

import pytest
from pyspark.sql import functions as F

from granary.functions import text
from granary.operators import enrichment, fold, matching, review
from granary.streaming import limits

SF = "/root/testdata/sf0.001"


def review_rows(n, items=3):
    rng = random.Random(n)
    actions = ["claim", "refresh", "release", "accept", "change", "defer", "reopen", "reopen", "dance", None]
    return [(k, rng.choice([None, *range(items)]), rng.choice(actions), rng.choice("abc"), k * 200_000_000, rng.choice(["x", "y", "unknown", None])) for k in range(n)]


ACTIONS = "id long, item long, action string, user string, at long, category string"


def plain(rows, step, start, key):
    states, out = {}, {}
    for row in rows:
        states[key(row)], out[row["id"]] = step(states.get(key(row), start), row)
    return out


@pytest.mark.parametrize("chunk", [9, 1000])
def test_review_fold(spark, chunk):
    rows = review_rows(300)
    df = spark.createDataFrame(rows, ACTIONS)
    got = review.reviewed(df.repartition(5), ["item"], ["at"], None, chunk).collect()
    want = plain([dict(zip(df.columns, r, strict=True)) for r in rows], review.review_step, ["in_queue", None, None, None], lambda r: r["item"])
    assert {r.id: tuple(r)[6:] for r in got} == want and len({w[2] for w in want.values()}) >= 5


def test_review_cases(spark):
    minute = 60_000_000
    rows = [
        (1, 1, "claim", "ann", 0, None), (2, 1, "accept", "bob", minute, None), (3, 1, "accept", "ann", 2 * minute, None), (4, 1, "change", "ann", 3 * minute, "y"),
        (5, 2, "claim", "ann", 0, None), (6, 2, "claim", "bob", 15 * minute, None), (7, 2, "refresh", "ann", 16 * minute, None), (8, 2, "refresh", "bob", 40 * minute, None),
        (9, 2, "change", "bob", 41 * minute, "x"), (10, 3, "change", "bob", 0, "unknown"), (11, 3, "defer", "bob", 1, None), (12, 3, "accept", "bob", 2, None), (13, 3, "reopen", "bob", 3, None), (14, 3, "change", "bob", 4, "y"),
    ]
    got = {r.id: (r.refusal, r.status_after) for r in review.reviewed(spark.createDataFrame(rows, ACTIONS), ["item"], ["at"], "x").collect()}
    assert got == {
        1: (None, "reviewing"), 2: ("locked", "reviewing"), 3: (None, "accepted"), 4: ("illegal_transition", "accepted"), 5: (None, "reviewing"), 6: (None, "reviewing"), 7: ("locked", "reviewing"),
        8: ("lock_expired", "reviewing"), 9: ("same_category", "reviewing"), 10: ("system_state", "in_queue"), 11: (None, "deferred"), 12: ("illegal_transition", "deferred"), 13: (None, "in_queue"), 14: (None, "changed"),
    }


def test_refused_event_leaves_the_state(spark):
    rows = [(1, 1, "accepted"), (2, 1, "reviewing"), (3, 1, "changed"), (4, 2, "deferred"), (5, 2, "accepted"), (6, 2, "in_queue")]
    got = {r.n: (r.previous, r.valid) for r in review.checked_transitions(spark.createDataFrame(rows, "n long, item long, state string"), ["item"], ["n"]).collect()}
    assert got == {1: ("in_queue", True), 2: ("accepted", False), 3: ("accepted", False), 4: ("in_queue", True), 5: ("deferred", False), 6: ("deferred", True)}
    assert review.checked_transitions(spark.createDataFrame([], "n long, item long, state string"), ["item"], ["n"]).count() == 0


def requests(n):
    rng = random.Random(n)
    now, rows = 0, []
    for k in range(n):
        now += rng.randrange(0, 4_000_000)
        rows.append((k, rng.choice(["a", "a", "a", "b", None]), rng.choice(["compute", "classify"]), now))
    return rows


@pytest.mark.parametrize("chunk", [25, 10_000])
def test_rate_limit(spark, chunk):
    rows = requests(400)
    df = spark.createDataFrame(rows, "id long, key string, group string, at long")
    step = limits.limit_step(limits.LIMITS, 60)
    got = {r.id: (r.accepted, r.retry_after) for r in fold.folded(df, ["key", "group"], ["at", "id"], [], step, "accepted boolean, retry_after long", chunk).collect()}
    want = plain([dict(zip(df.columns, r, strict=True)) for r in rows], step, [], lambda r: (r["key"], r["group"]))
    assert got == want and sum(not x for x, _ in want.values()) > 50
    assert {r.id: (r.accepted, r.retry_after) for r in limits.limited(df, ["at", "id"]).collect()} == want


def test_rate_limit_steps():
    step, times = limits.limit_step({"compute": 2}, 60), []
    out = []
    for second in (0, 10, 20, 59, 60, 61):
        times, found = step(times, {"group": "compute", "at": second * 1_000_000})
        out.append(found)
    assert out == [(True, 0), (True, 0), (False, 41), (False, 2), (True, 0), (False, 10)]


def test_rate_limit_stream_by_group(spark, tmp_path):
    rows = requests(120)
    df = spark.createDataFrame([(k or "none", g, i, at) for i, k, g, at in rows], "key string, group string, event_id long, at long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = limits.limited_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("by_group").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    until = time.time() + 240  # buckets that wait for their time to run out keep the query alive
    while spark.table("by_group").count() < len(rows) and time.time() < until:
        time.sleep(1)
    run.stop()
    want = {r.event_id: (r.accepted, r.retry_after) for r in limits.limited(df, ["at", "event_id"]).collect()}
    assert {r.event_id: (r.accepted, r.retry_after) for r in spark.table("by_group").collect()} == want


def test_route_groups(spark):
    cases = [
        ("POST", "/api/v1/projects/1/uploads", "uploads"), ("POST", "/api/v1/p/1/ingest", "uploads"), ("post", "/api/v1/p/1/jobs/classify", "classify"), ("GET", "/api/v1/p/1/export", "exports"),
        ("POST", "/api/v1/p/1/jobs/export", "exports"), ("POST", "/api/v1/p/1/jobs/calculate", "compute"), ("POST", "/api/v1/p/1/scenarios/2/run", "compute"), ("POST", "/api/v1/p/1/run", "default"),
        ("GET", "/api/v1/p/1/comparisons", "compute"), ("GET", "/api/v1/p/1/uploads", "default"), ("OPTIONS", "/api/v1/p/1/uploads", None),
    ]
    df = spark.createDataFrame(cases, "method string, path string, want string")
    assert df.filter(~limits.route_group(F.col("method"), F.col("path")).eqNullSafe(F.col("want"))).count() == 0


HEADS = [("fromage blanc", "dairy_fresh_cheese", ["fromage blanc", "quark"]), ("lait", "dairy_milk", ["lait", "milk"]), ("ratatouille", "prepared_meal", ["ratatouille"])]


def test_heads(spark):
    names = ["Fromage Blanc 0%", "Laitue verte", "Lait demi-écrémé", "RATATOUILLE à l'huile", None, ""]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(text.product_head(F.col("n"), [h[:2] for h in HEADS])["raw"].alias("h")).collect()
    assert [r.h for r in got] == ["fromage blanc", None, "lait", "ratatouille", None, None]
    products = spark.createDataFrame([(1, "Ratatouille à l'Huile d'Olive"), (2, "Lait entier"), (3, "Olive verte"), (4, None)], "left_id long, product_name string")
    references = spark.createDataFrame([(1, "Oil olive"), (2, "Ratatouille prepared wo meat"), (3, "Potatoes mashed with milk"), (4, "Milk whole"), (5, "Ratatouille olive")], "right_id long, name string").withColumn("source", F.lit("s"))
    found = matching.shortlist(matching.asked_words(products, [h[:2] for h in HEADS], {"lait": ["milk"]}), matching.with_heads(references, HEADS)).collect()
    assert {(r.left_id, r.right_id, r.overlap, r.score, r["rank"]) for r in found} == {(1, 5, 2, 7, 1), (1, 2, 1, 6, 2), (2, 4, 1, 6, 1), (3, 1, 1, 1, 1), (3, 5, 1, 1, 2)}


@pytest.mark.parametrize("least", [0, 5, 1000])
def test_shortlist_equals_the_full_join(spark, least):
    rng = random.Random(least)
    vocabulary = [f"w{k}" for k in range(40)]
    pick = lambda: sorted({vocabulary[min(int(rng.expovariate(0.15)), 39)] for _ in range(rng.randint(0, 6))})
    asked = [(k, pick(), rng.choice(["", "", "h"])) for k in range(60)]
    known = [(k, rng.choice("ab"), rng.choice("xyz") * 2, pick(), ["", "h"] if rng.random() < 0.4 else [""]) for k in range(300)]
    got = matching.shortlist(spark.createDataFrame(asked, "left_id long, words array<string>, head string"), spark.createDataFrame(known, "right_id long, source string, name string, words array<string>, for_heads array<string>"), 4, "name", 0.0, least)
    want = set()
    for left, words, head in asked:
        for source in "ab":
            found = sorted((-len(set(words) & set(w)), name, right) for right, s, name, w, heads in known if s == source and head in heads and set(words) & set(w))
            want |= {(left, source, right, -n, -n + 5 * (head != ""), k + 1) for k, (n, _, right) in enumerate(found[:4])}
    assert {tuple(r) for r in got.collect()} == want


def test_no_row_from_frequent_words(spark, monkeypatch):
    """A word that most rows hold joins classes, not rows."""
    rows = spark.range(3000).select(F.col("id").alias("right_id"), F.lit("s").alias("source"), F.concat_ws(" ", F.lit("common"), F.concat(F.lit("own"), F.col("id"))).alias("name"))
    asked = matching.asked_words(spark.range(500).select(F.col("id").alias("left_id"), F.concat(F.lit("common own"), F.col("id")).alias("product_name")), [], {})
    joined = []
    monkeypatch.setattr(matching, "materialize", lambda df: joined.append(df.count()) or df)
    found = matching.shortlist(asked, matching.with_heads(rows, []), 2, "name", 0.01)
    assert found.count() == 1000 and found.filter("rank = 1 AND overlap = 2 AND left_id = right_id").count() == 500
    assert joined == [500, 3000]


def shuffled(plan):
    """Rows that each shuffle of a plan that ran has written."""
    kind = plan.getClass().getSimpleName()
    inner = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else [plan.children().apply(k) for k in range(plan.children().size())]
    own = plan.metrics().get("shuffleRecordsWritten")
    return ([own.get().value()] if own.isDefined() else []) + [n for p in inner for n in shuffled(p)]


def test_a_large_class_sends_no_list_a_product(spark):
    """Products with the same frequent words take the list of their class as it is; before, every product's list was shuffled, grouped and ranked again."""
    asked = spark.range(3000).select(F.col("id").alias("left_id"), F.array(F.lit("common"), F.when(F.col("id") == 7, "own7").otherwise("none")).alias("words"), F.lit("").alias("head"))
    names = spark.range(200).select(F.col("id").alias("right_id"), F.lit("s").alias("source"), F.concat(F.lit("n"), F.col("id") % 100).alias("name"), F.array(F.lit("common"), F.concat(F.lit("own"), F.col("id"))).alias("words"), F.array(F.lit("")).alias("for_heads"))
    found = matching.shortlist(asked, names, 10, "name", 0.01)
    rows = found.collect()
    assert len(rows) == 30_000 and {(r.right_id, r.overlap) for r in rows if r["rank"] == 1 and r.left_id != 7} == {(0, 1)}
    assert [(r.right_id, r.overlap) for r in sorted(rows, key=lambda r: r["rank"]) if r.left_id == 7][:2] == [(7, 2), (0, 1)]
    assert max(shuffled(found._jdf.queryExecution().executedPlan())) <= 6000


def test_shortlist_of_ids_that_come_twice(spark):
    """Rows with one id count together, a null id too, whether their words are frequent or not."""
    known = spark.createDataFrame([(k, "s", f"n{k:03}", [f"w{k % 3}"], [""]) for k in range(200)], "right_id long, source string, name string, words array<string>, for_heads array<string>")
    asked = spark.createDataFrame([(1, ["w0"], ""), (1, ["w1"], ""), (None, ["w1"], ""), (None, ["w2"], ""), (2, ["w0"], "")], "left_id long, words array<string>, head string")
    got = {(r.left_id, r.right_id, r["rank"]) for r in matching.shortlist(asked, known, 3).collect()}
    assert got == {(1, 0, 1), (1, 1, 2), (1, 3, 3), (None, 1, 1), (None, 2, 2), (None, 4, 3), (2, 0, 1), (2, 3, 2), (2, 6, 3)}


GATE_FORMS = [("pois chiches", "chickpea"), ("peas chick", "chickpea"), ("chickpeas", "chickpea"), ("hummus", "hummus"), ("houmous", "hummus"), ("ratatouille", "ratatouille"), ("oil", "oil"), ("olive", "olive"), ("milk", "milk"), ("lait", "milk"), ("corn flakes", "cereal"), ("apple", "apple")]


@pytest.mark.parametrize(
    "product, candidate, action, confidence",
    [
        ("Pois chiches", "Peas chick boiled", "accepted", 0.96),
        ("Ratatouille à l'huile d'olive", "Oil olive", "qualifier_trap", 0.0),
        ("Ratatouille", "Ratatouille prepared wo meat", "accepted", 0.96),
        ("Pois chiches", "Hummus with chickpeas", "composite_reject", 0.0),
        ("Houmous", "Hummus natural", "accepted", 0.96),
        ("Lait", "Potatoes mashed with milk", "composite_reject", 0.0),
        ("Date", "Date dried", "accepted_head", 0.95),
        ("Corn Flakes", "Corn starch", "head_reject", 0.0),
        ("Lentil", "Crisps lentil", "proxy_review", 0.6),
        ("Apple", "Apple pie without sugar", "composite_reject", 0.0),
        ("Chair", "Table", "abstain", 0.0),
        (None, "Table", "abstain", 0.0),
    ],
)
def test_gate(spark, product, candidate, action, confidence):
    pairs = spark.createDataFrame([(product, candidate)], "product_name string, candidate_name string")
    found = matching.concept_columns(pairs, spark.createDataFrame(GATE_FORMS, "form string, concept string"), 2, ["pie", "soup"])
    assert tuple(found.select(matching.gate().alias("g")).first().g) == (action, confidence)


def test_earliest_then_longest_concept(spark):
    forms = spark.createDataFrame([("peas", "pea"), ("peas chick", "chickpea"), ("coco", "coconut"), ("peas", "apea")], "form string, concept string")
    names = spark.createDataFrame([("coco peas chick",), ("peas chick coco",), ("Peas",), ("none",), (None,)], "n string").select("n", text.normal_words(F.col("n")).alias("words"))
    got = {r.n: r.concept for r in names.join(text.concepts(names, forms, 2), "words").collect()}
    assert got == {"coco peas chick": "coconut", "peas chick coco": "chickpea", "Peas": "apea"}


def test_cascade_takes_what_is_open(spark):
    products = spark.createDataFrame(
        [(1, "Lait", True, None, "dairy", "g"), (2, "milk fresh", True, None, "dairy", "g"), (3, "Quinoa", True, None, "grain", "g"), (4, "Quinoa", True, 1.0, "grain", "g"), (5, "Beef", True, None, "grain", "g"), (6, "zzz", True, None, "x", "g"), (7, "yyy", True, None, "x", None), (8, "Lait", False, None, "dairy", "g"), (9, "empty thing", True, None, "dairy", None)],
        "product_id long, product_name string, in_scope boolean, own_value double, family string, pt_group string",
    )
    kind = "code long, name_en string, name_nl string, value double, ord long, family string"
    first = spark.createDataFrame([(10, "lait", None, 3.0, 1, "dairy"), (11, "Milk", None, 3.5, 2, "dairy"), (12, "beef", None, 20.0, 3, "meat"), (13, "empty", None, None, 4, "dairy")], kind)
    second = spark.createDataFrame([(20, "quinoa", None, 14.0, 1, "grain"), (21, "beef", None, 21.0, 2, "meat")], kind)
    averages = spark.createDataFrame([("g", 9.0, 0.5)], "pt_group string, value double, confidence double")
    got = {r.product_id: tuple(r)[1:] for r in enrichment.cascaded(products, first, second, F.col("family") == F.col("ref_family"), [], {}, averages).collect()}
    assert got == {
        1: (1, "first_matched", "exact", "10", 3.0, 0.85), 2: (2, "first_matched", "fuzzy", "11", 3.5, 0.55), 3: (3, "second_matched", "exact", "20", 14.0, 0.8), 4: (0, "skipped_own_value", None, None, None, None),
        5: (1, "no_match", "family_mismatch", None, None, None), 6: (4, "average", "group_average", None, 9.0, 0.5), 7: (5, "no_match", None, None, None, None), 8: (0, "skipped_out_of_scope", None, None, None, None), 9: (5, "no_match", None, None, None, None),
    }
