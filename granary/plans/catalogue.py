"""The registered catalogue queries and, beside each, the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions import numeric, text
from granary.operators import bulk, comparison, coverage, enrichment, evaluation, fingerprint, food_groups, ingest, ingredients, matching, protein, quality_plans, readiness, reporting, review, rule_tables, rules, vector_index
from granary.plans.projection import BASE, PT_GROUP, STEP2, purchases, step2
from granary.session import dealt, materialize, prepare, shared_folder, table
from granary.sources import exports, history, run_exports

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
NOW = "2024-01-20 00:00:00"


def query(sql: str | None = None):
    """Register a query by its name, with its SQL."""

    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(prepare(spark), sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return run

    return put


def real(c: str, places: int | None = None, name: str | None = None):
    value = F.col(c).cast("double")
    return (value if places is None else F.round(value, places)).alias(name or c)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", F.get_json_object("props", "$.k").cast("long"))


EVENTS = "e AS (SELECT event_id, ts, user_id, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"


@query(f"""WITH {BASE}, s AS (SELECT pt_group, sum(grams) AS g, sum(grams * pct) AS p, count(*) AS n FROM base WHERE pct IS NOT NULL GROUP BY 1)
SELECT g.pt_group, coalesce(s.g, 0) / 1000.0 AS volume_kg, coalesce(s.p, 0) / 100000.0 AS protein_kg, CAST(coalesce(n, 0) AS BIGINT) AS item_count
FROM (VALUES ('plant_based_core'), ('plant_based_non_core'), ('composite_products'), ('animal_core')) AS g(pt_group) LEFT JOIN s USING (pt_group)""")
def pt_run_groups(spark, sf_dir):
    rows = protein.run_rows(protein.resolved(purchases(spark, sf_dir)))
    return protein.group_totals(rows).select("pt_group", real("volume_kg"), real("protein_kg"), "item_count")


HEADLINE = """SELECT p / 100000.0 AS plant_protein_kg, a / 100000.0 AS animal_protein_kg, (p + a) / 100000.0 AS total_protein_kg,
       round(100.0 * p / (p + a), 4) AS plant_share_pct, round(100.0 * a / (p + a), 4) AS animal_share_pct
FROM (SELECT sum(CASE WHEN pt_group LIKE 'plant%' THEN 1.0 WHEN pt_group = 'composite_products' THEN 0.5 ELSE 0 END * grams * pct) AS p,
             sum(CASE WHEN pt_group = 'animal_core' THEN 1.0 WHEN pt_group = 'composite_products' THEN 0.5 ELSE 0 END * grams * pct) AS a FROM base)"""


@query(f"WITH {BASE} {HEADLINE}")
def pt_headline_share(spark, sf_dir):
    rows = protein.run_rows(protein.resolved(purchases(spark, sf_dir)))
    return protein.headline(rows).select(real("plant_protein_kg"), real("animal_protein_kg"), real("total_protein_kg"), real("plant_share_pct", 4), real("animal_share_pct", 4))


@query(f"""WITH {BASE}, k AS (SELECT *, pct IS NOT NULL AS own, coalesce(pct, CASE WHEN product_id % 3 = 0 THEN 5 END) AS p FROM base)
SELECT count(*) FILTER (own AND product_id % 2 = 0) AS rows_label, count(*) FILTER (own AND product_id % 2 <> 0) AS rows_reference, count(*) FILTER (p IS NOT NULL AND pt_group = 'out_of_scope') AS out_of_scope_count,
       count(*) FILTER (p IS NOT NULL AND pt_group = 'unknown') AS unknown_count, count(*) FILTER (p IS NOT NULL AND NOT own) AS enriched_count,
       count(*) FILTER (pt_group = 'composite_products' AND (own AND p_size % 2 = 0 OR NOT own AND p IS NOT NULL)) AS rows_with_split, count(*) FILTER (p IS NULL) AS missing_protein_count FROM k""")
def pt_quality_counters(spark, sf_dir):
    """Parts of even size give a split of their own protein, and a third of the parts have an enrichment with one."""
    share = lambda x: F.when(F.col("p_size") % 2 == 0, F.col("protein_pct") * F.lit(x).cast("decimal(3,2)")).cast("decimal(18,10)")
    own = purchases(spark, sf_dir).withColumn("plant_protein_pct", share("0.40")).withColumn("animal_protein_pct", share("0.60"))
    value = lambda x: F.lit(x).cast("decimal(18,10)")
    more = table(spark, sf_dir, "part").filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("product_id"), value("5").alias("protein_pct"), F.lit("reference_a").alias("source"), value("2").alias("plant_protein_pct"), value("3").alias("animal_protein_pct"))
    products = protein.resolved(own, more)
    return protein.counters(products, protein.run_rows(products))


@query(f"""WITH {BASE}, {STEP2},
w AS (SELECT food_group, subgroup, grams AS g FROM base WHERE NOT is_composite UNION ALL SELECT food_group, subgroup, g FROM ingredient),
s AS (SELECT food_group, sum(g) AS g, sum(CASE WHEN subgroup = 'cheese' THEN 10 * g ELSE g END) AS d FROM w GROUP BY 1)
SELECT f.food_group, coalesce(g, 0) / 1000.0 AS weight_kg, CASE WHEN f.food_group = 'FG2' THEN coalesce(d, 0) / 1000.0 END AS weight_kg_dairy,
       round(100.0 * coalesce(g, 0) / (SELECT sum(grams) FROM base), 4) AS share_pct, CAST(f.reference_share_pct AS DOUBLE) AS reference_share_pct
FROM (VALUES ('FG1', 16), ('FG2', 19), ('FG3', 4), ('FG4', 39), ('FG5', 18), ('FG6', 4), ('FG7', NULL)) AS f(food_group, reference_share_pct) LEFT JOIN s USING (food_group)""")
def wwf_food_group_share(spark, sf_dir):
    rows = food_groups.run_rows(purchases(spark, sf_dir))
    return food_groups.group_shares(rows, step2(spark, sf_dir)).select("food_group", real("weight_kg"), real("weight_kg_dairy"), real("share_pct", 4), real("reference_share_pct"))


@query(f"""WITH {BASE} SELECT sum(grams) / 1000.0 AS composites_kg, sum(grams) FILTER (bucket = 'meat_based') / 1000.0 AS meat_based_kg, sum(grams) FILTER (bucket = 'seafood_based') / 1000.0 AS seafood_based_kg,
 sum(grams) FILTER (bucket = 'vegetarian') / 1000.0 AS vegetarian_kg, sum(grams) FILTER (bucket = 'vegan') / 1000.0 AS vegan_kg FROM base WHERE is_composite""")
def wwf_composite_buckets(spark, sf_dir):
    totals = food_groups.bucket_totals(food_groups.run_rows(purchases(spark, sf_dir)))
    return totals.select(*[real(c) for c in totals.columns])


@query(f"""WITH {BASE}, {STEP2},
w AS (SELECT food_group, subgroup, grams AS g FROM base WHERE NOT is_composite UNION ALL SELECT food_group, subgroup, g FROM ingredient),
s AS (SELECT CASE WHEN food_group IN ('FG4', 'FG5', 'FG6') OR subgroup IN ('legumes', 'dairy_alternative_plant', 'plant_based_fat', 'plant_based_snack') THEN 'plant' ELSE 'animal' END AS side,
             CASE WHEN subgroup = 'cheese' THEN 10 * g ELSE g END AS g FROM w),
t AS (SELECT sum(g) FILTER (side = 'plant') AS p, sum(g) FILTER (side = 'animal') AS a FROM s)
SELECT p / 1000.0 AS plant_kg, a / 1000.0 AS animal_kg, round(100.0 * p / (p + a), 4) AS plant_share_pct, round(100.0 * a / (p + a), 4) AS animal_share_pct FROM t""")
def wwf_whole_diet_polarity(spark, sf_dir):
    diet = food_groups.whole_diet(food_groups.run_rows(purchases(spark, sf_dir)), step2(spark, sf_dir))
    return diet.select(real("plant_kg"), real("animal_kg"), real("plant_share_pct", 4), real("animal_share_pct", 4))


@query(f"WITH {BASE}, {STEP2} SELECT product_id, food_group, subgroup, sum(g) / 1000.0 AS weight_kg, count(*) AS n_rows FROM ingredient GROUP BY ALL")
def wwf_step2_distribution(spark, sf_dir):
    parts = food_groups.ingredient_rows(food_groups.run_rows(purchases(spark, sf_dir)), step2(spark, sf_dir))
    return parts.groupBy("product_id", "food_group", "subgroup").agg(F.sum("weight_kg").cast("double").alias("weight_kg"), F.count("*").alias("n_rows"))


@query(f"""WITH {BASE}, r AS (SELECT pt_group, year(l_shipdate) AS y, sum(grams * pct) AS v FROM base WHERE pct IS NOT NULL AND pt_group NOT IN ('out_of_scope', 'unknown') GROUP BY ALL),
j AS (SELECT g AS pt_group, coalesce((SELECT v FROM r WHERE pt_group = g AND y = 1996), 0) / 100000.0 AS before, coalesce((SELECT v FROM r WHERE pt_group = g AND y = 1997), 0) / 100000.0 AS after
      FROM (VALUES ('plant_based_core'), ('plant_based_non_core'), ('composite_products'), ('animal_core')) AS x(g))
SELECT pt_group, before, after, round(after - before, 4) AS delta, CASE WHEN after - before > 0.1 THEN 'up' WHEN after - before < -0.1 THEN 'down' ELSE 'flat' END AS direction FROM j""")
def run_comparison_pt(spark, sf_dir):
    rows = protein.run_rows(protein.resolved(purchases(spark, sf_dir))).filter("in_scope")
    sums = comparison.by_run(rows, "pt_group", "full_protein_kg", F.year("l_shipdate"), 1996, 1997)
    groups = spark.createDataFrame([(g,) for g in protein.GROUPS], "pt_group string")
    return comparison.moved(groups.join(sums, "pt_group", "left")).select("pt_group", "before", "after", real("delta", 4), "direction")


@query(f"""WITH {BASE}, r AS (SELECT food_group, year(l_shipdate) AS y, sum(grams) AS v FROM base WHERE NOT is_composite GROUP BY ALL),
j AS (SELECT coalesce(a.food_group, b.food_group) AS food_group, coalesce(a.v, 0) / 1000.0 AS before, coalesce(b.v, 0) / 1000.0 AS after
      FROM (SELECT * FROM r WHERE y = 1996) a FULL JOIN (SELECT * FROM r WHERE y = 1997) b USING (food_group))
SELECT food_group, before, after, round(after - before, 4) AS delta, CASE WHEN after - before > 0.001 THEN 'up' WHEN after - before < -0.001 THEN 'down' ELSE 'flat' END AS direction FROM j""")
def run_comparison_wwf(spark, sf_dir):
    parts = food_groups.run_rows(purchases(spark, sf_dir)).filter("not is_composite")
    sums = comparison.by_run(parts, "food_group", "weight_kg", F.year("l_shipdate"), 1996, 1997)
    return comparison.moved(sums, comparison.MOVED_FRACTION).select("food_group", "before", "after", real("delta", 4), "direction")


def operations(spark, sf_dir):
    """An operation for each event."""
    k = F.coalesce("k", F.lit(0))
    kind = F.element_at(F.create_map(*map(F.lit, ["click", comparison.OPERATIONS[0], "view", comparison.OPERATIONS[1], "error", comparison.OPERATIONS[2], "purchase", comparison.OPERATIONS[3]])), F.col("event_type"))
    pick = lambda n, *values: F.element_at(F.array(*map(F.lit, values)), (k % n + 1).cast("int"))
    return events(spark, sf_dir).select(
        F.col("event_id").alias("op_id"), F.col("event_id").alias("op_order"), F.coalesce(kind, F.lit("dance")).alias("operation_type"), pick(5, *protein.GROUPS, "unknown").alias("from_group"),
        pick(3, "animal_core", "plant_based_core", "out_of_scope").alias("to_group"), F.when(k % 7 == 0, "-1").when(k % 7 == 1, "many").otherwise(k.cast("string")).alias("amount_kg"),
        k.cast("string").alias("plant_pct"), F.when(k % 4 == 0, 90 - k).otherwise(100 - k).cast("string").alias("animal_pct"),
    )


OPERATIONS = f"""{EVENTS},
o AS (
  SELECT event_id, event_type, coalesce(k, 0) AS k, ['plant_based_core', 'plant_based_non_core', 'composite_products', 'animal_core', 'unknown'][coalesce(k, 0) % 5 + 1] AS src, ['animal_core', 'plant_based_core', 'out_of_scope'][coalesce(k, 0) % 3 + 1] AS dst,
         CASE WHEN coalesce(k, 0) % 4 = 0 THEN 90 ELSE 100 END - coalesce(k, 0) AS animal, CASE coalesce(k, 0) % 7 WHEN 0 THEN 'negative_amount_kg' WHEN 1 THEN 'unparseable_amount_kg' END AS amount FROM e),
w AS (
  SELECT *, CASE WHEN event_type NOT IN ('click', 'view', 'error', 'purchase') THEN 'unknown_operation_type'
                 WHEN event_type = 'click' AND src = 'unknown' THEN 'invalid_from_group' WHEN event_type = 'click' AND dst = 'out_of_scope' THEN 'invalid_to_group'
                 WHEN event_type = 'purchase' THEN CASE WHEN animal < 0 THEN 'negative_split' WHEN k % 4 = 0 THEN 'split_not_100' END ELSE amount END AS warning FROM o),
d AS (
  SELECT g AS pt_group, sum(x) AS d FROM (
    SELECT src AS g, -k AS x FROM w WHERE event_type = 'click' AND warning IS NULL UNION ALL SELECT dst, k FROM w WHERE event_type = 'click' AND warning IS NULL
    UNION ALL SELECT 'plant_based_core', k FROM w WHERE event_type = 'view' AND warning IS NULL UNION ALL SELECT 'animal_core', -k FROM w WHERE event_type = 'error' AND warning IS NULL) GROUP BY 1),
g AS (SELECT pt_group, sum(grams * pct) / 100000.0 AS b FROM base WHERE pct IS NOT NULL AND pt_group NOT IN ('out_of_scope', 'unknown') GROUP BY 1),
p AS (
  SELECT n AS pt_group, coalesce(b, 0) AS b, coalesce(d, 0) AS d, (SELECT arg_max(k, event_id) FROM w WHERE event_type = 'purchase' AND warning IS NULL) AS split
  FROM (VALUES ('plant_based_core'), ('plant_based_non_core'), ('composite_products'), ('animal_core')) AS x(n) LEFT JOIN g ON g.pt_group = n LEFT JOIN d ON d.pt_group = n)"""


@query(f"""WITH {BASE}, {OPERATIONS} SELECT pt_group, round(b, 4) :: DOUBLE AS base_kg, round(greatest(0, b + d), 4) :: DOUBLE AS projected_kg, b + d < 0 AS clamped,
       CASE WHEN pt_group = 'composite_products' THEN coalesce(split / 100.0, 0.5) WHEN pt_group LIKE 'plant%' THEN 1.0 ELSE 0.0 END :: DOUBLE AS plant_fraction FROM p""")
def scenario_projection(spark, sf_dir):
    groups = protein.group_totals(protein.run_rows(protein.resolved(purchases(spark, sf_dir))))
    return comparison.scenario(groups, operations(spark, sf_dir)).select("pt_group", real("base_kg", 4), real("projected_kg", 4), "clamped", "plant_fraction")


@query(f"""WITH {BASE}, {OPERATIONS} SELECT CAST(event_id AS VARCHAR) AS subject, warning FROM w WHERE warning IS NOT NULL UNION ALL SELECT pt_group, 'clamped_to_zero' FROM p WHERE b + d < 0""")
def scenario_warnings(spark, sf_dir):
    groups = protein.group_totals(protein.run_rows(protein.resolved(purchases(spark, sf_dir))))
    made = operations(spark, sf_dir)
    return comparison.scenario_warnings(made, comparison.scenario(groups, made))


def records(spark, sf_dir):
    """Enrichment records: a source and a value for each order line of a part."""
    source = F.element_at(F.array(*map(F.lit, enrichment.PRIORITY)), (F.col("l_suppkey") % 4 + 1).cast("int"))
    nutrient = F.element_at(F.array(*map(F.lit, ["protein", "plant_protein", "animal_protein"])), (F.col("l_linenumber") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("product_id"), source.alias("source"), nutrient.alias("nutrient"), F.when(F.col("l_tax") > 0, F.col("l_quantity")).alias("value"), F.when(F.col("l_discount") < 0.09, "enriched").otherwise("failed").alias("status"), F.col("l_shipdate").alias("created_at"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("record_id"), (F.col("l_suppkey") % 4).alias("prio")
    )


RECORDS = """rec AS (SELECT l_partkey AS product_id, l_suppkey % 4 AS prio, CASE l_suppkey % 4 WHEN 0 THEN 'manual' WHEN 1 THEN 'reference_a' WHEN 2 THEN 'reference_b' ELSE 'category_average' END AS source,
 CASE l_linenumber % 3 WHEN 0 THEN 'protein' WHEN 1 THEN 'plant_protein' ELSE 'animal_protein' END AS nutrient, CASE WHEN l_tax > 0 THEN l_quantity END AS value, CASE WHEN l_discount < 0.09 THEN 'enriched' ELSE 'failed' END AS status, l_shipdate AS created_at, l_orderkey * 10 + l_linenumber AS record_id FROM lineitem)"""


@query(f"""WITH {RECORDS}, b AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY prio, created_at DESC, record_id, value) AS n FROM rec WHERE nutrient = 'protein' AND value IS NOT NULL AND status = 'enriched'),
s AS (SELECT product_id, source, count(*) FILTER (nutrient = 'plant_protein') > 0 AND count(*) FILTER (nutrient = 'animal_protein') > 0 AS whole FROM rec WHERE value IS NOT NULL AND status = 'enriched' GROUP BY ALL)
SELECT b.product_id, b.source, b.value, b.record_id, coalesce(s.whole, false) AS has_split FROM b LEFT JOIN s USING (product_id, source) WHERE n = 1""")
def enrichment_best_source(spark, sf_dir):
    all_ = records(spark, sf_dir)
    best = enrichment.best_record(all_.filter("nutrient = 'protein'"))
    with_ = enrichment.with_siblings(best.select("product_id", "source", "value", "record_id"), all_)
    return with_.select("product_id", "source", "value", "record_id", F.col("plant_protein").isNotNull().alias("has_split"))


@query("""WITH m AS (SELECT p_brand AS food_group, avg(p_size) AS m, count(p_size) AS n FROM part GROUP BY 1)
SELECT food_group, round_even(m, 4) AS avg_value, n, (SELECT p_partkey FROM part WHERE p_brand = food_group ORDER BY abs(p_size - m), p_partkey LIMIT 1) AS representative FROM m""")
def enrichment_group_average(spark, sf_dir):
    foods = table(spark, sf_dir, "part").select(F.col("p_brand").alias("food_group"), F.col("p_size").cast("double").alias("value"), F.col("p_partkey").alias("code"))
    return enrichment.group_averages(foods)


@query("""WITH r AS (SELECT lower(trim(p_name)) AS k, max(p_partkey) AS code FROM part WHERE p_partkey % 3 = 0 GROUP BY 1)
SELECT p_partkey AS product_id, r.code AS ref_code, CASE WHEN r.code IS NOT NULL THEN 'name_en' END AS matched_on FROM part LEFT JOIN r ON r.k = lower(trim(p_name))""")
def reference_exact_match(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    reference = part.filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("code"), F.col("p_size").alias("value"), F.upper("p_name").alias("name_en"), F.lit(None).cast("string").alias("name_nl"), F.col("p_partkey").alias("ord"))
    found = matching.exact_match(part.select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name")), reference)
    return found.select("product_id", "ref_code", "matched_on")


@query("""WITH t AS (SELECT item_id, unnest(list_distinct(list_filter(regexp_split_to_array(translate(lower(text), 'àâäçéèêëîïñóôöùúûüíáì', 'aaaceeeeiinooouuuuiai'), '[^a-z0-9]+'),
   lambda x: length(x) >= 3 AND x NOT IN ('the', 'and', 'with', 'without', 'for', 'avec', 'sans', 'des', 'les', 'aux', 'van', 'met', 'een', 'het', 'raw', 'average', 'prepared')))) AS w
   FROM (SELECT item_id, replace(text, 'ß', 'ss') AS text FROM benchmark)),
p AS (SELECT a.item_id AS left_id, b.item_id AS right_id, count(*) AS score FROM t a JOIN t b USING (w) WHERE a.item_id <> b.item_id GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY score DESC, right_id) AS rank FROM p)
SELECT left_id, right_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""")
def fuzzy_token_match_topk(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    words = F.array_sort(text.tokens(F.col("text")))
    a = items.select(F.col("item_id").alias("left_id"), words.alias("words"), F.lit("").alias("head"))
    b = items.select(F.col("item_id").alias("right_id"), F.lit("one").alias("source"), words.alias("words"), F.array(F.lit("")).alias("for_heads"))
    near = matching.shortlist(a, b, 4, "right_id").filter("left_id <> right_id")
    order = Window.partitionBy("left_id").orderBy(F.desc("score"), "right_id")
    return near.withColumn("rank", F.row_number().over(order)).filter("rank <= 3").select("left_id", "right_id", "score", "rank")


VECTORS = """q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q, label AS q_label FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id AS ref_id, q_label, label, list_cosine_similarity(q, CAST(embedding AS DOUBLE[])) AS similarity FROM q, embeddings WHERE vec_id <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, ref_id) AS rank FROM s)"""


def neighbours(spark, sf_dir, k):
    """The nearest vectors of every vector whose id is divisible by 50, in blocks of queries."""
    e = table(spark, sf_dir, "embeddings")
    queries = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    top = matching.vector_top_k(queries, e.select(F.col("vec_id").alias("ref_id"), F.col("embedding").alias("r")), k + 1).filter("query_id <> ref_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "ref_id")
    return top.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


@query(f"WITH {VECTORS} SELECT query_id, ref_id, round(similarity, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def vector_topk(spark, sf_dir):
    return neighbours(spark, sf_dir, 5).select("query_id", "ref_id", real("similarity", 6), "rank")


#: Forms of the concepts of the queries, dishes, and dishes that are a product's own concept.
FORMS = [("ring", "ring"), ("gear", "gear"), ("gizmo", "gear"), ("hot gizmo", "hot_gear"), ("soup", "soup"), ("oil", "oil"), ("red bolt", "red_bolt"), ("bolt", "bolt"), ("red", "anything red")]
FORMS_SQL = ", ".join(f"('{a}', '{b}')" for a, b in FORMS)


@query(f"""WITH {VECTORS},
n AS (SELECT vec_id, coalesce(p_name, '') AS name, CASE p_size % 5 WHEN 0 THEN p_name || ' with oil' WHEN 1 THEN 'oil ' || p_name WHEN 2 THEN p_name || ' soup' WHEN 3 THEN 'old ' || p_name ELSE coalesce(p_name, '') END AS other FROM embeddings LEFT JOIN part ON p_partkey = vec_id),
d AS (SELECT query_id, ref_id, similarity, rank, q.name AS p, c.other AS c, contains(' ' || c.other || ' ', ' soup ') AS dish, contains(c.other, ' with ') AS joined FROM r JOIN n q ON q.vec_id = query_id JOIN n c ON c.vec_id = ref_id WHERE rank <= 20),
m AS (SELECT *, CASE WHEN NOT dish AND joined THEN split_part(c, ' with ', 1) ELSE c END AS main FROM d),
t(form, concept) AS (VALUES {FORMS_SQL}),
w AS (SELECT DISTINCT p AS name FROM m UNION SELECT DISTINCT main FROM m),
k AS (SELECT name, arg_min(concept, (instr(' ' || name || ' ', ' ' || form || ' '), -length(form), concept)) AS concept FROM w, t WHERE contains(' ' || name || ' ', ' ' || form || ' ') GROUP BY 1),
f AS (
  SELECT m.*, k.concept AS pc, CASE WHEN NOT dish OR l.concept = 'soup' THEN l.concept END AS cc, split_part(p, ' ', 1) AS ph, split_part(c, ' ', 1) AS ch, dish OR joined AS composite
  FROM m LEFT JOIN k ON k.name = p LEFT JOIN k l ON l.name = main),
a AS (
  SELECT *, CASE WHEN ph = '' THEN 'abstain' WHEN cc IN ('oil', 'olive', 'garlic') AND pc IS NOT NULL AND pc <> cc THEN 'qualifier_trap' WHEN composite AND cc IS DISTINCT FROM pc THEN 'composite_reject'
                 WHEN pc = cc THEN 'accepted' WHEN ph = ch AND pc IS NOT NULL THEN 'head_reject' WHEN ph = ch THEN 'accepted_head'
                 WHEN list_contains(string_split(c, ' '), ph) AND pc IS NOT NULL THEN 'word_reject' WHEN list_contains(string_split(c, ' '), ph) THEN 'proxy_review' ELSE 'abstain' END AS action FROM f),
p AS (SELECT query_id, arg_min(ref_id, rank) FILTER (action LIKE 'accepted%') AS hit, arg_min(ref_id, rank) FILTER (action = 'proxy_review' AND similarity >= 0.2) AS proxy, count(*) FILTER (action LIKE '%reject') AS rejected FROM a GROUP BY 1)
SELECT query_id, coalesce(hit, proxy) AS ref_id, CASE WHEN hit IS NOT NULL THEN 'accepted' WHEN proxy IS NOT NULL THEN 'proxy' ELSE 'no_match' END AS outcome, rejected FROM p""")
def first_accept_gate(spark, sf_dir):
    """The gate over the names of the parts that vectors stand for, of the 20 nearest of each query."""
    size, name = F.col("p_size") % 5, F.coalesce("p_name", F.lit(""))
    other = F.when(size == 0, F.concat(name, F.lit(" with oil"))).when(size == 1, F.concat(F.lit("oil "), name)).when(size == 2, F.concat(name, F.lit(" soup"))).when(size == 3, F.concat(F.lit("old "), name)).otherwise(name)
    part = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "id")
    named = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")).join(part, "id", "left").select("id", name.alias("name"), other.alias("other"))
    near = neighbours(spark, sf_dir, 20).join(named.select(F.col("id").alias("query_id"), F.col("name").alias("product_name")), "query_id").join(named.select(F.col("id").alias("ref_id"), F.col("other").alias("candidate_name")), "ref_id")
    forms = spark.createDataFrame(FORMS, "form string, concept string")
    found = matching.concept_columns(near, forms, 2, ["soup"], ["soup"]).withColumn("action", matching.gate()["action"])
    picked = matching.first_accept(found, proxy=0.2)
    return picked.join(found.groupBy("query_id").agg(F.count_if(F.col("action").like("%reject")).alias("rejected")), "query_id")


RULES = [
    {"id": "r1", "priority": 10, "category": "round", "when": {"name_or_category_contains": ["ring", "gear"]}},
    {"id": "r2", "priority": 20, "category": "round", "when": {"all_of": [{"name_or_category_contains": "red"}, {"brand_in": ["brand#1", "brand#2", "brand#3"]}]}},
    {"id": "r3", "priority": 5, "category": "flat", "when": {"any_of": [{"name_or_category_contains": ["widget"]}, {"brand_in": ["brand#5"]}]}},
    {"id": "r4", "priority": 1, "category": "flat", "when": {"all_of": []}},
]


def part_products(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("retailer_category"), F.lit(None).cast("string").alias("retailer_subcategory"), "p_size")


@query("""WITH h AS (SELECT p_partkey AS product_id, lower(p_name || ' ' || p_type || ' ') AS t, lower(p_brand) AS b FROM part),
f AS (SELECT product_id, contains(t, 'widget') OR b = 'brand#5' AS r3, contains(t, 'ring') OR contains(t, 'gear') AS r1, contains(t, 'red') AND b IN ('brand#1', 'brand#2', 'brand#3') AS r2 FROM h)
SELECT product_id, CASE WHEN NOT r1 AND NOT r2 AND NOT r3 THEN 'pass_through' WHEN r3 AND (r1 OR r2) THEN 'collision' ELSE 'matched' END AS verdict,
       CASE WHEN r3 AND NOT (r1 OR r2) THEN 'flat' WHEN NOT r3 AND (r1 OR r2) THEN 'round' END AS category,
       concat_ws(',', CASE WHEN r3 THEN 'r3' END, CASE WHEN r1 THEN 'r1' END, CASE WHEN r2 THEN 'r2' END) AS rule_ids FROM f""")
def rule_verdicts(spark, sf_dir):
    return rules.verdicts(part_products(spark, sf_dir), RULES).select("product_id", "verdict", "category", "rule_ids")


ANIMAL_WORDS = ["the", "ing", "eau", "sch", "que"]


@query("""SELECT doc_id, CASE WHEN contains(lower(text), 'eau') THEN 'eau' WHEN contains(lower(text), 'ing') THEN 'ing' WHEN contains(lower(text), 'que') THEN 'que' WHEN contains(lower(text), 'sch') THEN 'sch' WHEN contains(lower(text), 'the') THEN 'the' END AS note
FROM documents""")
def contradiction_flags(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", rules.contradiction(F.array(F.lit("Vegan")), F.col("text"), ANIMAL_WORDS).alias("note"))


@query(r"""SELECT p_partkey AS product_id, CASE WHEN regexp_matches(p_name, '(?i)(^|[^a-z0-9])(ring|gear)s?($|[^a-z0-9])') THEN 'round' WHEN regexp_matches(p_name, '(?i)(^|[^a-z0-9])(widget|plate)s?($|[^a-z0-9])') THEN 'flat'
 WHEN p_size % 2 = 0 THEN 'even' ELSE 'other' END AS family, p_size % 2 = 0 OR regexp_matches(p_name, '(?i)(^|[^a-z0-9])(ring|gear)s?($|[^a-z0-9])') AS fits_round FROM part""")
def family_first_match(spark, sf_dir):
    name = F.col("product_name")
    of = text.first_match([("round", text.any_word(name, ["ring", "gear"])), ("flat", text.any_word(name, ["widget", "plate"])), ("even", F.col("p_size") % 2 == 0)], "other")
    rows = part_products(spark, sf_dir).withColumn("family", of)
    fits = matching.compatible(F.col("family"), F.lit("round"), []) | (F.col("p_size") % 2 == 0)
    return rows.select("product_id", "family", fits.alias("fits_round"))


def dirty(spark, sf_dir):
    """Order lines written loosely: decimal commas, thousands, blanks, words, wrong units."""
    line = dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("q")))
    n = F.col("l_partkey") % 7
    weight = F.when(n == 0, F.concat("q", F.lit(",5"))).when(n == 1, F.lit("abc")).when(n == 2, F.lit(" ")).when(n == 3, F.lit("0")).when(n == 4, F.lit("60000")).otherwise(F.col("q").cast("string"))
    return line.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_number"), F.when(F.col("l_partkey") % 5 != 0, F.concat(F.lit(" part "), F.col("l_partkey").cast("string"))).alias("product_name"),
        F.col("l_partkey").cast("string").alias("external_product_id"), weight.alias("weight_per_item_g"), F.when(n == 5, "1.5").alias("weight_per_item_kg"), F.concat("q", F.lit(".5")).alias("items_purchased"),
    )


@query("""WITH d AS (SELECT l_orderkey * 10 + l_linenumber AS r, l_partkey % 5 = 0 AS noname, l_partkey % 7 AS n, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
x AS (SELECT r, 'error' AS kind, 'product_name' AS field, 'missing_required' AS code FROM d WHERE noname
 UNION ALL SELECT r, 'error', 'weight_per_item_kg', CASE n WHEN 1 THEN 'invalid_type' WHEN 3 THEN 'weight_non_positive' WHEN 4 THEN 'weight_too_large' ELSE 'mixed_weight_units' END FROM d WHERE n IN (1, 3, 4, 5)
 UNION ALL SELECT r, 'warning', 'weight_per_item_g', 'weight_unit_likely_kg_warning' FROM d WHERE (n = 0 AND q + 0.5 < 5) OR (n = 6 AND q < 5)
 UNION ALL SELECT r, 'warning', 'items_purchased', 'non_integer_count' FROM d)
SELECT kind, field, code, count(DISTINCT r) AS n_rows FROM x GROUP BY ALL""")
def ingest_validation(spark, sf_dir):
    return ingest.report(ingest.parse(dirty(spark, sf_dir)))


@query("""SELECT p_partkey AS product_id, round(CASE p_partkey % 4 WHEN 0 THEN p_size * 0.001 WHEN 1 THEN p_size * 0.45359237 WHEN 2 THEN p_size * 0.028349523125 ELSE p_size * 1.0 END, 6) AS weight_kg,
 CASE p_partkey % 4 WHEN 1 THEN CASE WHEN p_size * 0.45359237 > 50 THEN 'weight_too_large' END END AS weight_code, round(CASE WHEN p_partkey % 2 = 0 THEN p_size / 4.0 ELSE p_size * 100 / 80.0 END, 6) AS protein_pct FROM part""")
def unit_normalisation(spark, sf_dir):
    size, n = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    kg, code = numeric.weight_kg(g=F.when(n == 0, size), lb=F.when(n == 1, size), oz=F.when(n == 2, size), kg=F.when(n == 3, size))
    none = F.lit(None).cast("string")
    pct, _ = numeric.protein_pct(none, F.when(n % 2 == 0, size), F.when(n % 2 == 0, "4"), F.when(n % 2 == 1, size), F.when(n % 2 == 1, "80"))
    made = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), kg.alias("weight_kg"), code.alias("weight_code"), pct.alias("protein_pct"))
    return made.select("product_id", real("weight_kg", 6), "weight_code", real("protein_pct", 6))


@query("""WITH d AS (SELECT l_partkey % 3 = 0 AS no_pt, l_partkey % 4 = 0 AS no_sold, l_returnflag = 'R' AS no_channel, l_discount = 0 AS no_protein FROM lineitem)
SELECT concat_ws(',', CASE WHEN NOT no_sold AND NOT no_channel THEN 'food_groups' END, CASE WHEN NOT no_pt THEN 'protein_tracker' END) AS methodologies,
 concat_ws(',', CASE WHEN no_pt THEN 'missing_items_purchased' END, CASE WHEN no_sold THEN 'missing_items_sold' END, CASE WHEN no_channel THEN 'missing_channel' END,
   CASE WHEN no_pt AND (no_sold OR no_channel) THEN 'no_methodology_satisfiable' END, CASE WHEN NOT no_pt AND no_protein THEN 'enrichment_needed' END) AS notes, count(*) AS n FROM d GROUP BY ALL""")
def methodology_downgrade(spark, sf_dir):
    p = purchases(spark, sf_dir)
    some = p.withColumn("items_purchased", F.when(F.col("product_id") % 3 != 0, F.col("items_purchased"))).withColumn("items_sold", F.when(F.col("product_id") % 4 != 0, F.col("items_sold")))
    some = some.withColumn("retail_channel", ingest.channel(F.when(F.col("l_returnflag") == "A", "Frais").when(F.col("l_returnflag") == "N", "  FROZEN ").otherwise("moon")))
    return ingest.satisfiable(some).groupBy(F.concat_ws(",", "methodologies").alias("methodologies"), F.concat_ws(",", "notes").alias("notes")).agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT p_brand AS source, CASE p_type WHEN 'ECONOMY' THEN 'plant_based_core' WHEN 'STANDARD' THEN 'plant_based_non_core' WHEN 'MEDIUM' THEN 'composite_products' WHEN 'LARGE' THEN 'animal_core' WHEN 'PROMO' THEN 'out_of_scope' ELSE 'unknown' END AS pt_group FROM part)
SELECT 'source' AS facet, source AS value, count(*) AS n FROM c GROUP BY ALL UNION ALL SELECT 'pt_group', pt_group, count(*) FROM c GROUP BY ALL""")
def classification_facets(spark, sf_dir):
    p = part_classes(spark, sf_dir)
    return coverage.facets(p, "source", "pt_group")


def part_classes(spark, sf_dir):
    from granary.plans.projection import PT_GROUP

    group = F.lit("unknown")
    for kind, g in PT_GROUP.items():
        group = F.when(F.col("p_type") == kind, g).otherwise(group)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("source"), group.alias("pt_group"), "p_size")


@query("""SELECT p_partkey AS product_id, false AS any_counts FROM part WHERE p_type NOT IN ('ECONOMY', 'STANDARD', 'MEDIUM', 'LARGE', 'PROMO') OR p_size % 3 = 0
UNION ALL SELECT p_partkey, true FROM part WHERE p_size % 3 = 0""")
def eligibility_anti_join(spark, sf_dir):
    every = part_classes(spark, sf_dir)
    have = every.filter("p_size % 3 <> 0")
    strict = coverage.unclassified(every, have).select("product_id", F.lit(False).alias("any_counts"))
    return strict.unionByName(coverage.unclassified(every, have, True).select("product_id", F.lit(True).alias("any_counts")))


@query(f"""WITH {BASE}, c AS (SELECT product_id, any_value(pt_group) AS g, bool_or(pct IS NULL) AS lacks FROM base GROUP BY 1), {EVENTS}, r AS (SELECT DISTINCT user_id FROM e WHERE event_type = 'error')
SELECT count(*) AS n_products, count(*) FILTER (g <> 'unknown') AS n_classified, count(*) FILTER (lacks) AS n_missing, count(*) FILTER (product_id IN (SELECT user_id FROM r)) AS n_in_review FROM c""")
def workflow_counts(spark, sf_dir):
    products = purchases(spark, sf_dir).groupBy("product_id").agg(F.any_value("pt_group").alias("g"), F.bool_or(F.col("protein_pct").isNull()).alias("lacks"))
    queued = events(spark, sf_dir).filter("event_type = 'error'").select(F.col("user_id").alias("product_id"), F.lit(True).alias("queued")).distinct()
    joined = products.join(queued, "product_id", "left")
    return joined.agg(F.count("*").alias("n_products"), F.count_if(F.col("g") != "unknown").alias("n_classified"), F.count_if("lacks").alias("n_missing"), F.count_if(F.coalesce("queued", F.lit(False))).alias("n_in_review"))


COVERED = """cov AS (SELECT count(*) AS n_rows, count(*) FILTER (pt_group <> 'unknown') AS n_classified, count(*) FILTER (pt_group = 'unknown') AS n_unknown, count(*) FILTER (pt_group = 'out_of_scope') AS n_out_of_scope,
 count(pct) AS n_protein, count(*) FILTER (pt_group NOT IN ('unknown', 'out_of_scope') AND pct IS NULL) AS n_missing_protein, count(*) FILTER (grams = 0) AS n_zero_weight, count(*) FILTER (p_brand = 'Brand#1') AS n_ai,
 count(*) FILTER (l_returnflag = 'R' AND p_size = 1) AS n_pending, sum(grams) AS v, sum(grams) FILTER (pct IS NOT NULL) AS vp FROM base)"""


def covered(spark, sf_dir):
    p = purchases(spark, sf_dir).withColumn("volume_kg", numeric.q8(F.col("items_purchased") * F.col("weight_per_item_kg")))
    source = F.when(F.col("brand") == "Brand#1", "ai").otherwise("rule")
    return coverage.coverage(p.withColumn("source", source).withColumn("pending", (F.col("l_returnflag") == "R") & (F.col("p_size") == 1)))


UNCERTAINTY = """CASE WHEN 100.0 * n_unknown / n_rows >= 10 OR (n_pending > 0 AND 100.0 * n_pending / n_rows >= 5) THEN 'high' WHEN 100.0 * n_ai / n_rows >= 30 OR 100.0 * n_missing_protein / n_rows >= 10
 OR 100.0 * n_zero_weight / n_rows >= 10 OR n_pending > 0 THEN 'medium' ELSE 'low' END"""


@query(f"""WITH {BASE}, {COVERED}
SELECT n_rows, n_classified, n_unknown, n_out_of_scope, n_protein, n_missing_protein, n_zero_weight, n_ai, n_pending, round(100.0 * n_classified / n_rows, 2) AS classified_pct, round(100.0 * n_protein / n_rows, 2) AS protein_pct,
 round(100.0 * n_pending / n_rows, 2) AS pending_pct, round(100.0 * vp / v, 1) AS volume_pct, {UNCERTAINTY} AS uncertainty FROM cov""")
def coverage_uncertainty(spark, sf_dir):
    counts = ["n_rows", "n_classified", "n_unknown", "n_out_of_scope", "n_protein", "n_missing_protein", "n_zero_weight", "n_ai", "n_pending"]
    return covered(spark, sf_dir).select(*counts, "classified_pct", "protein_pct", "pending_pct", "volume_pct", "uncertainty")


@query(f"""WITH {BASE}, s AS (SELECT product_id, any_value(p_name) AS product_name, CASE WHEN any_value(pt_group) LIKE 'plant%' THEN 'positive' WHEN any_value(pt_group) = 'animal_core' THEN 'watch_out' END AS side, sum(grams * pct) AS p FROM base WHERE pct IS NOT NULL GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY p DESC, product_id) AS rank FROM s WHERE side IS NOT NULL)
SELECT product_id, product_name, side, p / 100000.0 AS protein_kg, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def top_contributors(spark, sf_dir):
    rows = protein.run_rows(protein.resolved(purchases(spark, sf_dir)))
    per = rows.groupBy("product_id").agg(F.any_value("product_name").alias("product_name"), F.any_value("pt_group").alias("g"), F.sum("full_protein_kg").alias("protein_kg"))
    side = F.when(F.col("g").startswith("plant"), "positive").when(F.col("g") == "animal_core", "watch_out")
    return coverage.contributors(per, side, "protein_kg").select("product_id", "product_name", "side", real("protein_kg"), "rank")


@query(f"""WITH {BASE}, {COVERED}, t AS (SELECT 100.0 * sum(CASE WHEN pt_group LIKE 'plant%' THEN 1.0 WHEN pt_group = 'composite_products' THEN 0.5 ELSE 0 END * grams * pct) / sum(grams * pct) FILTER (pt_group NOT IN ('out_of_scope', 'unknown')) AS plant,
 100.0 * sum(grams * pct) FILTER (pt_group = 'composite_products') / sum(grams * pct) FILTER (pt_group NOT IN ('out_of_scope', 'unknown')) AS comp FROM base WHERE pct IS NOT NULL),
w AS (SELECT count(*) FILTER (is_composite AND is_own_brand) AS own, count(*) FILTER (is_composite AND NOT is_own_brand) AS branded, 100.0 * sum(grams) FILTER (food_group = 'FG1') / sum(grams) AS fg1 FROM base),
x AS (SELECT *, {UNCERTAINTY} AS unc FROM cov, t, w),
a(methodology, generation, action_type, priority, holds) AS (
 SELECT 'protein_tracker', 0, 'increase_plant_core_share', 'high', plant < 40 FROM x UNION ALL SELECT 'protein_tracker', 1, 'improve_composite_breakdown', 'medium', comp >= 30 FROM x
 UNION ALL SELECT 'protein_tracker', 2, 'enrich_missing_nutrition', 'medium', n_missing_protein > 0 FROM x UNION ALL SELECT 'food_groups', 0, 'collect_step2_ingredient_data', 'high', own > 0 FROM x
 UNION ALL SELECT 'food_groups', 1, 'improve_data_quality', 'low', branded > 0 FROM x UNION ALL SELECT 'food_groups', 2, 'promote_legume_products', 'medium', fg1 > 13.5 FROM x
 UNION ALL SELECT m, 3, 'review_high_impact_unknowns', 'high', 100.0 * n_unknown / n_rows >= 5 FROM x, (VALUES ('protein_tracker'), ('food_groups')) v(m)
 UNION ALL SELECT m, 4, 'improve_data_quality', 'medium', 100.0 * n_ai / n_rows >= 30 FROM x, (VALUES ('protein_tracker'), ('food_groups')) v(m)
 UNION ALL SELECT m, 5, 'improve_data_quality', 'critical', unc = 'high' FROM x, (VALUES ('protein_tracker'), ('food_groups')) v(m)
 UNION ALL SELECT m, 6, 'create_category_target', 'low', unc = 'high' FROM x, (VALUES ('protein_tracker'), ('food_groups')) v(m)),
f AS (SELECT *, row_number() OVER (PARTITION BY methodology, action_type ORDER BY generation) AS n FROM a WHERE holds)
SELECT methodology, CAST(generation AS INTEGER) AS generation, action_type, priority FROM f WHERE n = 1""")
def recommendations(spark, sf_dir):
    bought = purchases(spark, sf_dir)
    rows = protein.run_rows(protein.resolved(bought))
    shared = covered(spark, sf_dir).select("unknown_pct", "ai_pct", "uncertainty", F.col("n_missing_protein").alias("missing_protein"))
    parts = rows.agg(F.sum("protein_kg").alias("t"), F.sum(F.when(F.col("pt_group") == "composite_products", F.col("protein_kg"))).alias("c"))
    composite = parts.select(F.try_divide(F.col("c").cast("double") * 100, F.col("t").cast("double")).alias("composite_share_pct"))
    grams, own = F.col("items_sold") * F.col("weight_per_item_kg"), F.col("is_composite") & F.col("is_own_brand")
    foods = bought.agg(
        F.count_if(own).alias("own_composites"), F.lit(0).alias("step2_applied"), F.count_if(F.col("is_composite") & ~F.col("is_own_brand")).alias("branded_composites"),
        F.try_divide(F.sum(F.when(F.col("food_group") == "FG1", grams)).cast("double") * 100, F.sum(grams).cast("double")).alias("fg1_share_pct"), F.lit(13.5).alias("fg1_reference_pct"),
    )
    one = protein.headline(rows).select("plant_share_pct").crossJoin(composite).crossJoin(shared)  # one row each
    both = [comparison.recommendations(one).withColumn("methodology", F.lit("protein_tracker")), comparison.recommendations(foods.crossJoin(shared), "food_groups").withColumn("methodology", F.lit("food_groups"))]
    return both[0].unionByName(both[1]).select("methodology", "generation", "action_type", "priority")


REASON = "CASE event_type WHEN 'error' THEN 'contradiction_detected' WHEN 'purchase' THEN 'rule_collision' WHEN 'signup' THEN 'low_confidence' WHEN 'click' THEN 'ai_parse_failed' ELSE 'requested' END"


def queue(spark, sf_dir):
    reason = F.when(F.col("event_type") == "error", "contradiction_detected").when(F.col("event_type") == "purchase", "rule_collision").when(F.col("event_type") == "signup", "low_confidence").when(F.col("event_type") == "click", "ai_parse_failed").otherwise("requested")
    return events(spark, sf_dir).select("event_id", "ts", "user_id", "value", "k", reason.alias("reason"), review.weight(reason).alias("w")).withColumn("priority", review.priority(F.col("w")))


@query(f"""WITH {EVENTS}, q AS (SELECT event_id, {REASON} AS reason, CASE event_type WHEN 'error' THEN 3 WHEN 'click' THEN 3 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END AS w, ts FROM e)
SELECT event_id, reason, w, CASE WHEN w = 3 THEN 'critical' WHEN w = 2 THEN 'high' WHEN w = 1 THEN 'medium' ELSE 'low' END AS priority FROM q ORDER BY w DESC, ts, event_id LIMIT 50 OFFSET 10""")
def review_queue_sorted(spark, sf_dir):
    return review.page(queue(spark, sf_dir), 10, 50, F.desc("w"), "ts", "event_id").select("event_id", "reason", "w", "priority")


STATE = "CASE k % 5 WHEN 0 THEN 'in_queue' WHEN 1 THEN 'reviewing' WHEN 2 THEN 'accepted' WHEN 3 THEN 'changed' ELSE 'deferred' END"


EDGES = "'in_queue>reviewing', 'reviewing>reviewing', 'reviewing>in_queue', 'in_queue>accepted', 'reviewing>accepted', 'in_queue>changed', 'reviewing>changed', 'in_queue>deferred', 'reviewing>deferred', 'deferred>in_queue'"


@query(f"""WITH RECURSIVE {EVENTS}, s AS (SELECT event_id, user_id, {STATE} AS state, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM e),
f AS (
  SELECT event_id, user_id, n, 'in_queue>' || state IN ({EDGES}) AS valid, CASE WHEN 'in_queue>' || state IN ({EDGES}) THEN state ELSE 'in_queue' END AS state FROM s WHERE n = 1
  UNION ALL SELECT s.event_id, s.user_id, s.n, f.state || '>' || s.state IN ({EDGES}), CASE WHEN f.state || '>' || s.state IN ({EDGES}) THEN s.state ELSE f.state END
  FROM f JOIN s ON s.user_id = f.user_id AND s.n = f.n + 1)
SELECT user_id, arg_max(state, n) AS state, max(event_id) FILTER (valid) AS last_valid, count(*) FILTER (valid) AS n_valid FROM f GROUP BY 1""")
def review_state_latest(spark, sf_dir):
    states = F.element_at(F.array(*map(F.lit, ["in_queue", "reviewing", "accepted", "changed", "deferred"])), (F.col("k") % 5 + 1).cast("int"))
    checked = review.checked_transitions(events(spark, sf_dir).withColumn("state", states), ["user_id"], ["ts", "event_id"])
    kept = checked.withColumn("state", F.when(F.col("valid"), F.col("state")).otherwise(F.col("previous")))
    last = review.latest(kept, ["user_id"], ["ts", "event_id"], ["state"])
    return last.join(checked.groupBy("user_id").agg(F.max(F.when(F.col("valid"), F.col("event_id"))).alias("last_valid"), F.count_if("valid").alias("n_valid")), "user_id")


@query(f"""WITH RECURSIVE {EVENTS},
s AS (
  SELECT event_id, user_id // 3 AS item, CAST(user_id % 3 AS VARCHAR) AS by_user, epoch_us(ts) // 100 AS at_us, row_number() OVER (PARTITION BY user_id // 3 ORDER BY ts, event_id) AS n,
         ['claim', 'release', 'claim', 'refresh', 'defer', 'reopen', 'change', 'release', 'claim', 'accept'][CAST(k % 10 AS INTEGER) + 1] AS action, ['animal_core', 'unknown', 'plant_based_core'][CAST(k % 3 AS INTEGER) + 1] AS to_ FROM e),
f AS (
  SELECT CAST(NULL AS BIGINT) AS event_id, item, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS refusal, 'in_queue' AS before_, 'in_queue' AS status, CAST(NULL AS VARCHAR) AS holder, CAST(NULL AS BIGINT) AS until_, CAST(NULL AS VARCHAR) AS category FROM s WHERE n = 1
  UNION ALL
  SELECT event_id, item, n, refusal, status, CASE WHEN refusal IS NULL THEN CASE action WHEN 'claim' THEN 'reviewing' WHEN 'release' THEN 'in_queue' WHEN 'accept' THEN 'accepted' WHEN 'change' THEN 'changed' WHEN 'defer' THEN 'deferred' WHEN 'reopen' THEN 'in_queue' ELSE status END ELSE status END,
         CASE WHEN refusal IS NOT NULL THEN holder WHEN action IN ('claim', 'refresh') THEN by_user END,
         CASE WHEN refusal IS NOT NULL THEN until_ WHEN action IN ('claim', 'refresh') THEN at_us + 900000000 END,
         CASE WHEN refusal IS NULL AND action = 'change' THEN to_ ELSE category END
  FROM (
    SELECT s.*, f.status, f.holder, f.until_, f.category,
           CASE WHEN action = 'reopen' THEN CASE WHEN status <> 'deferred' THEN 'illegal_transition' END
                WHEN status IN ('accepted', 'changed', 'deferred') THEN 'illegal_transition'
                WHEN action = 'refresh' THEN CASE WHEN holder IS NULL OR holder <> by_user THEN 'locked' WHEN until_ <= at_us THEN 'lock_expired' END
                WHEN holder IS NOT NULL AND until_ > at_us AND holder <> by_user THEN 'locked'
                WHEN action = 'change' AND to_ = 'unknown' THEN 'system_state'
                WHEN action = 'change' AND to_ = category THEN 'same_category' END AS refusal
    FROM f JOIN s ON s.item = f.item AND s.n = f.n + 1))
SELECT event_id, before_ AS status_before, refusal IS NULL AS accepted, refusal, status AS status_after, category AS category_after FROM f WHERE n > 0""")
def review_actions(spark, sf_dir):
    """Three reviewers share an item; a hundredth of the time between events, so that locks are still held."""
    pick = lambda c, n, *values: F.element_at(F.array(*map(F.lit, values)), (F.col(c) % n + 1).cast("int"))
    actions = events(spark, sf_dir).select(
        "event_id", "ts", F.floor(F.col("user_id") / 3).alias("item"), (F.col("user_id") % 3).cast("string").alias("user"), F.floor(F.unix_micros("ts") / 100).alias("at"),
        pick("k", 10, "claim", "release", "claim", "refresh", "defer", "reopen", "change", "release", "claim", "accept").alias("action"), pick("k", 3, "animal_core", "unknown", "plant_based_core").alias("category"),
    )
    return review.reviewed(actions, ["item"], ["ts", "event_id"]).select("event_id", "status_before", "accepted", "refusal", "status_after", "category_after")


@query(f"""WITH RECURSIVE {EVENTS},
s AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS at_us, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 3 ELSE 2 END AS most, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM e),
f AS (
  SELECT event_id, user_id, event_type, n, true AS accepted, CAST(0 AS BIGINT) AS retry_after, [at_us] AS times FROM s WHERE n = 1
  UNION ALL
  SELECT event_id, user_id, event_type, n, len(kept) < most, CASE WHEN len(kept) < most THEN 0 ELSE (kept[1] - (at_us - 432000000000)) // 1000000 + 1 END, CASE WHEN len(kept) < most THEN list_append(kept, at_us) ELSE kept END
  FROM (SELECT s.*, list_filter(f.times, lambda t: t > s.at_us - 432000000000) AS kept FROM f JOIN s ON s.user_id = f.user_id AND s.event_type = f.event_type AND s.n = f.n + 1))
SELECT event_id, accepted, retry_after FROM f""")
def rate_limit(spark, sf_dir):
    """At most one click, three views and two of any other event of a user in five days."""
    from granary.streaming.limits import limited

    requests = events(spark, sf_dir).select("event_id", F.col("user_id").alias("key"), F.col("event_type").alias("group"), F.unix_micros("ts").alias("at"))
    return limited(requests, ["at", "event_id"], {"click": 1, "view": 3, "default": 2}, 432_000).select("event_id", "accepted", "retry_after")


@query(f"WITH {EVENTS} SELECT user_id, max(event_id) AS event_id FROM e WHERE event_type NOT IN ('purchase', 'signup') AND ts < TIMESTAMP '{NOW}' - INTERVAL 30 MINUTES GROUP BY 1")
def stale_jobs(spark, sf_dir):
    status = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "signup", "failed").otherwise("running")
    jobs = events(spark, sf_dir).select("user_id", "event_id", status.alias("status"), F.col("ts").alias("updated_at"))
    return review.stale(jobs, F.lit(NOW).cast("timestamp")).groupBy("user_id").agg(F.max("event_id").alias("event_id"))


@query(f"""WITH {EVENTS}, l AS (SELECT user_id AS item, arg_max(k, (ts, k)) AS holder, max(ts) AS ts FROM e WHERE event_type = 'click' GROUP BY 1)
SELECT item, holder, epoch_us(ts + INTERVAL 15 MINUTES) AS expires_us, ts + INTERVAL 15 MINUTES > TIMESTAMP '{NOW}' AS held FROM l""")
def lease_expiry(spark, sf_dir):
    from granary.streaming.limits import leases

    claims = events(spark, sf_dir).filter("event_type = 'click'").select(F.col("user_id").alias("item"), F.col("k").alias("holder"), "ts")
    return leases(claims, F.lit(NOW).cast("timestamp")).select("item", "holder", F.unix_micros("expires").alias("expires_us"), "held")


@query(f"""WITH {EVENTS} SELECT event_id, n_before, n_before < 2 AS below_limit FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) - 1 AS n_before FROM e)""")
def rate_limit_candidates(spark, sf_dir):
    """Requests of the last hour before each: a bound of the stateful limit, which counts accepted ones only."""
    last = Window.partitionBy("user_id").orderBy(F.unix_micros("ts")).rangeBetween(-3_600_000_000, 0)
    return events(spark, sf_dir).select("event_id", (F.count("*").over(last) - 1).alias("n_before")).withColumn("below_limit", F.col("n_before") < 2)


@query("""SELECT substr(sha1(lower(trim(source)) || '|' || lower(trim(lang))), 1, 16) AS key, count(*) AS group_size, min(doc_id) AS first_id, sum(doc_id) :: BIGINT AS id_sum FROM documents GROUP BY 1""")
def dedupe_canonical_key(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    groups = evaluation.canonical_groups(docs, ["source", "lang"], "doc_id")
    return groups.join(evaluation.members(docs, ["source", "lang"], "doc_id").groupBy("key").agg(F.sum("id").alias("id_sum")), "key")


@query("""WITH c AS (SELECT quality AS expected, CASE WHEN n_chars > 800 THEN 1 ELSE 0 END AS predicted, n_chars > 500 AS accepted FROM labels JOIN documents USING (doc_id)),
t AS (SELECT count(*) AS n_cases, count(*) FILTER (expected = predicted) AS r, count(*) FILTER (accepted) AS a, count(*) FILTER (accepted AND expected = predicted) AS ar FROM c)
SELECT n_cases, round(r / n_cases, 6) AS accuracy, round(ar / a, 6) AS accepted_accuracy, round(1 - round(a / n_cases, 6), 6) AS review_rate, a - ar AS wrong_accepted FROM t""")
def eval_metrics(spark, sf_dir):
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return evaluation.classification_metrics(joined.select(F.col("quality").alias("expected"), (F.col("n_chars") > 800).cast("int").alias("predicted"), (F.col("n_chars") > 500).alias("accepted")))


@query(f"""WITH {VECTORS}, f AS (SELECT query_id, min(rank) FILTER (q_label = label AND rank <= 20) AS rank FROM r GROUP BY 1)
SELECT count(*) AS n_cases, round(avg(CASE WHEN rank IS NOT NULL THEN 1.0 ELSE 0 END), 6) AS coverage, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 6) AS recall_at_1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS recall_at_5,
 round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END), 6) AS recall_at_10, round(avg(CASE WHEN rank <= 20 THEN 1.0 ELSE 0 END), 6) AS recall_at_20, round(avg(rank), 6) AS mean_rank FROM f""")
def eval_delta(spark, sf_dir):
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    near = neighbours(spark, sf_dir, 20).join(labels.withColumnsRenamed({"id": "query_id", "label": "a"}), "query_id").join(labels.withColumnsRenamed({"id": "ref_id", "label": "b"}), "ref_id")
    return evaluation.retrieval_metrics(near.groupBy("query_id").agg(F.min(F.when(F.col("a") == F.col("b"), F.col("rank"))).alias("rank")))


@query("""WITH x AS (SELECT CASE WHEN label % 2 = 0 THEN label END AS a, CASE WHEN vec_id % 3 <> 0 THEN label % 4 END AS b, label % 5 AS ca, vec_id % 5 AS cb, vec_id % 7 = 0 AS rev, vec_id % 11 <> 0 AS fit FROM embeddings),
y AS (SELECT *, CASE WHEN a IS NULL AND b IS NULL THEN 'both_no_match' WHEN b IS NULL THEN 'v1_only' WHEN a IS NULL THEN 'v2_only' WHEN a = b THEN 'same_code' WHEN ca = cb THEN 'same_concept' ELSE 'disagreement_needs_review' END AS bucket FROM x)
SELECT bucket, CASE WHEN bucket IN ('same_code', 'both_no_match', 'same_concept') THEN 'safe_agreement' WHEN rev THEN 'v2_review_only' WHEN b IS NOT NULL AND fit THEN 'v2_better_than_v1'
 WHEN b IS NOT NULL THEN 'v2_potential_false_positive' ELSE 'manual_inspection_needed' END AS risk, count(*) AS n FROM y GROUP BY ALL""")
def agreement_risk_buckets(spark, sf_dir):
    c, lab = F.col("vec_id"), F.col("label")
    e = table(spark, sf_dir, "embeddings").select(F.when(lab % 2 == 0, lab).alias("a"), F.when(c % 3 != 0, lab % 4).alias("b"), (lab % 5).alias("ca"), (c % 5).alias("cb"), (c % 7 == 0).alias("rev"), (c % 11 != 0).alias("fit"))
    e = e.withColumn("bucket", evaluation.agreement(F.col("a"), F.col("b"), F.col("ca"), F.col("cb")))
    return e.groupBy("bucket", evaluation.risk(F.col("bucket"), F.col("b"), F.col("rev"), F.col("fit"), F.lit(False)).alias("risk")).agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT l_partkey AS product_id, bool_or(l_returnflag = 'R' AND l_quantity > 45) AS m, bool_or(l_returnflag = 'A' AND l_quantity > 40) AS v2, bool_or(l_returnflag = 'N' AND l_quantity > 35) AS v1 FROM lineitem GROUP BY 1)
SELECT product_id, CASE WHEN m THEN 'skip_manual' WHEN v2 THEN 'skip_v2' WHEN v1 THEN 'skip_v1' ELSE 'write' END AS disposition FROM f""")
def apply_disposition(spark, sf_dir):
    flag, q = F.col("l_returnflag"), F.col("l_quantity")
    kind = F.when((flag == "R") & (q > 45), "manual").when((flag == "A") & (q > 40), "v2").when(flag == "N", "v1").otherwise("none")
    value = F.when((flag != "N") | (q > 35), q)  # a version 1 record without a value doesn't count
    nutrient = F.when(kind == "none", "fat").otherwise("protein_pct")
    return review.disposition(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("product_id"), kind.alias("kind"), nutrient.alias("nutrient"), value.alias("value")))


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name IN ('EUROPE', 'ASIA'))")
def rls_semi_join(spark, sf_dir):
    visible = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region").filter(F.col("r_name").isin("EUROPE", "ASIA")), F.col("r_regionkey") == F.col("n_regionkey"))
    return table(spark, sf_dir, "customer").join(visible, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select("c_custkey", "c_nationkey")


@query(f"""WITH {BASE}, {STEP2}, one AS (SELECT product_id, place, food_group, subgroup, sum(g) AS g FROM ingredient GROUP BY ALL)
SELECT product_id, '[' || string_agg('{{"food_group":"' || food_group || '","subgroup":"' || subgroup || '","weight_kg":"' || printf('%.8f', g / 1000.0) || '"}}', ',' ORDER BY place) || ']' AS ingredients_json FROM one GROUP BY 1""")
def export_rows_json(spark, sf_dir):
    rows = food_groups.run_rows(purchases(spark, sf_dir)).filter("is_composite and is_own_brand").groupBy("product_id").agg(F.sum("items_sold").alias("n"))
    joined = rows.join(step2(spark, sf_dir), "product_id").withColumn("weight_kg", numeric.q8(F.col("weight_kg_per_item").cast("decimal(18,14)") * F.col("n").cast("decimal(18,2)")))
    return exports.inline_ingredients(joined)


@query("""SELECT 'only_nation' AS part, k FROM (SELECT n_regionkey AS k FROM nation EXCEPT SELECT r_regionkey FROM region WHERE r_regionkey < 3) UNION ALL
SELECT 'both', k FROM (SELECT n_regionkey AS k FROM nation INTERSECT SELECT r_regionkey FROM region WHERE r_regionkey < 3) UNION ALL SELECT 'any', k FROM (SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region)""")
def set_ops_fields(spark, sf_dir):
    a, b = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("k")), table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"))
    some = b.filter("k < 3")
    named = lambda d, n: d.select(F.lit(n).alias("part"), "k")
    return named(a.subtract(some), "only_nation").unionByName(named(a.intersect(some), "both")).unionByName(named(a.union(b).distinct(), "any"))


@query(f"""WITH {EVENTS}, q AS (SELECT {REASON} AS reason, user_id, ts, event_id FROM e) SELECT reason, count(*) AS n, arg_max(user_id, (ts, event_id)) AS last_user FROM q GROUP BY 1 ORDER BY n DESC, reason LIMIT 5""")
def report_review_summary(spark, sf_dir):
    q = queue(spark, sf_dir)
    last = review.latest(q, ["reason"], ["ts", "event_id"], ["user_id"]).withColumnRenamed("user_id", "last_user")
    return review.top_reasons(q).join(last, "reason")


@query(f"""WITH {VECTORS}, a AS (SELECT query_id, min(rank) FILTER (q_label = label AND rank <= 10) AS r1, min(rank) FILTER (ref_id % 3 = 0 AND rank <= 10) AS r2, arg_min(ref_id, rank) AS c1 FROM r GROUP BY 1)
SELECT CASE WHEN (r1 IS NULL AND r2 IS NOT NULL) OR r2 < r1 THEN 'improved' WHEN (r2 IS NULL AND r1 IS NOT NULL) OR r2 > r1 THEN 'regressed' WHEN c1 % 2 = 1 THEN 'changed_candidate' ELSE 'same' END AS change, count(*) AS n FROM a GROUP BY 1""")
def retrieval_change_buckets(spark, sf_dir):
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    near = neighbours(spark, sf_dir, 10).join(labels.withColumnsRenamed({"id": "query_id", "label": "a"}), "query_id").join(labels.withColumnsRenamed({"id": "ref_id", "label": "b"}), "ref_id")
    per = near.groupBy("query_id").agg(F.min(F.when(F.col("a") == F.col("b"), F.col("rank"))).alias("r1"), F.min(F.when(F.col("ref_id") % 3 == 0, F.col("rank"))).alias("r2"), F.min_by("ref_id", "rank").alias("c1"))
    return per.groupBy(evaluation.change(F.col("r1"), F.col("r2"), F.col("c1") % 2 == 0).alias("change")).agg(F.count("*").alias("n"))


@query(f"""WITH {EVENTS}, o AS (SELECT user_id, event_type, min(event_id) AS content, CASE WHEN count(*) % 2 = 0 THEN 'approved' ELSE 'draft' END AS status FROM e WHERE k < 50 GROUP BY ALL), w AS (SELECT user_id, event_type, max(event_id) AS content, 'draft' AS status FROM e WHERE k >= 30 GROUP BY ALL)
SELECT user_id, event_type, coalesce(w.content, o.content) AS content, CASE WHEN o.status = 'approved' THEN 'approved' ELSE coalesce(w.status, o.status) END AS status FROM o FULL JOIN w USING (user_id, event_type)""")
def upsert_keep_status(spark, sf_dir):
    e = events(spark, sf_dir)
    old = e.filter("k < 50").groupBy("user_id", "event_type").agg(F.min("event_id").alias("content"), F.when(F.count("*") % 2 == 0, "approved").otherwise("draft").alias("status"))
    new = e.filter("k >= 30").groupBy("user_id", "event_type").agg(F.max("event_id").alias("content"), F.lit("draft").alias("status"))
    return comparison.upserted(old, new, ["user_id", "event_type"], ("approved",))


@query(f"""WITH {EVENTS}, r AS (SELECT CASE k % 5 WHEN 0 THEN 'accept' WHEN 1 THEN 'change' WHEN 2 THEN 'reject' WHEN 3 THEN 'defer' ELSE 'moon' END AS decision, event_type = 'error' AS p0, k % 2 = 0 AS ov, CASE WHEN k % 3 = 0 THEN 'x' END AS chosen FROM e)
SELECT decision, concat_ws(',', CASE WHEN decision = 'moon' THEN 'unknown_decision' END, CASE WHEN decision = 'accept' AND p0 AND NOT ov THEN 'p0_needs_override' END, CASE WHEN decision = 'change' AND chosen IS NULL THEN 'missing_choice' END) AS errors, count(*) AS n FROM r GROUP BY ALL""")
def review_row_validation(spark, sf_dir):
    k = F.col("k")
    decision = F.element_at(F.array(*map(F.lit, ["accept", "change", "reject", "defer", "moon"])), (k % 5 + 1).cast("int"))
    rows = queue(spark, sf_dir).withColumn("decision", decision)
    level = F.when(F.col("reason") == "contradiction_detected", "P0").otherwise("P1")
    errors = review.decision_errors(F.col("decision"), level, k % 2 == 0, F.when(k % 3 == 0, "x"))
    return rows.groupBy("decision", F.concat_ws(",", errors).alias("errors")).agg(F.count("*").alias("n"))


@query(f"WITH {EVENTS} SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM e GROUP BY ALL")
def event_window_counts(spark, sf_dir):
    w = F.window("ts", "1 day")
    return events(spark, sf_dir).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


@query(f"""WITH {BASE}, c AS (SELECT product_id, any_value(p_size) AS s, any_value(pt_group) AS g FROM base GROUP BY 1),
x AS (SELECT product_id, CASE WHEN product_id % 3 = 0 THEN s * 1.0 END AS a, product_id % 2 = 0 AS ok, CASE WHEN product_id % 5 = 0 THEN s * 2.0 END AS b, CASE g WHEN 'plant_based_core' THEN 15.0 WHEN 'plant_based_non_core' THEN 12.0 WHEN 'composite_products' THEN 10.0 WHEN 'animal_core' THEN 18.0 END AS v FROM c)
SELECT product_id, CASE WHEN a IS NOT NULL AND NOT ok THEN 'failed_family' WHEN a IS NOT NULL THEN 'reference_a' WHEN b IS NOT NULL THEN 'reference_b' WHEN v IS NOT NULL THEN 'category_average' ELSE 'no_match' END AS source,
 CASE WHEN a IS NOT NULL AND NOT ok THEN NULL ELSE coalesce(a, b, v) :: DOUBLE END AS value FROM x""")
def enrichment_cascade(spark, sf_dir):
    p = purchases(spark, sf_dir).groupBy("product_id").agg(F.any_value("p_size").cast("double").alias("s"), F.any_value("pt_group").alias("g"))
    average = F.element_at(F.create_map(*[F.lit(x) for kv in enrichment.CATEGORY_AVERAGE.items() for x in kv]), F.col("g"))
    x = p.select("product_id", F.when(F.col("product_id") % 3 == 0, F.col("s")).alias("a_value"), (F.col("product_id") % 2 == 0).alias("a_family_ok"), F.when(F.col("product_id") % 5 == 0, F.col("s") * 2).alias("b_value"), average.alias("group_value"))
    return enrichment.cascade(x).select("product_id", "source", "value")


@query("""SELECT CASE WHEN p_type IN ('ECONOMY', 'STANDARD', 'MEDIUM', 'LARGE', 'PROMO') AND p_size % 4 <> 0 THEN p_brand ELSE 'unclassified' END AS source, count(*) AS n FROM part GROUP BY 1""")
def classification_sources(spark, sf_dir):
    every = part_classes(spark, sf_dir)
    return coverage.sources(every.select("product_id"), every.filter("pt_group <> 'unknown' and p_size % 4 <> 0").select("product_id", "source"))


@query("""WITH r AS (SELECT l_partkey AS product_id, sum(l_quantity) FILTER (l_linenumber % 3 = 1) AS plant_protein, sum(l_quantity) FILTER (l_linenumber % 3 = 2) AS animal_protein, sum(l_quantity) FILTER (l_linenumber % 3 = 0) AS protein FROM lineitem WHERE l_tax > 0 AND l_discount < 0.09 GROUP BY 1)
SELECT *, CASE WHEN plant_protein IS NULL OR animal_protein IS NULL OR protein IS NULL THEN 'missing' WHEN abs(plant_protein + animal_protein - protein) > 0.01 THEN 'invalid' ELSE 'ok' END AS status FROM r""")
def split_audit(spark, sf_dir):
    return evaluation.split_audit(enrichment.eligible(records(spark, sf_dir)).select("product_id", "nutrient", "value"))


@query(f"""WITH {RECORDS}, b AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY prio, created_at DESC, record_id, value) AS n FROM rec WHERE nutrient = 'protein' AND value IS NOT NULL AND status = 'enriched'),
p AS (SELECT p_partkey AS product_id, CASE WHEN p_size % 3 = 0 THEN p_size * 1.0 END AS own FROM part)
SELECT p.product_id, CASE WHEN own IS NOT NULL THEN own ELSE b.value END :: DOUBLE AS value, CASE WHEN own IS NOT NULL THEN 'retailer' ELSE coalesce(b.source, 'missing') END AS origin,
 CASE WHEN own IS NOT NULL THEN 'high' WHEN b.value IS NULL THEN 'none' WHEN b.value / 50 >= 0.85 THEN 'high' WHEN b.value / 50 >= 0.7 THEN 'medium' WHEN b.value / 50 >= 0.5 THEN 'low' WHEN b.value / 50 >= 0.3 THEN 'very_low' ELSE 'none' END AS status
FROM p LEFT JOIN (SELECT * FROM b WHERE n = 1) b USING (product_id)""")
def nutrition_table(spark, sf_dir):
    products = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.when(F.col("p_size") % 3 == 0, F.col("p_size")).alias("protein_pct"))
    return reporting.nutrition_table(products, records(spark, sf_dir).withColumn("confidence", F.col("value") / 50))


CLASSES = """c AS (SELECT p_partkey AS product_id, 'protein_tracker' AS methodology, p_type AS pt_group, p_brand AS source, (p_size % 10) / 10.0 AS confidence FROM part WHERE p_partkey % 4 <> 0
 UNION ALL SELECT p_partkey, 'food_groups', p_type, p_brand, (p_size % 7) / 10.0 FROM part WHERE p_partkey % 5 = 0),
v AS (SELECT p_partkey AS product_id, 'protein_tracker' AS methodology, 'pending' AS review_status FROM part WHERE p_partkey % 6 = 0)"""


@query(f"""WITH {CLASSES}, j AS (SELECT product_id, methodology, pt_group, source, confidence, review_status FROM c FULL JOIN v USING (product_id, methodology)),
t AS (SELECT p_partkey AS product_id, p_name AS product_name, methodology, pt_group, source, confidence, review_status FROM part LEFT JOIN j ON j.product_id = p_partkey)
SELECT 'all' AS part, count(*) AS n, count(methodology) AS with_methodology FROM t UNION ALL SELECT 'unknown_source', count(*), count(methodology) FROM t WHERE source IS NULL
UNION ALL SELECT 'confident_economy', count(*), count(methodology) FROM t WHERE pt_group = 'ECONOMY' AND confidence >= 0.3 AND confidence <= 0.6 UNION ALL SELECT 'pending_ring', count(*), count(methodology) FROM t WHERE review_status = 'pending' AND contains(lower(product_name), 'ring')""")
def classification_table(spark, sf_dir):
    part, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    of = lambda d, m, c: d.select(key.alias("product_id"), F.lit(m).alias("methodology"), F.col("p_type").alias("pt_group"), F.col("p_brand").alias("source"), (F.col("p_size") % c / 10).alias("confidence"))
    classes = of(part.filter(key % 4 != 0), "protein_tracker", 10).unionByName(of(part.filter(key % 5 == 0), "food_groups", 7))
    reviews = part.filter(key % 6 == 0).select(key.alias("product_id"), F.lit("protein_tracker").alias("methodology"), F.lit("pending").alias("review_status"))
    rows = reporting.classification_table(part.select(key.alias("product_id"), F.col("p_name").alias("product_name")), classes, reviews)
    cuts = {"all": {}, "unknown_source": {"source": "unknown"}, "confident_economy": {"group": "ECONOMY", "least": 0.3, "most": 0.6}, "pending_ring": {"review": "pending", "search": "RING"}}
    parts = [reporting.filtered(rows, **c).agg(F.count("*").alias("n"), F.count("methodology").alias("with_methodology")).select(F.lit(name).alias("part"), "n", "with_methodology") for name, c in cuts.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"""WITH {BASE}, x AS (SELECT CASE WHEN is_composite THEN 'composite' ELSE food_group END AS label FROM base),
p(place, label) AS (VALUES (0, 'FG1'), (1, 'FG2'), (2, 'FG3'), (3, 'FG4'), (4, 'FG5'), (5, 'FG6'), (6, 'FG7'), (7, 'composite'), (8, 'unknown'))
SELECT label, count(*) AS n, place FROM x JOIN p USING (label) GROUP BY ALL""")
def workbook_counts(spark, sf_dir):
    label = F.when(F.col("is_composite"), "composite").otherwise(F.col("food_group"))
    return reporting.ordered_counts(purchases(spark, sf_dir), label, [*food_groups.REFERENCE_SHARE, "composite", "unknown"])


@query(f"""WITH {BASE}, s AS (SELECT count(*) FILTER (pt_group = 'unknown' AND pct IS NOT NULL) AS u, count(*) FILTER (pct IS NULL) AS m, count(*) FILTER (is_composite AND NOT is_own_brand) AS b FROM base)
SELECT concat_ws('; ', CASE WHEN u > 0 THEN u || ' products have no known group' END, CASE WHEN m > 0 THEN m || ' products have no protein value and are left out' END, CASE WHEN b > 0 THEN b || ' branded composites are counted whole' END) AS caveats FROM s""")
def report_caveats(spark, sf_dir):
    products = protein.resolved(purchases(spark, sf_dir))
    counts = protein.counters(products, protein.run_rows(products)).crossJoin(products.agg(F.count_if(F.col("is_composite") & ~F.col("is_own_brand")).alias("branded_composites")))  # one row each
    return counts.select(F.array_join(reporting.caveats(counts), "; ").alias("caveats"))


@query("""WITH r AS (SELECT o_custkey % 50 AS project_id, o_orderstatus AS methodology, o_orderkey AS run_id, CASE WHEN o_orderpriority LIKE '1%' THEN NULL ELSE o_orderdate END AS finished_at FROM orders)
SELECT project_id, methodology, arg_max(run_id, (finished_at, run_id)) AS run_id FROM r WHERE finished_at IS NOT NULL GROUP BY ALL""")
def latest_runs(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("project_id"), F.col("o_orderstatus").alias("methodology"), F.col("o_orderkey").alias("run_id"), F.when(~F.col("o_orderpriority").startswith("1"), F.col("o_orderdate")).alias("finished_at"))
    return reporting.latest_finished(runs, ["project_id", "methodology"]).select("project_id", "methodology", "run_id")


@query("""SELECT n_nationkey AS project_id, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n_products, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n_runs FROM nation""")
def project_counts(spark, sf_dir):
    projects = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("project_id"))
    return reporting.counted_projects(projects, table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("project_id")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("project_id")))


@query("""SELECT count(*) AS n_rows, count(DISTINCT l_partkey) AS n_products FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#7')""")
def cascade_delete(spark, sf_dir):
    products = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), "p_brand")
    left = reporting.without_upload({"lines": table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "product_id")}, products, F.col("p_brand") == "Brand#7")
    return left["lines"].agg(F.count("*").alias("n_rows"), F.count_distinct("product_id").alias("n_products"))


@query(f"""WITH {EVENTS}, q AS (SELECT event_id AS item_id, {STATE} AS state FROM e WHERE event_type <> 'error'), a AS (SELECT user_id // 2 AS batch, event_id AS item_id FROM e),
b AS (SELECT batch, count(*) AS n FROM a GROUP BY 1)
SELECT batch, item_id, CASE WHEN n > 100 THEN 'too_many' WHEN state IS NULL THEN 'not_queued' ELSE 'not_pending' END AS error FROM a JOIN b USING (batch) LEFT JOIN q USING (item_id) WHERE n > 100 OR state IS DISTINCT FROM 'in_queue'""")
def bulk_decision_errors(spark, sf_dir):
    """The events of two users are a batch; errors aren't queued."""
    e = events(spark, sf_dir)
    states = F.element_at(F.array(*map(F.lit, ["in_queue", "reviewing", "accepted", "changed", "deferred"])), (F.col("k") % 5 + 1).cast("int"))
    queue_ = e.filter("event_type <> 'error'").select(F.col("event_id").alias("item_id"), states.alias("state"))
    return reporting.bulk_errors(e.select(F.floor(F.col("user_id") / 2).alias("batch"), F.col("event_id").alias("item_id")), queue_, bulk.MOST)


@query("""SELECT coalesce(CASE WHEN lang <> 'fr' THEN 'other_language' WHEN n_chars < 500 THEN 'too_short' WHEN source IN ('src1', 'src2') THEN 'blocked_source' END, 'candidate') AS skip_reason, count(*) AS n FROM documents GROUP BY 1""")
def language_plan_skips(spark, sf_dir):
    guards = [("other_language", F.col("lang") != "fr"), ("too_short", F.col("n_chars") < 500), ("blocked_source", F.col("source").isin("src1", "src2"))]
    return reporting.skips(table(spark, sf_dir, "documents"), guards, [("plan_disabled", False)]).groupBy(F.coalesce("skip_reason", F.lit("candidate")).alias("skip_reason")).agg(F.count("*").alias("n"))


@query(f"""WITH {VECTORS}, a AS (SELECT query_id, any_value(q_label) AS f, min(rank) FILTER (q_label = label AND rank <= 10) AS r1, min(rank) FILTER (ref_id % 4 = 0 AND rank <= 10) AS r2, max(similarity) AS s FROM r GROUP BY 1)
SELECT CASE WHEN s >= 0.9 THEN 'keep_accepted' WHEN r2 IS NULL THEN 'keep_not_found' WHEN f % 2 = 1 THEN 'keep_family_mismatch' WHEN r1 IS NULL OR r2 < r1 THEN 'switch' ELSE 'keep_not_better' END AS choice, count(*) AS n FROM a GROUP BY 1""")
def conservative_choice(spark, sf_dir):
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    near = neighbours(spark, sf_dir, 10).join(labels.withColumnsRenamed({"id": "query_id", "label": "a"}), "query_id").join(labels.withColumnsRenamed({"id": "ref_id", "label": "b"}), "ref_id")
    per = near.groupBy("query_id").agg(F.any_value("a").alias("f"), F.min(F.when(F.col("a") == F.col("b"), F.col("rank"))).alias("r1"), F.min(F.when(F.col("ref_id") % 4 == 0, F.col("rank"))).alias("r2"), F.max("similarity").alias("s"))
    return per.groupBy(reporting.conservative(F.col("r1"), F.col("r2"), F.col("f") % 2 == 0, F.col("s") >= 0.9).alias("choice")).agg(F.count("*").alias("n"))


@query(f"""WITH {BASE}, t AS (SELECT product_id, any_value(pt_group) AS g, any_value(p_size) AS s FROM base GROUP BY 1)
SELECT product_id, CASE WHEN g LIKE 'plant%' THEN s ELSE 0 END :: DOUBLE AS plant, CASE WHEN g LIKE 'plant%' THEN 0 ELSE s END :: DOUBLE AS animal FROM t WHERE g LIKE 'plant%' OR g = 'animal_core'""")
def split_proposals(spark, sf_dir):
    per = purchases(spark, sf_dir).groupBy("product_id").agg(F.any_value("pt_group").alias("g"), F.any_value("p_size").cast("double").alias("s"))
    return per.select("product_id", reporting.split_proposal(F.col("g"), F.col("s")).alias("x")).filter("x is not null").select("product_id", "x.plant", "x.animal")


@query("SELECT l_partkey AS product_id, l_suppkey % 4 AS prio, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_audit(spark, sf_dir):
    return reporting.duplicates(records(spark, sf_dir), ["product_id", "prio"])


@query("""WITH w AS (SELECT l_partkey AS product_id, arg_min(l_returnflag, (l_orderkey, l_linenumber)) AS name FROM lineitem GROUP BY 1)
SELECT CASE WHEN w.name IS NULL THEN 'no_reference' WHEN CASE WHEN p_size % 2 = 0 THEN 'R' ELSE 'A' END = w.name THEN 'up_to_date' ELSE 'would_update' END AS status, count(*) AS n FROM part LEFT JOIN w ON w.product_id = p_partkey GROUP BY 1""")
def metadata_backfill(spark, sf_dir):
    recs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_partkey").alias("record_id"), F.create_map(F.lit("name"), F.when(F.col("p_size") % 2 == 0, "R").otherwise("A")).alias("metadata"))
    want = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("product_id"), F.col("l_returnflag").alias("name"), F.lit(None).cast("string").alias("code"), F.struct("l_orderkey", "l_linenumber").alias("ord"))
    return reporting.backfill(recs, want).groupBy("status").agg(F.count("*").alias("n"))


ENRICHED = f"""{RECORDS}, ok AS (SELECT * FROM rec WHERE value IS NOT NULL AND status = 'enriched'),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY prio, created_at DESC, record_id, value) AS n FROM ok WHERE nutrient = 'protein') WHERE n = 1),
sib AS (SELECT product_id, source, arg_max(value, (created_at, value)) FILTER (nutrient = 'plant_protein') AS plant, arg_max(value, (created_at, value)) FILTER (nutrient = 'animal_protein') AS animal FROM ok GROUP BY ALL),
chosen AS (SELECT b.product_id, b.source, b.value, CASE WHEN animal IS NOT NULL THEN plant END AS plant, CASE WHEN plant IS NOT NULL THEN animal END AS animal FROM best b LEFT JOIN sib USING (product_id, source))"""


def chosen(spark, sf_dir):
    """The enrichment record of each product, with its siblings."""
    all_ = records(spark, sf_dir)
    best = enrichment.best_record(all_.filter("nutrient = 'protein'")).select("product_id", "source", "value")
    return enrichment.with_siblings(best, all_)


STATES = f"""{ENRICHED}, st AS (SELECT p_partkey, p_size > 2 AS vol, p_size > 1 AS wgt, CASE WHEN p_partkey % 9 <> 0 THEN {"CASE p_type WHEN 'ECONOMY' THEN 'plant_based_core' WHEN 'STANDARD' THEN 'plant_based_non_core' WHEN 'MEDIUM' THEN 'composite_products' WHEN 'LARGE' THEN 'animal_core' WHEN 'PROMO' THEN 'out_of_scope' ELSE 'unknown' END"} END AS g,
 p_size % 3 = 0 AS own, e.value IS NOT NULL AS enr, e.plant IS NOT NULL AS esp FROM part LEFT JOIN chosen e ON e.product_id = p_partkey),
pf AS (SELECT *, own OR enr AS prot, (own AND p_partkey % 2 = 0) OR (NOT own AND enr AND esp) AS spl, g IS NOT NULL AND vol AND wgt AND (own OR enr) AND g <> 'unknown' AS ready FROM st)"""


def readiness_products(spark, sf_dir):
    size, key = F.col("p_size"), F.col("p_partkey")
    group = F.lit("unknown")
    for kind, g in PT_GROUP.items():
        group = F.when(F.col("p_type") == kind, g).otherwise(group)
    own = size % 3 == 0
    p = table(spark, sf_dir, "part").select(
        key.alias("product_id"), F.when(size > 2, 5).alias("items_purchased"), F.when(size > 1, 0.5).otherwise(0.0).alias("weight_per_item_kg"), F.when(own, 10.0).alias("protein_pct"),
        *[F.when(own & (key % 2 == 0), 5.0).alias(f"{s}_protein_pct") for s in ("plant", "animal")], F.when(key % 9 != 0, group).alias("pt_group"),
    )
    e = chosen(spark, sf_dir).select("product_id", F.col("value").alias("e_value"), F.col("plant_protein").alias("e_plant"), F.col("animal_protein").alias("e_animal"))
    return readiness.protein_states(p.join(e, "product_id", "left"))


@query(f"""WITH {STATES} SELECT count(*) AS total_products, count(g) AS classified_products, count(*) FILTER (vol) AS products_with_volume, count(*) FILTER (wgt) AS products_with_weight, count(*) FILTER (g IS NOT NULL AND prot) AS products_with_total_protein,
 count(*) FILTER (g IS NOT NULL AND spl) AS products_with_plant_animal_split, count(*) FILTER (ready) AS products_ready_for_calculation, count(*) FILTER (g IS NOT NULL AND NOT ready AND NOT prot) AS products_missing_nutrition,
 count(*) FILTER (g IS NOT NULL AND NOT ready AND NOT (vol AND wgt)) AS products_missing_volume_or_weight, count(*) FILTER (g IS NULL) AS products_missing_classification, count(*) FILTER (g IN ('out_of_scope', 'unknown')) AS products_out_of_scope FROM pf""")
def preflight_protein(spark, sf_dir):
    return readiness.protein_preflight(readiness_products(spark, sf_dir))


@query(f"""WITH {STATES} SELECT CAST(row_number() OVER (ORDER BY p_partkey) AS INTEGER) AS rank, p_partkey AS product_id, CASE WHEN g IS NULL THEN 'missing classification' ELSE concat_ws(', ', CASE WHEN NOT vol THEN 'no volume' END, CASE WHEN NOT wgt THEN 'no weight' END,
 CASE WHEN NOT prot THEN 'no protein data' END, CASE WHEN g = 'unknown' THEN 'classification=unknown' END) END AS reasons FROM pf WHERE NOT ready ORDER BY p_partkey LIMIT 10""")
def preflight_samples(spark, sf_dir):
    found = readiness.samples(readiness_products(spark, sf_dir), F.col("product_id"))
    return found.withColumn("reasons", F.array_join("reasons", ", "))


@query("""WITH s AS (SELECT p_size > 1 AS wgt, CASE WHEN p_partkey % 9 = 0 THEN NULL WHEN p_partkey % 10 = 0 THEN 'out_of_scope' WHEN p_partkey % 11 = 0 THEN 'unknown' ELSE 'FG' || (1 + p_partkey % 7) END AS g FROM part)
SELECT count(*) AS total_products, count(g) AS classified_products, count(*) FILTER (wgt) AS products_with_volume, count(*) FILTER (wgt) AS products_with_weight, count(*) FILTER (g LIKE 'FG%' AND wgt) AS products_ready_for_calculation,
 count(*) FILTER (g IS NOT NULL AND NOT wgt) AS products_missing_volume_or_weight, count(*) FILTER (g IS NULL) AS products_missing_classification, count(*) FILTER (g = 'out_of_scope') AS products_out_of_scope FROM s""")
def preflight_food_groups(spark, sf_dir):
    key = F.col("p_partkey")
    group = F.when(key % 9 != 0, F.when(key % 10 == 0, "out_of_scope").when(key % 11 == 0, "unknown").otherwise(F.concat(F.lit("FG"), (1 + key % 7).cast("string"))))
    p = table(spark, sf_dir, "part").select(key.alias("product_id"), F.when(F.col("p_size") > 1, 0.5).otherwise(0.0).alias("weight_per_item_kg"), group.alias("food_group"))
    return readiness.food_preflight(readiness.food_states(p))


@query(f"""WITH {EVENTS}, r AS (SELECT user_id, {REASON} AS reason FROM e), u AS (SELECT p_partkey AS id, p_type FROM part),
c AS (SELECT count(*) FILTER (p_type IN ('ECONOMY', 'STANDARD', 'MEDIUM', 'LARGE', 'PROMO')) AS cat, count(*) FILTER (p_type NOT IN ('ECONOMY', 'STANDARD', 'MEDIUM', 'LARGE', 'PROMO')) AS unk, count(*) FILTER (p_type = 'PROMO') AS oos FROM u),
v AS (SELECT count(*) AS rev, count(*) FILTER (reason IN ('ai_parse_failed', 'ai_provider_error')) AS failed FROM r WHERE user_id IN (SELECT id FROM u))
SELECT cat AS categorized_total, unk AS unknown_total, oos AS out_of_scope_total, rev AS review_required_total, failed AS failed_total, greatest(0, cat - rev) AS accepted_total FROM c, v""")
def job_progress(spark, sf_dir):
    every = part_classes(spark, sf_dir)
    items = queue(spark, sf_dir).select(F.col("user_id").alias("product_id"), "reason")
    return readiness.progress(every, every.select("product_id", "pt_group"), items)


@query("""SELECT sum(o_custkey) :: BIGINT AS total_uploaded, sum(o_custkey - o_custkey % 10) :: BIGINT AS total_valid, sum(o_orderkey % 4) :: BIGINT AS total_errors, sum(o_orderkey % 3) :: BIGINT AS total_warnings, sum(o_custkey % 10) :: BIGINT AS invalid_rows FROM orders WHERE o_orderstatus = 'F'""")
def upload_totals(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    uploads = o.select(F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")).alias("total_rows"), (F.col("o_custkey") % 10).alias("rows_with_errors"), (F.col("o_orderkey") % 4).alias("error_count"), (F.col("o_orderkey") % 3).alias("warning_count"))
    return readiness.upload_totals(uploads)


@query("""WITH u AS (SELECT o_custkey AS project_id, md5(o_orderpriority) AS checksum, o_orderkey AS upload_id, o_orderdate AS created_at FROM orders), w AS (SELECT DISTINCT c_custkey AS project_id, md5('1-URGENT') AS checksum FROM customer)
SELECT project_id, arg_max(upload_id, (created_at, upload_id)) AS upload_id FROM w LEFT JOIN u USING (project_id, checksum) GROUP BY project_id""")
def same_upload(spark, sf_dir):
    uploads = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project_id"), F.md5("o_orderpriority").alias("checksum"), F.col("o_orderkey").alias("upload_id"), F.col("o_orderdate").alias("created_at"))
    wanted = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project_id"), F.md5(F.lit("1-URGENT")).alias("checksum")).distinct()
    return readiness.same_upload(uploads, wanted).select("project_id", "upload_id")


@query(f"""WITH {EVENTS}, q AS (SELECT event_id, user_id AS product_id, {REASON} AS reason, CASE WHEN event_id % 2 = 0 THEN 'protein_tracker' ELSE 'food_groups' END AS methodology FROM e),
c AS (SELECT p_partkey AS product_id, 'protein_tracker' AS methodology, p_type AS category FROM part WHERE p_partkey % 3 = 0)
SELECT event_id, product_id, p_name AS product_name, methodology, category, reason, CASE WHEN reason IN ('contradiction_detected', 'ai_parse_failed', 'ai_provider_error') THEN 'critical' WHEN reason = 'rule_collision' THEN 'high' WHEN reason = 'low_confidence' THEN 'medium' ELSE 'low' END AS priority FROM q JOIN part ON p_partkey = product_id LEFT JOIN c USING (product_id, methodology)""")
def review_list(spark, sf_dir):
    items = queue(spark, sf_dir).select("event_id", F.col("user_id").alias("product_id"), "reason", F.when(F.col("event_id") % 2 == 0, "protein_tracker").otherwise("food_groups").alias("methodology"))
    part = table(spark, sf_dir, "part")
    classes = part.filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("product_id"), F.lit("protein_tracker").alias("methodology"), F.col("p_type").alias("category"))
    found = readiness.review_list(items, part.select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name")), classes)
    return found.select("event_id", "product_id", "product_name", "methodology", "category", "reason", "priority")


@query("""SELECT p_partkey AS product_id FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')""")
def products_in_run(spark, sf_dir):
    run = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("product_id"))
    return readiness.in_run(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id")), run)


@query(f"""WITH {BASE}, w AS (SELECT product_id, any_value(food_group) AS g, any_value(subgroup) AS sg, any_value(is_composite) AS c, any_value(bucket) AS b, sum(grams) AS m FROM base GROUP BY 1),
s AS (SELECT *, CASE WHEN c THEN CASE WHEN b IN ('vegan', 'vegetarian') THEN 'positive' ELSE 'watchout' END WHEN g = 'FG1' THEN CASE WHEN sg = 'red_meat' THEN 'watchout' ELSE 'positive' END WHEN g IN ('FG4', 'FG5') THEN 'positive' WHEN g = 'FG7' THEN 'watchout' END AS side FROM w WHERE m > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY m DESC, product_id) AS rank FROM s WHERE side IS NOT NULL)
SELECT product_id, coalesce(p_name, 'Produit ' || left(CAST(product_id AS VARCHAR), 8)) AS product_name, side, m / 1000.0 AS weight_kg, CAST(rank AS INTEGER) AS rank FROM r LEFT JOIN (SELECT * FROM part WHERE p_partkey % 2 = 0) ON p_partkey = product_id WHERE rank <= 10""")
def food_contributors(spark, sf_dir):
    per = food_groups.run_rows(purchases(spark, sf_dir)).groupBy("product_id").agg(*[F.any_value(c).alias(c) for c in ("food_group", "subgroup", "is_composite", "bucket", "in_scope")], F.sum("weight_kg").alias("weight_kg"))
    names = table(spark, sf_dir, "part").filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"), F.col("p_type").alias("retailer_category"))
    return readiness.named(readiness.food_contributors(per, food_groups.ANIMAL_FG1), names).select("product_id", "product_name", "side", real("weight_kg"), "rank")


@query(f"""WITH {BASE}, s AS (SELECT pt_group AS label, sum(grams * pct) / 100000.0 AS kg FROM base WHERE pct IS NOT NULL AND pt_group NOT IN ('out_of_scope', 'unknown') GROUP BY 1),
t AS (SELECT * FROM s UNION ALL SELECT 'plant', sum(CASE WHEN label LIKE 'plant%' THEN kg WHEN label = 'composite_products' THEN kg / 2 ELSE 0 END) FROM s UNION ALL SELECT 'animal', sum(CASE WHEN label = 'animal_core' THEN kg WHEN label = 'composite_products' THEN kg / 2 ELSE 0 END) FROM s)
SELECT label, round(kg, 1) AS kg FROM t""")
def workbook_protein(spark, sf_dir):
    rows = protein.run_rows(protein.resolved(purchases(spark, sf_dir))).filter("in_scope")
    plant = F.when(F.col("pt_group").startswith("plant"), 1.0).when(F.col("pt_group") == "composite_products", 0.5).otherwise(0.0)
    kg = F.col("protein_kg").cast("double")
    return readiness.workbook_protein(rows.select("pt_group", kg.alias("total_kg"), (kg * plant).alias("plant_kg"), (kg * (1 - plant)).alias("animal_kg")))


@query(f"""WITH {STATES}, a AS (SELECT p_partkey AS product_id, g, e.value FROM pf JOIN chosen e ON e.product_id = p_partkey WHERE e.plant IS NULL AND g IN ('plant_based_core', 'plant_based_non_core', 'animal_core'))
SELECT product_id, 'plant_protein_pct' AS nutrient, CASE WHEN g LIKE 'plant%' THEN value ELSE 0 END :: DOUBLE AS value FROM a UNION ALL SELECT product_id, 'animal_protein_pct', CASE WHEN g LIKE 'plant%' THEN 0 ELSE value END :: DOUBLE FROM a""")
def assumed_split(spark, sf_dir):
    lone = readiness_products(spark, sf_dir).filter("e_value is not null and e_plant is null").select("product_id", "pt_group", F.col("e_value").alias("value"))
    return readiness.assumed_split(lone)


@query(f"""WITH {BASE}, {ENRICHED}, x AS (SELECT b.*, coalesce(b.pct, c.value) AS v, b.pct IS NULL AND c.value IS NOT NULL AS enr, b.pct IS NULL AND c.plant IS NOT NULL AND abs(c.plant + c.animal - c.value) <= 0.0001 AND b.pt_group = 'composite_products' AS spl FROM base b LEFT JOIN chosen c USING (product_id))
SELECT pt_group, count(*) AS item_count, round(sum(grams * v) / 100000.0, 4) AS protein_kg, count(*) FILTER (enr) AS enriched_count, count(*) FILTER (spl) AS rows_with_split FROM x WHERE v IS NOT NULL GROUP BY 1""")
def pt_run_with_enrichment(spark, sf_dir):
    """Missing protein comes from the chosen records, and so do splits that add up."""
    e = chosen(spark, sf_dir).select("product_id", "source", F.col("value").cast("decimal(18,10)").alias("protein_pct"), *[F.col(f"{s}_protein").cast("decimal(18,10)").alias(f"{s}_protein_pct") for s in ("plant", "animal")])
    rows = protein.run_rows(protein.resolved(purchases(spark, sf_dir), e))
    return rows.groupBy("pt_group").agg(F.count("*").alias("item_count"), F.round(F.sum("full_protein_kg").cast("double"), 4).alias("protein_kg"), F.count_if(F.col("protein_origin") != "own").alias("enriched_count"), F.count_if("used_split").alias("rows_with_split"))


@query("""WITH n AS (SELECT doc_id, list_distinct(regexp_split_to_array(lower(coalesce(lang, '') || ' ' || coalesce(source, '')), ' ')) AS a, list_distinct(regexp_split_to_array(lower(coalesce(source, '')), ' ')) AS b FROM documents)
SELECT CASE WHEN list_has_all(b, a) AND len(b) > len(a) THEN 'v2_more_specific' WHEN list_has_all(a, b) AND len(a) > len(b) THEN 'v1_more_specific' END AS specificity, count(*) AS n FROM n GROUP BY 1""")
def name_specificity(spark, sf_dir):
    both = F.lower(F.concat_ws(" ", F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))))
    words = lambda c: F.array_distinct(F.split(c, " "))
    found = readiness.specificity(words(both), words(F.lower(F.coalesce("source", F.lit("")))))
    return table(spark, sf_dir, "documents").groupBy(found.alias("specificity")).agg(F.count("*").alias("n"))


@query("""SELECT p_partkey AS product_id, p_size % 4 >= 2 AS v2_accuracy_ge_v1, p_size % 3 <= 1 AS v2_wrong_accepted_le_v1, p_partkey % 5 <> 0 AS unknown_readable_zero, p_partkey % 7 <> 0 AS high_confidence_false_positives_zero, p_size % 6 IN (0, 3) AS forbidden_rejection_100,
 p_size % 4 >= 2 AND p_size % 3 <= 1 AND p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AND p_size % 6 IN (0, 3) AS passed FROM part""")
def version_gates(spark, sf_dir):
    s, k = F.col("p_size"), F.col("p_partkey")
    m = table(spark, sf_dir, "part").select(
        k.alias("product_id"), (s % 4).alias("v2_accuracy"), F.lit(2).alias("v1_accuracy"), (s % 3).alias("v2_wrong_accepted"), F.lit(1).alias("v1_wrong_accepted"), (k % 5 == 0).cast("int").alias("v2_unknown_readable"),
        (k % 7 == 0).cast("int").alias("false_positive_count"), (s % 6).alias("forbidden_total"), F.lit(3).alias("forbidden_rejected"),
    )
    return readiness.gates(m).select("product_id", "v2_accuracy_ge_v1", "v2_wrong_accepted_le_v1", "unknown_readable_zero", "high_confidence_false_positives_zero", "forbidden_rejection_100", "passed")


@query("""WITH p AS (SELECT p_partkey, p_size, CASE WHEN p_partkey % 12 = 0 THEN 'unknown_product' WHEN p_partkey % 8 = 0 THEN 'not_object' WHEN p_partkey % 8 = 1 THEN 'missing_ingredients' WHEN p_partkey % 8 = 2 THEN 'not_list' WHEN p_partkey % 8 = 3 THEN 'empty_list'
 WHEN p_size % 7 = 0 THEN 'not_enabled' WHEN p_size % 5 = 0 THEN 'unclassified' WHEN p_size % 3 = 0 THEN 'not_composite' END AS error FROM part)
SELECT CAST(p_partkey AS VARCHAR) AS external_product_id, error, CASE WHEN p_partkey % 8 >= 4 THEN 2 ELSE 0 END AS ingredient_count, CASE WHEN error IS NULL THEN 0.015 ELSE 0 END :: DOUBLE AS attributed_kg, error IS NULL AND p_partkey % 2 = 0 AND p_size < 15 AS overweight,
 CASE WHEN error IS NULL AND p_partkey % 2 = 0 THEN greatest(0, p_size - 15) / 1000.0 END :: DOUBLE AS residual_kg FROM p""")
def companion_checks(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size")
    part = table(spark, sf_dir, "part")
    good = '{"ingredients":[{"food_group":"FG1","subgroup":"legumes","ingredient_weight_kg_per_item":"0.010"},{"food_group":"FG2","ingredient_weight_kg_per_item":"0.005"}]}'
    entry = F.when(key % 8 == 0, "7").when(key % 8 == 1, '{"note":"x"}').when(key % 8 == 2, '{"ingredients":"x"}').when(key % 8 == 3, '{"ingredients":[]}').otherwise(good)
    companions = part.select(F.concat(F.lit('{"'), key.cast("string"), F.lit('":'), entry, F.lit("}")).alias("json"))
    products = part.filter(key % 12 != 0).select(key.cast("string").alias("external_product_id"), (size / 1000).cast("decimal(18,8)").alias("weight_per_item_kg"), (key % 2 == 0).alias("is_own_brand"), (size % 7 != 0).alias("enabled"), F.when(size % 5 != 0, "FG1").alias("food_group"), (size % 3 != 0).alias("is_composite"))
    found = readiness.companion_checks(companions, products)
    return found.select("external_product_id", "error", "ingredient_count", real("attributed_kg"), "overweight", real("residual_kg"))


PART_NAMES = """c AS (
  SELECT p_partkey AS right_id, CASE WHEN p_size <= 25 THEN 'a' ELSE 'b' END AS source, p_name || CASE p_size % 4 WHEN 0 THEN ' with ' || lower(p_type) WHEN 1 THEN ' ' || lower(p_type) ELSE '' END AS name FROM part),
cw AS (SELECT *, list_distinct(list_filter(string_split(name, ' '), lambda x: length(x) >= 3 AND x <> 'with')) AS w, contains(name, ' with ') AS dish FROM c),
q AS (SELECT p_partkey AS left_id, lower(p_name || ' ' || p_type) AS name FROM part),
qw AS (
  SELECT left_id, list_distinct(string_split(name || CASE WHEN contains(name, 'bolt') THEN ' rod anvil' ELSE '' END, ' ')) AS w,
         CASE WHEN contains(name, 'red widget') THEN 'red widget' WHEN contains(name, ' ring') THEN 'ring' WHEN contains(name, ' gear') THEN 'gear' ELSE '' END AS head FROM q)"""


@query(f"""WITH {PART_NAMES},
p AS (
  SELECT left_id, source, right_id, name, head, len(list_intersect(qw.w, cw.w)) AS overlap FROM qw, cw
  WHERE head = '' OR (head = 'red widget' AND list_contains(cw.w, 'widget')) OR (head = 'ring' AND list_contains(cw.w, 'ring') AND NOT dish) OR (head = 'gear' AND list_contains(cw.w, 'gizmo')))
SELECT left_id, source, right_id, CAST(overlap AS BIGINT) AS overlap, CAST(overlap + CASE WHEN head = '' THEN 0 ELSE 5 END AS BIGINT) AS score, CAST(row_number() OVER (PARTITION BY left_id, source ORDER BY overlap DESC, name, right_id) AS INTEGER) AS rank
FROM p WHERE overlap > 0 QUALIFY rank <= 10""")
def head_shortlist(spark, sf_dir):
    heads = [("red widget", "prepared_meal", ["widget"]), ("ring", "egg", ["ring", "rings"]), ("gear", "meat_red", ["gizmo"])]
    part, kind = dealt(table(spark, sf_dir, "part")), F.lower("p_type")
    products = part.select(F.col("p_partkey").alias("left_id"), F.concat_ws(" ", "p_name", "p_type").alias("product_name"))
    name = F.concat("p_name", F.when(F.col("p_size") % 4 == 0, F.concat(F.lit(" with "), kind)).when(F.col("p_size") % 4 == 1, F.concat(F.lit(" "), kind)).otherwise(""))
    references = part.select(F.col("p_partkey").alias("right_id"), F.when(F.col("p_size") <= 25, "a").otherwise("b").alias("source"), name.alias("name"))
    asked = matching.asked_words(products, [h[:2] for h in heads], {"bolt": ["rod", "anvil"]})
    found = matching.shortlist(asked, matching.with_heads(references, heads), 10)
    return found.select("left_id", "source", "right_id", F.col("overlap").cast("long"), F.col("score").cast("long"), "rank")


FAMILY = "CASE WHEN regexp_matches({0}, 'ring|gear|anvil') THEN 'round' WHEN regexp_matches({0}, 'widget|gizmo') THEN 'flat' ELSE 'other' END"


@query(f"""WITH a AS (SELECT p_partkey AS code, p_name AS name, CASE WHEN p_size % 9 <> 0 THEN p_size * 1.0 END AS value, {FAMILY.format("p_name")} AS family FROM part WHERE regexp_matches(p_name, 'ring|gear|widget')),
b AS (SELECT p_name AS name, arg_max(p_partkey, p_partkey) AS code, arg_max(CASE WHEN p_size % 9 <> 0 THEN p_size * 1.0 ELSE -1 END, p_partkey) AS value FROM part WHERE regexp_matches(p_name, 'bolt|rod') GROUP BY 1),
p AS (SELECT p_partkey AS product_id, p_name || CASE WHEN p_size % 2 = 0 THEN '' ELSE ' ' || lower(p_type) END AS name, p_size % 10 <> 0 AS in_scope, CASE WHEN p_size % 11 = 0 THEN 1.0 END AS own_value, {FAMILY.format("p_name")} AS family, p_type,
       CASE WHEN contains(p_name, 'bolt') THEN 'bolt' WHEN contains(p_name, ' rod') THEN 'rod' WHEN contains(p_name, 'plate') THEN 'plate' ELSE '' END AS head FROM part),
ea AS (SELECT name, arg_max(code, code) AS code, arg_max(coalesce(value, -1), code) AS value, arg_max(family, code) AS family FROM a GROUP BY 1),
x AS (SELECT p.*, ea.code AS e_code, ea.value AS e_value, ea.family AS e_family FROM p LEFT JOIN ea ON ea.name = p.name AND ea.value >= 0),
names AS (SELECT name, min(code) AS code, arg_min(coalesce(value, -1), code) AS value, any_value(family) AS family FROM a GROUP BY 1),
f AS (
  SELECT product_id, arg_min({{'c': n.code, 'v': n.value, 'f': n.family, 'o': o}}, (-o, n.code)) AS hit
  FROM (SELECT product_id, n.code, n.value, n.family, len(list_intersect(string_split(x.name, ' '), string_split(n.name, ' '))) AS o FROM x, names n WHERE e_code IS NULL AND head = '') n WHERE o > 0 GROUP BY 1),
g AS (
  SELECT x.*, CASE WHEN hit.v >= 0 THEN hit.c END AS f_code, hit.v AS f_value, hit.f AS f_family, hit.o AS o, b.code AS b_code, b.value AS b_value
  FROM x LEFT JOIN f USING (product_id) LEFT JOIN b ON b.name = x.name AND b.value >= 0),
s AS (SELECT *, CASE WHEN NOT in_scope OR own_value IS NOT NULL THEN 0 WHEN e_code IS NOT NULL THEN 1 WHEN f_code IS NOT NULL THEN 2 WHEN b_code IS NOT NULL THEN 3 WHEN p_type IN ('PROMO', 'SMALL') THEN 4 ELSE 5 END AS stage FROM g),
t AS (SELECT *, CASE stage WHEN 1 THEN family = e_family OR (family = 'flat' AND e_family = 'round') WHEN 2 THEN family = f_family OR (family = 'flat' AND f_family = 'round') END AS fits FROM s)
SELECT product_id, stage, CASE stage WHEN 0 THEN CASE WHEN NOT in_scope THEN 'skipped_out_of_scope' ELSE 'skipped_own_value' END WHEN 3 THEN 'second_matched' WHEN 4 THEN 'average' WHEN 5 THEN 'no_match' ELSE CASE WHEN fits THEN 'first_matched' ELSE 'no_match' END END AS outcome,
       CASE WHEN fits = false THEN 'family_mismatch' ELSE [NULL, 'exact', 'fuzzy', 'exact', 'group_average', NULL][stage + 1] END AS match_type,
       CASE WHEN fits THEN CAST(CASE stage WHEN 1 THEN e_code ELSE f_code END AS VARCHAR) WHEN stage = 3 THEN CAST(b_code AS VARCHAR) END AS ref_code,
       CAST(CASE WHEN fits THEN CASE stage WHEN 1 THEN e_value ELSE f_value END WHEN stage = 3 THEN b_value WHEN stage = 4 THEN CASE p_type WHEN 'PROMO' THEN 12 ELSE 10 END END AS DOUBLE) AS value,
       CAST(CASE WHEN fits THEN CASE stage WHEN 1 THEN 0.85 ELSE CASE WHEN o >= 3 THEN 0.82 WHEN o = 2 THEN 0.72 ELSE 0.55 END END WHEN stage = 3 THEN 0.80 WHEN stage = 4 THEN CASE p_type WHEN 'PROMO' THEN 0.6 ELSE 0.5 END END AS DOUBLE) AS confidence
FROM t""")
def enrichment_cascade_chained(spark, sf_dir):
    """From raw products and two reference tables: exact name, best by words, exact in the second, average of the group."""
    part = table(spark, sf_dir, "part")
    family = F.when(F.col("p_name").rlike("ring|gear|anvil"), "round").when(F.col("p_name").rlike("widget|gizmo"), "flat").otherwise("other")
    size = F.col("p_size")
    references = part.select(
        F.col("p_partkey").alias("code"), F.col("p_name").alias("name_en"), F.lit(None).cast("string").alias("name_nl"), F.when(size % 9 != 0, size.cast("double")).alias("value"), F.col("p_partkey").alias("ord"), family.alias("family")
    )
    products = part.select(
        F.col("p_partkey").alias("product_id"), F.concat("p_name", F.when(size % 2 == 0, "").otherwise(F.concat(F.lit(" "), F.lower("p_type")))).alias("product_name"),
        (size % 10 != 0).alias("in_scope"), F.when(size % 11 == 0, 1.0).alias("own_value"), family.alias("family"), F.col("p_type").alias("pt_group"),
    )
    heads = [(x, "meat_red", [x]) for x in ("bolt", "rod", "plate")]
    averages = spark.createDataFrame([("PROMO", 12.0, 0.6), ("SMALL", 10.0, 0.5)], "pt_group string, value double, confidence double")
    fits = matching.compatible(F.col("family"), F.col("ref_family"), [("flat", "round")])
    return enrichment.cascaded(products, references.filter(F.col("name_en").rlike("ring|gear|widget")), references.filter(F.col("name_en").rlike("bolt|rod")), fits, heads, {}, averages)


@query("""WITH d AS (SELECT p_partkey AS r, p_partkey % 8 AS n, p_size AS s, ['Grocery/Ambient', 'frais  & Traiteur', 'Épicerie sèche', 'shelf-stable', 'Surgelés', 'garden'][p_size % 6 + 1] AS channel FROM part)
SELECT r AS row_number, CASE p.s % 6 WHEN 1 THEN 'fresh' WHEN 4 THEN 'frozen' WHEN 5 THEN NULL ELSE 'grocery_ambient' END AS retail_channel,
       CASE WHEN n = 0 OR n = 1 OR (n = 2 AND s % 5 <> 0) OR (n = 4 AND s % 5 <> 0) THEN round(CASE n WHEN 0 THEN s WHEN 1 THEN s WHEN 2 THEN s / (1 + s % 5 / 10.0) ELSE s * 100.0 / (s % 5 * 50) END, 4) END AS protein_pct,
       concat_ws(',', CASE n WHEN 2 THEN CASE WHEN s % 5 = 0 THEN 'missing_density' END WHEN 3 THEN 'missing_density' WHEN 4 THEN CASE WHEN s % 5 = 0 THEN 'missing_serving_g' END WHEN 5 THEN 'mixed_protein_inputs' WHEN 6 THEN 'energy_not_protein' END,
       CASE WHEN p.s % 6 = 5 THEN 'invalid_enum' END) AS codes FROM d p""")
def ingest_protein_inputs(spark, sf_dir):
    """Every way to give protein, and channels as files write them."""
    size, n, text_ = F.col("p_size"), F.col("p_partkey") % 8, F.col("p_size").cast("string")
    names = F.array(*map(F.lit, ["Grocery/Ambient", "frais  & Traiteur", "Épicerie sèche", "shelf-stable", "Surgelés", "garden"]))
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("row_number"), F.col("p_name").alias("product_name"), F.lit("x").alias("external_product_id"), F.element_at(names, (size % 6 + 1).cast("int")).alias("retail_channel"),
        F.when(n.isin(0, 5), text_).alias("protein_pct"), F.when(n.isin(1, 5), text_).alias("protein_g_per_100g"), F.when(n.isin(2, 3), text_).alias("protein_g_per_100ml"),
        F.when((n == 2) & (size % 5 != 0), (1 + size % 5 / 10).cast("string")).alias("density_g_per_ml"), F.when(n == 4, text_).alias("protein_g_per_serving"),
        F.when((n == 4) & (size % 5 != 0), (size % 5 * 50).cast("string")).alias("serving_g"), F.when(n == 6, text_).alias("protein_kj"),
    )
    return ingest.parse(rows).select("row_number", "retail_channel", real("protein_pct", 4), F.array_join(F.transform("errors", lambda e: e["code"]), ",").alias("codes"))


@query(f"""WITH {EVENTS} SELECT event_id, CASE WHEN event_id % 9 IN (3, 8) THEN CASE event_id % 9 WHEN 3 THEN 'sliced' ELSE 'partial' END WHEN event_id % 9 = 4 THEN 'repaired' ELSE 'strict' END AS how,
 CASE WHEN event_id % 9 = 8 THEN 1 ELSE 2 END AS n_rows, CAST(event_id AS VARCHAR) || CASE WHEN event_id % 9 = 8 THEN '' ELSE ',' || (event_id + 1) END AS ids, event_type AS pt_group, round(k / 1000.0, 4) AS confidence FROM e""")
def json_salvage(spark, sf_dir):
    """Two rows for each event, as an answer that is damaged in nine ways."""
    from granary.operators import salvage

    e = events(spark, sf_dir)
    row = lambda i, end="}": F.concat(F.lit('{"id": "'), i.cast("string"), F.lit('", "pt_group": "'), F.col("event_type"), F.lit('", "confidence": '), (F.col("k") / 1000).cast("string"), F.lit(end))
    one, two, n = row(F.col("event_id")), row(F.col("event_id") + 1), F.col("event_id") % 9
    listed = F.concat(F.lit("["), one, F.lit(", "), two, F.lit("]"))
    clean = F.concat(F.lit('{"note": "a", "results": '), listed, F.lit("}"))
    payload = (
        F.when(n == 1, F.concat(F.lit("```json\n"), clean, F.lit("\n```"))).when(n == 2, F.concat(F.lit("﻿​"), F.replace(clean, F.lit('"id"'), F.lit('"‍id"'))))
        .when(n == 3, F.concat(F.lit("Here it is: "), clean, F.lit(" I hope it helps."))).when(n == 4, F.regexp_replace(F.replace(clean, F.lit("}, {"), F.lit("} {")), '", "pt_group', '" "pt_group')).when(n == 5, listed)
        .when(n == 6, F.replace(clean, F.lit("results"), F.lit("items"))).when(n == 7, F.replace(clean, F.lit("results"), F.lit("other"))).when(n == 8, F.concat(F.lit('{"results": ['), one, F.lit(", "), row(F.col("event_id") + 1, ""))).otherwise(clean)
    )
    found = salvage.salvaged(e.select("event_id", payload.alias("payload")), "payload")
    read = found.select("event_id", "how", F.transform("rows", lambda r: salvage.fields(r, {"id": "string", "pt_group": "string", "confidence": "double"})).alias("rows"))
    return read.select("event_id", "how", F.size("rows").alias("n_rows"), F.array_join("rows.id", ",").alias("ids"), F.col("rows")[0]["pt_group"].alias("pt_group"), F.round(F.col("rows")[0]["confidence"], 4).alias("confidence"))


@query(f"""WITH {EVENTS}, h AS (SELECT user_id, event_type, k, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('week', ts) DESC, event_id DESC) AS n FROM e WHERE date_trunc('week', ts) <= TIMESTAMP '2024-01-15')
SELECT user_id, event_type, k FROM h WHERE n = 1 AND event_type <> 'error'""")
def classification_as_of(spark, sf_dir):
    """What was known of each user in the third week, of a table that gets a version each week; an error takes a user out."""
    path, e = shared_folder(spark), events(spark, sf_dir).withColumn("week", F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd"))
    e = materialize(e, ["week"])
    for week in sorted(r.week for r in e.select("week").distinct().collect()):  # five or six
        newest = e.filter(F.col("week") == week).groupBy("user_id").agg(F.max_by(F.struct("event_type", "k"), "event_id").alias("x"))
        history.append(newest.select("user_id", "x.event_type", "x.k", (F.col("x.event_type") == "error").alias("gone")), path, f"w{week}", f"{week} 00:00:00")
    rows = history.read(spark, path, "user_id long, event_type string, k long, gone boolean", "2024-01-15 00:00:00")
    return history.latest(rows, ["user_id"], "gone").select("user_id", "event_type", "k")


@query("""WITH p AS (SELECT p_partkey AS product_id, CASE WHEN p_size % 13 = 0 THEN NULL WHEN p_size % 7 = 0 THEN 'n/a' ELSE CAST(p_size AS VARCHAR) END AS value, CASE p_partkey % 5 WHEN 0 THEN 'manual' WHEN 1 THEN 'v2' WHEN 2 THEN 'v1' END AS kind, p_size % 2 = 0 AS has FROM part),
s AS (SELECT product_id, CASE WHEN value IS NULL OR value = 'n/a' THEN 'error' WHEN kind = 'manual' THEN 'skipped_existing_manual' WHEN kind = 'v2' THEN 'skipped_existing_v2' WHEN kind = 'v1' AND has THEN 'skipped_existing_v1' ELSE 'written' END AS status, value FROM p)
SELECT product_id, status, CASE WHEN status = 'error' THEN 'invalid_value' END AS detail, CASE WHEN status = 'written' THEN CAST(value AS DOUBLE) END AS stored FROM s""")
def plan_apply(spark, sf_dir):
    """A plan over all parts, applied to what they have, tried first, and once more after it was applied."""
    part, path = table(spark, sf_dir, "part"), shared_folder(spark)
    n = F.col("p_partkey") % 5
    kinds = F.when(n == 0, "manual").when(n == 1, "v2").when(n == 2, "v1")
    had = part.select(F.col("p_partkey").alias("product_id"), F.lit("protein_pct").alias("nutrient"), kinds.alias("kind"), F.when(F.col("p_size") % 2 == 0, 1.0).alias("value")).filter("kind is not null")
    history.append(had, path, "before", "2024-01-01 00:00:00")
    plan = part.select(F.col("p_partkey").alias("product_id"), F.when(F.col("p_size") % 13 == 0, None).when(F.col("p_size") % 7 == 0, "n/a").otherwise(F.col("p_size").cast("string")).alias("value"))
    bulk.apply_plan(plan, path, "plan", "2024-01-02 00:00:00", write=False)
    bulk.apply_plan(plan, path, "plan", "2024-01-02 00:00:00", write=True)
    done = bulk.apply_plan(plan, path, "plan", "2024-01-02 00:00:00", write=True)
    stored = history.read(spark, path, bulk.RECORDS).filter("version = 'plan'").select("product_id", F.col("value").alias("stored"))
    return done.join(stored, "product_id", "left").select("product_id", "status", "detail", "stored")


@query("""WITH p AS (SELECT p_partkey AS id, 'Name: ' || p_name || chr(10) || 'Retailer category: ' || p_type AS text FROM part)
SELECT count(*) AS n_rows, count(DISTINCT text) AS n_texts, (SELECT count(DISTINCT text) FROM p WHERE id % 2 = 0) AS first_embedded, count(DISTINCT text) - (SELECT count(DISTINCT text) FROM p WHERE id % 2 = 0) AS then_embedded, CAST(0 AS BIGINT) AS last_embedded, CAST(count(*) AS DOUBLE) AS unit_vectors FROM p""")
def vector_index_cache(spark, sf_dir):
    """Half of the parts are indexed, then all, then all again: only new texts are embedded."""
    part, path = table(spark, sf_dir, "part"), shared_folder(spark)
    products = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("product_name"), F.col("p_type").alias("retailer_category"))
    rows = products.select("id", vector_index.descriptor_text(products).alias("text"))
    runs = [vector_index.build(x, path, v, "2024-01-01 00:00:00") for x, v in ((rows.filter("id % 2 = 0"), "a"), (rows, "b"), (rows, "c"))]
    counts = [n for _, n in runs]
    length = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    return runs[2][0].agg(F.count("*").alias("n_rows"), F.count_distinct("key").alias("n_texts"), F.round(F.sum(length), 3).alias("unit_vectors")).select(
        "n_rows", "n_texts", *[F.lit(n["embedded"]).cast("long").alias(c) for n, c in zip(counts, ("first_embedded", "then_embedded", "last_embedded"))], "unit_vectors"
    )


NESTED = [
    {"id": "n1", "priority": 3, "category": {"group": "round", "own": True}, "when": {"all_of": [{"any_of": [{"name_or_category_contains": ["ring", "gear"]}, {"brand_in": ["Brand#9"]}]}, {"all_of": [{"name_or_category_contains": "re"}, {"any_of": [{"labels_contains": ["Big"]}, {"brand_in": ["brand#1", "brand#3"]}]}]}]}},
    {"id": "n2", "priority": 1, "category": {"own": True, "group": "round"}, "when": {"labels_contains": ["big"]}},
    {"id": "n3", "priority": 2, "category": {"group": "round", "own": False}, "when": {"ingredients_contains": ["steel rod"]}},
]


@query("""WITH h AS (SELECT p_partkey AS product_id, lower(p_name || ' ' || p_type || ' ') AS t, lower(p_brand) AS b, p_size > 40 AS big, contains(p_name || ' of steel ' || split_part(p_name, ' ', 2), 'steel rod') AS rod FROM part),
f AS (SELECT product_id, (contains(t, 'ring') OR contains(t, 'gear') OR b = 'brand#9') AND contains(t, 're') AND (big OR b IN ('brand#1', 'brand#3')) AS n1, big AS n2, rod AS n3 FROM h)
SELECT product_id, CASE WHEN NOT n1 AND NOT n2 AND NOT n3 THEN 'pass_through' WHEN n3 AND (n1 OR n2) THEN 'collision' ELSE 'matched' END AS verdict,
       CASE WHEN n3 AND NOT (n1 OR n2) THEN '{"group": "round", "own": false}' WHEN NOT n3 AND (n1 OR n2) THEN '{"group": "round", "own": true}' END AS category,
       concat_ws(',', CASE WHEN n2 THEN 'n2' END, CASE WHEN n3 THEN 'n3' END, CASE WHEN n1 THEN 'n1' END) AS rule_ids FROM f""")
def rule_table_verdicts(spark, sf_dir):
    """Nested rules and categories with fields, from tables."""
    noun = F.element_at(F.split("product_name", " "), 2)
    rows = part_products(spark, sf_dir).withColumn("labels", F.when(F.col("p_size") > 40, F.array(F.lit("big"))).otherwise(F.array().cast("array<string>"))).withColumn("ingredients_text", F.concat("product_name", F.lit(" of steel "), noun))
    return rule_tables.verdicts(rows, NESTED).select("product_id", "verdict", "category", "rule_ids")


@query("""WITH s AS (SELECT p_brand AS upload, p_partkey AS id, p_name AS name, CAST(substr(p_brand, 7) AS INTEGER) AS n FROM part),
f AS (SELECT upload, n, max(CASE WHEN n % 4 = 2 AND contains(name, 'ring') THEN 1 ELSE 0 END) AS renamed FROM s GROUP BY ALL)
SELECT upload, upload AS catalogue, CASE WHEN renamed = 1 THEN 'ids' ELSE 'lines' END AS how FROM f WHERE n % 4 IN (0, 2)""")
def catalogue_fingerprints(spark, sf_dir):
    """The parts of a brand as uploads: as they are, with a line twice, with other names, with a line more."""
    part = table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.substring("p_brand", 7, 3).cast("int").alias("n"))
    name = F.when((F.col("n") % 4 == 2) & F.col("name").contains("ring"), F.lit("another")).otherwise(F.upper("name"))
    lines = part.select(F.col("p_brand").alias("upload"), "id", name.alias("name"), "n")
    more = lines.filter("n % 4 = 1").unionByName(lines.filter("n % 4 = 3").withColumn("id", -F.col("id") - 1))
    return fingerprint.recognised(lines.unionByName(more).select("upload", "id", "name"), part.select(F.col("p_brand").alias("catalogue"), "id", "name"))


RUN = {"run_id": "r1", "methodology": "protein_tracker", "methodology_version": "1.0", "methodology_source_edition": "2024", "taxonomy_version": "t1", "rules_version": "v1", "reporting_period_label": "FY, 2024"}


def export_sides(spark, sf_dir):
    """Masters of all parts, and classifications of six in seven."""
    part = table(spark, sf_dir, "part")
    key, size = F.col("p_partkey"), F.col("p_size")
    channel = F.when(size % 4 == 0, "fresh").when(size % 4 == 1, "frozen").when(size % 4 == 2, "grocery_ambient")
    masters = part.select(key.alias("product_id"), F.concat(F.lit("E"), key).alias("external_product_id"), F.concat("p_name", F.when(size % 3 == 0, ', "new"').otherwise("")).alias("product_name"), F.when(size % 2 == 0, F.col("p_brand")).alias("brand"), (size % 2 == 0).alias("is_own_brand"), channel.alias("retail_channel"))
    kind = size % 3
    classified = part.filter(size % 7 != 0).select(
        key.alias("product_id"), F.when(kind == 0, "deterministic").when(kind == 1, "ai").otherwise("manual_review").alias("classification_source"), F.when(kind != 1, "1").otherwise("0.8").cast("decimal(18,8)").alias("classification_confidence"),
        F.when(kind == 0, F.concat(F.lit("r"), size)).alias("classification_rule_id"), F.when(kind == 1, "m1").alias("classification_ai_model"), F.when(kind == 2, F.concat(F.lit("u"), size)).alias("classification_reviewer_user_id"),
    )
    return masters, classified


SIDES_SQL = ''''E' || product_id || ',' || CASE WHEN p_size % 3 = 0 THEN '"' || p_name || ', ""new"""' ELSE p_name END || ',' || CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END'''
CLASSIFIED_SQL = """CASE WHEN p_size % 7 = 0 THEN ',,,,' ELSE CASE p_size % 3 WHEN 0 THEN 'deterministic,1.00000000,r' || p_size || ',,' WHEN 1 THEN 'ai,0.80000000,,m1,' ELSE 'manual_review,1.00000000,,,u' || p_size END END"""


@query(f"""WITH {BASE} SELECT l_orderkey, l_linenumber, 'r1,protein_tracker,1.0,2024,t1,v1,"FY, 2024",' || product_id || ',' || {SIDES_SQL} || ',' || pt_group || ',' || printf('%.8f', p_size / 1000.0) || ',' || printf('%.8f', grams / p_size) || ',' || printf('%.8f', grams / 1000.0)
 || ',' || printf('%.8f', pct * 1.0) || ',' || CASE WHEN product_id % 2 = 0 THEN 'label' ELSE 'reference_db' END || ',' || CASE WHEN pt_group IN ('out_of_scope', 'unknown') THEN '0.00000000' ELSE printf('%.8f', grams * pct / 100000.0) END || ',false,,,' || {CLASSIFIED_SQL} AS line FROM base WHERE pct IS NOT NULL""")
def export_pt_csv(spark, sf_dir):
    """The line of each row of the run, as the file holds it."""
    rows = protein.run_rows(protein.resolved(purchases(spark, sf_dir))).withColumnRenamed("used_split", "used_per_product_split")
    export = run_exports.csv_lines(rows, run_exports.PT_COLUMNS, RUN, *export_sides(spark, sf_dir), keep=["l_orderkey", "l_linenumber"])
    return export.select(F.col("l_orderkey").cast("long"), F.col("l_linenumber").cast("int"), "line")


@query(f"""WITH {BASE} SELECT l_orderkey, l_linenumber, 'r1,protein_tracker,1.0,2024,t1,v1,"FY, 2024",' || product_id || ',' || {SIDES_SQL} || ',' || CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END || ',' || CASE p_size % 4 WHEN 0 THEN 'fresh' WHEN 1 THEN 'frozen' WHEN 2 THEN 'grocery_ambient' ELSE '' END
 || ',' || food_group || ',' || coalesce(subgroup, '') || ',' || CASE WHEN is_composite THEN 'true' ELSE 'false' END || ',' || bucket || ',' || printf('%.8f', p_size / 1000.0) || ',' || printf('%.8f', grams / p_size) || ',' || printf('%.8f', grams / 1000.0)
 || ',' || CASE WHEN food_group = 'FG2' THEN printf('%.8f', grams * CASE WHEN subgroup = 'cheese' THEN 10 ELSE 1 END / 1000.0) ELSE '' END
 || ',' || CASE WHEN is_composite THEN '"[{{""food_group"":""FG1"",""subgroup"":""legumes"",""ingredient_weight_kg_per_item"":""0.01000000""}},{{""food_group"":""FG2"",""subgroup"":""cheese"",""ingredient_weight_kg_per_item"":""0.00500000""}}]"' ELSE '' END || ',' || {CLASSIFIED_SQL} AS line FROM base""")
def export_wwf_csv(spark, sf_dir):
    names = {"food_group": "wwf_food_group", "subgroup": "wwf_subgroup", "is_composite": "wwf_is_composite", "bucket": "wwf_composite_step1_bucket", "weight_kg_dairy": "weight_kg_dairy_equiv"}
    rows = food_groups.run_rows(purchases(spark, sf_dir)).withColumnsRenamed(names)
    export = run_exports.csv_lines(rows, run_exports.WWF_COLUMNS, RUN, *export_sides(spark, sf_dir), run_exports.ingredients_json(step2(spark, sf_dir)), keep=["l_orderkey", "l_linenumber"])
    return export.select(F.col("l_orderkey").cast("long"), F.col("l_linenumber").cast("int"), "line")


@query("""WITH i AS (SELECT p_partkey AS id, place, p_size % 9 AS n, p_size FROM part, (VALUES (0), (1)) t(place)),
c AS (SELECT id, place, CASE WHEN n = 0 THEN 'FG3' WHEN n = 1 THEN 'FG7' WHEN n = 2 THEN 'FGx' WHEN n = 3 THEN NULL WHEN n = 4 THEN 'FG1' WHEN n = 5 THEN 'FG5' ELSE 'FG2' END AS g, CASE WHEN n = 5 THEN 'rye' WHEN n >= 6 THEN 'cheese' END AS s, CASE n WHEN 6 THEN '0' WHEN 7 THEN 'x' ELSE '0.01' END AS w, n FROM i)
SELECT CAST(id AS VARCHAR) AS external_product_id, place, CASE n WHEN 1 THEN 'food_group' WHEN 2 THEN 'food_group' WHEN 3 THEN 'food_group' WHEN 4 THEN 'subgroup' WHEN 5 THEN 'subgroup' WHEN 6 THEN 'ingredient_weight_kg_per_item' WHEN 7 THEN 'ingredient_weight_kg_per_item' END AS field,
       CASE n WHEN 1 THEN 'not_decomposed' WHEN 2 THEN 'invalid_enum' WHEN 3 THEN 'required' WHEN 4 THEN 'required' WHEN 5 THEN 'invalid_enum' WHEN 6 THEN 'non_positive' WHEN 7 THEN 'invalid_type' END AS code,
       concat_ws(',', CASE WHEN n IN (0, 8) AND place = 1 THEN 'duplicate' END, CASE WHEN n = 0 THEN 'fg3_without_subgroup' END) AS warnings FROM c""")
def ingredient_errors(spark, sf_dir):
    """A companion for each part, with the same ingredient twice."""
    n = F.col("p_size") % 9
    group = F.when(n == 0, "FG3").when(n == 1, "FG7").when(n == 2, "FGx").when(n == 3, None).when(n == 4, "FG1").when(n == 5, "FG5").otherwise("FG2")
    item = F.struct(group.alias("food_group"), F.when(n == 5, "rye").when(n >= 6, "cheese").alias("subgroup"), F.when(n == 6, "0").when(n == 7, "x").otherwise("0.01").alias("ingredient_weight_kg_per_item"))
    made = table(spark, sf_dir, "part").select(F.to_json(F.create_map(F.col("p_partkey").cast("string"), F.struct(F.array(item, item).alias("ingredients")))).alias("json"))
    return ingredients.ingredient_checks(ingredients.items_of(made)).select("external_product_id", "place", "field", "code", F.array_join("warnings", ",").alias("warnings"))


PLAN = """p AS (SELECT p_partkey AS product_id, ['food', 'food', 'pet', 'non_food'][p_size % 4 + 1] AS policy, ['would_enrich', 'skip_state_mismatch', 'skip_proxy_too_broad', 'route_to_review', 'skip_no_match', 'skip_no_nutrition_value'][p_partkey % 6 + 1] AS act,
 CASE WHEN p_size % 3 = 0 THEN 'a generic snack proxy' ELSE 'low' END AS reason, ['auto_accept', 'review', 'no_match'][p_size % 3 + 1] AS outcome, p_size / 50.0 AS confidence, p_size % 2 = 0 AS listed FROM part),
s AS (SELECT *, CASE WHEN policy = 'pet' THEN 'reject_policy_excluded' WHEN policy = 'non_food' THEN 'reject_non_food' WHEN act = 'would_enrich' THEN 'approve_auto_candidate' WHEN act = 'skip_state_mismatch' THEN 'review_state_mismatch'
 WHEN act = 'skip_proxy_too_broad' THEN 'review_proxy_too_broad' WHEN act = 'route_to_review' AND reason LIKE '%snack%' THEN 'review_generic_proxy' WHEN act = 'skip_no_match' AND listed THEN 'review_no_match' ELSE 'needs_manual_search' END AS a FROM p)"""


def nutrition_plan(spark, sf_dir):
    size, key = F.col("p_size"), F.col("p_partkey")
    pick = lambda c, *values: F.element_at(F.array(*map(F.lit, values)), (c % len(values) + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        key.alias("product_id"), pick(size, "food", "food", "pet", "non_food").alias("policy"), pick(key, "would_enrich", "skip_state_mismatch", "skip_proxy_too_broad", "route_to_review", "skip_no_match", "skip_no_nutrition_value").alias("safety_action"),
        F.when(size % 3 == 0, "a generic snack proxy").otherwise("low").alias("safety_reason"), pick(size, "auto_accept", "review", "no_match").alias("matcher_outcome"), (size / 50).alias("confidence"), (size % 2 == 0).alias("has_candidates"),
    )


@query(f"""WITH {PLAN} SELECT product_id, a AS suggested_action,
 CASE WHEN policy <> 'food' THEN CASE WHEN outcome <> 'no_match' THEN 'P0' ELSE 'P3' END WHEN a = 'approve_auto_candidate' THEN CASE WHEN confidence >= 0.97 THEN 'P2' ELSE 'P1' END WHEN a IN ('review_no_match', 'needs_manual_search') THEN CASE WHEN listed THEN 'P1' ELSE 'P2' END ELSE 'P1' END AS review_priority,
 CASE WHEN a LIKE 'reject%' THEN 'non_food_policy' WHEN a = 'approve_auto_candidate' THEN 'auto_ready' WHEN a = 'review_state_mismatch' THEN 'state_mismatch' WHEN a = 'review_proxy_too_broad' THEN 'proxy_too_broad' WHEN a = 'review_generic_proxy' THEN 'needs_review'
      WHEN a = 'review_no_match' OR outcome = 'no_match' THEN 'no_match' ELSE 'needs_review' END AS review_bucket,
 CASE WHEN outcome = 'auto_accept' AND act = 'would_enrich' THEN CASE WHEN policy = 'non_food' THEN 'true_high_risk' ELSE 'auto_ready' END WHEN outcome = 'no_match' OR act = 'skip_no_match' THEN 'no_match' WHEN act IN ('skip_state_mismatch', 'skip_proxy_too_broad', 'skip_no_nutrition_value') THEN 'safety_downgrade' ELSE 'needs_review' END AS batch_bucket,
 CASE WHEN act <> 'would_enrich' THEN 'safety_downgraded_current_batch' WHEN confidence >= 0.97 THEN 'current_batch_better' ELSE 'needs_manual_review' END AS diff_bucket FROM s""")
def plan_review_columns(spark, sf_dir):
    rows = quality_plans.review_columns(nutrition_plan(spark, sf_dir))
    batch = quality_plans.batch_bucket(F.col("matcher_outcome"), F.col("safety_action"), F.col("policy"))
    return rows.select("product_id", "suggested_action", "review_priority", "review_bucket", batch.alias("batch_bucket"), quality_plans.diff_bucket(F.col("safety_action"), F.col("confidence")).alias("diff_bucket"))


@query("""WITH r AS (SELECT p_brand AS package, CASE WHEN p_brand = 'Brand#3' THEN 'approve' ELSE ['approve', 'Reject', 'replace ', '', 'needs_more_info', NULL][p_size % 6 + 1] END AS d, p_brand IN ('Brand#1', 'Brand#2') AND p_size % 5 = 0 AS bad FROM part),
t AS (SELECT package, coalesce(nullif(lower(trim(d)), ''), 'pending') AS d, CASE WHEN bad THEN 2 ELSE 0 END AS n FROM r)
SELECT package, count(*) AS total_rows, count(*) FILTER (d = 'approve') AS approve_count, count(*) FILTER (d = 'reject') AS reject_count, count(*) FILTER (d = 'replace') AS replace_count, count(*) FILTER (d = 'needs_more_info') AS needs_more_info_count, count(*) FILTER (d = 'pending') AS pending_count,
 CAST(sum(n) AS BIGINT) AS error_count, count(*) FILTER (n > 0) AS blocked_count, count(*) FILTER (n = 0 AND d IN ('approve', 'replace')) AS apply_ready_count,
 CASE WHEN sum(n) > 0 THEN 'blocked_by_errors' WHEN count(*) FILTER (d IN ('pending', 'needs_more_info')) > 0 THEN 'review_incomplete' ELSE 'ready_for_apply_planning' END AS recommendation FROM t GROUP BY 1""")
def package_summary(spark, sf_dir):
    """A review package for each brand."""
    size, brand = F.col("p_size"), F.col("p_brand")
    said = F.element_at(F.array(*map(F.lit, ["approve", "Reject", "replace ", "", "needs_more_info", None])), (size % 6 + 1).cast("int"))
    errors = F.when(brand.isin("Brand#1", "Brand#2") & (size % 5 == 0), F.array(F.lit("no_code"), F.lit("no_value")))
    rows = table(spark, sf_dir, "part").select(brand.alias("package"), F.when(brand == "Brand#3", "approve").otherwise(said).alias("manual_decision"), errors.alias("errors"))
    return quality_plans.package_summary(rows, "package")


@query("""WITH s AS (SELECT l_partkey AS product_id, bool_or(l_returnflag = 'R' AND l_linenumber < 3) AS has_total, bool_or(l_returnflag = 'A') AS has_split, arg_min(l_suppkey, l_orderkey * 10 + l_linenumber) FILTER (l_returnflag = 'R' AND l_linenumber < 3) AS code FROM lineitem GROUP BY 1),
b AS (SELECT p_partkey AS product_id, CASE WHEN p_size % 5 = 0 THEN '' WHEN p_size % 2 = 0 THEN CAST(code AS VARCHAR) ELSE CAST(p_size AS VARCHAR) END AS mine, has_total, has_split, code FROM part LEFT JOIN s ON s.product_id = p_partkey)
SELECT product_id, coalesce(has_total, false) AS has_total, coalesce(has_split, false) AS has_split, CAST(code AS VARCHAR) AS stored_code, CASE WHEN NOT coalesce(has_total, false) OR code IS NULL OR coalesce(mine, '') = '' THEN 'unknown' WHEN mine = CAST(code AS VARCHAR) THEN 'true' ELSE 'false' END AS matches FROM b""")
def batch_against_stored(spark, sf_dir):
    """Codes of a batch beside the first stored total of each part."""
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    flag = F.col("l_returnflag")
    stored = line.select(
        F.col("l_partkey").alias("product_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("record_id"), F.when(flag == "R", "v2").when(flag == "A", "split").otherwise("v1").alias("version"),
        F.when(F.col("l_linenumber") < 3, "protein_pct").otherwise("fat").alias("nutrient"), F.col("l_suppkey").cast("string").alias("code"),
    )
    first = stored.filter("version = 'v2' AND nutrient = 'protein_pct'").groupBy("product_id").agg(F.min_by("code", "record_id").alias("c"))
    size = F.col("p_size")
    batch = part.join(first, F.col("product_id") == F.col("p_partkey"), "left").select(F.col("p_partkey").alias("product_id"), F.when(size % 5 == 0, "").when(size % 2 == 0, F.col("c")).otherwise(size.cast("string")).alias("code"))
    return quality_plans.against_stored(batch, stored, "v2", "split").drop("code")


@query("""WITH c AS (SELECT doc_id AS case_id, CAST(quality AS VARCHAR) AS expected, CASE WHEN n_chars > 800 THEN '1' ELSE '0' END AS v1, CASE WHEN n_chars > 2000 THEN '1' WHEN n_chars > 20 THEN '0' END AS v2 FROM labels JOIN documents USING (doc_id))
SELECT case_id, expected, v1, v2, CASE WHEN v1 IS NOT DISTINCT FROM expected AND expected IS NOT NULL THEN CASE WHEN v2 = expected THEN 'both_correct' ELSE 'regression' END WHEN v2 = expected THEN 'improvement' ELSE 'both_wrong' END AS kind FROM c""")
def version_deltas(spark, sf_dir):
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    case = lambda p: joined.select(F.col("doc_id").alias("case_id"), F.col("quality").cast("string").alias("expected"), p.alias("predicted"))
    n = F.col("n_chars")
    return quality_plans.case_deltas(case(F.when(n > 800, "1").otherwise("0")), case(F.when(n > 2000, "1").when(n > 20, "0")))


@query("""WITH c AS (SELECT CAST(quality AS VARCHAR) AS expected, CASE WHEN n_chars > 800 THEN '1' WHEN n_chars > 300 THEN '0' END AS predicted, least(1.0, n_chars / 1000.0) AS confidence, lang = 'fr' AS review, CASE WHEN n_chars % 2 = 0 THEN source END AS name, quality = 1 AS ec, n_chars > 500 AS ac, lang AS eb, CASE WHEN n_chars > 1000 THEN lang END AS ab FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL),
t AS (SELECT count(*) AS total, count(*) FILTER (expected = predicted) AS correct, count(*) FILTER (predicted IS NULL) AS abstained, count(*) FILTER (predicted IS NULL AND coalesce(name, '') <> '') AS unknown_readable, count(*) FILTER (predicted IS NULL AND coalesce(name, '') = '') AS failed, count(*) FILTER (review) AS review_count,
 count(*) FILTER (confidence >= 0.9 AND NOT review) AS auto_accepted, count(*) FILTER (confidence >= 0.9 AND NOT review AND expected = predicted) AS auto_correct, count(*) FILTER (confidence >= 0.9 AND NOT review AND expected <> predicted) AS wrong_accepted, count(*) FILTER (ec = ac) AS composite_flag_correct,
 count(*) FILTER (ec) AS composite_buckets, count(*) FILTER (ec AND eb IS NOT DISTINCT FROM ab) AS composite_bucket_correct FROM c)
SELECT *, round(correct / total, 6) AS accuracy, round(auto_correct / auto_accepted, 6) AS auto_accept_accuracy, round(review_count / total, 6) AS review_rate FROM t""")
def classification_figures(spark, sf_dir):
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source"), "doc_id")
    n = F.col("n_chars")
    return evaluation.full_metrics(joined.select(
        F.col("quality").cast("string").alias("expected"), F.when(n > 800, "1").when(n > 300, "0").alias("predicted"), F.least(F.lit(1.0), n / 1000).alias("confidence"), (F.col("lang") == "fr").alias("review"), F.when(n % 2 == 0, F.col("source")).alias("name"),
        (F.col("quality") == 1).alias("expected_composite"), (n > 500).alias("composite"), F.col("lang").alias("expected_bucket"), F.when(n > 1000, F.col("lang")).alias("bucket"),
    ))


@query("""WITH c AS (SELECT p_partkey, p_size % 3 <> 0 AS should, CASE WHEN p_size % 3 <> 0 THEN p_size % 7 END AS expected, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 7 END AS matched, p_size / 40.0 AS confidence, p_size % 4 = 0 AS review, p_size % 2 AS bad FROM part),
t AS (SELECT *, should AND matched IS NOT NULL AND confidence >= 0.9 AND NOT review AS sure FROM c),
u AS (SELECT count(*) AS total, count(*) FILTER (should) AS should_match_total, count(*) FILTER (should AND matched = expected) AS matched_correct, count(*) FILTER (sure) AS high_confidence_total, count(*) FILTER (sure AND matched = expected) AS high_confidence_correct, CAST(2 * count(*) AS BIGINT) AS forbidden_total,
 count(*) FILTER (should AND matched IS NULL OR NOT should AND (matched IS NULL OR review)) AS abstained, count(*) FILTER (sure AND matched <> expected OR NOT should AND matched IS NOT NULL AND NOT review) + CAST(sum(bad) AS BIGINT) AS false_positives, CAST(sum(bad) AS BIGINT) AS b FROM t)
SELECT total, should_match_total, matched_correct, high_confidence_total, high_confidence_correct, forbidden_total, abstained, false_positives, round(high_confidence_correct / high_confidence_total, 6) AS precision, round((forbidden_total - b) / forbidden_total, 6) AS forbidden_rejection FROM u""")
def match_figures(spark, sf_dir):
    size, key = F.col("p_size"), F.col("p_partkey")
    return evaluation.match_quality(table(spark, sf_dir, "part").select(
        (size % 3 != 0).alias("should_match"), F.when(size % 3 != 0, size % 7).cast("long").alias("expected"), F.when(key % 5 != 0, key % 7).alias("matched"), (size / 40).alias("confidence"), (size % 4 == 0).alias("review"),
        F.array(F.lit("composite_reject"), F.when(size % 2 == 1, "accepted_head").otherwise("abstain")).alias("forbidden"),
    ))


@query("""WITH f(k, name) AS (VALUES (0, 'non_food'), (1, 'meat'), (2, 'prepared_meal'), (3, 'dairy'), (4, 'sweet_bakery'), (5, 'legume'), (6, 'tofu_substitute'), (7, 'unknown_food'), (8, 'oil_fat')),
x(a, b) AS (VALUES ('meat', 'prepared_meal'), ('prepared_meal', 'meat'), ('prepared_meal', 'dairy'), ('dairy', 'sweet_bakery'), ('sweet_bakery', 'dairy'), ('tofu_substitute', 'legume'), ('tofu_substitute', 'dairy')),
s(k, state) AS (VALUES (0, 'created'), (1, 'validation'), (2, 'review_required'), (3, 'calculation'), (4, 'report_draft'), (5, 'archived')), e(a, b) AS (VALUES ('validation', 'review_required'), ('review_required', 'calculation'), ('calculation', 'report_draft'), ('report_draft', 'calculation')),
p AS (SELECT p_partkey, f.name AS a, g.name AS b, s.state AS c, t.state AS d, p_size FROM part JOIN f ON f.k = p_partkey % 9 JOIN f g ON g.k = p_size % 9 JOIN s ON s.k = p_partkey % 6 JOIN s t ON t.k = p_size % 6)
SELECT p_partkey AS product_id, CASE WHEN a = 'non_food' OR b = 'non_food' THEN a = b ELSE a = b OR a = 'unknown_food' OR (a, b) IN (SELECT (a, b) FROM x) END AS fits, (c, d) IN (SELECT (a, b) FROM e) AS may_move,
 CASE WHEN p_size % 10 = 0 THEN 'queued' WHEN CASE WHEN p_size % 3 = 0 THEN least(p_size / 50.0, 0.69) ELSE p_size / 50.0 END >= 0.7 THEN 'accepted' ELSE 'review' END AS route FROM p""")
def policies(spark, sf_dir):
    """Families that may meet, moves of projects, and routes by confidence."""
    size, key = F.col("p_size"), F.col("p_partkey")
    pick = lambda c, *values: F.element_at(F.array(*map(F.lit, values)), (c % len(values) + 1).cast("int"))
    families, states = ("non_food", "meat", "prepared_meal", "dairy", "sweet_bakery", "legume", "tofu_substitute", "unknown_food", "oil_fat"), ("created", "validation", "review_required", "calculation", "report_draft", "archived")
    verdict = F.when(size % 20 == 0, "collision").when(size % 10 == 0, "contradiction").otherwise("matched")
    return table(spark, sf_dir, "part").select(
        key.alias("product_id"), quality_plans.family_compatible(pick(key, *families), pick(size, *families)).alias("fits"), reporting.may_move(pick(key, *states), pick(size, *states)).alias("may_move"),
        rules.routed(size / 50, verdict, rules.THRESHOLDS["protein_tracker"], size % 3 == 0).alias("route"),
    )
