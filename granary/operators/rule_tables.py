"""Rules as tables: thousands of rules from files, met by an inverted index of their words instead of one expression for each.

A rule's conditions are a tree. Its words and its nodes are rows: products meet words by equality, or,
where a text must hold a word somewhere, by the word's rarest three letters and a check of the whole word; what holds
climbs the tree a level at a time. The plan grows with the depth of the deepest rule, not with their number.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.rules import ordered
from granary.session import materialize

GRAM = 3
#: Kinds of leaves: texts that hold a word somewhere, lists of which an element is a word, and columns that are a word.
TEXTS = {"name_or_category_contains": ["product_name", "retailer_category", "retailer_subcategory"], "ingredients_contains": ["ingredients_text"]}
EQUAL = {"brand_in": "brand", "language_in": "language", "country_in": "country", "taxonomy_equals": "taxonomy"}
LEAVES = [*TEXTS, "labels_contains", *EQUAL]


def load(spark: SparkSession, path: str) -> dict[str, list[Mapping[str, Any]]]:
    """The rules of all JSON files under a folder by methodology, each in order; a file is a list of rules.

    A rule has id, priority, methodology, category (a name or an object) and when. An id given twice, another kind of condition or a missing field is an error.
    Rules are written by people, so they are read by the driver.
    """
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json").select("value", "_metadata.file_path")
    found: list[Mapping[str, Any]] = []
    for row in files.toLocalIterator():
        rules = json.loads(row.value) if row.value.strip() else []
        if not isinstance(rules, list):
            raise ValueError(f"{row.file_path}: not a list of rules")
        for rule in rules:
            if lacks := {"id", "priority", "methodology", "category", "when"} - set(rule):
                raise ValueError(f"{row.file_path}: a rule lacks {', '.join(sorted(lacks))}")
            checked(rule["when"])
        found += rules
    ordered(found)
    return {m: ordered([r for r in found if r["methodology"] == m]) for m in sorted({r["methodology"] for r in found})}


def checked(node: Mapping[str, Any]) -> None:
    ((kind, value),) = node.items()
    if kind in ("any_of", "all_of"):
        for part in value:
            checked(part)
    elif kind not in LEAVES:
        raise ValueError(f"unknown condition {kind}")


def tables(spark: SparkSession, rules: Sequence[Mapping[str, Any]]) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """words (kind, word, rule, node), nodes (rule, node, parent, needs: true parts that make it true), rules (rule, priority, id, category as JSON), and the depth."""
    words, nodes, heads, depth = [], [], [], 0

    def put(rule: int, node: Mapping[str, Any], parent: int, level: int) -> None:
        nonlocal depth
        depth = max(depth, level)
        ((kind, value),) = node.items()
        me = len(nodes)
        if kind in ("any_of", "all_of"):
            nodes.append((rule, me, parent, len(value) if kind == "all_of" else 1))
            for part in value:
                put(rule, part, me, level + 1)
        else:
            nodes.append((rule, me, parent, 1))
            words.extend((kind, str(w).lower(), rule, me) for w in ([value] if isinstance(value, str) else value))

    for k, rule in enumerate(ordered(rules)):
        heads.append((k, rule["priority"], rule["id"], json.dumps(rule["category"], sort_keys=True)))
        put(k, rule["when"], -1, 1)
    return (
        spark.createDataFrame(words, "kind string, word string, rule int, node int"), spark.createDataFrame(nodes, "rule int, node int, parent int, needs int"),
        spark.createDataFrame(heads, "rule int, priority int, id string, category string"), depth,
    )


def grams(c: Column) -> Column:
    size = F.length(c)
    return F.when(size >= GRAM, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(size - GRAM + 1, F.lit(1))), lambda k: F.substring(c, k, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))


def held_words(products: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """key, kind, word: the words of rules that hold for a product."""
    for c in {"labels", *EQUAL.values(), *[x for some in TEXTS.values() for x in some]} - set(products.columns):
        products = products.withColumn(c, F.lit(None).cast("array<string>" if c == "labels" else "string"))
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    asked = words.select("kind", "word").distinct()
    equal = F.array(*[F.struct(F.lit(kind).alias("kind"), low(c).alias("word")) for kind, c in EQUAL.items()])
    labels = F.transform(F.coalesce("labels", F.array().cast("array<string>")), lambda x: F.struct(F.lit("labels_contains").alias("kind"), F.lower(x).alias("word")))
    by_value = products.select(key, F.inline(F.concat(equal, labels))).join(asked, ["kind", "word"])

    texts = F.array(*[F.struct(F.lit(kind).alias("kind"), F.concat_ws(" ", *map(low, columns)).alias("text")) for kind, columns in TEXTS.items()])
    rows = materialize(products.select(key, F.inline(texts)))
    in_text = asked.filter(F.col("kind").isin(*TEXTS))
    # a text holds a word only if it holds the word's rarest letters
    held = rows.select(key, "kind", F.explode(grams(F.col("text"))).alias("gram"))
    often = held.groupBy("kind", "gram").agg(F.count("*").alias("n"))
    anchors = in_text.select("kind", "word", F.explode(grams(F.col("word"))).alias("gram")).join(often, ["kind", "gram"]).groupBy("kind", "word").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    likely = held.join(anchors, ["kind", "gram"]).select(key, "kind", "word")
    short = in_text.filter(F.length("word") < GRAM)
    few = rows.select(key, "kind").join(short, "kind")
    by_text = likely.unionByName(few).join(rows, [key, "kind"]).filter(F.contains("text", F.col("word"))).select(key, "kind", "word")
    return by_value.select(key, "kind", "word").unionByName(by_text).distinct()


def fired(products: DataFrame, rules: Sequence[Mapping[str, Any]], key: str = "product_id") -> DataFrame:
    """key, priority, id, category (JSON) of the rules that hold for a product."""
    words, nodes, heads, depth = tables(products.sparkSession, rules)
    true = held_words(products, words, key).join(words, ["kind", "word"]).select(key, "rule", "node").distinct()
    out = None
    for _ in range(depth):
        at = true.join(nodes, ["rule", "node"])
        roots = at.filter("parent < 0").select(key, "rule")
        out = roots if out is None else out.unionByName(roots)
        up = at.filter("parent >= 0").groupBy(key, "rule", F.col("parent").alias("node")).agg(F.count_distinct("node").alias("n"))
        true = up.join(nodes.select("rule", "node", "needs"), ["rule", "node"])
        # leaves of several depths meet in their parent: what is true of it so far is carried on
        true = materialize(at.select(key, "rule", "node").unionByName(true.filter(F.col("n") >= F.col("needs")).select(key, "rule", "node")).distinct())
    done = true.join(nodes.filter("parent < 0"), ["rule", "node"]).select(key, "rule")
    return (done if out is None else out.unionByName(done)).distinct().join(heads, "rule").drop("rule")


def verdicts(products: DataFrame, rules: Sequence[Mapping[str, Any]], key: str = "product_id") -> DataFrame:
    """Add verdict (pass_through, matched, collision), category (JSON) and rule_ids in order. Rules agree if their whole categories are equal."""
    hits = fired(products, rules, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("priority", "id"))).alias("ids"), F.min("category").alias("low"), F.max("category").alias("high"))
    joined = products.join(hits, key, "left")
    verdict = F.when(F.col("ids").isNull(), "pass_through").when(F.col("low") == F.col("high"), "matched").otherwise("collision")
    return joined.withColumn("verdict", verdict).withColumn("category", F.when(F.col("verdict") == "matched", F.col("low"))).withColumn("rule_ids", F.coalesce(F.array_join("ids.id", ","), F.lit(""))).drop("ids", "low", "high")
