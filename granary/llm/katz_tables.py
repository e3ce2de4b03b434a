"""A stored Katz backoff model of any order: n-gram tables that `write` trains, and `score` that looks every token up in them.

A table holds, for each order, the n-grams seen in training with their discounted probabilities and the contexts
with the weights that make each context's distribution sum to one. A token is looked up with its longest context; where the n-gram
wasn't seen, the context's weight (1 for a context never seen) is taken and the token is looked up with a shorter one, down to the single word, and an
unknown word has the mass that single words free. Distinct n-grams of the texts are looked up once, whatever the number of texts that hold them.

Discounts are those of `katz_lm`. The tables are partitioned by order and by buckets of contexts, so a lost executor loses but tasks. A text's tokens are its
words after lower-casing A-Z, then an end. Null texts count as empty; null and repeated ids are scored each; very long texts are one row while their tokens are
told apart. An empty table gives an empty result, and a model of no texts gives every token the probability of the unknown word. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.katz_lm import K, discounts, small_counts
from granary.session import materialize

#: Marks that no word can be: white space. They also join the words of a context.
END, START, BETWEEN = "\t", "\r", "\n"
BUCKETS = 64


def token_rows(rows: DataFrame, order: int) -> DataFrame:
    """rid, word, context (the order - 1 tokens before it, joined) of every token of rows (rid, text)."""
    low = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.concat(F.array(*[F.lit(START)] * (order - 1)).cast("array<string>"), F.regexp_extract_all(low, F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0)), F.array(F.lit(END)))
    listed = rows.select("rid", words.alias("words"))
    at = listed.select("rid", "words", F.explode(F.sequence(F.lit(order), F.size("words"))).alias("at"))
    context = F.array_join(F.slice("words", F.col("at") - (order - 1), F.lit(order - 1)), BETWEEN) if order > 1 else F.lit("")
    return at.select("rid", F.element_at("words", F.col("at")).alias("word"), context.alias("context"))


def shorter(context: Column) -> Column:
    """A context without its first token."""
    return F.when(F.contains(context, F.lit(BETWEEN)), F.regexp_replace(context, r"^[^\n]*\n", "")).otherwise(F.lit(""))


def discounted(d: np.ndarray, n: Column) -> Column:
    """A count after its discount."""
    small = F.element_at(F.array(*[F.lit(float(x)) for x in d]), F.least(n, F.lit(K)).cast("int"))
    return F.when(n <= K, small * n).otherwise(n.cast("double"))


def write(docs: DataFrame, path: str, order: int = 3, text_col: str = "text") -> None:
    """Train on all texts: path/ngrams (order, bucket, context, word, n, prob), path/contexts (order, bucket, context, weight), path/facts (order, total, unknown)."""
    spark = docs.sparkSession
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("rid"), F.col(text_col).alias("text")))
    longest = token_rows(rows, order).groupBy("context", "word").agg(F.count("*").alias("n"))
    counts = {order: materialize(longest)}
    for k in range(order - 1, 0, -1):
        counts[k] = materialize(counts[k + 1].groupBy(shorter(F.col("context")).alias("context"), "word").agg(F.sum("n").alias("n")))
    bucket = F.pmod(F.xxhash64("context"), F.lit(BUCKETS)).cast("int").alias("bucket")
    total = int(counts[1].agg(F.sum("n")).first()[0] or 0)
    below = None
    for k in range(1, order + 1):
        # how many n-grams have each count: the root of twice the corpus at most
        whole = [(int(r.n), int(r.m)) for r in counts[k].groupBy("n").agg(F.count("*").alias("m")).orderBy("n").collect()]
        r, m = np.array([x for x, _ in whole], np.int64), np.array([x for _, x in whole], np.int64)
        d = discounts(small_counts(r, m), (r, m))
        cut = discounted(d, F.col("n"))
        if k == 1:
            freed = float(sum(x * y * (1 - d[x - 1]) for x, y in whole if x <= K))
            made = counts[1].withColumn("prob", cut / max(total, 1))
            spark.createDataFrame([(order, total, freed / total if total and freed else 1.0)], "order int, total long, unknown double").write.mode("overwrite").parquet(f"{path}/facts")
        else:
            # a context all of whose n-grams are frequent frees nothing by discounts
            stat = counts[k].groupBy("context").agg(F.sum("n").alias("all"), F.count("*").alias("types"), F.min("n").alias("least"))
            stat = stat.select("context", "all", F.when(F.col("least") > K, F.col("all") / (F.col("all") + F.col("types"))).otherwise(F.lit(1.0)).alias("keep"))
            made = counts[k].join(stat, "context").withColumn("prob", cut * F.col("keep") / F.col("all"))
            lower = below.select(F.col("context").alias("short"), "word", F.col("prob").alias("lower"))
            both = made.withColumn("short", shorter(F.col("context"))).join(lower, ["short", "word"])
            left = both.groupBy("context").agg(F.sum("prob").alias("kept"), F.sum("lower").alias("lower"))
            weight = F.greatest(1 - F.col("kept"), F.lit(0.0)) / F.greatest(1 - F.col("lower"), F.lit(1e-300))
            left.select(F.lit(k).alias("order"), bucket, "context", weight.alias("weight")).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/contexts/of={k}")
        below = materialize(made.select("context", "word", "n", "prob"))
        below.select(F.lit(k).alias("order"), bucket, "context", "word", "n", "prob").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/ngrams/of={k}")


def table(spark: SparkSession, path: str, kind: str, order: int) -> DataFrame:
    schema = "context string, word string, n long, prob double" if kind == "ngrams" else "context string, weight double"
    return spark.read.schema(schema + ", bucket int").parquet(f"{path}/{kind}/of={order}")


def looked_up(spark: SparkSession, path: str, asked: DataFrame) -> DataFrame:
    """context, word, logp of distinct n-grams (context, word): from the longest context to none."""
    facts = spark.read.parquet(f"{path}/facts").first()
    left, done = asked.select("context", "word", F.col("context").alias("c"), F.lit(0.0).alias("logp")), None
    for k in range(facts["order"], 0, -1):
        seen = table(spark, path, "ngrams", k).select(F.col("context").alias("c"), "word", "prob")
        met = materialize(left.join(seen, ["c", "word"], "left"))
        hit = met.filter("prob is not null").select("context", "word", (F.col("logp") + F.log10("prob")).alias("logp"))
        done = hit if done is None else done.unionByName(hit)
        missed = met.filter("prob is null").drop("prob")
        if k == 1:
            return done.unionByName(missed.select("context", "word", (F.col("logp") + F.log10(F.lit(facts.unknown))).alias("logp")))
        weights = table(spark, path, "contexts", k).select(F.col("context").alias("c"), "weight")
        weighed = missed.join(weights, "c", "left").withColumn("logp", F.col("logp") + F.coalesce(F.log10("weight"), F.lit(0.0)))
        left = weighed.select("context", "word", shorter(F.col("c")).alias("c"), "logp")


def score(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, score (log10 probability) of every row under the model stored at path."""
    spark = docs.sparkSession
    order = spark.read.parquet(f"{path}/facts").first()["order"]
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    own = materialize(token_rows(rows, order).groupBy("rid", "context", "word").agg(F.count("*").alias("times")))
    found = looked_up(spark, path, own.select("context", "word").distinct())
    sums = own.join(found, ["context", "word"]).groupBy("rid").agg(F.sum("times").alias("n_tokens"), F.sum(F.col("times") * F.col("logp")).alias("score"))
    return rows.select("rid", "doc_id").join(sums, "rid").select("doc_id", "n_tokens", "score")
