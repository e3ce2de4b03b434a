"""A corpus pipeline: quality, language, exact copies, near copies, packing.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and is
written as Parquet before the next one reads it. All but the last keep the
columns of documents; extra columns pass through, whatever their names. An empty input gives an empty result.
The operators are imported when a stage runs, so this file loads without them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.session import dealt, prepare, scratch, shared_folder, table

#: Documents with a lower score are rejected: those that are likelier bad than good.
LEAST_QUALITY = 0.5
#: Texts without a language, or whose language is less likely than this, are rejected.
LEAST_LANGUAGE = 0.5
#: Texts go that fit their language worse, n-gram by n-gram, than all but this share of documents known to be in it.
WORST_FIT = 0.005


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field finds bad go. Empty texts, null ids, very long texts and repeated rows are scored like any other, equal texts alike."""
    from granary.llm import quality_crf
    from granary.llm.carried import restored
    from granary.llm.queries import held

    prepare(spark)
    model = quality_crf.fit(docs, table(spark, sf_dir, "labels").filter(~held("doc_id", 4)))
    return restored(quality_crf.score(dealt(docs), model, carry=True).filter(F.col("score") >= LEAST_QUALITY), docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or a likely language go, and those in a language that wasn't learned, or in none.

    How well a text must fit is set on half of the learned fold by a model of the other half. A language without documents in both has the bound 0.
    Equal texts, repeated rows and null ids meet the same test, however long.
    """
    from granary.llm import lang_id
    from granary.llm.carried import restored
    from granary.llm.queries import fold, held

    prepare(spark)
    learned, half = docs.filter(~held("doc_id", 4)), F.coalesce(fold("doc_id", 8) < 4, F.lit(True))
    least = lang_id.least_per_gram(learned.filter(~half), lang_id.fit(learned.filter(half)), WORST_FIT)
    found = lang_id.predict(dealt(docs), lang_id.fit(learned), carry=True)
    bound = F.lit(0.0)
    if least:
        bound = F.coalesce(F.create_map(*[F.lit(x) for pair in sorted(least.items()) for x in pair])[F.col("lang_pred")], bound)
    return restored(found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE) & (F.col("per_gram") >= bound)), docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space, one row stays. A repeated id stays once for each text kept; of rows that repeat id and text any one stays."""
    from granary.llm import exact_dedup
    from granary.llm.carried import bundled, restored

    prepare(spark)
    found = exact_dedup.exact_dedup(docs, F.xxhash64("doc_id") % 2 == 0)
    name = lambda doc_id, digest: F.concat(F.coalesce(F.hex(doc_id), F.lit("null")), F.lit(":"), F.hex(digest))
    kept = found.filter("kept").select(name(F.col("doc_id"), F.col("digest")).alias("name")).distinct()
    rows = bundled(docs).withColumn("name", name(F.col("row.doc_id"), exact_dedup.digest_of(F.col("text"))))
    return restored(rows.join(kept, "name").dropDuplicates(["name"]), docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by five-word shingles at a similarity of 0.8 or more, the smallest id stays.

    Null ids and texts without words stay. An id that repeats is one document: its rows, whatever their texts, stay or go together.
    Very long texts are compared whole.
    """
    from granary.llm import ngram_join
    from granary.llm.carried import quoted

    prepare(spark)
    found = ngram_join.ngram_join(docs, n=5, num=80, den=100)
    gone = found.filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*map(quoted, docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, as op6 returns them; null ids, empty, equal and very long texts are documents like any other."""
    from granary.llm import packing
    from granary.llm.queries import vocabulary

    prepare(spark)
    return packing.pack(dealt(docs), vocabulary("byte_bpe_50k.json"), end_id=1).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [("quality", quality), ("language", language), ("exact_copies", exact_copies), ("near_copies", near_copies), ("packing", pack)]
#: Models are trained and sets are joined, which SQL can't express; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written before the next reads it; what a stage wrote besides is deleted then."""
    docs = table(prepare(spark), sf_dir, "documents")
    for _, stage in STAGES:
        path = shared_folder(spark)
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
