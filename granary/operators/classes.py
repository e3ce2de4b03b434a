"""Rows with the same frequent words as classes: which references are best for a class, and for each of its products."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.session import materialize

#: A class of products is large if it holds more than this share of them.
CROWD = 0.001
CLASS = ["scope", "source", "common"]


def class_lists(shared: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """scope, ours, list, products: for each class of products (left_id, scope, ours) the k references of each source that share most of its words, with their rank.

    References have right_id, source, by, scope, common; the words are never empty.
    """
    first = Window.partitionBy(*CLASS).orderBy("by", "right_id")
    members = known.select("right_id", "by", *CLASS).withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k)
    theirs = members.filter("n = 1").select(*CLASS, "by", "right_id", F.explode("common").alias("w"))
    ours = shared.groupBy("scope", "ours").agg(F.count("*").alias("products"))
    met = ours.select("scope", "ours", F.explode("ours").alias("w")).join(theirs, ["scope", "w"])
    classes = met.groupBy(*CLASS, "ours", "by", "right_id").agg(F.count("*").alias("overlap"))
    best = Window.partitionBy("scope", "source", "ours").orderBy(F.desc("overlap"), "by", "right_id")
    # a class whose first reference comes after those of k others has none among the k best
    near = classes.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k).select(*CLASS, "ours", "overlap")
    listed = near.join(members, CLASS).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    lists = listed.groupBy("scope", "ours").agg(F.collect_list(F.struct("source", "right_id", "by", "overlap", "rank")).alias("list"))
    return materialize(lists.join(ours, ["scope", "ours"]))


def of_products(shared: DataFrame, lists: DataFrame, crowd: float) -> DataFrame:
    """left_id, scope, source, right_id, by, overlap, rank: the list of each product's class.

    Classes of more than `crowd` products are few, and meet their products without a shuffle, so no task takes a whole one.
    """
    large = F.broadcast(lists.filter(F.col("products") > crowd).drop("products"))
    others = lists.filter(F.col("products") <= crowd).drop("products").hint("merge")
    met = shared.join(large, ["scope", "ours"]).unionByName(shared.join(large, ["scope", "ours"], "left_anti").join(others, ["scope", "ours"]))
    return met.select("left_id", "scope", F.inline("list"))
