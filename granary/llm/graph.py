"""Connected components of a links table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.session import materialize


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node it is connected with), for every node of links (a, b: long).

    Each round links every node's larger neighbours, then its smaller ones, to its
    smallest neighbour, until only stars are left; rounds grow with the logarithm
    of the longest path. Rounds are written to the shared folder. Null ends and loops don't count.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a is not null and b is not null and a <> b").distinct())
    while not stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = materialize(small.select("e.a", "e.b").filter("a <> b").distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour, which has none."""
    again = edges.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1")
    return edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").isEmpty() and again.isEmpty()
