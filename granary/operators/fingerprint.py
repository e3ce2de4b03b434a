"""Catalogues known by their content, whatever the order of their lines.

A catalogue's fingerprint is its number of lines, and sums of hashes of its ids and of its lines. Sums are made where the
lines lie and merged, so no task holds a catalogue. Only catalogues whose fingerprints agree are compared line by line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.text import fold

SALTS = ("a", "b")


def normal_name(c: Column) -> Column:
    """Folded words of a name between single spaces."""
    return F.trim(F.regexp_replace(fold(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def fingerprints(lines: DataFrame, owner: str = "catalogue") -> DataFrame:
    """owner, n, distinct_ids, ids, names of lines (owner, id, name): the sums are arrays, one for each salt."""
    total = lambda *c: F.array(*[F.sum(F.xxhash64(F.lit(s), *c).cast("decimal(20,0)")) for s in SALTS])
    rows = lines.select(owner, F.col("id").cast("string").alias("id"), normal_name(F.col("name")).alias("name"))
    return rows.groupBy(owner).agg(F.count("*").alias("n"), F.count_distinct("id").alias("distinct_ids"), total("id").alias("ids"), total("id", "name").alias("names"))


def recognised(uploads: DataFrame, catalogues: DataFrame) -> DataFrame:
    """upload, catalogue, how (lines or ids) for uploads (upload, id, name) that are one of the catalogues (catalogue, id, name).

    All ids must be there once, and no other. Names may differ (how = ids). An upload that holds an id twice, or a null one, is none.
    """
    mine = fingerprints(uploads, "upload").filter("n = distinct_ids")
    known = fingerprints(catalogues).filter("n = distinct_ids").withColumnsRenamed({"ids": "known_ids", "names": "known_names"}).drop("distinct_ids")
    likely = mine.join(known, "n").filter(F.col("ids") == F.col("known_ids")).select("upload", "catalogue", "n")
    rows = uploads.join(likely, "upload").select("upload", "catalogue", "n", F.col("id").cast("string").alias("id"), normal_name(F.col("name")).alias("name"))
    truth = catalogues.select("catalogue", F.col("id").cast("string").alias("id"), normal_name(F.col("name")).alias("known"))
    same = rows.join(truth, ["catalogue", "id"]).groupBy("upload", "catalogue").agg(F.first("n").alias("n"), F.count("*").alias("found"), F.count_if(F.col("name") == F.col("known")).alias("named"))
    return same.filter("found = n").select("upload", "catalogue", F.when(F.col("named") == F.col("n"), "lines").otherwise("ids").alias("how"))
