"""Rows from answers that should be JSON and often aren't: a chain of repairs over a text column, without Python.

An answer may stand in a code fence or in prose, hold a byte-order mark or invisible characters, lack commas between
fields or objects, or come without its envelope. If nothing of it parses, what looks like a row is taken by itself.
Objects that repeat a key count as damaged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that may hold the rows, in order, and fields that make an object a row.
ENVELOPES = ["results", "products", "items", "classifications", "rows"]
ROW_FIELDS = ["pt_group", "wwf_food_group"]
#: Commas that answers lack: between strings, behind a number, between objects.
COMMAS = [(r'"(\s*)"(?=[A-Za-z_])', '"$1,"'), (r'(\d)(\s*)"(?=[A-Za-z_])', '$1$2,"'), (r"\}(\s*)\{", "},$1{")]


def unfenced(c: Column) -> Column:
    """Without invisible characters and an outer code fence."""
    seen = F.regexp_replace(F.regexp_replace(c, "[​-‍﻿]", ""), r"^\s+|\s+$", "")
    bare = F.regexp_replace(F.regexp_replace(seen, r"^```(?:json|JSON)?\s*", ""), r"\s*```\s*$", "")
    return F.regexp_replace(F.when(seen.startswith("```"), bare).otherwise(seen), r"^\s+|\s+$", "")


def with_commas(c: Column) -> Column:
    for pattern, put in COMMAS:
        c = F.regexp_replace(c, pattern, put)
    return c


def outermost(c: Column) -> Column:
    """From the first opening bracket to the last closing one of its kind; null without both."""
    sliced = lambda a, b: F.nullif(F.regexp_substr(c, F.lit(rf"(?s)\{a}.*\{b}")), F.lit(""))
    brace, bracket = F.instr(c, "{"), F.instr(c, "[")
    return F.when((bracket > 0) & ((brace == 0) | (bracket < brace)), sliced("[", "]")).otherwise(sliced("{", "}"))


def is_list(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))


def rows_of(v: Column, text: Column) -> Column:
    """The rows (array of variants) of a parsed answer: a list, an envelope, a single row, or the first list that an object holds; else null."""
    whole = F.try_variant_get(v, "$", "array<variant>")
    named = [F.when(is_list(F.try_variant_get(v, f"$.{k}", "variant")), F.try_variant_get(v, f"$.{k}", "array<variant>")) for k in ENVELOPES]
    has = lambda k: F.try_variant_get(v, f"$.{k}", "variant").isNotNull()
    single = has("id") & (has(ROW_FIELDS[0]) | has(ROW_FIELDS[1]))
    fields = F.try_variant_get(v, "$", "map<string,variant>")  # by name; the order is that of the text
    order = F.map_keys(F.from_json(text, "map<string,string>"))
    first = F.get(F.filter(F.transform(order, lambda k: F.element_at(fields, k)), is_list), F.lit(0))
    of_object = F.coalesce(*named, F.when(single, F.array(v)), F.try_variant_get(first, "$", "array<variant>"))
    return F.when(is_list(v), whole).when(F.schema_of_variant(v).startswith("OBJECT"), of_object)


def salvaged(answers: DataFrame, column: str) -> DataFrame:
    """Add rows (array of variants) and how: strict, repaired, sliced, partial, or failed with no rows. Null texts failed.

    Each step is a column of its own, so that a text is repaired and parsed once for each step that it needs.
    """
    kept = answers.columns
    # answers that parse as they are need no repair: what others need is null for them
    read = answers.withColumn("__clean", unfenced(F.coalesce(F.col(column), F.lit("")))).withColumn("__v1", F.try_parse_json("__clean"))
    read = read.withColumn("__commas", F.when(F.col("__v1").isNull(), with_commas(F.col("__clean")))).withColumn("__v2", F.try_parse_json("__commas"))
    read = read.withColumn("__s1", F.when(F.col("__v2").isNull(), outermost(F.col("__commas")))).withColumn("__v3", F.try_parse_json("__s1"))
    read = read.withColumn("__s2", F.when(F.col("__v3").isNull() & F.col("__v2").isNull() & F.col("__v1").isNull(), outermost(F.col("__clean")))).withColumn("__v4", F.try_parse_json("__s2"))
    text = F.when(F.col("__v1").isNotNull(), F.col("__clean")).when(F.col("__v2").isNotNull(), F.col("__commas")).when(F.col("__v3").isNotNull(), F.col("__s1")).when(F.col("__v4").isNotNull(), F.col("__s2"))
    how = F.when(F.col("__v1").isNotNull(), "strict").when(F.col("__v2").isNotNull(), "repaired").otherwise("sliced")
    read = read.withColumn("__v", F.coalesce("__v1", "__v2", "__v3", "__v4")).withColumn("__how", how)
    read = read.withColumn("__rows", rows_of(F.col("__v"), text))
    pieces = F.regexp_extract_all("__clean", F.lit(r'(?s)\{[^{}]*?"id"\s*:[^{}]*?\}'), F.lit(0))
    some = F.filter(F.transform(pieces, lambda x: F.coalesce(F.try_parse_json(x), F.try_parse_json(with_commas(x)))), lambda v: F.try_variant_get(v, "$.id", "variant").isNotNull())
    read = read.withColumn("__some", F.when(F.col("__rows").isNull(), some))
    found = F.when(F.col("__rows").isNotNull(), F.col("__how")).when(F.size("__some") > 0, "partial").otherwise("failed")
    return read.select(*kept, F.coalesce("__rows", "__some").alias("rows"), found.alias("how"))


def fields(row: Column, names: dict[str, str]) -> Column:
    """A row's fields as a struct of the given types; null where a field is missing or of another type."""
    return F.struct(*[F.try_variant_get(row, f"$.{k}", t).alias(k) for k, t in names.items()])
