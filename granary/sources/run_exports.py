"""Exports of runs: CSV with the fixed columns of each methodology, JSON with an envelope of run and summary."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.numeric import plain_text
from granary.sources.exports import as_text, text_cell

#: Columns of the exports, in order.
RUN = ["run_id", "methodology", "methodology_version", "methodology_source_edition", "taxonomy_version", "rules_version", "reporting_period_label"]
CLASSIFICATION = ["classification_source", "classification_confidence", "classification_rule_id", "classification_ai_model", "classification_reviewer_user_id"]
PT_COLUMNS = [
    *RUN, "product_id", "external_product_id", "product_name", "brand", "pt_group", "weight_per_item_kg", "items_purchased", "volume_kg", "protein_pct", "protein_source", "protein_kg",
    "used_per_product_split", "plant_protein_kg", "animal_protein_kg", *CLASSIFICATION,
]
WWF_COLUMNS = [
    *RUN, "product_id", "external_product_id", "product_name", "brand", "is_own_brand", "retail_channel", "wwf_food_group", "wwf_subgroup", "wwf_is_composite", "wwf_composite_step1_bucket",
    "weight_per_item_kg", "items_sold", "weight_kg", "weight_kg_dairy_equiv", "wwf_step2_ingredient_weights_json", *CLASSIFICATION,
]
#: Types whose text never needs quotes, beside decimals; a column that is missing has none.
PLAIN = {"", "boolean", "tinyint", "smallint", "int", "bigint"}
BOM = "﻿"


def ingredients_json(ingredients: DataFrame, key: str = "product_id") -> DataFrame:
    """key, wwf_step2_ingredient_weights_json of ingredients (key, place, food_group, subgroup, weight_kg_per_item)."""
    item = F.struct("place", "food_group", "subgroup", plain_text(F.col("weight_kg_per_item")).alias("ingredient_weight_kg_per_item"))
    listed = F.transform(F.array_sort(F.collect_list(item)), lambda x: x.dropFields("place"))
    return ingredients.groupBy(key).agg(F.to_json(listed, {"ignoreNullFields": "false"}).alias("wwf_step2_ingredient_weights_json"))


def cells(rows: DataFrame, columns: list[str], run: dict[str, str], masters: DataFrame, classifications: DataFrame, *more: DataFrame, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """The export's columns as text, one row for each of the run's; what isn't known is empty.

    masters and classifications have a row a product: external_product_id, product_name, brand (and is_own_brand, retail_channel), and the classification's columns.
    """
    out = rows
    for side in (masters, classifications, *more):
        out = out.drop(*[c for c in side.columns if c != "product_id"]).join(side, "product_id", "left")
    for c in RUN:
        out = out.withColumn(c, F.lit(run.get(c, "")))
    return as_text(out, [*keep, *columns])


def quoted(cell: Column) -> Column:
    """A cell of text as a file holds it: with commas, quotes or line ends it stands in quotes, and quotes are doubled."""
    special = cell.contains(",") | cell.contains('"') | cell.contains("\r") | cell.contains("\n")
    return F.when(special, F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(cell)


def file_cell(c: str, kind: str) -> Column:
    """A column of this type as a file holds it; numbers and booleans need no quotes."""
    return text_cell(c, kind) if kind in PLAIN or kind.startswith("decimal") else quoted(text_cell(c, kind))


def csv_line(columns: list[str]) -> Column:
    """A line of cells."""
    return F.concat_ws(",", *[quoted(F.col(c)) for c in columns])


def csv_lines(rows: DataFrame, columns: list[str], run: dict[str, str], masters: DataFrame, classifications: DataFrame, *more: DataFrame, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """keep, line: csv_line of `cells`. What is known of a product is joined and written once a product, neighbouring columns as one piece; a row adds its own cells."""
    known = masters
    for side in (classifications, *more):
        known = known.drop(*[c for c in side.columns if c != "product_id"]).join(side, "product_id", "full")
    origin = lambda c: "run" if c in RUN else "product" if c != "product_id" and c in known.columns else "row"
    product_kinds, kinds = dict(known.dtypes), dict(rows.dtypes)
    pieces = [(f"__piece_{k}", kind, list(found)) for k, (kind, found) in enumerate(groupby(columns, origin))]
    once = known.select("product_id", *[F.concat_ws(",", *[file_cell(c, product_kinds[c]) for c in found]).alias(piece) for piece, kind, found in pieces if kind == "product"])
    line = []
    for piece, kind, found in pieces:
        if kind == "run":
            line += [quoted(F.lit(run.get(c, ""))) for c in found]
        else:
            line += [F.coalesce(F.col(piece), F.lit("," * (len(found) - 1)))] if kind == "product" else [file_cell(c, kinds.get(c, "")) for c in found]
    return rows.join(once, "product_id", "left").select(*keep, F.concat_ws(",", *line).alias("line"))


def write_csv(export: DataFrame, columns: list[str], path: str) -> None:
    """Lines as UTF-8 text in parts; the first part is the header with a byte-order mark, so that the parts one behind the other are the file."""
    head = export.sparkSession.range(1, numPartitions=1).select(F.lit(BOM + ",".join(columns)).alias("value"))
    head.unionByName(export.select(csv_line(columns).alias("value"))).write.mode("overwrite").text(path)


def json_rows(export: DataFrame, columns: list[str]) -> DataFrame:
    """The export's rows with empty cells as null and the classification as an object, null without a source; what the run knows stands in the envelope."""
    value = lambda c: F.nullif(F.col(c), F.lit(""))
    boolean = {"used_per_product_split", "is_own_brand", "wwf_is_composite"}
    plain = [value(c).cast("boolean").alias(c) if c in boolean else value(c).alias(c) for c in columns if c not in RUN and c not in CLASSIFICATION]
    meta = F.struct(*[value(c).alias(c.removeprefix("classification_")) for c in CLASSIFICATION])
    return export.select(*plain, F.when(value(CLASSIFICATION[0]).isNotNull(), meta).alias("classification"))


def pt_summary(headline: DataFrame, groups: DataFrame, counters: DataFrame, status: str) -> DataFrame:
    """summary: one struct of a protein run's headline, groups and counters."""
    by_group = F.map_from_entries(F.array_sort(F.collect_list(F.struct("pt_group", F.struct("item_count", plain_text(F.col("volume_kg")).alias("volume_kg"), plain_text(F.col("protein_kg")).alias("protein_kg"))))))
    one = headline.crossJoin(groups.agg(by_group.alias("by_group"))).crossJoin(counters)  # one row each
    text = lambda c, name=None: plain_text(F.col(c)).alias(name or c)
    share = lambda c: F.nullif(plain_text(F.col(c)), F.lit("")).alias(c)
    return one.select(
        F.struct(
            text("total_protein_kg", "total_in_scope_protein_kg"), text("plant_protein_kg"), text("animal_protein_kg"), share("plant_share_pct"), share("animal_share_pct"), "by_group", F.col("out_of_scope_count").alias("out_of_scope_rows"),
            F.col("unknown_count").alias("unknown_rows"), F.col("rows_with_split").alias("per_product_split_rows"), F.col("rows_label").alias("protein_source_label_rows"), F.col("rows_reference").alias("protein_source_reference_db_rows"),
            F.lit(status).alias("pt_validation_status"),
        ).alias("summary")
    )


def write_json(rows: DataFrame, summary: DataFrame, run: dict[str, str], path: str) -> None:
    """path/rows: a line of JSON for each row; path/envelope: one with run and summary."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/rows")
    named = F.struct(*[F.lit(v).alias(k.removeprefix("run_") if k == "run_id" else k) for k, v in run.items()])
    summary.select(named.alias("run"), "summary").coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/envelope")
