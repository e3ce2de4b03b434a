"""Writing results: CSV with fixed columns, JSON lines, Markdown, and the file's name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.numeric import plain_text


def text_cell(c: str, kind: str) -> Column:
    """A column of this type as text: decimals plain, null as empty; one without type is missing, and empty."""
    if not kind:
        return F.lit("")
    return plain_text(F.col(c)) if kind.startswith("decimal") else F.coalesce(F.col(c).cast("string"), F.lit(""))


def as_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """All columns as text, decimals plain, null as empty; a column that is missing is empty."""
    kinds = dict(df.dtypes)
    return df.select(*[text_cell(c, kinds.get(c, "")).alias(c) for c in columns])


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    as_text(df, columns).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def inline_ingredients(ingredients: DataFrame, key: str = "product_id") -> DataFrame:
    """key, ingredients_json: each product's ingredients as one JSON array in their order."""
    item = F.struct("place", "food_group", "subgroup", plain_text(F.col("weight_kg")).alias("weight_kg"))
    ordered = ingredients.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("i"))
    return ordered.select(key, F.to_json(F.transform("i", lambda x: F.struct(x["food_group"].alias("food_group"), x["subgroup"].alias("subgroup"), x["weight_kg"].alias("weight_kg")))).alias("ingredients_json"))


def markdown(df: DataFrame, columns: list[str], most: int = 1000) -> str:
    """A small result as a Markdown table; more than `most` rows are an error."""
    rows = as_text(df, columns).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(columns), line(["---"] * len(columns)), *[line([x.replace("|", "\\|") for x in r]) for r in rows]])


def file_name(project: Column, methodology: Column, period: Column, day: Column) -> Column:
    """A name that says what a file holds, of safe characters."""
    text = F.concat_ws("_", project, methodology, period, F.date_format(day, "yyyyMMdd"))
    return F.concat(F.regexp_replace(F.lower(text), "[^a-z0-9_]+", "-"), F.lit(".csv"))
