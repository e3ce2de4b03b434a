"""Rows that pass through a Python stage whole, whatever their other columns are called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def bundled(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """row: all columns but the text, as one struct; text."""
    return docs.select(F.struct(*[quoted(c) for c in docs.columns if c != text_col]).alias("row"), quoted(text_col).cast("string").alias("text"))


def restored(found: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns of docs from row and text."""
    return found.select(*[(F.col("text").cast(docs.schema[c].dataType) if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])
