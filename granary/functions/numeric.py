"""Exact decimal columns: parsing of loosely written numbers, unit conversion, rounding and shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kilograms in a unit.
KG = {"kg": "1", "g": "0.001", "lb": "0.45359237", "oz": "0.028349523125"}
#: Words that mean yes and no, and words of brand types that mean an own brand or another's.
YES = ["true", "1", "yes", "y", "oui", "o", "vrai"]
NO = ["false", "0", "no", "n", "non", "faux"]
OWN_BRAND = [
    "own brand", "own-brand", "ownbrand", "own label", "private label", "private-label", "store brand", "store label", "house brand", "store-own label", "pl",
    "marque distributeur", "marque du distributeur", "marque propre", "marque enseigne", "mdd",
]
OTHER_BRAND = ["branded", "brand", "national brand", "national-brand", "manufacturer brand", "manufacturer-brand", "name brand", "marque nationale", "marque fabricant", "marque"]
HEAVIEST_KG = 50


def q8(c: Column) -> Column:
    """Half-even to eight places. A cast would round half up."""
    return F.bround(c, 8).cast("decimal(28,8)")


def trimmed(c: Column) -> Column:
    """Trimmed text, null if nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def commas(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(","), F.lit("")))


def dots(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("."), F.lit("")))


def to_decimal(raw: Column, kind: str = "decimal(28,12)") -> Column:
    """A number written with a decimal dot, a decimal comma, or dots for thousands before a decimal comma; null if it can't be read."""
    return decimal_of(trimmed(raw), kind)


def decimal_of(text: Column, kind: str = "decimal(28,12)") -> Column:
    """to_decimal of text that is trimmed already."""
    plain = F.when((commas(text) == 1) & (dots(text) == 0), F.replace(text, F.lit(","), F.lit(".")))
    plain = plain.when((commas(text) == 1) & (F.instr(text, ",") > F.length(text) - F.instr(F.reverse(text), ".") + 1) & (dots(text) > 0), F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
    return plain.otherwise(text).try_cast(kind)


def unreadable(raw: Column) -> Column:
    """Something is written, but no number."""
    return trimmed(raw).isNotNull() & to_decimal(raw).isNull()


class Number:
    """A number that was read once: its value, whether anything was written, and whether that can't be read."""

    def __init__(self, value: Column, given: Column):
        self.value, self.given, self.bad = value, given, given & value.isNull()


def numbers(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, dict[str, Number]]:
    """Rows with each of the columns read once, in a projection of its own, and where to find what was read."""
    texts = rows.select("*", *[trimmed(F.col(c)).alias(f"__text_{c}") for c in columns])
    read = texts.select("*", *[decimal_of(F.col(f"__text_{c}")).alias(f"__value_{c}") for c in columns])
    return read, {c: Number(F.col(f"__value_{c}"), F.col(f"__text_{c}").isNotNull()) for c in columns}


def one(raw: Column) -> Number:
    return Number(to_decimal(raw), trimmed(raw).isNotNull())


def either(*conditions: Column) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def weight_of(**units: Number) -> tuple[Column, Column]:
    """Weight in kilograms by unit, and the code of what is wrong; no weight at all is null without a code.

    One unit at most may be given; the weight must be above 0 and not above 50 kg.
    """
    values = [n.value.cast("decimal(18,6)") * F.lit(KG[u]).cast("decimal(13,12)") for u, n in units.items()]
    kg = F.coalesce(*values).cast("decimal(28,16)")
    many = sum(n.given.cast("int") for n in units.values()) > 1
    code = F.when(either(*[n.bad for n in units.values()]), "invalid_type").when(many, "mixed_weight_units")
    code = code.when(kg <= 0, "weight_non_positive").when(kg > HEAVIEST_KG, "weight_too_large")
    return F.when(code.isNull(), kg), code


def weight_kg(**units: Column) -> tuple[Column, Column]:
    """weight_of raw text."""
    return weight_of(**{u: one(c) for u, c in units.items()})


def protein_of(pct: Number, per_100ml: Number, density: Number, per_serving: Number, serving_g: Number, energy: Column | None = None, per_100g: Number | None = None) -> tuple[Column, Column]:
    """Protein in percent from a percentage (or grams in 100 g), grams in 100 ml and a density, or grams in a serving; and the code of what is wrong.

    energy: whether an energy value was given for protein. A density or serving of 0 counts as missing.
    """
    p, ml, d, s, g = (n.value.cast("decimal(18,6)") for n in (pct, per_100ml, density, per_serving, serving_g))
    direct = [pct] + ([per_100g] if per_100g else [])
    every = [*direct, per_100ml, density, per_serving, serving_g]
    many = sum(n.given.cast("int") for n in (*direct, per_100ml, per_serving)) > 1
    value = F.coalesce(*[n.value.cast("decimal(28,12)") for n in direct], F.try_divide(ml, d).cast("decimal(28,12)"), F.try_divide(s * 100, g).cast("decimal(28,12)"))
    code = F.when(F.lit(False) if energy is None else energy, "energy_not_protein").when(either(*[n.bad for n in every]), "invalid_type")
    code = code.when(per_100ml.given & F.coalesce(d == 0, F.lit(True)), "missing_density").when(per_serving.given & F.coalesce(g == 0, F.lit(True)), "missing_serving_g")
    code = code.when(many, "mixed_protein_inputs").when((value < 0) | (value > 100), "protein_out_of_range")
    return F.when(code.isNull(), value), code


def protein_pct(pct: Column, per_100ml: Column, density: Column, per_serving: Column, serving_g: Column) -> tuple[Column, Column]:
    """protein_of raw text."""
    return protein_of(*map(one, (pct, per_100ml, density, per_serving, serving_g)))


def to_boolean(raw: Column) -> Column:
    word = F.lower(F.trim(raw))
    brand = F.trim(F.regexp_replace(F.replace(word, F.lit("_"), F.lit(" ")), r"\s+", " "))
    return F.when(word.isin(YES) | brand.isin(OWN_BRAND), True).when(word.isin(NO) | brand.isin(OTHER_BRAND), False)


def to_list(raw: Column, mark: str = "|") -> Column:
    """Parts between marks, trimmed, without blanks; an empty list for null."""
    return F.coalesce(F.filter(F.transform(F.split(raw, "\\Q" + mark + "\\E"), lambda x: F.trim(x)), lambda x: F.length(x) > 0), F.array().cast("array<string>"))


def share_pct(part: Column, total: Column, places: int = 8) -> Column:
    """part in percent of total, half-even; null if total is 0. With wider types the quotient would have six places only."""
    return F.when(total > 0, F.bround(part.cast("decimal(22,8)") * 100 / total.cast("decimal(22,8)"), places))


def clamped_pct(part: Column, total: Column, places: int = 1) -> Column:
    """part in percent of total between 0 and 100, half up; 0 without a total."""
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(F.try_divide(part.cast("double") * 100, total.cast("double")), F.lit(0.0)))), places)


def plain_text(c: Column, places: int = 8) -> Column:
    """A decimal without exponent; empty for null."""
    value = c.cast(f"decimal(28,{places})")
    # only what is nearer to 0 than a millionth may be written with an exponent
    rest = (F.abs(value) * F.lit(10**places).cast(f"decimal({places + 1},0)")).cast("long").cast("string")
    near_0 = F.concat(F.when(c < 0, "-").otherwise(""), F.lit("0."), F.lpad(rest, places, "0"))
    return F.coalesce(F.when(F.abs(value) >= F.lit("0.000001").cast("decimal(7,6)"), value.cast("string")).otherwise(near_0), F.lit(""))
