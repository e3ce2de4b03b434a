"""Text columns: folding, tokens, predicates in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Accented letters and what they fold to.
ACCENTED = "àáâãäåāçćčèéêëēėęìíîïīñńòóôõöøōùúûüūýÿžźż"
FOLDED = "aaaaaaaccceeeeeeeiiiiinnooooooouuuuuyyzzz"
#: Words too common to tell foods apart.
STOP = ["the", "and", "with", "without", "for", "avec", "sans", "des", "les", "aux", "van", "met", "een", "het", "raw", "average", "prepared"]


def fold(c: Column) -> Column:
    """Lower case without accents and ligatures."""
    low = F.translate(F.lower(c), ACCENTED, FOLDED)
    for a, b in (("œ", "oe"), ("æ", "ae"), ("ß", "ss")):
        low = F.replace(low, F.lit(a), F.lit(b))
    return low


def tokens(c: Column, stop: list[str] = STOP) -> Column:
    """Distinct folded words of three letters or more, without stop words."""
    words = F.split(fold(F.coalesce(c, F.lit(""))), "[^a-z0-9]+")
    return F.array_distinct(F.filter(words, lambda t: (F.length(t) >= 3) & ~t.isin(stop)))


def expanded(words: Column, aliases: dict[str, list[str]]) -> Column:
    """Words and their aliases."""
    if not aliases:
        return words
    table = F.create_map(*[x for k, v in sorted(aliases.items()) for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.array_distinct(F.flatten(F.transform(words, lambda t: F.concat(F.array(t), F.coalesce(F.element_at(table, t), F.array().cast("array<string>"))))))


def without_packaging(c: Column) -> Column:
    """A name without amounts and pack words; the name itself if nothing would be left."""
    bare = F.regexp_replace(c, r"(?i)\b(\d+\s*x\s*)?\d+([.,]\d+)?\s*(kg|g|ml|cl|l|oz|lb)\b|\b\d+\s*x\b|\b(pack|bottle|can|box|bag|jar|multipack)\b", " ")
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(bare, r"\s+", " ")), F.lit("")), c)


def any_word(c: Column, words: list[str]) -> Column:
    """Whether one of the words stands in c by itself, a plural s allowed; false for null."""
    choice = "|".join(sorted(words, key=lambda w: (-len(w), w)))
    return F.coalesce(c.rlike(rf"(?i)(?<![a-z0-9])({choice})s?(?![a-z0-9])"), F.lit(False))


def first_match(rules: list[tuple[str, Column]], otherwise: str | None = None) -> Column:
    """The name of the first rule that holds."""
    found = F.lit(None).cast("string")
    for name, holds in reversed(rules):
        found = F.when(F.coalesce(holds, F.lit(False)), name).otherwise(found)
    return F.coalesce(found, F.lit(otherwise).cast("string"))


def all_matches(rules: list[tuple[str, Column]]) -> Column:
    """The names of all rules that hold, in order: the trace of an evaluation."""
    return F.array_compact(F.array(*[F.when(F.coalesce(holds, F.lit(False)), name) for name, holds in rules]))


def earliest_concept(c: Column, forms: list[tuple[str, str]]) -> Column:
    """The concept whose form stands first in c; of forms at one place the longest, then the first name."""
    places = F.array(*[F.struct(F.instr(c, form).alias("at"), (-F.lit(len(form))).alias("shorter"), F.lit(concept).alias("concept")) for form, concept in forms])
    return F.array_min(F.filter(places, lambda x: x["at"] > 0))["concept"]


#: Words that tell a dish made with a food from the food itself.
COMPOSITE = ["with", "without", "containing", "in", "met", "zonder", "supplemented", "enriched", "mixed"]


def product_head(c: Column, heads: list[tuple[str, str]]) -> Column:
    """raw, kind of the first of the ordered heads (raw, kind) that stands in c by itself, whatever its accents; null without one."""
    name = fold(c)
    found = [F.when(name.rlike(rf"\b\Q{x}\E\b"), F.struct(F.lit(raw).alias("raw"), F.lit(kind).alias("kind"))) for raw, kind, x in ((r, k, folded_text(r)) for r, k in heads)]
    return F.coalesce(*found, F.lit(None).cast("struct<raw:string,kind:string>"))


def folded_text(word: str) -> str:
    """`fold` of a parameter."""
    return word.lower().translate(str.maketrans(ACCENTED, FOLDED)).replace("œ", "oe").replace("æ", "ae").replace("ß", "ss")


def reads_composite(c: Column) -> Column:
    """Whether a name reads like a dish with, without or in something."""
    return F.coalesce(c.rlike(rf"(?i)\b({'|'.join(COMPOSITE)})\b"), F.lit(False))


def normal_words(c: Column) -> Column:
    """Folded words in order, of any length."""
    return F.filter(F.split(fold(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")


def concepts(names: DataFrame, forms: DataFrame, longest: int) -> DataFrame:
    """words, concept: the concept of each distinct list of words whose form stands first; of forms at one place the longest, then the first name.

    All runs of up to `longest` words (the most that a form has) meet the forms (form, concept) by equality, so work doesn't grow with their number.
    """
    rows = names.select("words").distinct()
    starts = F.explode(F.flatten(F.transform("words", lambda _, k: F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.struct(k.alias("at"), F.array_join(F.slice("words", k + 1, n), " ").alias("form"))))))
    runs = rows.filter("size(words) > 0").select("words", starts.alias("x")).select("words", "x.*").distinct()
    met = runs.join(forms.select(F.array_join(normal_words(F.col("form")), " ").alias("form"), "concept").distinct(), "form")
    return met.groupBy("words").agg(F.min(F.struct("at", (-F.length("form")).alias("shorter"), "concept")).alias("x")).select("words", "x.concept")


def short_key(c: Column, digits: int = 16) -> Column:
    """The first hexadecimal digits of a text's SHA-1."""
    return F.substring(F.sha1(c), 1, digits)


def hashed_vector(c: Column, width: int = 64) -> Column:
    """A unit vector that counts a text's folded words by a hash; zero without words."""
    slots = F.transform(F.filter(F.split(fold(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda t: t != ""), lambda t: F.pmod(F.xxhash64(t), F.lit(width)))
    counts = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.size(F.filter(slots, lambda s: s == k)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(counts, lambda x: x / norm)).otherwise(counts)
