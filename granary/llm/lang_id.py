"""Language identification by multinomial naive Bayes over hashed character n-grams.

Counting runs where the rows lie and is summed by Spark; the model is a matrix
of log probabilities, buckets by languages, in blocks of so many languages that
each has a bounded size, whatever the corpus, and is broadcast.
Batches are scored sparsely in numpy: each n-gram picks a row of the matrix, and
rows are summed by document.

A text that is null, empty or without a letter is `und` with score 0, and so is
every text if nothing was learned. The posterior nears 1 for any longer text, of whatever
language, so `per_gram` says how well a text fits the language chosen: the mean logarithm of how much
likelier its n-grams are there than if all buckets were equal. Null languages teach nothing. Of languages
equally likely, the first in alphabetical order wins. Repeated rows and rows with a null id are predicted
each; a very long text is scored whole. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.carried import bundled
from granary.session import materialize

ORDERS = (2, 3)
BUCKETS = 1 << 15
#: Languages of a block of the matrix: a broadcast of 2**15 * 64 * 8 bytes = 17 MB at most. More languages take more blocks.
LANGS = 64
#: Stands between documents in a batch; no character has this number.
GAP = 0x110000
#: Texts are scored in pieces of about so many code points, cut between documents.
PIECE = 1 << 20


def letters(text: str) -> bool:
    return any(map(str.isalpha, text))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram of each order (BUCKETS where it would cross documents), and where documents start."""
    points = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    gap = np.full(max(ORDERS), GAP, np.uint32)
    whole = np.concatenate([x for p in points for x in (p, gap)]) if points else gap
    starts = np.cumsum([0] + [len(p) + len(gap) for p in points[:-1]])
    out = []
    for n in ORDERS:
        h = np.full(len(whole) - n + 1, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        crosses = np.zeros(len(h), bool)
        for k in range(n):
            c = whole[k : len(whole) - n + 1 + k]
            h = (h ^ c) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
            crosses |= c == GAP
        slot = (h % np.uint32(BUCKETS)).astype(np.int32)
        slot[crosses] = BUCKETS
        out.append(np.concatenate([slot, np.full(n - 1, BUCKETS, np.int32)]))
    return np.stack(out), starts


def pieces(texts: list[str]):
    """Runs of documents of about PIECE code points."""
    begin, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= PIECE:
            yield begin, k + 1
            begin, size = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, bucket, n over all the rows given, and for each lang its documents at bucket -1."""

    def work(batches):
        seen: dict[str, np.ndarray] = {}
        n_docs: dict[str, int] = {}
        for batch in batches:
            by: dict[str, list[str]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                n_docs[lang] = n_docs.get(lang, 0) + len(texts)
                total = seen.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                for a, b in pieces(texts):
                    total += np.bincount(grams(texts[a:b])[0].ravel(), minlength=BUCKETS + 1)
        for lang, total in seen.items():
            total[BUCKETS] = 0
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1), pa.string()), pa.array(np.r_[-1, at], pa.int32()), pa.array(np.r_[n_docs[lang], total[at]], pa.int64())], ["lang", "bucket", "n"])

    rows = docs.select(F.col(text_col).cast("string"), F.col(lang_col).cast("string")).na.drop()
    return rows.mapInArrow(work, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Languages by name, their log priors, and a table of counts from which blocks of the matrix are read."""

    def __init__(self, langs: list[str], priors: np.ndarray, table: DataFrame):
        self.langs, self.priors, self.table = langs, priors, table

    def blocks(self):
        """(languages, log probabilities as BUCKETS + 1 rows, of which the last is 0, by languages; log priors), LANGS languages at a time."""
        for a in range(0, len(self.langs), LANGS):
            langs = self.langs[a : a + LANGS]
            got = self.table.filter(F.col("bucket") >= 0).filter(F.col("lang").isin(langs)).toArrow()  # LANGS * BUCKETS rows at most
            place = {x: k for k, x in enumerate(langs)}
            counts = np.zeros((BUCKETS + 1, len(langs)))
            counts[got.column("bucket").to_numpy(), [place[x] for x in got.column("lang").to_pylist()]] = got.column("n").to_numpy()
            logs = np.log((counts[:BUCKETS] + 0.5) / (counts[:BUCKETS].sum(axis=0) + 0.5 * BUCKETS))
            yield langs, np.vstack([logs, np.zeros((1, len(langs)))]), self.priors[a : a + LANGS]


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts of all the rows given."""
    table = materialize(counts(docs, text_col, lang_col))
    known = sorted((r.lang, r.n) for r in table.filter("bucket = -1").select("lang", "n").collect())  # a row for each language
    n = np.array([k for _, k in known], float)
    return Model([x for x, _ in known], np.log(n / n.sum()) if known else n, table)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """id, lang_pred, score (the posterior of the language chosen), per_gram for every row and whole text; with carry, row and text (see carried) for id.

    One pass over the rows for each block of languages.
    """
    rows = bundled(docs, text_col) if carry else docs.select(F.col(id_col).alias("row"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("row", "text", F.lit("und").alias("lang_pred"), F.lit(float("-inf")).alias("best"), F.lit(float("-inf")).alias("total"), F.lit(0.0).alias("per_gram"))
    for block in model.blocks():
        rows = compared(rows, block)
    out = rows.withColumn("score", F.when(F.col("lang_pred") == "und", 0.0).otherwise(F.exp(F.col("best") - F.col("total"))))
    return out.select(*["row", "text"] if carry else [F.col("row").alias(id_col)], "lang_pred", "score", "per_gram")


def compared(rows: DataFrame, block: tuple) -> DataFrame:
    """The best language so far and the logarithm of the sum of all likelihoods, with one more block of languages."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def scores(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        _, logs, priors = shared.value
        out, n = np.zeros((len(texts), len(priors))), np.zeros(len(texts))
        for a, b in pieces(texts):
            slots, starts = grams(texts[a:b])
            n[a:b] = sum(np.add.reduceat((s < BUCKETS).astype(np.int64), starts) for s in slots)
            for k in range(logs.shape[1]):
                column = np.ascontiguousarray(logs[:, k])
                out[a:b, k] = sum(np.add.reduceat(column[s], starts) for s in slots)
        return out + priors, n

    def work(batches):
        langs, _, priors = shared.value
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "").to_pylist()
            readable = np.flatnonzero(np.array([letters(t) for t in texts], bool))
            lang = batch.column("lang_pred").to_pylist()
            best, total, per_gram = (batch.column(c).to_numpy().copy() for c in ("best", "total", "per_gram"))
            if len(readable):
                s, n = scores([texts[k] for k in readable])
                top = s.argmax(axis=1)
                most = s[np.arange(len(s)), top]
                whole = most + np.log(np.exp(s - most[:, None]).sum(axis=1))
                total[readable] = np.logaddexp(total[readable], whole)
                better = most > best[readable]
                at, top, n, most = readable[better], top[better], n[better], most[better]
                best[at] = most
                per_gram[at] = np.where(n > 0, (most - priors[top]) / np.maximum(n, 1) + np.log(BUCKETS), 0.0)
                for k, t in zip(at, top, strict=True):
                    lang[k] = langs[t]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), pa.array(lang, pa.string()), *[pa.array(x, pa.float64()) for x in (best, total, per_gram)]], batch.schema.names)

    return rows.mapInArrow(work, rows.schema)


def least_per_gram(docs: DataFrame, model, share: float, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, float]:
    """For each language the per_gram that this share of its documents, told right, stay below, but 0 at least.

    The documents given must be others than those the model learned from, whose own n-grams it knows.
    """
    right = predict(docs, model, id_col, text_col, carry=True).filter(F.col("lang_pred") == F.col("row")[lang_col])
    found = right.groupBy("lang_pred").agg(F.percentile_approx("per_gram", share, 10_000)).collect()  # a row for each language
    return {lang: max(0.0, least) for lang, least in found}
