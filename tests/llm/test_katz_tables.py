"""The stored Katz model: by brute force at two orders, read afresh, and without some of its rows."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("granary.llm")

from granary.llm import katz_lm, katz_tables  # noqa: E402
from granary.session import shared_folder  # noqa: E402

SCHEMA = "doc_id long, text string, word string, context string, rid long"


def texts(n=90):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(25)] + ["The", "the"] * 12
    some = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 40))) for _ in range(n)]
    return [*enumerate(some), (500, None), (501, ""), (None, "the the"), (3, "the again"), (502, "x y " * 30), (503, "q\tr " * 2000), (504, "q\tr " * 2000)]


def tokens(text):
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    return [*(text or "").translate(lower).split(), katz_tables.END]


def brute(train, order):
    """P(word after a history) by plain recursion."""
    counts = {k: defaultdict(Counter) for k in range(1, order + 1)}
    for text in train:
        t = tokens(text)
        padded = [katz_tables.START] * (order - 1) + t
        for at in range(order - 1, len(padded)):
            for k in counts:
                counts[k][tuple(padded[at - k + 1 : at])][padded[at]] += 1
    d = {}
    for k, table in counts.items():
        r, m = np.unique([n for x in table.values() for n in x.values()], return_counts=True)
        d[k] = katz_lm.discounts(katz_lm.small_counts(r, m), (r, m))
    total = sum(counts[1][()].values())
    cut = lambda k, n: d[k][n - 1] * n if n <= katz_lm.K else n
    free = sum(n - cut(1, n) for n in counts[1][()].values()) / total or 1.0

    def p(word, history):
        k = len(history) + 1
        seen = counts[k].get(history, {})
        if k == 1:
            return cut(1, seen[word]) / total if word in seen else free
        if not seen:
            return p(word, history[1:])
        n = sum(seen.values())
        keep = n / (n + len(seen)) if min(seen.values()) > katz_lm.K else 1.0
        mine = {w: cut(k, c) * keep / n for w, c in seen.items()}
        if word in mine:
            return mine[word]
        return (1 - sum(mine.values())) / (1 - sum(p(w, history[1:]) for w in seen)) * p(word, history[1:])

    return p, counts, free


@pytest.mark.parametrize("order", [1, 2, 3])
def test_stored_model(spark, order):
    rows = texts()
    df = spark.createDataFrame([(i, t, "clash", "clash", 1) for i, t in rows], SCHEMA)
    path = shared_folder(spark)
    katz_tables.write(df, path, order)
    p, counts, free = brute([t for _, t in rows], order)
    new = [(900, "the w1 w2 never seen"), (901, "w3 w4 w3 the the the w1"), (902, None)]
    got = katz_tables.score(df.unionByName(spark.createDataFrame([(i, t, "", "", 1) for i, t in new], SCHEMA)), path).collect()
    want = []
    for i, t in [*rows, *new]:
        padded = [katz_tables.START] * (order - 1) + tokens(t)
        want.append((i, len(tokens(t)), round(sum(math.log10(p(padded[at], tuple(padded[at - order + 1 : at]))) for at in range(order - 1, len(padded))), 6)))
    assert sorted(((r.doc_id, r.n_tokens, round(r.score, 6)) for r in got), key=str) == sorted(want, key=str)
    # every context's distribution sums to one, the unknown word counted once
    for history in list(counts[order])[:20]:
        assert abs(sum(p(w, history) for w in counts[1][()]) + p("never seen at all", history) - 1) < 1e-9


def test_scores_come_from_the_tables(spark):
    df = spark.createDataFrame([(k, "a b a b c") for k in range(8)] + [(9, "b a c c")], "doc_id long, text string")
    path, less = shared_folder(spark), shared_folder(spark)
    katz_tables.write(df, path, 2)
    for kind, k in (("ngrams", 1), ("ngrams", 2), ("contexts", 2)):
        rows = katz_tables.table(spark, path, kind, k)
        kept = rows.filter("not (context = 'a' and word = 'b')") if (kind, k) == ("ngrams", 2) else rows
        kept.write.partitionBy("bucket").parquet(f"{less}/{kind}/of={k}")
    spark.read.parquet(f"{path}/facts").write.parquet(f"{less}/facts")
    a, b = (katz_tables.score(df.filter("doc_id = 1"), x).first().score for x in (path, less))
    assert b < a - 0.1


def test_order_two_agrees_with_the_packed_model(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([r for r in texts(60) if r[0] is not None and r[0] != 3], "doc_id long, text string")
    path = shared_folder(spark)
    katz_tables.write(df, path, 2)
    one = {r.doc_id: round(r.score, 6) for r in katz_tables.score(df, path).collect()}
    two = {r.doc_id: round(r.score, 6) for r in katz_lm.katz(df, F.lit(False)).collect()}
    assert one == two


def test_empty_model(spark):
    empty, path = spark.createDataFrame([], "doc_id long, text string"), shared_folder(spark)
    katz_tables.write(empty, path, 2)
    assert katz_tables.score(empty, path).count() == 0
    assert katz_tables.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), path).first().score == 0
