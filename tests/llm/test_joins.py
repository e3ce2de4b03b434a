"""The joins, the language model and the pipeline against brute force, with awkward rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("granary.llm")

from pyspark.sql import functions as F  # noqa: E402

from granary.llm import graph, katz_lm, near_vectors, ngram_join, queries, words  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long, head string"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def joined(pairs, nodes):
    parent = {n: n for n in nodes}
    for a, b in pairs:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    return {n: find(parent, n) for n in nodes}


def brute_sets(texts, n):
    out = []
    for t in texts:
        w = WORD.findall((t or "").encode().lower())
        out.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    return out


def brute_join(rows, n, num, den):
    sets = brute_sets([t for _, t in rows], n)
    nodes = [i for i, _ in rows if i is not None]
    pairs = [(rows[a][0], rows[b][0]) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and None not in (rows[a][0], rows[b][0]) and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    comp = joined(pairs, nodes)
    return sorted(((i, len(s), comp.get(i)) for (i, _), s in zip(rows, sets, strict=True)), key=str)


def near_copies(seed=0):
    """Families of near copies of many degrees, tiny texts, exact copies, shared passages, a repeated id, nulls."""
    rng = random.Random(seed)
    word = lambda: rng.choice("ab cd ef gh ij kl mn op qr st uv wx yz".split()) + str(rng.randrange(60))
    shared = " ".join(word() for _ in range(40))
    texts = [None, "", "  ", "one", "One", "two words", "two  WORDS", "three little words", "THREE\tlittle\nwords", "é à", "É à"]
    for _ in range(12):
        base = [word() for _ in range(rng.choice([4, 9, 12, 30, 80, 150]))]
        texts.append(" ".join(base))
        for _ in range(rng.choice([1, 2, 9])):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts += [shared + " " + " ".join(word() for _ in range(k)) for k in (0, 1, 3, 5, 8, 20, 60)]
    rows = list(enumerate(texts)) + [(5, texts[30]), (7, texts[7]), (None, texts[30]), (None, None)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, 1, "clash") for i, t in rows], DOCS)


@pytest.mark.parametrize("n,num,bucket,split,part", [(3, 90, 400_000, 400_000, 256), (5, 80, 20, 2, 2), (2, 60, 50, 3, 3)])
def test_ngram_join(spark, monkeypatch, n, num, bucket, split, part):
    monkeypatch.setattr(ngram_join, "PART", part)
    rows = near_copies(n)
    got = sorted((tuple(r) for r in ngram_join.ngram_join(frame(spark, rows), n, num, 100, bucket=bucket, split=split).collect()), key=str)
    assert got == brute_join(rows, n, num, 100)


def test_ngram_join_of_nothing(spark):
    for rows in ([], [(1, None)], [(1, "a b c d e f")]):
        assert ngram_join.ngram_join(frame(spark, rows)).count() == len(rows)


def test_ngram_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in queries.op3_ngram_join(spark, SF).collect()), key=str) == brute_join(rows, 3, 90, 100)


def test_word_hashes():
    texts = [b"The cat the CAT \xc3\x89", b"", b"  ", b"cat"]
    h, n = words.word_hashes(texts)
    assert n.tolist() == [5, 0, 0, 1] and h[0] == h[2] and h[1] == h[3] == h[5] and len(set(h.tolist())) == 3
    assert words.word_hashes([b"x cat"])[0][1] == h[1]


def test_block_skipping_finds_all_pairs(monkeypatch):
    rng = np.random.default_rng(5)
    n = 900
    e = {"side": np.zeros(n, int), "node": np.arange(n), "head": np.arange(n), "size": rng.integers(20, 60, n), "place": rng.integers(0, 8, n), "shingle": rng.integers(0, 3, n)}
    found = []
    for size in (10_000, 16):
        monkeypatch.setattr(ngram_join, "BLOCK", size)
        found.append(sorted({tuple(sorted(p)) for i, j in ngram_join.list_pairs(e, 90, 100) for p in zip(i.tolist(), j.tolist(), strict=True)}))
    assert found[0] == found[1] and found[0]


def test_components(spark):
    rng = random.Random(1)
    pairs = [(k, k + 1) for k in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(5, 5), (1000, 3)]
    want = joined([p for p in pairs if p[0] != p[1]], sorted({x for p in pairs for x in p}))
    got = {r.node: r.component for r in graph.components(spark.createDataFrame([*pairs, (None, 1)], "a long, b long")).collect()}
    assert got == {k: v for k, v in want.items() if any(k in p and p[0] != p[1] for p in pairs)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("tile", [1536, 20])
def test_near_vectors(spark, tile):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(25, 12))
    vectors = [(b + rng.normal(size=12) * s).tolist() for b in base for s in (0, 0, 0.05, 0.1, 0.15, 0.2)]
    rows = [(k, v, k // 6 % 3) for k, v in enumerate(vectors)]
    rows += [(1000, None, 1), (1001, [0.0] * 12, 1), (1002, [float("nan")] * 12, 1), (1003, [1.0, None], 1), (1004, vectors[0], None), (1005, [], 1), (1006, [1.0, 2.0], 0), (1007, [2.0, 4.0], 0), (None, vectors[0], 0), (1008, [-0.0, 1.0], 0), (1009, [0.0, 1.0], 0), (1009, [0.0, 1.0], 0)]
    ok = [(i, np.array(v, np.float32).astype(float), c) for i, v, c in rows if v and i is not None and c is not None and None not in v and np.isfinite(v).all() and any(v)]
    links, pairs = Counter(), []
    for a in range(len(ok)):
        for b in range(a):
            (i, x, c), (j, y, d) = ok[a], ok[b]
            if c == d and len(x) == len(y) and x @ y / (math.sqrt(x @ x) * math.sqrt(y @ y)) >= 0.93:
                links[a] += 1
                links[b] += 1
                pairs.append((i, j))
    comp = joined(pairs, [i for i, _, _ in rows if i is not None])
    want = Counter((i, links[k], comp[i], comp[i] == i) for k, (i, _, _) in enumerate(ok))
    want += Counter((i, 0, i, None if i is None else True) for i, v, c in rows if not any(i == o[0] for o in ok))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("key", F.lit("clash"))
    assert Counter(tuple(r) for r in near_vectors.near_vectors(df, 0.93, tile=tile).collect()) == want
    assert near_vectors.near_vectors(df.limit(0)).count() == 0


def test_near_vectors_longer_than_the_axes(spark, monkeypatch):
    """Long vectors are turned onto the leading axes alone; the links stay the same."""
    rng = np.random.default_rng(7)
    base = rng.normal(size=(12, 40))
    rows = [(k, (base[k % 12] + rng.normal(size=40) * 0.02 * (k // 12)).tolist(), 0) for k in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want = sorted(tuple(r) for r in near_vectors.near_vectors(df, 0.93).collect())
    monkeypatch.setattr(near_vectors, "WIDE", 16)
    monkeypatch.setattr(near_vectors, "NARROW", 10)
    assert sorted(tuple(r) for r in near_vectors.near_vectors(df, 0.93, tile=9).collect()) == want and any(r[1] for r in want)


def test_tiles_that_cannot_link_never_meet(spark):
    """Tiles of groups far apart are dropped before anything is joined."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 24))
    rows = [(k, (centres[k % 40] + rng.normal(size=24) * 0.01).tolist(), 0) for k in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    classes = near_vectors.prepared(df, "vec_id", "embedding", "label").groupBy("label", "key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).withColumn("node", F.col("rep"))
    axes = near_vectors.principal_axes(classes)
    packed = near_vectors.packed_tiles(near_vectors.tiled(classes, axes, 0.374, 50), axes).cache()
    n, met = packed.count(), near_vectors.tile_pairs(packed, 0.14).count()
    assert n >= 40 and met < n * (n + 1) / 8


def brute_katz(rows, held):
    toks = [[*WORD.findall((t or "").encode().lower()), None] for _, t in rows]
    train = [t for (i, _), t in zip(rows, toks, strict=True) if not held(i)]
    one, two = Counter(w for t in train for w in t), defaultdict(Counter)
    for t in train:
        for h, w in zip(["start", *t], t, strict=False):
            two[h][w] += 1
    total, k = sum(one.values()), katz_lm.K
    cc = lambda values: np.array([0] + [sum(v == r for v in values) for r in range(1, k + 2)])
    d1, d2 = katz_lm.discounts(cc(list(one.values()))), katz_lm.discounts(cc([v for x in two.values() for v in x.values()]))
    cut = lambda c, d: d[c - 1] * c if c <= k else c
    free = sum(c - cut(c, d1) for c in one.values())
    p1 = lambda w: cut(one[w], d1) / total if w in one else free / total if free else 1.0
    keep, back = {}, {}
    for h, x in two.items():
        n = sum(x.values())
        keep[h] = n / (n + len(x)) if min(x.values()) > k else 1.0
        back[h] = (1 - sum(cut(v, d2) * keep[h] / n for v in x.values())) / (1 - sum(map(p1, x)))
        if len(x) < len(one):
            assert abs(sum(cut(v, d2) * keep[h] / n for v in x.values()) + back[h] * (sum(p1(w) for w in one if w not in x) + free / total) - 1) < 1e-9
    out = []
    for (i, _), t in zip(rows, toks, strict=True):
        s = 0.0
        for h, w in zip(["start", *t], t, strict=False):
            x = two.get(h, {})
            s += math.log10(p1(w) if not x else cut(x[w], d2) * keep[h] / sum(x.values()) if w in x else back[h] * p1(w))
        out.append((i, bool(held(i)), len(t), sum(w in one for w in t), total, round(sum(math.log10((one[w] + 1) / (total + len(one) + 1)) for w in t), 6), round(s, 6)))
    return sorted(out, key=str)


@pytest.mark.parametrize("small", [False, True])
def test_katz(spark, small):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(40)] + ["The", "the"] * 20
    rows = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 60)))) for k in range(120)] + [(500, None), (501, ""), (None, "the the"), (3, "the again"), (502, "x y " * 30), (503, "q r " * 3000)]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    options = {"words": 1, "pairs": 40, "hot": 50, "block": 300} if small else {}
    got = katz_lm.katz(frame(spark, rows).repartition(5), queries.fold("doc_id", 7) == 2, **options).collect()
    assert sorted(((*r[:5], round(r[5], 6), round(r[6], 6)) for r in got), key=str) == brute_katz(rows, held)


def plain_good_turing(counts):
    """Simple Good-Turing in plain loops: smoothed counts of counts, then the Katz formula."""
    n = Counter(counts)
    seen = sorted(n)
    points = []
    for k, r in enumerate(seen):
        below = seen[k - 1] if k else 0
        above = seen[k + 1] if k + 1 < len(seen) else 2 * r - below
        points.append((math.log(r), math.log(n[r] / (0.5 * (above - below)))))
    b = np.polyfit(*zip(*points, strict=True), 1)[0]
    smooth = lambda r: r**b
    a = 6 * smooth(6) / smooth(1)
    return np.array([((r + 1) * smooth(r + 1) / smooth(r) / r - a) / (1 - a) for r in range(1, 6)])


def test_katz_keeps_good_turing(spark, monkeypatch):
    """Copied documents make the plain Good-Turing discount of a count exceed 1, as in the given tables."""
    rng = random.Random(9)
    word = lambda: f"w{int(rng.paretovariate(0.7))}"
    texts = [" ".join(word() for _ in range(rng.randrange(5, 40))) for _ in range(70)]
    rows = list(enumerate(texts + texts[:12] * 4))
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    toks = [[*t.encode().split(), None] for i, t in rows if not held(i)]
    want = []
    for counts in (Counter(w for t in toks for w in t), Counter(p for t in toks for p in zip(["start", *t], t, strict=False))):
        n = Counter(counts.values())
        a = 6 * n[6] / n[1]
        plain = [((r + 1) * n[r + 1] / n[r] / r - a) / (1 - a) for r in range(1, 6)]
        assert not all(0 < d < 1 for d in plain)
        want.append(plain_good_turing(counts.values()))
        assert all(0 < d < 1 for d in want[-1])
    got = katz_lm.katz(frame(spark, rows), queries.fold("doc_id", 7) == 2, words=50, pairs=200).collect()
    told = iter(want)
    monkeypatch.setattr(katz_lm, "discounts", lambda _: next(told))
    assert sorted(((*r[:5], round(r[5], 6), round(r[6], 6)) for r in got), key=str) == brute_katz(rows, held)


def test_katz_of_nothing(spark):
    assert katz_lm.katz(frame(spark, []), F.lit(False)).count() == 0
    got = katz_lm.katz(frame(spark, [(1, "a b")]), F.lit(True)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.score) for r in got] == [(3, 0, 0, 0.0)]


def test_pack_round_trip():
    a = {"x": np.array([0, 1, 255, 256, 2**62]), "y": np.array([0.5, -1.0]), "z": np.empty(0, np.int64)}
    got = katz_lm.unpack(katz_lm.pack(**a))
    assert all((got[k] == v).all() and len(got[k]) == len(v) for k, v in a.items())


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, "12 34 !!", "en", "s", 8), (None, "A text without an id, of plain words.", None, None, None)], docs.schema)
    docs = docs.unionByName(odd)
    for name in ("digest", "score", "lang_pred", "per_gram", "__id", "__digest", "__old", "__text", "row", "name", "size", "a.b"):
        docs = docs.withColumn(name, F.lit("clash"))
    kept, before = {}, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in p.STAGES[:-1]:
        after = stage(spark, docs, SF).cache()
        assert after.columns == docs.columns and 0 < after.count() <= docs.count()
        kept[name], docs = {r.doc_id: r.text for r in after.collect()}, after
    assert not {9001, 9002, 9003} & set(kept["language"])
    plain = [re.sub("[\x20\x09-\x0d]", "", t or "") for t in kept["exact_copies"].values()]
    assert len(set(plain)) == len(plain) == len({re.sub("[\x20\x09-\x0d]", "", t or "") for t in kept["language"].values()})
    rows = sorted((x for x in kept["exact_copies"].items() if x[0] is not None))
    comp = brute_join(rows, 5, 80, 100)
    assert {i for i in kept["near_copies"] if i is not None} == {i for i, _, c in comp if i == c}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert len([i for i in good if i in kept["quality"]]) >= 0.97 * len(good)
    bad = [i for i, q in labels.items() if q == 0 and i in before]
    assert len([i for i in bad if i not in kept["quality"]]) >= 0.9 * len(bad)
    pieces = p.STAGES[-1][1](spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == len(kept["near_copies"])
    empty = docs.limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_near_copies_take_a_repeated_id_as_one_document(spark):
    import corpus_pipeline as p

    text = " ".join(f"w{k}" for k in range(40))
    rows = [(1, text), (2, text + " end"), (2, "quite another text of some words"), (3, "alone among all of these rows"), (3, "alone among all of these rows"), (None, text), (4, "x " * 300_000 + "end")]
    got = p.near_copies(spark, frame(spark, rows), SF).select("doc_id").collect()
    assert Counter(r.doc_id for r in got) == Counter({1: 1, 3: 2, None: 1, 4: 1})


def test_language_stage_rejects_foreign_texts_and_noise(spark):
    import base64

    import corpus_pipeline as p

    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    odd = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
        "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心,并应以兄弟关系的精神相对待。",
        " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 10))) for _ in range(60)),
        base64.b64encode(rng.randbytes(400)).decode(),
    ]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    planted = spark.createDataFrame([(10**9 + 100 * k + j, t, None, None, None) for k, t in enumerate(odd) for j in range(8)], docs.schema)
    kept = {r.doc_id for r in p.language(spark, docs.unionByName(planted), "").select("doc_id").collect()}
    assert not [i for i in kept if i >= 10**9]
    for held in (True, False):
        clean = [r.doc_id for r in docs.filter("lang is not null and text is not null").select("doc_id").collect() if (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == held]
        assert sum(i in kept for i in clean) >= 0.98 * len(clean)


def test_families_send_only_what_their_heads_leave_open(spark, monkeypatch):
    """A family whose members are all linked with its head needs no comparison; many near copies give rows in proportion."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = []
    for k in range(400):
        copy = list(base)
        copy[rng.randrange(len(copy))] = f"new{k}"
        rows.append((k, " ".join(copy)))
    sent, spanning = spark.sparkContext.accumulator(0), ngram_join.spanning

    def counted(x, y, *rest):
        sent.add(len(x))
        return spanning(x, y, *rest)

    monkeypatch.setattr(ngram_join, "spanning", counted)
    got = ngram_join.ngram_join(frame(spark, rows), 3, 90, 100).collect()
    assert {r.component_id for r in got} == {0} and sent.value <= len(rows)
