"""The numbered operators against brute force, exact round trips and held-out accuracy, with awkward rows."""

import hashlib
import math
import random
import zlib
from functools import lru_cache
from pathlib import Path

import numpy as np
import pytest

pytest.importorskip("granary.llm")
P = pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from granary.llm import bpe, chat, dac, exact_dedup, lang_id, packing, quality_crf, queries, tokens  # noqa: E402
from granary.llm.tokens import LibraryEncoder  # noqa: E402
from granary.session import shared_folder  # noqa: E402

SF = "/root/testdata/sf0.001"
JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, bucket int"
ODD = [
    None, "", " ", "a", "the cat\n\n  sat   on\t the mat \n ", "x" * 5000, "it's we'll  \n don't", "don't" * 50, "   lead", "trail   ", "日本語 テキスト", "\x00 nul", "a \x1c b",
    "<|endoftext|> here", "é   nbsp", "\r\n\r\n", "𝒳𝒴 🙂 smile", "same text", "same text", "same\ttext ",
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns whose names clash."""
    rows = [(k, t, None if k % 3 else "en", None, None, "clash", 1) for k, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[3], (None, "null id", "en", None, None, None, None), (None, None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@lru_cache(1)
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(JSON)


def library(text):
    return tokenizer().encode(text, add_special_tokens=False).ids


def u32(ids):
    return np.array(ids, "<u4").tobytes()


def test_library_encoder_is_the_library(monkeypatch):
    texts = [t or "" for t in ODD] + [" ".join(f"w{k % 977}, {k}" for k in range(60_000)), "one<|endoftext|>two"]
    want = [u32(library(t)) for t in texts]
    assert LibraryEncoder(JSON).encode(texts) == want
    monkeypatch.setattr(tokens, "KEPT_BYTES", 2000)
    monkeypatch.setattr(tokens, "RUN", 500)
    small = LibraryEncoder(JSON)
    assert small.encode(texts) == want and small.size < 100_000
    small.forget()
    assert not small.kept and small.size == 0


def test_library_encoder_cuts_where_pre_tokens_end(monkeypatch):
    """Random mixtures of letters, marks, digits, short forms and white space of many kinds, with and without a special token between pieces."""
    rng = random.Random(3)
    some = ["a", "B", "é", "×", "÷", "ñ", "ɏ", "ɐ", "1", "23", "٣", "²", "'", "s", "t", "re", "ll", "'S", " ", " ", " ", "\n", "\t", "\r", "\xa0", "\x1c", "\x85", "\u3000"]
    some += [".", ",", "!!", "%", "-", "_", "`", "~", "[", "…", "“", "ß", "中", "文", "\u0301", "ж", "ˈ", "🙂", "<|endoftext|>"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randint(0, 25))) for _ in range(20_000)]
    want = [u32(x.ids) for x in tokenizer().encode_batch(texts, add_special_tokens=False)]
    encoder = LibraryEncoder(JSON)
    assert encoder.encode(texts) == want and encoder.encode(texts[:500]) == want[:500]
    encoder.forget()
    encoder.between = None
    assert encoder.encode(texts[:5000]) == want[:5000]
    monkeypatch.setattr(tokens, "JOINED", 1)
    assert LibraryEncoder(JSON).encode(texts[:5000]) == want[:5000]


def test_token_codes_random_access():
    ids = np.random.default_rng(1).choice([5, 200, 300, 50_256, 70_000, 2**24 + 7, 2**32 - 1], 5000).astype(np.uint32)
    codes = dac.Codes.from_bytes(dac.Codes.build([1, None], [ids[:3000], ids[3000:]]).to_bytes())
    assert (codes.ids() == ids).all() and all(codes.token(i) == ids[i] for i in range(0, 5000, 37))
    assert codes.offsets.tolist() == [0, 3000, 5000]


def test_token_codes_file(spark, odd, empty):
    path = shared_folder(spark)
    dac.write(odd, path, JSON, 2, parts=3)
    got = dac.read(spark, path).join(dac.bases(spark, path), ["part", "seq"]).withColumn("start", F.col("base") + F.col("at")).orderBy("start").collect()
    want = sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert [(r.doc_id, bytes(r.ids)) for r in got] == [(i, u32([*library(t), 2])) for i, t in want]
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got[:-1]]).tolist()
    dac.write(empty, path + "e", JSON, 2)
    assert dac.read(spark, path + "e").count() == 0


def test_token_codes_query(spark, docs):
    got = {r.doc_id: r for r in queries.op2_token_codes(spark, SF).collect()}
    start = 0
    for r in docs.orderBy("doc_id").collect():
        raw = u32([*library(r.text or ""), 2])
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (start, len(raw) // 4, zlib.crc32(raw))
        start += len(raw) // 4
    assert len(got) == docs.count()


@pytest.mark.parametrize("chunk,overlap", [(1 << 16, 1 << 12), (64, 32), (16, 12)])
def test_bpe_chunks(spark, odd, empty, chunk, overlap):
    from granary.llm.tokens import RankEncoder

    whole = RankEncoder(RANKS, P.PATTERN)
    coded = bpe.decode(bpe.encode(odd, RANKS, P.PATTERN, chunk=chunk, overlap=overlap), RANKS, P.PATTERN)
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    got = sorted(((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in coded.collect()), key=key)
    assert got == sorted(((r.doc_id, whole.encode(r.text or ""), (r.text or "").encode()) for r in odd.collect()), key=key)
    assert bpe.decode(bpe.encode(empty, RANKS, P.PATTERN), RANKS, P.PATTERN).count() == 0


def test_bpe_chunks_of_real_texts(spark, docs):
    few = docs.withColumn("text", F.concat_ws("\n", "text", "text", "text"))
    one = bpe.encode(few, RANKS, P.PATTERN).select("doc_id", F.sha2("ids", 256)).collect()
    assert sorted(one) == sorted(bpe.encode(few, RANKS, P.PATTERN, chunk=700, overlap=200).select("doc_id", F.sha2("ids", 256)).collect())


def test_bpe_of_a_very_long_text(spark):
    """20 MB of words with a run in the middle that no boundary cuts."""
    from granary.llm.tokens import RankEncoder

    text = " ".join(f"word{k % 977} {k}," for k in range(700_000))
    text += " " + "z" * 9000 + text + " end" + text[:1000]
    assert len(text) > 20_000_000
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    got = {r.doc_id: (bytes(r.ids), bytes(r.decoded)) for r in bpe.decode(bpe.encode(docs, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()}
    whole = RankEncoder(RANKS, P.PATTERN)
    assert got == {1: (whole.encode(text), text.encode()), 2: (whole.encode("short"), b"short")}


def test_packing(spark, monkeypatch, docs, odd, empty):
    for table in (docs, odd):
        rows = packing.pack(table, JSON, 1).collect()
        by_doc, by_sequence = {}, {}
        for r in rows:
            by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
            by_sequence.setdefault((r.sequence_id, r.sequence_size), []).append(r)
            assert len(r.ids) == 4 * r.length > 0
        padding = 0
        for (_, size), pieces in by_sequence.items():
            pieces.sort(key=lambda r: r.offset)
            assert [p.offset for p in pieces] == np.cumsum([0] + [p.length for p in pieces[:-1]]).tolist()
            total = sum(p.length for p in pieces)
            assert total <= size and (total == size or size == 2048) and size & (size - 1) == 0
            padding += size - total
        total = sum(r.length for r in rows)
        assert padding <= max(0.05 * total, 2048)
        assert total == sum(len(library(r.text or "")) + 1 for r in table.select("text").collect())
        for (doc, n), pieces in by_doc.items():
            if doc is not None and doc != 3:
                pieces.sort(key=lambda r: r.start)
                text = table.filter(F.col("doc_id") == doc).first().text if table is odd else None
                assert [p.start for p in pieces] == np.cumsum([0] + [p.length for p in pieces[:-1]]).tolist() and sum(p.length for p in pieces) == n
                assert text is None or b"".join(bytes(p.ids) for p in pieces) == u32([*library(text), 1])
        groups = {}
        for (_, size), pieces in by_sequence.items():
            groups[pieces[0].step_group] = groups.get(pieces[0].step_group, 0) + size
        assert max(groups.values()) <= packing.STEP
    # groups hold the same tokens in the same mix; batches fill them, and a task's last ones share what is left
    for batch, full in ((1 << 30, False), (40_000, True)):
        monkeypatch.setattr(packing, "BATCH", batch)
        rows = packing.pack(docs.coalesce(1), JSON, 1, step=8192).select("step_group", "sequence_id", "sequence_size").distinct().collect()
        sizes = {}
        for r in rows:
            sizes.setdefault(r.step_group, []).append(r.sequence_size)
        by_group = [sizes[g] for g in sorted(sizes)]
        assert len(by_group) > 5 and sum(sum(x) != 8192 for x in by_group) <= (max(2, len(by_group) // 3) if full else len(by_group)) and all(sum(x) <= 8192 for x in by_group)
        if not full:
            assert max(map(sum, by_group)) - min(map(sum, by_group)) <= 2048
    assert packing.pack(empty, JSON, 1).count() == 0


def test_binary_fuse():
    keys = np.random.default_rng(0).integers(0, 2**64, 30_000, dtype=np.uint64)
    for n in (0, 1, 2, 3, 10, 500, 20_000):
        f = exact_dedup.BinaryFuse.from_bytes(exact_dedup.BinaryFuse.build(keys[:n]).to_bytes())
        assert f.has(keys[:n]).all() and f.has(keys[20_000:]).mean() < 0.02


def test_exact_dedup(spark, odd, empty):
    for old in (F.lit(True), F.lit(False), F.col("doc_id") % 2 == 0):
        got = exact_dedup.exact_dedup(odd, old).collect()
        rows = [(r.doc_id, r.text or "") for r in odd.collect()]
        plain = lambda t: t.encode().translate(None, b" \t\n\x0b\x0c\r")
        want = []
        for i, t in rows:
            same = [(-len(u), j is None, j or 0) for j, u in rows if plain(u) == plain(t)]
            best = min(same)
            keep = None if best[1] else best[2]
            want.append((i, keep, len(same), i == keep, hashlib.sha256(plain(t)).hexdigest()))
        key = lambda x: (x[0] is None, x[0] or 0, x[4])
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest).hex()) for r in got), key=key) == sorted(want, key=key)
    assert exact_dedup.exact_dedup(empty, F.lit(True)).count() == 0


def test_exact_dedup_goes_by_its_filters(spark, monkeypatch):
    """Negatives never meet the snapshot; a screen that lets nothing through leaves the two sides apart."""
    rows = [(k, f"text {k}") for k in range(4000)] + [(k + 10_000, f"text{k}") for k in range(3990, 8000)] + [(20_000, "text 5"), (20_001, "text\t5")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    old, screen, seen = F.col("doc_id") < 4000, exact_dedup.screened, []

    def counted(*args, **kw):
        seen.append(screen(*args, **kw).count())
        return screen(*args, **kw)

    monkeypatch.setattr(exact_dedup, "screened", counted)
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs, old).collect()}
    assert 11 <= seen[0] <= 11 + 0.02 * 4000  # 10 texts and one group of two lie in the snapshot
    assert got[13_990].keep_id == 3990 and got[3990].group_size == 2 and got[20_001].keep_id == 5 and got[5].group_size == 3
    monkeypatch.setattr(exact_dedup, "screened", lambda *a, **k: screen(*a, **k).limit(0))
    apart = {r.doc_id: r for r in exact_dedup.exact_dedup(docs, old).collect()}
    assert apart[13_990].keep_id == 13_990 and apart[20_001].keep_id == 20_000 and apart[3990].group_size == 1


def test_exact_dedup_compares_bytes(spark, monkeypatch):
    """Equal digests of unequal texts stay apart, and a batch meets several snapshots."""
    monkeypatch.setattr(exact_dedup, "HOT_LEAST", 1)
    paths = [shared_folder(spark) for _ in range(2)]
    for path, text in zip(paths, ("one", "two"), strict=True):
        exact_dedup.write_snapshot(spark.createDataFrame([(1 if text == "one" else 2, text)], "doc_id long, text string"), path)
    batch = spark.createDataFrame([(3, "o ne"), (4, "two"), (5, "three"), (6, "three")], "doc_id long, text string")
    rows, new = exact_dedup.dedup(batch, paths)
    assert {(r.doc_id, r.keep_id, r.group_size, r.seen_before) for r in rows.collect()} == {(3, 3, 2, True), (4, 2, 2, True), (5, 5, 2, False), (6, 5, 2, False)}
    assert [x.count() for x in new] == [1, 1]
    broken = shared_folder(spark)
    kept = spark.read.parquet(f"{paths[0]}/groups")
    kept.withColumn("plain", F.lit("other bytes")).write.parquet(f"{broken}/groups")
    spark.read.parquet(f"{paths[0]}/filters").write.parquet(f"{broken}/filters")
    assert {r.seen_before for r in exact_dedup.dedup(batch, [broken])[0].collect()} == {False}


def brute_bayes(learn, texts):
    """Multinomial naive Bayes over hashed 2- and 3-grams, in plain loops: log likelihoods by language."""

    def slots(t):
        out, p = [], [ord(c) for c in t.lower()]
        for n in (2, 3):
            for a in range(len(p) - n + 1):
                h = n * 0x9E3779B1 & 0xFFFFFFFF
                for c in p[a : a + n]:
                    h = (h ^ c) * 0x85EBCA6B & 0xFFFFFFFF
                    h ^= h >> 15
                out.append(h % lang_id.BUCKETS)
        return out

    counts, n_docs = {}, {}
    for t, lang in learn:
        if t is not None and lang is not None:
            have = counts.setdefault(lang, {})
            n_docs[lang] = n_docs.get(lang, 0) + 1
            for s in slots(t):
                have[s] = have.get(s, 0) + 1
    out = []
    for t in texts:
        found, k = {}, slots(t)
        for lang, have in counts.items():
            total = sum(have.values()) + 0.5 * lang_id.BUCKETS
            found[lang] = math.log(n_docs[lang] / sum(n_docs.values())) + sum(math.log((have.get(s, 0) + 0.5) / total) for s in k)
        out.append(found)
    return out


@pytest.mark.parametrize("langs", [64, 1, 3])
def test_language_against_brute_force(spark, monkeypatch, langs):
    monkeypatch.setattr(lang_id, "LANGS", langs)  # blocks of languages
    learn = [("the cat sat", "en"), ("le chat noir", "fr"), ("el gato negro", "es"), ("die katze", "de"), ("the end", "en"), (None, "en"), ("nothing", None), ("el gato negro", "tie"), ("x" * 3000, "x")]
    model = lang_id.fit(spark.createDataFrame(learn, "text string, lang string"))
    texts = ["the black cat", "chat", "gato", "katze", "q", "ÀÉ", "le " * 2000, "el gato negro"]
    rows = [*enumerate(texts), (None, "the cat"), (3, "katze"), (50, None), (51, ""), (52, "12 !")]
    got = lang_id.predict(spark.createDataFrame(rows, "doc_id long, text string").withColumn("best", F.lit("clash")).withColumn("row", F.lit(1)), model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for (i, _), found in zip(enumerate(texts), brute_bayes(learn, texts), strict=True):
        best = max(sorted(found), key=lambda x: (round(found[x], 9), [-ord(c) for c in x]))
        assert by[i].lang_pred == best
        assert by[i].score == pytest.approx(1 / sum(math.exp(v - found[best]) for v in found.values()), abs=1e-9)
    assert by[None].lang_pred == "en" and {by[k].lang_pred for k in (50, 51, 52)} == {"und"} and {by[k].score for k in (50, 51, 52)} == {0}


def test_language(spark, docs, odd, empty):
    model = lang_id.fit(docs.filter(~queries.held("doc_id", 4)))
    found = lang_id.predict(docs, model, carry=True).filter(queries.held("row.doc_id", 4) & F.col("row.lang").isNotNull()).collect()
    assert np.mean([r.row.lang == r.lang_pred for r in found]) > 0.98
    by = {(r.doc_id): r for r in lang_id.predict(odd, model).collect()}
    assert len(by) == len(ODD) + 1 and {by[k].lang_pred for k in (0, 1, 2)} == {"und"} and all(0 <= r.score <= 1 for r in by.values())
    # a prediction doesn't depend on the rows beside it
    alone = {r.doc_id: r.score for r in lang_id.predict(odd.repartition(23), model).collect()}
    assert all(abs(alone[k] - by[k].score) < 1e-9 for k in by)
    assert {r.lang_pred for r in lang_id.predict(odd, lang_id.fit(empty)).collect()} == {"und"}
    assert lang_id.predict(empty, model).count() == 0


def test_held_out_is_never_null(spark, tmp_path):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    docs.limit(40).unionByName(spark.createDataFrame([(None, "a text without an id", "en", None, None)], docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for query in (queries.op8_language_id, queries.op10_quality_crf):
        got = {r.doc_id: r.held_out for r in query(spark, str(tmp_path)).collect()}
        assert len(got) == 41 and got[None] is False and None not in got.values()


def brute_chain(u, link):
    from itertools import product

    total, good = 0, np.zeros(len(u))
    for y in product((0, 1), repeat=len(u)):
        w = np.exp(sum(u[t] * y[t] for t in range(len(u))) + sum(link[a, b] for a, b in zip(y, y[1:], strict=False)))
        total += w
        good += w * np.array(y)
    return good / total


def test_marginals():
    rng = np.random.default_rng(3)
    n_lines = np.array([3, 1, 6, 2, 6])
    u, link = rng.normal(size=n_lines.sum()) * 2, rng.normal(size=(2, 2))
    p, (i, joint) = quality_crf.marginals(u, n_lines, link, pairs=True)
    cuts = np.cumsum(n_lines)[:-1]
    assert np.allclose(p, np.concatenate([brute_chain(x, link) for x in np.split(u, cuts)]))
    assert len(i) == (n_lines - 1).sum() and np.allclose(joint[:, 1].sum(axis=1), p[i])


def brute_quality(model, text):
    """A scalar scorer: features line by line, all label sequences weighed by a plain forward-backward, then the logistic curve."""
    import unicodedata

    def kind(c):
        cat = unicodedata.category(c) if ord(c) < 0x10000 else "So"
        if cat in ("Ll", "Lo", "Lm", "Mn", "Mc"):
            return "lower"
        if cat in ("Lu", "Lt"):
            return "upper"
        if cat in ("Nd", "Nl", "No"):
            return "digit"
        return "space" if cat[0] == "Z" or c in "\t\n\x0b\x0c\r" else "stop" if c in ".,;:!?'\"-()" else "symbol"

    lines, seen, bins = text.split("\n"), set(), []
    for line in lines:
        k = [kind(c) for c in line]
        n, size, words = k.count, max(len(line), 1), line.split()
        values = {
            "length": len(line), "upper": n("upper") / max(n("lower") + n("upper"), 1), "digit": n("digit") / size, "stop": n("stop") / size, "symbol": n("symbol") / size,
            "word": (len(line) - n("space")) / (n("space") + 1), "repeat": len(set(words)) / len(words) if words else 1,
            "end": 0 if not line else 1 if k[-1] == "stop" else 2, "again": float(line in seen and bool(words)),
        }
        seen.add(line)
        bins.append([sum(values[f] >= e for e in edges) for f, edges in quality_crf.EDGES.items()])
    w, none = model.weights.reshape(3, quality_crf.N, quality_crf.WIDTH), [quality_crf.WIDTH - 1] * quality_crf.N
    padded = [none, *bins, none]
    u = [sum(w[p, f, padded[t + p_at][f]] for p, p_at in ((0, 1), (1, 0), (2, 2)) for f in range(quality_crf.N)) for t in range(len(bins))]
    forward = [np.array([0.0, u[0]])]
    for x in u[1:]:
        forward.append(np.logaddexp(forward[-1][0] + model.link[0], forward[-1][1] + model.link[1]) + np.array([0.0, x]))
    backward = [np.zeros(2)]
    for x in reversed(u[1:]):
        backward.append(np.logaddexp(model.link[:, 0] + backward[-1][0], model.link[:, 1] + backward[-1][1] + x))
    p = [1 / (1 + math.exp(min(700, max(-700, (f + b)[0] - (f + b)[1])))) for f, b in zip(forward, reversed(backward), strict=True)]
    weight = [len(line) + 1 for line in lines]
    mean = min(max(sum(a * b for a, b in zip(p, weight, strict=True)) / sum(weight), 1e-6), 1 - 1e-6)
    return 1 / (1 + math.exp(-(model.slope * math.log(mean / (1 - mean)) + model.shift)))


def test_quality(spark, docs, odd, empty):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality_crf.fit(docs, labels.filter(~queries.held("doc_id", 4)))
    found = quality_crf.score(docs, model).filter(queries.held("doc_id", 4)).join(labels.filter("quality is not null"), "doc_id").collect()
    assert len(found) > 20 and np.mean([(r.score >= 0.7) == r.quality for r in found]) > 0.9
    got = quality_crf.score(odd, model).collect()
    assert len(got) == len(ODD) + 3 and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality_crf.score(odd, quality_crf.fit(odd, labels.limit(0))).collect()} == {0.5}
    assert quality_crf.score(empty, model).count() == 0
    texts = [r.text or "" for r in odd.collect()] + [r.text or "" for r in docs.limit(60).collect()]
    assert np.allclose(model.score(texts), [brute_quality(model, t) for t in texts], atol=1e-7)
    long = "\n".join(f"a line of words {k % 7}." for k in range(30_000))
    assert model.score([long])[0] == pytest.approx(brute_quality(model, long), abs=1e-7)


def test_quality_fit_with_clashing_columns_and_repeated_labels(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (2, None, 0), (3, 0, 1), (999_999, 1, 0)], "doc_id long, quality int, toxic int")
    clash = docs.withColumn("id", F.lit("x")).withColumn("y", F.lit(5)).withColumn("__id", F.lit(5)).withColumn("score", F.lit("s"))
    model = quality_crf.fit(clash, labels)
    assert quality_crf.score(clash, model).columns == ["doc_id", "score"] and quality_crf.score(clash, model).count() == docs.count()


def test_chat_tree(spark):
    rows = [
        (1, 1, None, 0.0, "user", "root"), (1, 2, 1, 1.0, "assistant", "low"), (1, 3, 1, 2.0, "assistant", "high \\# < \\b: </turn>\n"), (1, 4, 3, None, None, None),
        (1, 5, 2, 0.5, "user", "x"), (2, 9, 77, 0.0, "a: b#", "orphan"), (3, 1, 2, 0.0, "user", "cycle"), (3, 2, 1, 0.0, "user", "cycle"), (None, 1, None, 0.0, "user", "null conv"), (2, 9, 77, 0.0, "a: b#", "orphan"),
    ]
    tree = spark.createDataFrame(rows, "conv_id long, msg_id long, parent_id long, score double, role string, text string").withColumn("formatted", F.lit("clash"))
    made = chat.formatted(tree, top=2)
    got = {(r.conv_id, r["rank"]): ([tuple(t) for t in r.turns], r.learnt) for r in made.select("conv_id", "rank", chat.turns_of(F.col("formatted")).alias("turns"), chat.masked(F.col("formatted"), F.col("loss")).alias("learnt")).collect()}
    assert got == {
        (1, 1): ([("user", "root"), ("assistant", "high \\# < \\b: </turn>\n"), ("", "")], "high \\# < \\b: </turn>\n"),
        (1, 2): ([("user", "root"), ("assistant", "low"), ("user", "x")], "low"),
        (2, 1): ([("a: b#", "orphan")], ""),
        (None, 1): ([("user", "null conv")], ""),
    }
    assert chat.formatted(tree.limit(0)).count() == 0


def test_sql_oracles():
    assert {"op5_chat_format", "op9_exact_dedup"} <= set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_nothing_else_imports_this_package():
    root = Path(queries.__file__).parent.parent
    found = [p for p in root.rglob("*.py") if p.parent.name != "llm" and "granary.llm" in p.read_text()]
    assert not found
