"""Pieces, phrases and spelling variants against the library, SQL and brute force, with awkward rows."""

import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("granary.llm")
P = pytest.importorskip("public_tokenizers")

from granary.llm import phrases, pieces, queries, spelling  # noqa: E402

SF = "/root/testdata/sf0.001"
MODEL = P.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, word string, n long, seq binary, slot long"
ODD = [
    None, "", " ", "a", "  a  b ", "the cat\n\n  sat   on\t the mat \n ", "x" * 5000, " " * 3000, "▁a ▁", "日本語 テキスト", "a\x00b", "é x", "𝒳𝒴 🙂 smile", "<s> </s> <unk> <0x41>", "same text", "same text",
    "don't stop,now!!", "\r\n\r\n", "ab-cd_ef 12.5", ("Straße naïve word, " * 4000) + "end",
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, None if k % 3 else "en", "clash", 1, b"x", 7) for k, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[3], (None, "null id", "en", None, None, None, None), (None, None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@lru_cache(1)
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=MODEL)


def test_pieces(spark, docs, odd, empty):
    for rows in (docs, odd):
        got = pieces.decode(pieces.encode(rows, MODEL), MODEL).collect()
        want = [library().encode(r.text or "") for r in rows.collect()]
        assert sorted((r.doc_id or -1, r.ids, r.decoded) for r in got) == sorted((r.doc_id or -1, ids, library().decode(ids)) for r, ids in zip(rows.collect(), want, strict=True))
    assert pieces.decode(pieces.encode(empty, MODEL), MODEL).count() == 0
    assert pieces.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), MODEL).first().decoded == ""


def test_pieces_of_random_texts():
    model, rng = pieces.piece_model(MODEL), random.Random(7)
    some = [" ", "  ", "a", "e", "th", "er", "\n", "▁", "0", "12", ".", "'s", "中", "é", "\x00", "🙂", "    ", "<s>", "x" * 9, "​", "ab", "▁▁"]
    texts = ["".join(rng.choice(some if rng.random() < 0.5 else model.names[259:32000]) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    assert model.encode(texts).to_pylist() == library().encode(texts)
    # the search has to step back and to mark positions
    merged = [m for m in ("".join(rng.choice("etaoinsr") for _ in range(60)) for _ in range(300))]
    assert [model.spelt(x) for x in merged] == [[library().piece_to_id(p) for p in model.merged(x)] for x in merged]
    ids = [[rng.choice([rng.randrange(32000), rng.randrange(300)]) for _ in range(rng.randint(0, 12))] for _ in range(3000)]
    assert model.decode(pa.array(ids, pa.list_(pa.int32()))) == [library().decode(x) for x in ids]


def test_pieces_in_runs(monkeypatch):
    monkeypatch.setattr(pieces, "RUN", 50)
    monkeypatch.setattr(pieces, "KEPT_BYTES", 1000)
    monkeypatch.setattr(pieces, "KEPT_PAIRS", 20)
    model = pieces.PieceModel(MODEL)
    texts = [t or "" for t in ODD]
    assert model.encode(texts).to_pylist() == library().encode(texts)


def brute_phrases(rows, least, longest, share=100):
    counts, total = Counter(), Counter()
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            words = [w for w in re.split("[ \t]", piece) if w]
            total[lang] += len(words)
            counts.update((lang, *words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    frequent = {p: a for p, a in counts.items() if a >= least}
    out = []
    for (lang, *w), a in frequent.items():
        longer = [f for (x, *v), f in frequent.items() if x == lang and len(v) > len(w) > 1 and any(v[i : i + len(w)] == w for i in range(len(v)))]
        if len(w) > 1 and not any(100 * f >= share * a for f in longer):
            score, k = min((1000 * a * total[lang] // (counts[lang, *w[:k]] * counts[lang, *w[k:]]), k) for k in range(1, len(w)))
            out.append((lang, " ".join(w), a, counts[lang, *w[:k]], counts[lang, *w[k:]], total[lang], score))
    return sorted(out)


def found_phrases(docs, **how):
    return sorted((r.lang, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in phrases.phrases(docs, **how).collect())


def test_phrases(spark, docs, odd, empty, monkeypatch):
    rows = [(r.lang, r.text) for r in docs.limit(40).collect()]
    small = spark.createDataFrame(rows, "lang string, text string")
    want = brute_phrases(rows, 4, 5)
    assert len(want) > 20 and found_phrases(small, least=4, longest=5) == want
    assert found_phrases(small, least=4, longest=3, share=60) == brute_phrases(rows, 4, 3, 60)
    assert found_phrases(odd, least=2) == brute_phrases([(r.lang, r.text) for r in odd.collect()], 2, 5)
    assert found_phrases(empty) == []
    # several blocks of words and of candidates, several turns of the screen, sums over several levels
    for name, value in (("SLOTS", 300), ("FILTER", 1 << 10), ("CHUNK", 64), ("FAN", 2), ("GATHERED", 500)):
        monkeypatch.setattr(phrases, name, value)
    assert found_phrases(small.repartition(5), least=4, longest=5) == want


def test_rows_of_slots_are_read_once_for_all_blocks_and_counted_once_for_all_rounds(spark, docs, monkeypatch):
    reads, stored = spark.sparkContext.accumulator(0), phrases.materialize

    def tally(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    def counting(rows):
        rows = stored(rows)
        return rows.mapInArrow(tally, rows.schema) if "seq" in rows.columns and "text" not in rows.columns else rows

    small = spark.createDataFrame([(r.lang, r.text) for r in docs.limit(40).collect()], "lang string, text string").coalesce(1)
    monkeypatch.setattr(phrases, "materialize", counting)

    def read(**constants):
        before = reads.value
        with monkeypatch.context() as patched:
            for name, value in constants.items():
                patched.setattr(phrases, name, value)
            return found_phrases(small, least=4, longest=2), reads.value - before

    want, once = read()
    assert len(want) > 20 and read(SLOTS=50) == (want, once)
    # 4 rounds gather candidates, and nothing else is done again
    again, more = read(FILTER=1 << 10, CHUNK=1 << 10)
    assert again == want and more <= once + 3 * 40


def test_packed_counts():
    rng = np.random.default_rng(3)
    for size, kind in ((1, "<u4"), (1 << 10, "<u4"), (1 << 10, "<u8")):
        at = np.unique(rng.integers(0, 1 << 16, size))
        n = rng.integers(1, 1 << (31 if kind == "<u4" else 40), len(at))
        total = np.zeros(1 << 16, np.int64)
        for chunk, data in phrases.chunks(at, n, kind, 1 << 12):
            # what travels is in proportion to the places that occur, not to all places
            assert len(data) == 2 * np.dtype(kind).itemsize * ((at >> 12) == chunk).sum()
            total[chunk << 12 :][: 1 << 12] += phrases.added([data, data], kind, 1 << 12)
        assert (np.flatnonzero(total) == at).all() and (total[at] == 2 * n).all()


def test_keys_in_several_blocks(spark):
    keys = np.unique(np.random.default_rng(2).integers(0, 2**63, 4000, dtype=np.uint64))
    stored, part = keys[::2], phrases.ranges(keys[::2]) * np.uint64(3) // np.uint64(phrases.RANGES)
    built, base = {}, 0
    for p in (2, 0, 1):  # blocks are numbered as they come
        block = phrases.Keys(stored[part == p].copy(), base)
        built[p], base = spark.sparkContext.broadcast(block), base + len(block)
    of = phrases.Blocks(built, 3, base)
    got = of.slots(keys)
    assert sorted(got[::2]) == list(range(base)) and (got[1::2] == -1).all() and (of.keys(got[::2]) == stored).all()


def test_best_phrases(spark):
    rows = [("en", "b c", 9, 5), ("en", "a c", 9, 5), ("en", "é c", 9, 5), ("en", "z z", 10, 5), ("en", "y y", 9, 6), ("fr", "x x", 1, 1)]
    got = phrases.best(spark.createDataFrame(rows, "lang string, phrase string, a long, score long"), 4).collect()
    assert [(r.lang, r["rank"], r.phrase) for r in sorted(got, key=lambda r: (r.lang, r["rank"]))] == [("en", 1, "y y"), ("en", 2, "z z"), ("en", 3, "a c"), ("en", 4, "b c"), ("fr", 1, "x x")]


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000, dtype=np.uint64))
    made = phrases.Keys(keys[::2].copy(), base=10)
    got = made.slots(keys)
    assert sorted(got[::2]) == list(range(10, 10 + len(keys[::2]))) and (got[1::2] == -1).all()


def test_words_with_one_hash(monkeypatch):
    monkeypatch.setattr(phrases.Words, "hashed", staticmethod(lambda langs, words: np.full(len(words), 5, np.uint64)))
    made = phrases.Words(["en", "en", "fr"], [b"one", b"two", b"one"], [1, 2, 3])
    got = made.slots("en", pa.array([b"two", b"three", b"one"]))
    assert got[1] == -1 and [made.counts[got[0]], made.counts[got[2]]] == [2, 1] and made.counts[made.slots("fr", pa.array([b"one"]))[0]] == 3


def test_op12_against_sql(spark):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = db.sql(queries.ORACLE_SQL["op12_phrases"]).select(*columns).fetchall()
    assert sorted(tuple(r[c] for c in columns) for r in queries.op12_phrases(spark, SF).collect()) == sorted(want)


def brute_spelling(rows, every=199, shortest=6, least=5, ratio=5):
    counts = Counter()
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= shortest and c >= least}
    gaps = defaultdict(set)
    for w in n:
        for i in range(len(w) + 1):
            gaps[w[:i] + "\0" + w[i:]].add(w)
            if i < len(w):
                gaps[w[:i] + "\0" + w[i + 1 :]].add(w)
    near = defaultdict(set)
    for group in gaps.values():
        for w in group:
            near[w] |= group - {w}
    best = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: x for w, x in best.items() if n[x] >= ratio * n[w]}
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None)
    return out


def found_spelling(docs, **how):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(docs, **how).collect()}


def test_spelling(spark, docs, odd, empty):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_spelling(rows, every=7, least=2, ratio=2)
    assert sum(v[0] is not None for v in want.values()) > 20 and found_spelling(docs, every=7, least=2, ratio=2) == want
    assert found_spelling(docs) == brute_spelling(rows)
    assert found_spelling(odd, least=1, shortest=2) == brute_spelling([(r.doc_id, r.text) for r in odd.collect()], least=1, shortest=2)
    assert found_spelling(empty) == {}


def test_near_words_in_shards(spark):
    rng = random.Random(3)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randint(1, 7))) for _ in range(1500)}
    rows = spark.createDataFrame([(w, k) for k, w in enumerate(sorted(words))], "word string, n long")
    want = {(a, b) for a in words for b in words if a != b and brute_near(a, b)}
    for shard in (20_000, 25):  # with the small one most halves are hot
        got = [(r.a, r.b) for r in spelling.near(rows, shard).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def brute_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_wavelet_matrix():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 100):
        values = rng.permutation(n)
        ask = np.sort(rng.integers(0, n + 1, (50, 2)), axis=1)
        bound = np.sort(rng.integers(0, n + 1, (50, 2)), axis=1)
        q, v = spelling.WaveletMatrix(values).report(ask[:, 0], ask[:, 1], bound[:, 0], bound[:, 1])
        want = {(k, int(x)) for k in range(50) for x in values[ask[k, 0] : ask[k, 1]] if bound[k, 0] <= x < bound[k, 1]}
        assert set(zip(q.tolist(), v.tolist())) == want and len(q) == len(want)


def test_roots(spark):
    chain = [(f"w{k}", f"w{k + 1}" if k < 9 else None) for k in range(10)] + [("alone", None)]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {**{f"w{k}": "w9" for k in range(10)}, "alone": "alone"}
