"""A Katz backoff bigram model over words: trained, stored and evaluated where the rows lie.

Good-Turing discounts are taken from the counts of counts of the whole corpus, smoothed
by a log-linear fit; what they free is backed off to the discounted unigrams with weights that make
every context's distribution sum to one exactly. A text is scored token by
token: the discounted bigram if it was seen, else the context's weight times the unigram,
else, for a context never seen, the unigram alone; an unknown word has the mass that
the unigrams' discounts free.

Nothing of the corpus passes through the driver but sums: of fixed length, and of how many words or
pairs have each count, of which a corpus of N tokens has less than the root of 2 N.

1. Each block of documents (a run of rows of a scan task) sends its distinct words with their
   training counts to buckets of words; buckets return numbers and counts.
2. Each block, with these, turns its texts into word pairs, packed by buckets of contexts.
   A context with a very large count is spread over buckets by its next word.
3. Each bucket counts its pairs over the training documents: the model's bigram
   table, written in partitions beside sums for each document (how often
   which count occurs in it) and the pairs that need a backoff weight.
4. With the discounts known, weights and sums give each document's score.

Very long texts lie whole in one block. Null texts count as empty: one token, the end. Null ids belong to training, and repeated ids
are scored each. Without training texts every score is that of unknown words. An
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import json
import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.words import mix, runs, word_hashes
from granary.session import materialize

#: Counts up to this are discounted.
K = 5
#: Distinct words of a bucket of words, and pairs of a bucket of contexts, about.
WORDS, PAIRS = 300_000, 1_500_000
#: Code points of a block, about.
BLOCK = 8_000_000
#: A context that occurs more often is spread over buckets; the number of such contexts is N / HOT at most, and HOT at least N / 100,000.
HOT = 500_000
END = mix(np.array([0xE0F], np.uint64))[0]
UNKNOWN, START, FIRST = 0, 1, 2


def pack(**arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers from 0 on (or of doubles) as compressed byte planes."""
    head, parts = [], []
    for name, a in arrays.items():
        if a.dtype.kind == "f":
            width, raw = 0, a.astype("<f8").tobytes()
        else:
            width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
            raw = np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
        head.append([name, len(a), width])
        parts.append(raw)
    top, body = json.dumps(head).encode(), b"".join(parts)
    return struct.pack("<IQ", len(top), len(body)) + top + pa.compress(body, codec="zstd", asbytes=True)


def unpack(blob: bytes) -> dict[str, np.ndarray]:
    n, size = struct.unpack_from("<IQ", blob)
    head, body, at, out = json.loads(blob[12 : 12 + n]), pa.decompress(blob[12 + n :], size, codec="zstd", asbytes=True), 0, {}
    for name, length, width in head:
        if width:
            wide = np.zeros((length, 8), np.uint8)
            wide[:, :width] = np.frombuffer(body, np.uint8, length * width, at).reshape(width, length).T
            out[name] = wide.reshape(-1).view("<i8")
            at += length * width
        else:
            out[name] = np.frombuffer(body, "<f8", length, at)
            at += 8 * length
    return out


def counted(n: np.ndarray) -> dict[str, np.ndarray]:
    """The counts above 0 that occur in n, in order, and how often each does."""
    r, m = np.unique(n[n > 0], return_counts=True)
    return {"r": r.astype(np.int64), "m": m.astype(np.int64)}


def summed(found: list[dict[str, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The counts of many buckets as one."""
    r, at = np.unique(np.concatenate([np.empty(0, np.int64), *[x["r"] for x in found]]), return_inverse=True)
    return r, np.bincount(at, np.concatenate([np.empty(0, np.int64), *[x["m"] for x in found]]), len(r)).astype(np.int64)


def small_counts(r: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Counts of counts 0 to K + 1 (0 for 0)."""
    return np.bincount(r[r <= K + 1], m[r <= K + 1], K + 2).astype(np.int64)


def slope(r: np.ndarray, m: np.ndarray) -> float:
    """Of the logarithm of counts of counts over that of counts, each spread over the gap around its count (Gale and Sampson)."""
    before = np.append(0, r[:-1])
    after = np.append(r[1:], 2 * r[-1] - before[-1])
    x, y = np.log(r), np.log(2 * m / (after - before))
    return float(((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum())


def discounts(n: np.ndarray, whole: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Katz discounts of the counts 1 to K from the counts of counts n[0..K+1] (n[0] unused).

    Simple Good-Turing: counts of counts are those of a line fitted to the logarithms of all of
    them (whole: each count and how often it occurs; without it, those of n). A line steeper than -1 always gives valid
    discounts. Where one of the counts 1 to K + 1 doesn't occur or the line is flatter (tiny or odd corpora),
    absolute discounting of n1 / (n1 + 2 n2), held between 0.1 and 0.9, takes its place.
    """
    n, r = np.asarray(n, float), np.arange(1, K + 1)
    if (n[1 : K + 2] > 0).all():
        power = slope(*(whole or (np.arange(1, K + 2), n[1 : K + 2]))) + 1
        if power < 0:
            return 1 - np.expm1(power * np.log1p(1 / r)) / np.expm1(power * np.log(K + 1))
    d = min(max(n[1] / (n[1] + 2 * n[2]), 0.1), 0.9) if n[1] + n[2] > 0 else 0.5
    return (r - d) / r


def discounted(count: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.concatenate([[0.0], d])[np.minimum(count, K) * (count <= K)] * count * (count <= K) + count * (count > K)


class Unigrams:
    """Discounted unigram probabilities by a word's count; count 0 is the unknown word."""

    def __init__(self, total: int, counts_of_counts: np.ndarray, whole: tuple[np.ndarray, np.ndarray] | None = None):
        self.total, self.d = total, discounts(counts_of_counts, whole)
        freed = float((counts_of_counts[1 : K + 1] * np.arange(1, K + 1) * (1 - self.d)).sum())
        self.unknown = freed / total if total and freed else 1.0

    def __call__(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, discounted(count, self.d) / max(self.total, 1), self.unknown)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words with an end behind each text, and tokens of each text."""
    hashes, counts = [], []
    for a, b in runs(texts):
        h, c = word_hashes(texts[a:b])
        hashes.append(np.insert(h, np.cumsum(c), END))
        counts.append(c + 1)
    return (np.concatenate(hashes), np.concatenate(counts)) if hashes else (np.empty(0, np.uint64), np.empty(0, np.int64))


def raw_texts(column: pa.Array) -> list[bytes]:
    return pc.fill_null(column, "").cast(pa.binary()).to_pylist()


def block_words(rows: DataFrame, bits: int) -> DataFrame:
    """bucket, block, payload (words: sorted hashes; n: their training counts) of each block."""

    def made(block: int, parts: list) -> pa.RecordBatch:
        word, at = np.unique(np.concatenate([w for w, _ in parts]), return_inverse=True)
        n = np.bincount(at, np.concatenate([n for _, n in parts]), len(word)).astype(np.int64)
        cuts = np.searchsorted((word >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(word), np.int64), np.arange((1 << bits) + 1))
        out = [(k, block, pack(words=word[a:b], n=n[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["bucket", "block", "payload"])

    def work(batches):
        now, parts = None, []
        for batch in batches:
            for a, b in ranges(batch.column(0).to_numpy()):  # the rows of a block follow each other
                some = batch.slice(a, b - a)
                block = some.column(0)[0].as_py()
                if block != now and parts:
                    yield made(now, parts)
                    parts = []
                now = block
                h, c = tokens(raw_texts(some.column(3)))
                train = np.repeat(np.array(some.column(2).to_pylist(), bool), c)
                word, at = np.unique(h, return_inverse=True)
                parts.append((word, np.bincount(at[train], minlength=len(word))))
        if parts:
            yield made(now, parts)

    return rows.mapInArrow(work, "bucket long, block long, payload binary")


def numbered(words: DataFrame, bits: int) -> DataFrame:
    """For each bucket and block, payload (id, n of each of the block's words there); and at block -1 the bucket's counts of counts."""

    def work(key, found):
        bucket = key[0].as_py()
        blocks = found.column("block").to_pylist()
        parts = [unpack(p) for p in found.column("payload").to_pylist()]
        lengths = [len(p["words"]) for p in parts]
        word, at = np.unique(np.concatenate([p["words"] for p in parts]).view(np.uint64), return_inverse=True)
        n = np.bincount(at, np.concatenate([p["n"] for p in parts]), len(word)).astype(np.int64)
        known = n > 0
        ids = np.where(known, FIRST + (np.cumsum(known) - 1) * (1 << bits) + bucket, UNKNOWN)
        out = [pack(id=ids[x], n=n[x]) for x in np.split(at, np.cumsum(lengths)[:-1])]
        sums = np.array([n.sum(), known.sum()])
        return pa.table({"bucket": pa.array([bucket] * (len(out) + 1), pa.int64()), "block": pa.array([*blocks, -1], pa.int64()), "payload": pa.array([*out, pack(sums=sums, **counted(n))], pa.binary())})

    return words.groupBy("bucket").applyInArrow(work, "bucket long, block long, payload binary")


def paired(rows: DataFrame, numbers: DataFrame, buckets: int, hot: int, unigrams: Unigrams, n_words: int, n_docs: int) -> DataFrame:
    """bucket, block, payload: the pairs of each block by buckets of contexts, and at bucket -1 - block its documents."""

    def work(key, left, right):
        if not left.num_rows:
            return pa.table({"bucket": pa.array([], pa.int64()), "block": pa.array([], pa.int64()), "payload": pa.array([], pa.binary())})
        block = key[0].as_py()
        h, c = tokens(raw_texts(left.column("text").combine_chunks()))
        train = np.array(left.column("train").to_pylist(), bool)
        _, at = np.unique(h, return_inverse=True)
        got = sorted(zip(right.column("bucket").to_pylist(), right.column("payload").to_pylist(), strict=True))
        parts = [unpack(p) for _, p in got]  # buckets are ranges of hashes, so their words follow the order of the block's
        ids, n = (np.concatenate([p[x] for p in parts])[at] for x in ("id", "n"))
        first = np.concatenate([[0], np.cumsum(c)[:-1]])
        before, before_n = np.concatenate([[START], ids[:-1]]), np.concatenate([[n_docs], n[:-1]])
        before[first], before_n[first] = START, n_docs
        doc = np.repeat(np.arange(len(c)), c)
        total = unigrams.total
        base = np.log10((n + 1) / (total + n_words + 1))
        known = before_n > 0
        own = np.where(known, -np.log10(np.maximum(before_n, 1)), np.log10(unigrams(n)))
        add = lambda x: np.add.reduceat(x, first)
        doc_ids = left.column("doc_id").to_pylist()
        info = pack(id=np.array([zigzag(i) for i in doc_ids], np.uint64), null=np.array([i is None for i in doc_ids], np.int64), held=(~train).astype(np.int64), tokens=c, known=add((n > 0).astype(np.int64)), base=add(base), own=add(own))
        made = [(-1 - block, block, info)]
        b, w, bn, wn, doc = before[known], ids[known], before_n[known], n[known], doc[known]
        spread = np.maximum(1, -(-bn // hot))
        where = ((b + w % spread * 7919) % buckets).astype(np.int64)
        order = np.lexsort((w, b, where))
        b, w, bn, wn, doc, where = (x[order] for x in (b, w, bn, wn, doc, where))
        for a, z in ranges(where):
            run = np.flatnonzero(np.concatenate([[True], np.diff(b[a:z]) != 0]))
            made.append((int(where[a]), block, pack(h=b[a:z][run], hn=bn[a:z][run], run=np.diff(np.append(run, z - a)), w=w[a:z], wn=wn[a:z], doc=doc[a:z] * 2 + train[doc[a:z]])))
        return pa.table({c: pa.array(x, t) for c, x, t in zip(("bucket", "block", "payload"), zip(*made, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)})

    return rows.groupBy("block").cogroup(numbers.groupBy("block")).applyInArrow(work, "bucket long, block long, payload binary")


def ranges(sorted_keys: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of equal keys."""
    if not len(sorted_keys):
        return []
    cuts = np.flatnonzero(np.diff(sorted_keys)) + 1
    return list(zip(np.concatenate([[0], cuts]).tolist(), np.append(cuts, len(sorted_keys)).tolist(), strict=True))


def zigzag(i: int | None) -> int:
    return 0 if i is None else (i << 1 ^ i >> 63) & (2**64 - 1)


def model_tables(pairs: DataFrame, unigrams: Unigrams, hot: int) -> DataFrame:
    """kind, key, payload: what each bucket of contexts knows.

    bigrams: h, run, w and count of each pair seen in training. sums: for each document of a
    block how often pairs of each small count occur, and the sum of the logarithms of counts.
    backoff: for contexts, their statistics and the unseen pairs that need a weight. hot: the part of
    a spread context's statistics. counts: counts of counts. documents: passed through.
    """

    def work(key, found):
        bucket = key[0].as_py()
        if bucket < 0:
            return rows_of([("documents", b, p) for b, p in zip(found.column("block").to_pylist(), found.column("payload").to_pylist(), strict=True)])
        blocks = found.column("block").to_pylist()
        parts = [unpack(p) for p in found.column("payload").to_pylist()]
        size = [len(p["w"]) for p in parts]
        h = np.concatenate([np.repeat(p["h"], p["run"]) for p in parts])
        hn = np.concatenate([np.repeat(p["hn"], p["run"]) for p in parts])
        w, wn, doc = (np.concatenate([p[x] for p in parts]) for x in ("w", "wn", "doc"))
        block = np.repeat(np.arange(len(parts)), size)
        order = np.lexsort((w, h))
        h, hn, w, wn, doc, block = (x[order] for x in (h, hn, w, wn, doc, block))
        new = np.concatenate([[True], (np.diff(h) != 0) | (np.diff(w) != 0)])
        pair = np.cumsum(new) - 1
        r = np.bincount(pair, doc & 1).astype(np.int64)  # training count of each distinct pair
        ph, pw, pwn, phn = h[new], w[new], wn[new], hn[new]
        seen = r > 0
        out = []
        run = np.flatnonzero(np.concatenate([[True], np.diff(ph[seen]) != 0])) if seen.any() else np.empty(0, np.int64)
        out.append(("bigrams", bucket, pack(h=ph[seen][run], run=np.diff(np.append(run, seen.sum())), w=pw[seen], count=r[seen])))
        out.append(("counts", bucket, pack(**counted(r))))
        # documents: pairs that were seen
        rr, who = r[pair], block << 40 | doc >> 1
        some = rr > 0
        order = np.argsort(who[some], kind="stable")
        key_, count = who[some][order], rr[some][order]
        if len(key_):
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(key_)) + 1])
            small = [np.add.reduceat((count == k).astype(np.int64), cuts) for k in range(1, K + 1)]
            logs, at = np.add.reduceat(np.log10(count), cuts), key_[cuts]
            for a, z in ranges(at >> 40):
                out.append(("sums", blocks[int(at[a] >> 40)], pack(doc=at[a:z] & (1 << 40) - 1, logs=logs[a:z], **{f"n{k + 1}": x[a:z] for k, x in enumerate(small)})))
        # contexts with unseen pairs
        context = np.cumsum(np.concatenate([[True], np.diff(ph) != 0])) - 1
        stat = lambda x: np.bincount(context, x)
        few = {f"m{k}": stat((r == k).astype(float)) for k in range(1, K + 1)}
        stats = {"types": stat(seen.astype(float)), "sum": stat(r.astype(float)), "lower": stat(unigrams(pwn) * seen), **few}
        first = np.concatenate([[True], np.diff(ph) != 0])
        hs, hns = ph[first], phn[first]
        spread = hns > hot
        if spread.any():
            out.append(("hot", bucket, pack(h=hs[spread], hn=hns[spread], **{k: v[spread] for k, v in stats.items()})))
        # a context whose pairs are all frequent frees nothing by discounts: its seen pairs change too
        full = sum(few.values()) == 0
        need = (rr == 0) | full[context[pair]]
        if need.any():
            used, back = np.unique(context[pair][need], return_inverse=True)
            out.append(("backoff", bucket, pack(h=hs[used], hn=hns[used], **{k: v[used] for k, v in stats.items()}, at=back, lower_w=np.log10(unigrams(wn[need])), unseen=(rr[need] == 0).astype(np.int64), block=np.array(blocks, np.int64)[block[need]], doc=doc[need] >> 1)))
        return rows_of(out)

    return pairs.groupBy("bucket").applyInArrow(work, "kind string, key long, payload binary")


def rows_of(rows: list[tuple]) -> pa.Table:
    return pa.table({c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate((("kind", pa.string()), ("key", pa.int64()), ("payload", pa.binary())))})


def weights(s: dict[str, np.ndarray], d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 of each context's backoff weight times its count, and of what its seen pairs keep (1, unless all are frequent)."""
    n, small = s["sum"], np.stack([s[f"m{k}"] for k in range(1, K + 1)])
    freed = (small * np.arange(1, K + 1)[:, None] * (1 - d)[:, None]).sum(axis=0)
    full = small.sum(axis=0) == 0
    keep = np.where(full, n / (n + s["types"]), 1.0)
    freed = np.where(full, n * (1 - keep), freed)
    return np.log10(freed / np.maximum(1 - s["lower"], 1e-300)), np.log10(keep)


def backed_off(tables: DataFrame, d: np.ndarray, hot: dict[int, dict[str, float]]) -> DataFrame:
    """kind sums, for the unseen pairs of each document."""

    def work(batches):
        for batch in batches:
            out = []
            for blob in batch.column(0).to_pylist():
                s = unpack(blob)
                s = {k: v.copy() for k, v in s.items()}
                for i in np.flatnonzero(np.isin(s["h"], np.array(list(hot), np.int64))) if hot else ():
                    for name, value in hot[int(s["h"][i])].items():
                        s[name][i] = value
                weight, keep = weights(s, d)
                still = sum(s[f"m{k}"] for k in range(1, K + 1))[s["at"]] == 0
                value = np.where(s["unseen"] == 1, weight[s["at"]] + s["lower_w"], np.where(still, keep[s["at"]], 0.0))
                order = np.lexsort((s["doc"], s["block"]))
                block, doc, value = s["block"][order], s["doc"][order], value[order]
                cuts = np.flatnonzero(np.concatenate([[True], (np.diff(block) != 0) | (np.diff(doc) != 0)]))
                block, doc, value = block[cuts], doc[cuts], np.add.reduceat(value, cuts)
                out += [("sums", int(block[a]), pack(doc=doc[a:z], logs=value[a:z])) for a, z in ranges(block)]
            yield from rows_of(out).to_batches()

    return tables.filter("kind = 'backoff'").select("payload").mapInArrow(work, "kind string, key long, payload binary")


def finished(sums: DataFrame, d: np.ndarray) -> DataFrame:
    """A row for each document from the sums of its block."""
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"

    def work(key, found):
        info, extra = None, []
        for kind, blob in zip(found.column("kind").to_pylist(), found.column("payload").to_pylist(), strict=True):
            s = unpack(blob)
            if kind == "documents":
                info = s
            else:
                extra.append((s["doc"], s["logs"] + sum(s[f"n{k}"] * np.log10(d[k - 1]) for k in range(1, K + 1) if f"n{k}" in s)))
        score = info["own"].copy()
        for doc, value in sorted(extra, key=lambda x: (len(x[0]), x[1][:1].tolist(), float(x[1].sum()))):  # an order of its own, so that sums repeat
            np.add.at(score, doc, value)
        raw = info["id"].view(np.uint64)
        ids = (raw >> np.uint64(1)).astype(np.int64) ^ -(raw & np.uint64(1)).astype(np.int64)
        return pa.table({"doc_id": pa.array(ids, mask=info["null"].astype(bool)), "held_out": pa.array(info["held"] == 1), "n_tokens": pa.array(info["tokens"]), "n_known": pa.array(info["known"]), "base_score": pa.array(info["base"]), "score": pa.array(score)})

    return sums.groupBy("key").applyInArrow(work, schema)


def plain_scan(docs: DataFrame) -> bool:
    """Whether rows come straight from a stored table, so that each reading gives them in one order; those of a shuffle are stored first."""
    names = {re.split(r"[ \[(]", line.lstrip(" :+-"))[0] for line in docs._jdf.queryExecution().optimizedPlan().toString().splitlines()}
    return names <= {"Project", "Filter", "Relation", "LocalRelation", "LogicalRDD", ""}


def katz(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, pairs: int = PAIRS, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """Train on the rows where held_out (a boolean Column over the id alone) isn't true, and score all.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    train = ~F.coalesce(held_out, F.lit(False))
    docs = docs if plain_scan(docs) else materialize(docs.select(id_col, text_col))
    size = docs.agg(F.coalesce(F.sum(F.length(text_col)), F.lit(0)).alias("chars"), F.count_if(train).alias("docs"), F.count("*").alias("all")).first()
    # runs of rows of a scan, which are the same each time it is read
    in_block = max(1, int(block * size["all"] / max(size["chars"], 1)))
    number = F.floor(F.monotonically_increasing_id() / in_block).cast("long")
    rows = docs.select(number.alias("block"), F.col(id_col).cast("long").alias("doc_id"), train.alias("train"), F.col(text_col).cast("string").alias("text"))
    bits = max(0, int(size["chars"] / 100 / words).bit_length())
    numbers = materialize(numbered(block_words(rows, bits), bits))
    found = [unpack(r[0]) for r in numbers.filter("block = -1").select("payload").toLocalIterator()]
    total, n_words = (int(sum(x["sums"][k] for x in found)) for k in range(2))
    whole = summed(found)
    unigrams = Unigrams(total, small_counts(*whole), whole)
    hot = max(hot, total // 100_000)
    buckets = max(1, int(size["chars"] / 6 / pairs))
    tables = materialize(model_tables(paired(rows, numbers.filter("block >= 0"), buckets, hot, unigrams, n_words, size["docs"]), unigrams, hot), ["kind"])
    whole = summed([unpack(r[0]) for r in tables.filter("kind = 'counts'").select("payload").toLocalIterator()])
    d = discounts(small_counts(*whole), whole)
    spread: dict[int, dict[str, float]] = {}
    for (blob,) in tables.filter("kind = 'hot'").select("payload").toLocalIterator():
        s = unpack(blob)
        for i, h in enumerate(s["h"].tolist()):
            mine = spread.setdefault(h, {})
            for name in s:
                if name not in ("h", "hn"):
                    mine[name] = mine.get(name, 0.0) + float(s[name][i])
    known = tables.filter("kind in ('documents', 'sums')").select("kind", "key", "payload")
    out = finished(known.unionByName(backed_off(tables, d, spread)), d)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
