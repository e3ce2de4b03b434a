"""Spelling variants: words that differ by one inserted, deleted or replaced code point, by two-dimensional range reporting.

A word that differs from another in one place shares with it all that stands before
that place and all that stands behind it. Among the words of one length, those with a given
beginning are an interval of the forward order and those with a given end an interval of the order of
reversed words; a wavelet matrix of the reverse ranks in forward order reports the words in both intervals,
for every edit position of every word. A replacement asks the words of the same
length, an insertion those that are one longer; deletions are insertions seen from the other word.

An edit in the second half of the longer word leaves its first half whole and the other way round, so words meet
in buckets by a half (its side, the length and the half's letters). A bucket holds many halves; a half that more than
`SHARD` words share is spread over several shards, and the words that ask go to each of them. No task holds more than a few shards' words.

Null texts and texts without letters give nothing; very long texts are one row each while their runs are read; equal
texts and repeated rows count each time; a null id counts as an empty one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.session import materialize

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a bucket or shard, on average.
SHARD = 20_000


def damaged(doc_id: Column, run: Column, every: int) -> Column:
    """The run; if its checksum is divisible by `every`, without the code point that the checksum names."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def counted(docs: DataFrame, every: int = 199, shortest: int = 6, least: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the words of all texts that are long and frequent enough."""
    runs = F.regexp_extract_all(F.translate(F.col(text_col).cast("string"), UPPER, LOWER), F.lit(RUN), F.lit(0))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.explode(runs).alias("run"))
    # shorter runs can't become words; a null text gives no row
    words = rows.filter(F.char_length("run") >= shortest).select(damaged(F.col("doc_id"), F.col("run"), every).alias("word")).filter(F.char_length("word") >= shortest)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


class WaveletMatrix:
    """Values 0 to n - 1, each once; reports those of an interval of places that lie in an interval of values."""

    def __init__(self, values: np.ndarray):
        self.bits = max(int(len(values) - 1).bit_length(), 1)
        self.zeros: list[np.ndarray] = []
        for level in range(self.bits - 1, -1, -1):
            bit = (values >> level) & 1
            self.zeros.append(np.concatenate([[0], np.cumsum(bit == 0)]).astype(np.int32))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def report(self, begin: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of questions and the values found: places [begin, end), values [low, high)."""
        ask, value = np.arange(len(begin)), np.zeros(len(begin), np.int64)
        for k, zeros in enumerate(self.zeros):
            half = 1 << (self.bits - 1 - k)
            b0, e0, first = zeros[begin], zeros[end], zeros[-1]
            left = (b0 < e0) & (value < high) & (value + half > low)
            b1, e1 = begin - b0 + first, end - e0 + first
            right = (b1 < e1) & (value + half < high) & (value + 2 * half > low)
            ask, low, high = (np.concatenate([x[left], x[right]]) for x in (ask, low, high))
            begin, end = np.concatenate([b0[left], b1[right]]), np.concatenate([e0[left], e1[right]])
            value = np.concatenate([value[left], value[right] + half])
        return ask, value


def interval(order: np.ndarray, asked: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The places in sorted words of those that begin with the first `length` code points of each asked word."""
    if not length:
        return np.zeros(len(asked), np.int64), np.full(len(asked), len(order))
    heads, asked = order.astype(f"U{length}"), asked.astype(f"U{length}")
    return np.searchsorted(heads, asked, "left"), np.searchsorted(heads, asked, "right")


def reverse(words: np.ndarray, length: int) -> np.ndarray:
    """Words of one length, read backwards."""
    return np.ascontiguousarray(np.ascontiguousarray(words.astype(f"U{length}")).view(np.uint32).reshape(-1, length)[:, ::-1]).view(f"U{length}").ravel()


def near_in(stored: np.ndarray, asked: np.ndarray, length: int, added: int, positions: range) -> tuple[np.ndarray, np.ndarray]:
    """Places (asked, stored) of words that differ at one of the positions; asked words are shorter by `added`, 0 or 1."""
    forward = np.argsort(stored, kind="stable")
    back = reverse(stored, length)
    order = np.argsort(back, kind="stable")
    rank = np.empty(len(stored), np.int64)
    rank[order] = np.arange(len(stored))
    matrix = WaveletMatrix(rank[forward])
    ahead, behind = stored[forward], back[order]
    turned = reverse(asked, length - added)
    found = []
    for at in positions:
        # what stands before place `at` and what stands behind it
        begin, end = interval(ahead, asked, at)
        low, high = interval(behind, turned, length - 1 - at)
        some = np.flatnonzero((begin < end) & (low < high))
        ask, value = matrix.report(begin[some], end[some], low[some], high[some])
        found.append(some[ask] * len(stored) + order[value])
    pairs = np.unique(np.concatenate([np.empty(0, np.int64), *found]))
    return pairs // len(stored), pairs % len(stored)


def meet(groups: pa.Table) -> pa.Table:
    """a, a_n, b, b_n: the pairs of a bucket, both ways."""
    word, n, length, stored, side = (groups.column(c).to_numpy(zero_copy_only=False) for c in ("word", "n", "length", "stored", "side"))
    word = word.astype(str)
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for m, s in set(zip(length.tolist(), side.tolist())):
        here = (length == m) & (side == s)
        have, ask = np.flatnonzero(here & stored), np.flatnonzero(here & ~stored)
        positions = range(m // 2, m) if s else range(m // 2)
        for added in (0, 1):
            asking = ask[np.char.str_len(word[ask]) == m - added] if len(ask) else ask
            if len(have) and len(asking):
                x, y = near_in(word[have].astype(f"U{m}"), word[asking].astype(f"U{m - added}"), m, added, positions)
                x, y = asking[x], have[y]
                other = word[x] != word[y]
                x, y = x[other], y[other]
                # a replacement is asked for by both words, an insertion by the shorter one
                a += [x, y] if added else [x]
                b += [y, x] if added else [y]
    x, y = np.concatenate(a), np.concatenate(b)
    return pa.table({"a": pa.array(word[x], pa.string()), "a_n": n[x], "b": pa.array(word[y], pa.string()), "b_n": n[y]})


def asked_of(words: DataFrame) -> DataFrame:
    """word, n, length, stored, side, half: each word where it is stored (by both halves) and where it asks (for its own length and one more)."""
    size, places = F.char_length("word"), []
    for stored, added in ((True, 0), (False, 0), (False, 1)):
        length = size + added
        middle = F.floor(length / 2).cast("int")
        places += [
            F.struct(length.alias("length"), F.lit(stored).alias("stored"), F.lit(True).alias("side"), F.substring("word", F.lit(1), middle).alias("half")),
            # what stands behind the middle of the longer word
            F.struct(length.alias("length"), F.lit(stored).alias("stored"), F.lit(False).alias("side"), F.substring("word", middle + 1 - added, size).alias("half")),
        ]
    return words.select("word", "n", F.explode(F.array(*places)).alias("p")).select("word", "n", "p.*")


def near(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """a, a_n, b, b_n: all pairs of near words (word, n), both ways."""
    rows = asked_of(words)
    halves = rows.filter("stored").groupBy("length", "side", "half").agg(F.count("*").alias("size")).filter(F.col("size") > shard)
    hot = halves.select("length", "side", "half", F.ceil(F.col("size") / shard).cast("int").alias("shards"))
    rows = rows.join(hot, ["length", "side", "half"], "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
    own = F.array(F.pmod(F.xxhash64("word"), F.col("shards")).cast("int"))
    rows = rows.withColumn("shard", F.explode(F.when(F.col("stored"), own).otherwise(F.sequence(F.lit(0), F.col("shards") - 1))))
    buckets = max(words.count() * 2 // shard, 1)
    # a shard of a hot half is a bucket of its own
    name = F.when(F.col("shards") > 1, F.xxhash64("length", "side", "half", "shard")).otherwise(F.pmod(F.xxhash64("length", "side", "half"), F.lit(buckets)))
    dealt = rows.select("word", "n", "length", "stored", "side", name.alias("bucket"))
    return dealt.groupBy("bucket").applyInArrow(meet, "a string, a_n long, b string, b_n long").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word, root: forms (word, form) followed to the last, which has none. Counts rise along a chain, so it ends; steps double."""
    step = materialize(forms.select("word", F.coalesce("form", "word").alias("root")))
    while True:
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        following = materialize(step.join(ahead, "root").select("word", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        step = following.select("word", "root")
        if following.filter("moved").isEmpty():
            return step


def variants(docs: DataFrame, every: int = 199, shortest: int = 6, least: int = 5, ratio: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n, form, form_n, n_near, root, one row per word.

    The form is the near word of largest n (of equals the smallest), if it occurs
    at least `ratio` times as often; the root is where forms lead to.
    """
    words = materialize(counted(docs, every, shortest, least, id_col, text_col))
    best = near(words).groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("n"), F.col("b").alias("word"))).alias("best"))
    found = words.join(best.withColumnRenamed("a", "word"), "word", "left")
    often = -F.col("best.n") >= F.col("n") * ratio
    forms = materialize(found.select("word", "n", F.when(often, F.col("best.word")).alias("form"), F.when(often, -F.col("best.n")).alias("form_n"), F.coalesce("n_near", F.lit(0)).alias("n_near")))
    return forms.join(roots(forms), "word")
