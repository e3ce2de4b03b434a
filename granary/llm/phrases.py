"""Phrase collocations: phrases of several words that occur often, scored by their weakest cut, per language.

Every level asks the level below. Words are counted by a shuffle; those that occur at least `least` times
get slots of a minimal perfect hash, and every text becomes the row of its words' slots. A phrase of
k words is the pair of slots of its first and its last k - 1 words, so slots identify phrases exactly.
Only pairs of frequent phrases can be frequent (Apriori). Mappers count them first by places of a hash, of which there are as many as the level's
phrases ask for; a place's counts meet in the task of its range, which tells the places that reach `least`. Distinct pairs with such places are the candidates. They get a minimal perfect hash with their keys stored by
slot, so that a pair that is no candidate is told by comparison. Mappers look
their pairs up once, write their slots and add them up by bincount in numpy arrays, which are summed as a tree. Counts of the parts of a phrase
are read by the slots that it is made of.

Counts travel as gaps and counts of places that occur, so what moves grows with the words and not with tasks times places. A block of candidates has `SLOTS` slots on average; a pair
is looked up in the one block of its hash. One broadcast tells of `FILTER` places; more take more rounds of gathering candidates, with the same memory. Slots of one level are unsigned 32-bit integers.

Null texts count as empty, null languages as `und`. Repeated rows count each time, very long texts are one row of slots each,
ids and other columns are not read, an empty table gives an empty result.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.words import mix, runs, span_hashes
from granary.session import discard, materialize

U64 = np.uint64
#: Slots of a block of candidates, on average: it is broadcast, with 8 bytes a key.
SLOTS = 1 << 21
#: Places of the screen that one broadcast tells of, a bit each; a place serves `LOAD` phrases at most, on average.
FILTER = 1 << 28
LOAD = 8
#: Counters in a row of a mapper's array, and arrays that are summed at once.
CHUNK = 1 << 19
FAN = 32
#: Pairs that a mapper gathers before it counts them.
GATHERED = 1 << 21
#: Texts that are split at once, and ranges of keys.
RUN, RANGES = 1 << 21, 256
#: A-Z lower-cased, tabs to spaces, separators of pieces to line ends.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 9)
_ONES = np.array([bin(k).count("1") for k in range(256)], np.int64)


class PerfectHash:
    """Distinct 64-bit keys to slots 0 to n - 1: levels of bits for keys that have a place to themselves, with ranks."""

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        at, left = 0, keys
        while len(left):
            size = max(2 * len(left), 64)
            place = self.places(left, len(self.levels), size)
            often = np.bincount(place, minlength=size)
            bits = np.packbits(often == 1)
            self.levels.append((size, at, bits, np.concatenate([[0], np.cumsum(_ONES[bits])]).astype(np.uint32)))
            at += int(self.levels[-1][3][-1])
            left = left[often[place] > 1]

    @staticmethod
    def places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + U64(0x9E3779B97F4A7C15 * (level + 1) % (1 << 64))) % U64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """A slot for every key; keys that aren't among those of the hash get any, or -1."""
        out, left = np.full(len(keys), -1), np.arange(len(keys))
        for level, (size, at, bits, rank) in enumerate(self.levels):
            place = self.places(keys[left], level, size)
            byte, bit = bits[place >> 3], place & 7
            hit = (byte >> (7 - bit)) & 1 == 1
            out[left[hit]] = (at + rank[place >> 3] + _ONES[byte >> (8 - bit)])[hit]
            left = left[~hit]
        return out


class Keys:
    """A block of pair candidates: perfect hash and keys by slot, behind bits that tell most other keys; `base` is the number of its first slot."""

    def __init__(self, keys: np.ndarray, base: int = 0):
        self.base, self.hash, self.keys = base, PerfectHash(keys), np.empty(len(keys), np.uint64)
        self.keys[self.hash.slots(keys)] = keys
        self.mask = U64((1 << (8 * len(keys)).bit_length()) - 1)
        seen = np.zeros(int(self.mask) + 1, bool)
        seen[mix(keys) & self.mask] = True
        self.seen = np.packbits(seen)

    def __len__(self) -> int:
        return len(self.keys)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out, likely = np.full(len(keys), -1), np.flatnonzero(held(self.seen, mix(keys) & self.mask)) if len(self) else np.empty(0, int)
        found = self.hash.slots(keys[likely])
        same = (found >= 0) & (self.keys[found] == keys[likely]) if len(likely) else likely > 0
        out[likely[same]] = found[same] + self.base
        return out


def held(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the bits of these places are set."""
    return (bits[at >> U64(3)] >> (U64(7) - (at & U64(7))).astype(np.uint8)) & 1 == 1


class Words:
    """A block of frequent words of languages, with counts, by slot; a word is found by its hash and compared."""

    def __init__(self, langs: list[str], words: list[bytes], counts: list[int]):
        self.base = 0
        keys = self.hashed(langs, pa.array(words, pa.large_binary()))
        # of two words with one hash the second is kept apart
        _, first = np.unique(keys, return_index=True)
        apart = np.setdiff1d(np.arange(len(keys)), first)
        self.hash = PerfectHash(keys[first])
        order = np.concatenate([first[np.argsort(self.hash.slots(keys[first]))], apart]).astype(int)
        self.keys = keys[order]
        self.langs, self.words, self.counts = [langs[k] for k in order], pa.array([words[k] for k in order], pa.large_binary()), np.array(counts, np.int64)[order]
        self.apart = {(langs[k], words[k]): len(first) + j for j, k in enumerate(apart)}
        self.lang_codes, self.codes = np.unique(np.array(self.langs, object).astype(str), return_inverse=True) if order.size else (np.empty(0, str), np.empty(0, int))

    def __len__(self) -> int:
        return len(self.langs)

    @staticmethod
    def hashed(langs: list[str], words: pa.LargeBinaryArray) -> np.ndarray:
        """Hashes of words and their languages, or of words and the one language."""
        if not len(words):
            return np.empty(0, np.uint64)
        _, offsets, data = words.buffers()
        ends = np.frombuffer(offsets, np.int64)[words.offset :][: len(words) + 1]
        h = span_hashes(np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends[:-1] - ends[0], ends[1:] - ends[0])
        named = {x: U64(int.from_bytes(x.encode()[:64].ljust(8), "little") % (1 << 64)) for x in set(langs)}
        return mix(h ^ mix(np.array([named[x] for x in langs], np.uint64)))

    def slots(self, lang: str, words: pa.Array) -> np.ndarray:
        """Slots of distinct words of a language, or -1."""
        if not len(self) or not len(words):
            return np.full(len(words), -1)
        words = words.cast(pa.large_binary())
        keys = self.hashed([lang], words)
        found = self.hash.slots(keys)
        code = np.searchsorted(self.lang_codes, lang)
        # words are compared where hash and language agree
        likely = np.flatnonzero((found >= 0) & (self.keys[found] == keys) & (code < len(self.lang_codes)) & (self.codes[found] == code))
        same = pc.equal(self.words.take(pa.array(found[likely])), words.take(pa.array(likely))).to_numpy(zero_copy_only=False)
        out = np.full(len(words), -1)
        out[likely[same]] = found[likely[same]]
        for k, word in enumerate(words.to_pylist()) if self.apart else ():
            out[k] = self.apart.get((lang, word), out[k])
        return np.where(out >= 0, out + self.base, -1)


def split(texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """The words of texts, whether a separator (or a text's begin) stands before each, and the number of each text's words."""
    raw_texts = [t.encode().translate(_PLAIN) for t in texts]
    raw = np.frombuffer(b"\n".join([*raw_texts, b""]), np.uint8)
    line = raw == 10
    white = line | (raw == 32)
    edge = np.flatnonzero(np.concatenate([[True], white[:-1]]) != white)
    begin, end = edge[0::2], edge[1::2]
    offsets = np.concatenate([[0], np.cumsum(end - begin)])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw[~white].tobytes())])
    breaks = np.zeros(len(begin) + 1, bool)
    breaks[np.searchsorted(begin, np.flatnonzero(line))] = True
    breaks[:1] = True
    breaks = breaks[: len(begin)]
    borders = np.cumsum([len(t) + 1 for t in raw_texts])
    return words.dictionary_encode(), breaks, np.diff(np.concatenate([[0], np.searchsorted(begin, borders)]))


def by_lang(batch: pa.RecordBatch):
    """For each language of a batch, its rows and texts, in runs of about two million code points."""
    rows: dict[str, list[int]] = {}
    for k, lang in enumerate(batch.column(0).to_pylist()):
        rows.setdefault(lang, []).append(k)
    texts = batch.column(1)
    for lang, at in rows.items():
        held = texts.take(pa.array(at)).to_pylist()
        for a, b in runs(held, RUN):
            yield lang, at[a:b], held[a:b]


def word_counts(rows: DataFrame) -> DataFrame:
    """lang, word (binary), n of rows (lang, text)."""

    def work(batches):
        for batch in batches:
            for lang, _, texts in by_lang(batch):
                words = split(texts)[0]
                n = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), words.dictionary.cast(pa.binary()), pa.array(n, pa.int64())], ["lang", "word", "n"])

    return rows.mapInArrow(work, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def blocks(rows: DataFrame, part, build) -> tuple[dict, int]:
    """By number, blocks of rows with slots, each built by one task from about `SLOTS` of them, as broadcast variables, and the number of slots; `part` tells a row's block."""

    def made(key, found):
        return pa.table({"p": pa.array([key[0].as_py()], pa.int64()), "block": pa.array([pickle.dumps(build(found))], pa.binary())})

    built = materialize(rows.groupBy(part.cast("long").alias("p")).applyInArrow(made, "p long, block binary"))
    out, base = {}, 0
    for row in built.toLocalIterator():  # one block at a time
        block = pickle.loads(row.block)
        block.base = base
        base += len(block)
        out[row.p] = rows.sparkSession.sparkContext.broadcast(block)
    if base >= 1 << 32:
        raise ValueError("more than 2**32 candidates of one length: raise least")
    discard(built)
    return out, base


def word_blocks(words: DataFrame) -> list:
    parts = max(-(-words.count() // SLOTS), 1)
    return list(blocks(words, F.pmod(F.xxhash64("lang", "word"), F.lit(parts)), lambda x: Words(*(x.column(c).to_pylist() for c in ("lang", "word", "n"))))[0].values())


def key_blocks(candidates: DataFrame) -> Blocks:
    """Blocks of packed keys (chunk, data)."""
    n = candidates.agg(F.sum(F.length("data"))).first()[0] or 0
    parts = min(max(-(-n // (8 * SLOTS)), 1), RANGES)
    built, size = blocks(candidates, F.floor(F.col("chunk") * parts / RANGES), lambda x: Keys(np.unique(np.concatenate([np.frombuffer(k, np.uint64) for k in x.column("data").to_pylist()]))))
    return Blocks(built, parts, size)


def ranges(keys: np.ndarray) -> np.ndarray:
    """The range of each key, by its hash."""
    return (mix(keys + U64(1)) >> U64(32)) % U64(RANGES)


class Blocks:
    """Blocks of pair candidates, each with a part of the ranges of keys."""

    def __init__(self, of: dict, parts: int, size: int):
        self.of, self.parts, self.size = of, parts, size

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slots of keys, or -1; a key is looked up in one block."""
        if self.parts == 1 and self.of:
            return self.of[0].value.slots(keys)
        out, part = np.full(len(keys), -1), ranges(keys) * U64(self.parts) // U64(RANGES)
        for p, block in self.of.items():
            mine = np.flatnonzero(part == U64(p))
            out[mine] = block.value.slots(keys[mine])
        return out

    def keys(self, slots: np.ndarray) -> np.ndarray:
        out = np.empty(len(slots), np.uint64)
        for block in self.of.values():
            mine = np.flatnonzero((slots >= block.value.base) & (slots < block.value.base + len(block.value)))
            out[mine] = block.value.keys[slots[mine] - block.value.base]
        return out


def numbered(rows: DataFrame, block) -> DataFrame:
    """lang, text, seq: the slots of the texts' words (int32 as unsigned; -1 for other words and between pieces), those of earlier blocks kept."""

    def work(batches):
        words_of = block.value
        for batch in batches:
            out: list[bytes] = [b""] * batch.num_rows
            before = batch.column(2).to_pylist()
            for lang, at, texts in by_lang(batch):
                words, breaks, sizes = split(texts)
                slots = words_of.slots(lang, words.dictionary)[words.indices.to_numpy()]
                ends = np.cumsum(sizes)
                firsts = np.concatenate([[0], np.cumsum(breaks)])
                line = np.full(len(slots) + firsts[-1], -1, np.int64)
                line[np.arange(len(slots)) + firsts[1:]] = slots
                for k, a, b in zip(at, ends - sizes, ends):
                    out[k] = line[a + firsts[a] : b + firsts[b]].astype(np.uint32).tobytes()
            out = [merged(a, b) if a else b for a, b in zip(before, out)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["lang", "text", "seq"])

    return rows.mapInArrow(work, "lang string, text string, seq binary")


def merged(a: bytes, b: bytes) -> bytes:
    return np.minimum(np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")).tobytes()


#: A place without a slot.
NONE = np.uint32(0xFFFFFFFF)


def sequence(batch: pa.RecordBatch, keep: np.ndarray | None = None) -> np.ndarray:
    """The rows of a batch, one behind the other, each ended by a place without a slot; slots that aren't to be kept are none."""
    slots = np.frombuffer(b"".join(x + b"\xff\xff\xff\xff" for x in batch.column(0).to_pylist()), "<u4")
    if keep is None:
        return slots
    out, at = np.full(len(slots), NONE), np.flatnonzero(slots != NONE)
    at = at[keep[slots[at]]]
    out[at] = slots[at]
    return out


def pairs(slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose slot and the next one exist, and their keys."""
    some = slots != NONE
    at = np.flatnonzero(some[:-1] & some[1:])
    return at, slots[at].astype(np.uint64) << U64(32) | slots[at + 1].astype(np.uint64)


class Kept:
    """Slots of a level that are frequent, as broadcast bits; without bits, all are."""

    def __init__(self, spark, bits: np.ndarray | None = None):
        self.bits = None if bits is None else spark.sparkContext.broadcast(bits)

    def mask(self) -> np.ndarray | None:
        return None if self.bits is None else np.unpackbits(self.bits.value).astype(bool)


def gathered(batches, kept: Kept, chosen):
    """What is chosen of the keys of pairs, of as many batches as `GATHERED` holds."""
    keep = kept.mask()
    waiting, size = [], 0
    for batch in batches:
        waiting.append(chosen(pairs(sequence(batch, keep))[1]))
        size += len(waiting[-1])
        if size >= GATHERED:
            yield np.concatenate(waiting)
            waiting, size = [], 0
    if size:
        yield np.concatenate(waiting)


def packed(at: np.ndarray, n: np.ndarray, kind: str) -> bytes:
    """Ascending places and their counts: gaps and counts, first bytes first, for most of the upper bytes are zeros that files and shuffles shorten."""
    both = np.concatenate([np.diff(at, prepend=0), n]).astype(kind)
    return both.view(np.uint8).reshape(len(both), -1).T.tobytes()


def unpacked(data: bytes, kind: str) -> tuple[np.ndarray, np.ndarray]:
    both = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel().astype(np.int64)
    return np.cumsum(both[: len(both) // 2]), both[len(both) // 2 :]


def added(arrays, kind: str, size: int) -> np.ndarray:
    """The sum of packed arrays of one chunk."""
    total = np.zeros(size, np.int64)
    for x in arrays:
        at, n = unpacked(x, kind)
        total[at] += n  # places are distinct
    return total


def chunks(at: np.ndarray, n: np.ndarray, kind: str, size: int):
    """Chunks of ascending places, and each one's packed array."""
    at = at.astype(np.int64)
    starts = np.flatnonzero(np.diff(at // size, prepend=-1))
    for a, b in zip(starts, [*starts[1:], len(at)]):
        chunk = int(at[a]) // size
        yield chunk, packed(at[a:b] - chunk * size, n[a:b], kind)


def tree(rows: DataFrame, parts: int, joined) -> DataFrame:
    """chunk, data: for each chunk, the bytes of all parts (chunk, part, data) joined in groups of `FAN`."""

    def add(key, found):
        data = joined(found.column("data").to_pylist())
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int64()), "part": pa.array([key[1].as_py()], pa.int64()), "data": pa.array([data], pa.binary())})

    while True:
        rows = rows.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("chunk", "part").applyInArrow(add, "chunk long, part long, data binary")
        parts = -(-parts // FAN)
        if parts <= 1:
            return rows.select("chunk", "data")


def tree_sum(rows: DataFrame, parts: int) -> DataFrame:
    """chunk, data: the packed arrays of all parts, summed as a tree."""

    def add(arrays):
        total = added(arrays, "<u8", CHUNK)
        at = np.flatnonzero(total)
        return packed(at, total[at], "<u8")

    return tree(rows, parts, add)


def tree_union(rows: DataFrame, kept: Kept, chosen) -> DataFrame:
    """chunk, data: the distinct chosen keys of pairs, packed by ranges of their hash."""
    from pyspark import TaskContext

    def work(batches):
        for keys in gathered(batches, kept, chosen):
            keys = np.unique(keys)
            place = ranges(keys)
            order = np.argsort(place, kind="stable")
            keys, ends = keys[order], np.searchsorted(place[order], np.arange(RANGES + 1).astype(np.uint64))
            some = np.flatnonzero(np.diff(ends))
            data = [keys[ends[k] : ends[k + 1]].tobytes() for k in some]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([TaskContext.get().partitionId()] * len(some), pa.int64()), pa.array(data, pa.binary())], ["chunk", "part", "data"])

    def add(arrays):
        return np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in arrays])).tobytes()

    return tree(rows.mapInArrow(work, "chunk long, part long, data binary"), rows.rdd.getNumPartitions(), add)


def bits_of(rows: DataFrame, size: int, first: int = 0) -> np.ndarray:
    """The bits of rows (chunk, bits) as one array of `size` bits from chunk `first` on."""
    out = np.zeros(-(-size // 8), np.uint8)
    for row in rows.collect():  # `size` bits at most
        to = out[(row.chunk - first) * CHUNK // 8 :][: len(row.bits)]
        to[:] = np.frombuffer(row.bits, np.uint8)[: len(to)]
    return out


def screened(rows: DataFrame, kept: Kept, least: int, total: int) -> DataFrame:
    """chunk, data: the distinct pairs whose hash is that of `least` pairs or more, packed; `total` phrases are in the rows."""
    places = max(1 << int(total // LOAD).bit_length(), 1 << 12, CHUNK)
    mask = U64(places - 1)

    def place(keys):
        return mix(keys) & mask

    def count(batches):
        for keys in gathered(batches, kept, place):
            at, n = np.unique(keys.astype(np.uint32) if places <= 1 << 32 else keys, return_counts=True)
            numbers, data = zip(*chunks(at, n, "<u4", CHUNK))
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(data, pa.binary())], ["chunk", "data"])

    def reached(key, found):  # `LOAD` counts a place at most, on average
        bits = np.packbits(added(found.column("data").to_pylist(), "<u4", CHUNK) >= least)
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([bits.tobytes() if bits.any() else None], pa.binary())})

    bits = materialize(rows.mapInArrow(count, "chunk long, data binary").groupBy("chunk").applyInArrow(reached, "chunk long, bits binary").filter("bits is not null"))
    found = None
    for turn in range(-(-places // FILTER)):
        first = turn * FILTER // CHUNK
        shared = rows.sparkSession.sparkContext.broadcast(bits_of(bits.filter(F.col("chunk").between(first, first + FILTER // CHUNK - 1)), min(places, FILTER), first))

        def likely(keys, shared=shared, turn=turn):
            at = place(keys)
            if places > FILTER:
                mine = at // U64(FILTER) == U64(turn)
                keys, at = keys[mine], at[mine] % U64(FILTER)
            return keys[held(shared.value, at)]

        more = tree_union(rows, kept, likely)
        found = more if found is None else found.unionByName(more)
    out = materialize(found)
    discard(bits)
    return out


def looked_up(rows: DataFrame, kept: Kept, of: Blocks) -> DataFrame:
    """seq: the slots of pairs that follow each other, runs of them parted by a place without a slot; or chunk, part, data: a task's counts of all slots."""
    from pyspark import TaskContext

    schema = pa.schema([("seq", pa.binary()), ("chunk", pa.int64()), ("part", pa.int64()), ("data", pa.binary())])

    def work(batches):
        keep = kept.mask()
        total, waiting, size = np.zeros(of.size, np.int64), [], 0
        for batch in batches:
            at, keys = pairs(sequence(batch, keep))
            slots = of.slots(keys)
            some = slots >= 0
            at, slots = at[some], slots[some]
            waiting.append(slots)
            size += len(slots)
            if size >= max(GATHERED, of.size):
                total += np.bincount(np.concatenate(waiting), minlength=of.size)
                waiting, size = [], 0
            # a slot without a neighbour is in no longer phrase
            next_to = np.diff(at) == 1
            near = np.concatenate([[False], next_to]) | np.concatenate([next_to, [False]]) if len(at) else some[:0]
            at, slots = at[near], slots[near]
            if len(at):
                shift = np.cumsum(np.diff(at, prepend=at[0] - 1) != 1)
                line = np.full(len(at) + shift[-1], NONE)
                line[np.arange(len(at)) + shift] = slots
                yield pa.RecordBatch.from_arrays([pa.array([line.tobytes()], pa.binary()), *(pa.nulls(1, x.type) for x in list(schema)[1:])], schema=schema)
        if size:
            total += np.bincount(np.concatenate(waiting), minlength=of.size)
        at = np.flatnonzero(total)
        for chunk, data in chunks(at, total[at], "<u8", CHUNK):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.binary()), pa.array([chunk]), pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([data], pa.binary())], schema=schema)

    return rows.mapInArrow(work, "seq binary, chunk long, part long, data binary")


def counted(sums: DataFrame, of: Blocks, least: int) -> tuple[DataFrame, Kept]:
    """slot, p, s, a: the candidates that occur often enough, with the slots they are made of; and which they are."""

    def read(batches):
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at, n = unpacked(data, "<u8")
                slots, n = at[n >= least] + chunk * CHUNK, n[n >= least]
                keys = of.keys(slots)
                columns = (slots, (keys >> U64(32)).astype(np.int64), (keys & U64(0xFFFFFFFF)).astype(np.int64), n)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["slot", "p", "s", "a"])

    def bits(batches):
        for batch in batches:
            out = []
            for data in batch.column(1).to_pylist():
                at, n = unpacked(data, "<u8")
                often = np.zeros(CHUNK, bool)
                often[at] = n >= least
                out.append(np.packbits(often).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["chunk", "bits"])

    found = materialize(sums.mapInArrow(read, "slot long, p long, s long, a long"))
    return found, Kept(sums.sparkSession, bits_of(sums.mapInArrow(bits, "chunk long, bits binary"), of.size))


def phrases(docs: DataFrame, least: int = 100, longest: int = 5, share: int = 100, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, phrase, words, a, l, r, n, score: all phrases of 2 to `longest` words that occur at least `least` times in a language.

    n is the number of words of the language; score is floor(1000 a n / (l r)) of
    the cut (first part l, rest r) that scores lowest, the first of equals.
    Phrases that lie in a longer one with share % of their occurrences or more are dropped.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    counts = materialize(word_counts(rows))
    totals = materialize(counts.groupBy("lang").agg(F.sum("n").alias("n")))
    total = totals.agg(F.sum("n")).first()[0] or 0
    words = materialize(counts.filter(F.col("n") >= least))
    discard(counts)
    of = word_blocks(words)
    lined = rows.withColumn("seq", F.lit(None).cast("binary"))
    for k, block in enumerate(of):
        lined = numbered(lined, block)
        lined = lined if k == len(of) - 1 else materialize(lined)
    lined = materialize((lined if of else lined.limit(0)).select("seq"))
    known = totals.limit(0).select("lang", F.lit("").alias("phrase"), F.lit("").alias("last"), F.lit(0).cast("long").alias("slot"), F.lit(0).cast("long").alias("a"))
    for block in of:
        known = known.unionByName(listed(spark, block))
    known = materialize(known.select("*", F.array().cast("array<long>").alias("ls"), F.array().cast("array<long>").alias("rs")))
    levels: list[tuple[DataFrame, DataFrame]] = []
    kept, written = Kept(spark), lined
    for _ in range(2, longest + 1):
        candidates = screened(lined, kept, least, total)
        of = key_blocks(candidates)
        discard(candidates)
        if not of.size:
            break  # no longer phrase can be frequent
        parts = lined.rdd.getNumPartitions()
        made = materialize(looked_up(lined, kept, of))
        discard(written)
        written, lined = made, made.filter("seq is not null").select("seq")
        sums = materialize(tree_sum(made.filter("chunk is not null").select("chunk", "part", "data"), parts))
        found, kept = counted(sums, of, least)
        discard(sums)
        total = found.agg(F.sum("a")).first()[0] or 0
        p, s = known.alias("p"), known.alias("s")
        known = materialize(
            found.alias("f").join(p, F.col("f.p") == F.col("p.slot")).join(s, F.col("f.s") == F.col("s.slot")).select(
                "p.lang", F.concat("p.phrase", F.lit(" "), "s.last").alias("phrase"), "s.last", "f.slot", "f.a",
                F.concat("p.ls", F.array("p.a")).alias("ls"), F.concat("s.rs", F.array("s.a")).alias("rs"),
            )
        )
        levels.append((known, found))
    out = known.limit(0)
    for k, (found, _) in enumerate(levels):
        if k + 1 < len(levels):
            longer = levels[k + 1][1].select(F.explode(F.array("p", "s")).alias("slot"), F.col("a").alias("f")).groupBy("slot").agg(F.max("f").alias("f"))
            found = found.join(longer, "slot", "left").filter(F.coalesce(F.col("f") * 100 < F.col("a") * share, F.lit(True))).drop("f")
        out = out.unionByName(found)
    return scored(out.join(totals, "lang"))


def listed(spark, block) -> DataFrame:
    """lang, phrase, last, slot, a of a block of words."""

    def work(batches):
        for batch in batches:
            at = batch.column(0).to_numpy()
            of = block.value
            words = of.words.take(pa.array(at)).cast(pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([of.langs[k] for k in at], pa.string()), words, words, pa.array(at + of.base), pa.array(of.counts[at])], ["lang", "phrase", "last", "slot", "a"])

    return spark.range(len(block.value)).mapInArrow(work, "lang string, phrase string, last string, slot long, a long")


def scored(found: DataFrame) -> DataFrame:
    """The lowest-scoring cut of each phrase, in exact whole numbers."""
    cut = """array_min(transform(sequence(1, size(ls)), k -> struct(
        (cast(1000 as decimal(4, 0)) * cast(a as decimal(17, 0)) * cast(n as decimal(17, 0))) div (cast(ls[k - 1] as decimal(19, 0)) * cast(rs[size(ls) - k] as decimal(19, 0))) as score,
        k as k, ls[k - 1] as l, rs[size(ls) - k] as r)))"""
    return found.withColumn("cut", F.expr(cut)).select("lang", "phrase", (F.size("ls") + 1).alias("words"), "a", "cut.l", "cut.r", "n", "cut.score")


def best(found: DataFrame, most: int = 2000) -> DataFrame:
    """Each language's first phrases by score, count and UTF-8 bytes, with their rank from 1."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return found.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= most)
