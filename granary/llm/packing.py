"""Hierarchical packing of documents into sequences of several lengths.

Windows of the longest size are cut off a document at once; what is left goes
to the shortest tier that holds it. Tiers are packed from the longest: each
piece opens a sequence of its tier's size, the gap takes the largest pieces of
the shorter tiers that fit, and then a cut from a piece of the shortest tier. What ends
up in no full sequence is cut into sequences whose lengths are powers of two, so
nothing is padded. Sequences are dealt, from the longest, each to the step group that holds the fewest tokens,
so groups hold the same tokens in the same mix of sizes; what fills no group waits for the next
batch, and only the last group of a task can be smaller.

Packing works where the rows lie, without a shuffle: a task packs batches of its own
rows, and only ids of the task and a counter name sequences and step groups, so a task that
runs again gives the same rows. Null texts count as empty and hold the end id
alone; null ids, equal texts and repeated rows are documents like any other. A very long text
is encoded by runs of its parts and fills windows of its own. An empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.tokens import library_encoder

TIERS = (64, 128, 256, 512, 1024, 2048)
#: Tokens of a step group.
STEP = 32 * 2048
#: Tokens packed at once; a task keeps no more, but for one document and an open step group.
BATCH = 1 << 18
Piece = tuple[int, int, int]  # length, document's place in the batch, start


class Packer:
    """Packs the pieces of a batch of documents; `sequences` gets (size, pieces)."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers, self.top = tiers, tiers[-1]
        self.waiting: dict[int, list[Piece]] = {t: [] for t in tiers}
        self.sequences: list[tuple[int, list[Piece]]] = []

    def route(self, piece: Piece) -> None:
        insort(self.waiting[next(t for t in self.tiers if piece[0] <= t)], piece)

    def add(self, doc: int, length: int) -> None:
        whole = length // self.top * self.top
        self.sequences += [(self.top, [(self.top, doc, s)]) for s in range(0, whole, self.top)]
        if length > whole:
            self.route((length - whole, doc, whole))

    def fitting(self, gap: int) -> Piece | None:
        """The largest waiting piece of at most gap ids."""
        for t in reversed(self.tiers):
            if t < 2 * gap and (have := self.waiting[t]) and (k := bisect_right(have, (gap, 1 << 62, 0))):
                return have.pop(k - 1)
        return None

    def cut(self, gap: int) -> Piece | None:
        """So many ids off the smallest waiting piece, which is longer."""
        for t in self.tiers:
            if have := self.waiting[t]:
                length, doc, start = have.pop(0)
                if length > gap:
                    self.route((length - gap, doc, start + gap))
                return min(length, gap), doc, start
        return None

    def fill(self, pieces: list[Piece], size: int) -> int:
        """Add pieces up to size; return what stays free."""
        gap = size - sum(p[0] for p in pieces)
        while gap and (p := self.fitting(gap) or self.cut(gap)):
            pieces.append(p)
            gap -= p[0]
        return gap

    def finish(self) -> list[tuple[int, list[Piece]]]:
        for t in reversed(self.tiers):
            while self.waiting[t]:
                pieces = [self.waiting[t].pop()]
                gap = self.fill(pieces, t)
                if gap:
                    self.split(pieces, t - gap)
                else:
                    self.sequences.append((t, pieces))
        return sorted(self.sequences, key=lambda s: -s[0])

    def split(self, pieces: list[Piece], total: int) -> None:
        """The last, partly filled sequence, as full sequences whose sizes are powers of two."""
        rest = list(reversed(pieces))
        for t in (1 << k for k in reversed(range(self.top.bit_length()))):
            if total >= t:
                taken, gap = [], t
                while gap:
                    length, doc, start = rest.pop()
                    use = min(length, gap)
                    taken.append((use, doc, start))
                    if use < length:
                        rest.append((length - use, doc, start + use))
                    gap -= use
                self.sequences.append((t, taken))
                total -= t


def dealt(sequences: list[tuple], step: int, last: bool) -> tuple[list[list[tuple]], list[tuple]]:
    """Step groups of `step` tokens from sequences (size first), and the sequences that fill none; if it is the last time, all are dealt."""
    sequences = sorted(sequences, key=lambda s: -s[0])
    total = sum(s[0] for s in sequences)
    n = -(-total // step) if last else total // step
    groups, load, left = [[] for _ in range(n)], [(0, k) for k in range(n)], []
    for s in sequences:
        if load and load[0][0] + s[0] <= step:
            have, k = load[0]
            groups[k].append(s)
            heapq.heapreplace(load, (have + s[0], k))
        else:
            left.append(s)
    if last and left:  # sizes that don't divide the step
        more, left = dealt(left, step, True)
        groups += more
    return groups, left


KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
NAMES = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "sequence_size", "step_group"]


def pack(docs: DataFrame, file: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS, step: int = STEP) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset, sequence_size, step_group."""
    if step < tiers[-1]:
        raise ValueError("a step group must hold the longest sequence")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def work(batches):
        encoder, task = library_encoder(file), TaskContext.get().partitionId()
        sequence = group = task << 36
        docs, ids, size = [], [], 0
        waiting: list[tuple] = []  # (size, pieces of document, start, length, ids, doc_tokens)
        last = np.array([end_id], "<u4").tobytes()

        def packed(end: bool):
            nonlocal sequence, group, waiting
            packer = Packer(tiers)
            for k, raw in enumerate(ids):
                packer.add(k, len(raw) // 4)
            for n, pieces in packer.finish():
                waiting.append((n, [(docs[k], start, length, ids[k][4 * start : 4 * (start + length)], len(ids[k]) // 4) for length, k, start in pieces]))
            groups, waiting = dealt(waiting, step, end)
            for members in groups:
                out = []
                for n, pieces in members:
                    offset = 0
                    for piece in pieces:
                        out.append((*piece, sequence, offset, n, group))
                        offset += piece[2]
                    sequence += 1
                group += 1
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), KINDS, strict=True)], NAMES)

        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist()), strict=True):
                docs.append(doc)
                ids.append(raw + last)
                size += len(raw) // 4 + 1
                if size >= BATCH:
                    yield from packed(False)
                    docs, ids, size = [], [], 0
        yield from packed(True)
        encoder.forget()

    return rows.mapInArrow(work, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_size int, step_group long")
