"""Token files of directly addressable codes.

An id is split into chunks of eight bits. Level 0 holds the lowest chunk of
every id and a bitmap that says which ids go on; level 1 holds the next chunk of
those, and so on. A rank directory counts the set bits before each block of 512,
so the chunk of any token on any level is found by adding ranks: one token is
read without decoding those before it.

A file is a Spark table of segments, in ascending order of document: Spark's
commit protocol makes it whole even if executors are lost, and a segment holds
whole documents, of about SEGMENT ids (one longer document stands alone).
Columns: part, seq (order of segments), n_docs, n_tokens and payload, the bytes below.

  magic "GDAC", version, levels (uint32 each), documents, ids (uint64 each);
  document ids (int64 each, and a byte each that is 1 for a null id);
  offsets of documents (uint64, one more than documents);
  for each level: number of chunks (uint64), chunks (bytes), bitmap (64-bit words), ranks (uint64 a block)

Null texts count as empty; an empty document holds its end id alone. Null
document ids come first; of repeated ids the order is that of their texts. A very long text is a segment of its own. An empty table gives an
empty file. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm.tokens import library_encoder

BITS, BLOCK = 8, 512
SEGMENT = 1 << 19
#: Code points of a task, about.
PART = 1 << 25
HEAD = struct.Struct("<4sIIQQ")
ONES = np.array([bin(x).count("1") for x in range(256)], np.uint8)


class Codes:
    """A segment: built from ids, or read from bytes."""

    def __init__(self, doc_ids: np.ndarray, nulls: np.ndarray, offsets: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.doc_ids, self.nulls, self.offsets, self.levels = doc_ids, nulls, offsets, levels

    @classmethod
    def build(cls, doc_ids: list[int | None], ids: list[np.ndarray]) -> Codes:
        rest = np.concatenate(ids) if ids else np.empty(0, np.uint32)
        offsets = np.cumsum([0] + [len(x) for x in ids]).astype("<u8")
        levels = []
        while len(rest) or not levels:
            more = rest >= 1 << BITS
            bits = np.packbits(more, bitorder="little")
            bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)])
            counts = ONES[bits].reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.uint64)
            ranks = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype("<u8") if len(counts) else np.empty(0, "<u8")
            levels.append(((rest & 255).astype(np.uint8), bits, ranks))
            rest = rest[more] >> BITS
        return cls(np.array([x or 0 for x in doc_ids], "<i8"), np.array([x is None for x in doc_ids], np.uint8), offsets, levels)

    def to_bytes(self) -> bytes:
        out = [HEAD.pack(b"GDAC", 1, len(self.levels), len(self.doc_ids), int(self.offsets[-1])), self.doc_ids.tobytes(), self.nulls.tobytes(), self.offsets.tobytes()]
        for chunks, bits, ranks in self.levels:
            out += [struct.pack("<Q", len(chunks)), chunks.tobytes(), bits.tobytes(), ranks.tobytes()]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, blob: bytes) -> Codes:
        magic, version, n_levels, n_docs, _ = HEAD.unpack_from(blob)
        if magic != b"GDAC" or version != 1:
            raise ValueError("not a segment of directly addressable codes")
        at = HEAD.size

        def take(kind, n):
            nonlocal at
            got = np.frombuffer(blob, kind, n, at)
            at += got.nbytes
            return got

        doc_ids, nulls, offsets = take("<i8", n_docs), take(np.uint8, n_docs), take("<u8", n_docs + 1)
        levels = []
        for _ in range(n_levels):
            n = int(take("<u8", 1)[0])
            blocks = -(-n // BLOCK)
            levels.append((take(np.uint8, n), take(np.uint8, blocks * BLOCK // 8), take("<u8", blocks)))
        return cls(doc_ids, nulls, offsets, levels)

    def token(self, i: int) -> int:
        """The id at a place, by one chunk and one rank a level."""
        value, shift = 0, 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                return value
            start = i // BLOCK * (BLOCK // 8)
            below = int(ONES[bits[start : i >> 3]].sum()) + int(ONES[bits[i >> 3] & ((1 << (i & 7)) - 1)])
            i, shift = int(ranks[i // BLOCK]) + below, shift + BITS
        raise ValueError("a code has no last chunk")

    def ids(self) -> np.ndarray:
        """All ids."""
        out = None
        for chunks, bits, _ in reversed(self.levels):
            here = chunks.astype(np.uint32)
            if out is not None:
                here[np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)] |= out << np.uint32(BITS)
            out = here
        return out


def write(docs: DataFrame, path: str, file: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> None:
    """Encode whole texts by the tokenizers library, append end_id to each, and write segments in ascending order of document.

    parts: how many tasks share the work; without it, one for PART code points, but one for each core at least. Equal ids are
    dealt by the beginnings of their texts, so that a repeated id isn't one task's work.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    if parts is None:
        size = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
        parts = max(-(-size // PART), docs.sparkSession.sparkContext.defaultParallelism)
    ordered = rows.repartitionByRange(parts, "doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")

    def work(batches):
        encoder, part, seq = library_encoder(file), TaskContext.get().partitionId(), 0
        held_docs, held_ids, size = [], [], 0

        def segment():
            nonlocal seq, held_docs, held_ids, size
            blob = Codes.build(held_docs, held_ids).to_bytes()
            row = [[part], [seq], [len(held_docs)], [size], [blob]]
            seq, held_docs, held_ids, size = seq + 1, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "seq", "n_docs", "n_tokens", "payload"])

        last = np.array([end_id], np.uint32)
        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist()), strict=True):
                ids = np.concatenate([np.frombuffer(raw, "<u4"), last])
                if held_docs and size + len(ids) > SEGMENT:
                    yield segment()
                held_docs.append(doc)
                held_ids.append(ids)
                size += len(ids)
        if held_docs:
            yield segment()
        encoder.forget()

    ordered.mapInArrow(work, "part int, seq int, n_docs long, n_tokens long, payload binary").write.mode("overwrite").option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """part, seq (its segment), doc_id, at (ids before it in its segment), n_tokens, ids, for every document of a file."""
    segments = spark.read.parquet(path)

    def work(batches):
        for batch in batches:
            for part, seq, blob in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                codes = Codes.from_bytes(blob)
                ids, off = codes.ids().astype("<u4", copy=False), codes.offsets.astype(np.int64)
                n = len(codes.doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, part), pa.int32()), pa.array(np.full(n, seq), pa.int32()), pa.array(codes.doc_ids, pa.int64(), mask=codes.nulls.astype(bool)),
                        pa.array(off[:-1]), pa.array(np.diff(off)), pa.array([ids[a:b].tobytes() for a, b in zip(off, off[1:])], pa.binary()),
                    ],
                    ["part", "seq", "doc_id", "at", "n_tokens", "ids"],
                )

    decoded = segments.select("part", "seq", "payload").mapInArrow(work, "part int, seq int, doc_id long, at long, n_tokens long, ids binary")
    return decoded


def bases(spark: SparkSession, path: str) -> DataFrame:
    """part, seq, base: the ids before each segment. Totals of parts are summed first, so no task sorts all segments."""
    segments = spark.read.parquet(path).select("part", "seq", "n_tokens")
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    parts = segments.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("left", F.coalesce(F.sum("n").over(before("part")), F.lit(0)))
    inner = segments.withColumn("inner", F.coalesce(F.sum("n_tokens").over(before("part", "seq")), F.lit(0)))
    return inner.join(parts.select("part", "left"), "part").select("part", "seq", (F.col("left") + F.col("inner")).alias("base"))
