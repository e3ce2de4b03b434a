"""Byte-level BPE encoding and decoding of whole texts, long ones by overlapping chunks.

A text longer than a chunk is cut into chunks that overlap. Each chunk is
pre-tokenised by itself, wherever it lies; left of its own end a scan is right
from the first boundary that it shares with the scan of the chunk before, for a
match depends on nothing to its left. At such a shared boundary, behind a
character that isn't white space, the chunks are stitched, and the pieces
between stitches are encoded in parallel. Two chunks that share no
boundary within the overlap (one pre-token fills it) stay in one piece. Decoding
concatenates the bytes of the tokens.

Null texts count as empty and give no ids. Repeated rows, equal texts and null ids are kept
as they are. Shorter texts than a chunk are a chunk by themselves; a very long one is cut in one pass. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.tokens import rank_encoder
from granary.session import materialize

CHUNK = 1 << 16
OVERLAP = 1 << 12
#: Code points before a chunk's end whose scan may have missed what follows; no alternative looks further.
MARGIN = 8


def encode_rows(rows: DataFrame, file: str, pattern: str) -> DataFrame:
    """ids for the last column, a text; the other columns stay."""

    def work(batches):
        encoder = rank_encoder(file, pattern)
        for batch in batches:
            texts = pc.fill_null(batch.columns[-1], "").to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([encoder.encode(t) for t in texts], pa.binary())], [*batch.schema.names[:-1], "ids"])

    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes[:-1])
    return rows.mapInArrow(work, f"{kinds}, ids binary")


def boundaries(chunks: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """For each chunk, the ends of pre-tokens (behind no white space) in the overlap with the chunk before and after, counted from the text's start."""

    def work(batches):
        import regex

        scan = regex.compile(pattern)
        for batch in batches:
            heads, tails = [], []
            for k, last, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                ends = np.array([m.end() for m in scan.finditer(text) if not text[m.end() - 1].isspace()], np.int64)
                sure = ends if last else ends[ends <= len(text) - MARGIN]
                heads.append((sure[sure < overlap] + k * chunk).astype("<i8").tobytes() if k else b"")
                tails.append((sure[sure >= chunk] + k * chunk).astype("<i8").tobytes() if not last else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(heads, pa.binary()), pa.array(tails, pa.binary())], ["rid", "k", "head", "tail"])

    return chunks.mapInArrow(work, "rid long, k int, head binary, tail binary")


def stitches(zones: DataFrame) -> DataFrame:
    """For each text, the positions where its chunks are stitched, ascending. Two chunks that share no boundary stay in one piece."""

    def work(key, found):
        rows = sorted(zip(found.column("k").to_pylist(), found.column("head").to_pylist(), found.column("tail").to_pylist(), strict=True))
        at: list[int] = []
        for (_, _, tail), (_, head, _) in zip(rows, rows[1:], strict=False):
            both = np.intersect1d(np.frombuffer(tail, "<i8"), np.frombuffer(head, "<i8"))
            both = both[both > (at[-1] if at else 0)]
            if len(both):
                at.append(int(both[0]))
        return pa.table({"rid": pa.array([key[0].as_py()], pa.int64()), "at": pa.array([at], pa.list_(pa.int64()))})

    return zones.groupBy("rid").applyInArrow(work, "rid long, at array<bigint>")


def chunked(long: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """rid, k, last, part: the overlapping chunks of each text (rid, text), a row each, cut in one pass."""

    def work(batches):
        for batch in batches:
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = -(-(len(text) - overlap) // chunk)
                for k in range(n):
                    part = text[k * chunk : (k + 1) * chunk + overlap]
                    yield pa.RecordBatch.from_arrays([pa.array([rid]), pa.array([k], pa.int32()), pa.array([k == n - 1]), pa.array([part], pa.string())], ["rid", "k", "last", "part"])

    return long.select("rid", "text").mapInArrow(work, "rid long, k int, last boolean, part string")


def pieces(cuts: DataFrame) -> DataFrame:
    """rid, k, text: the pieces of each text (rid, text, at) between its stitches, a row each, cut in one pass."""

    def work(batches):
        for batch in batches:
            for rid, text, at in zip(*(batch.column(c).to_pylist() for c in ("rid", "text", "at")), strict=True):
                for k, (a, b) in enumerate(zip([0, *at], [*at, len(text)], strict=True)):
                    yield pa.RecordBatch.from_arrays([pa.array([rid]), pa.array([k], pa.int32()), pa.array([text[a:b]], pa.string())], ["rid", "k", "text"])

    return cuts.select("rid", "text", "at").mapInArrow(work, "rid long, k int, text string")


def joined(coded: DataFrame) -> DataFrame:
    """rid, ids: the ids of all pieces of a text in order. A task holds the ids of one text, which are one value of the result."""

    def work(key, found):
        parts = [x for _, x in sorted(zip(found.column("k").to_pylist(), found.column("ids").to_pylist(), strict=True))]
        return pa.table({"rid": pa.array([key[0].as_py()], pa.int64()), "ids": pa.array([b"".join(parts)], pa.binary())})

    return coded.groupBy("rid").applyInArrow(work, "rid long, ids binary")


def encode(docs: DataFrame, file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers of the whole text)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = F.length("text")
    short = encode_rows(rows.filter(size <= chunk + overlap), file, pattern)
    long = materialize(rows.filter(size > chunk + overlap).select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text"))
    chunks = chunked(long, chunk, overlap).repartition("rid", "k")
    cuts = long.join(stitches(boundaries(chunks, pattern, chunk, overlap)), "rid")
    coded = encode_rows(pieces(cuts).repartition("rid", "k"), file, pattern)
    return short.unionByName(long.select("rid", "doc_id").join(joined(coded), "rid").select("doc_id", "ids"))


def decode(coded: DataFrame, file: str, pattern: str) -> DataFrame:
    """Add decoded: the bytes of all the ids."""

    def work(batches):
        encoder = rank_encoder(file, pattern)
        for batch in batches:
            ids = batch.columns[-1].to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([encoder.decode(x or b"") for x in ids], pa.binary())], [*batch.schema.names, "decoded"])

    rows = coded.select(*[c for c in coded.columns if c != "ids"], "ids")
    return rows.mapInArrow(work, ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", decoded binary")
