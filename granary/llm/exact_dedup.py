"""Exact deduplication against immutable snapshots that are screened by static binary-fuse filters.

`write_snapshot` writes a folder that never changes again:
  groups   by bucket: each distinct digest with its size, its best row and its normalised text (the exact buckets)
  filters  by bucket: a static binary-fuse filter of the bucket's digests
  rows     id and digest of every row
`dedup` groups a new batch by itself. Its digests meet the filters of their buckets; those that no
filter lets through never meet the snapshot. Positives join their exact bucket, and where the normalised
bytes are equal too, the batch's group and the snapshot's become one; the filter's errors end there.
Sizes and best rows of a snapshot's groups change by these matches alone. Filters are
as large as the snapshot, so they stay partitioned and are never broadcast.

Null texts count as empty; empty texts equal each other. Rows with a null id
take part; of equal texts the one with most code points stays, then the
smallest id, a null id last. Repeated rows are members like any other. Very long texts are hashed
whole. An empty table or snapshot gives an empty result for its part. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import math
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.session import materialize, shared_folder

#: Deleted before texts are compared.
WHITE = "[\\x20\\x09-\\x0D]+"
#: Snapshot digests to a filter, about, and incoming digests that one task screens by it.
BUCKET_KEYS = 100_000
#: Groups with more than this share of all rows meet their rows by a broadcast, so there are 100,000 of them at most (about 100 bytes each).
HOT_SHARE, HOT_LEAST = 100_000, 64
U64 = np.uint64


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A well-mixed 64-bit hash of 64-bit keys."""
    h = keys + U64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
    h = (h ^ (h >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


class BinaryFuse:
    """A static 3-wise binary-fuse filter with 8-bit fingerprints: no false negatives, about 1/256 false positives."""

    def __init__(self, seed: int, segment: int, segments: int, cells: np.ndarray):
        self.seed, self.segment, self.segments, self.cells = seed, segment, segments, cells

    @staticmethod
    def places(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
        """The cell of each key in each of three consecutive segments."""
        first = ((h >> U64(40)) * U64(segments)) >> U64(24)
        mask = U64(segment - 1)
        return np.stack([(first + U64(k)) * U64(segment) + ((h >> U64(13 * k)) & mask) for k in range(3)]).astype(np.int64)

    @staticmethod
    def prints(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> U64(32))) & U64(255)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse:
        keys = np.unique(keys.astype(U64))
        n = max(len(keys), 2)
        segment = min(1 << max(2, int(math.log(n) / math.log(3.33) + 2.25)), 1 << 13)
        factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))
        segments = max(1, math.ceil(n * factor / segment) - 2 + 1)
        for seed in range(1, 200):
            h = mixed(keys, seed)
            at = cls.places(h, segment, segments)
            order = cls.peel(at, (segments + 2) * segment)
            if order is not None:
                break
            segments += 1 + segments // 20
        else:
            raise RuntimeError("no binary-fuse filter found")
        cells, prints = np.zeros((segments + 2) * segment, np.uint8), cls.prints(h)
        for who, own in reversed(order):
            cells[own] = prints[who] ^ cells[at[0, who]] ^ cells[at[1, who]] ^ cells[at[2, who]]
        return cls(seed, segment, segments, cells)

    @staticmethod
    def peel(at: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Rounds of (keys, the cell that only that key has), until all keys are taken; None if some are stuck."""
        n = at.shape[1]
        count = np.bincount(at.ravel(), minlength=size)
        xored = np.zeros(size, np.int64)
        for k in range(3):
            np.bitwise_xor.at(xored, at[k], np.arange(n))
        rounds, taken = [], 0
        cells = np.flatnonzero(count == 1)
        while len(cells):
            who, index = np.unique(xored[cells], return_index=True)
            rounds.append((who, cells[index]))
            taken += len(who)
            touched = at[:, who].ravel()
            np.subtract.at(count, touched, 1)
            np.bitwise_xor.at(xored, touched, np.tile(who, 3))
            touched = np.unique(touched)
            cells = touched[count[touched] == 1]
        return rounds if taken == n else None

    def has(self, keys: np.ndarray) -> np.ndarray:
        h = mixed(keys.astype(U64), self.seed)
        at = self.places(h, self.segment, self.segments)
        return self.prints(h) == self.cells[at[0]] ^ self.cells[at[1]] ^ self.cells[at[2]]

    def to_bytes(self) -> bytes:
        return struct.pack("<4sIIQ", b"BFU8", self.seed, self.segment, self.segments) + self.cells.tobytes()

    @classmethod
    def from_bytes(cls, blob: bytes) -> BinaryFuse:
        magic, seed, segment, segments = struct.unpack_from("<4sIIQ", blob)
        if magic != b"BFU8":
            raise ValueError("not a binary-fuse filter")
        return cls(seed, segment, segments, np.frombuffer(blob, np.uint8, offset=struct.calcsize("<4sIIQ")))


def plain(text: Column) -> Column:
    """A text without white space."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), WHITE, "")


def digest_of(text: Column) -> Column:
    """SHA-256 of a text without white space, as bytes."""
    return F.unhex(F.sha2(plain(text).cast("binary"), 256))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, n_points (code points of the whole text), plain."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.select("doc_id", plain(F.col("text")).alias("plain"), F.length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long").alias("n_points"))
    return rows.select("doc_id", F.unhex(F.sha2(F.col("plain").cast("binary"), 256)).alias("digest"), "n_points", "plain")


def grouped(rows: DataFrame, *more: Column) -> DataFrame:
    """One row for each digest: its size, and the best row (most code points, then the smallest id, null last)."""
    best = F.struct((-F.col("n_points")).alias("n"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"))
    return rows.groupBy("digest").agg(F.count("*").alias("size"), F.min(best).alias("best"), *more)


def bucket(n) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(n) if isinstance(n, int) else n).alias("bucket")


def key_of(digest: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(x[:8] for x in digest.to_pylist()), "<u8")


def write_snapshot(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", bucket_keys: int = BUCKET_KEYS) -> None:
    """Write an immutable snapshot of all rows."""

    def build(key, table):
        blob = BinaryFuse.build(key_of(table.column("digest"))).to_bytes()
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64()), "filter": pa.array([blob], pa.binary())})

    spark, rows = docs.sparkSession, digests(docs, id_col, text_col)
    rows.select("doc_id", "digest").write.parquet(f"{path}/rows")
    groups = grouped(rows, F.any_value("plain").alias("plain"))
    groups.write.parquet(f"{path}/groups")
    groups = spark.read.parquet(f"{path}/groups")
    buckets = max(1, groups.count() // bucket_keys)
    filters = groups.select(bucket(buckets), "digest").groupBy("bucket").applyInArrow(build, "bucket long, filter binary")
    filters.withColumn("buckets", F.lit(buckets)).write.parquet(f"{path}/filters")


def screened(incoming: DataFrame, filters: DataFrame, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """Those digests of the incoming groups that the filter of their bucket lets through.

    A bucket with many incoming digests is dealt over tasks, each of which gets the filter.
    """
    known = filters.select("buckets").first()
    if known is None:
        return incoming.select("digest").limit(0)
    shares = max(1, incoming.count() // (known["buckets"] * bucket_keys))

    def screen(left, right):
        if not left.num_rows or not right.num_rows:
            return left.select(["digest"]).slice(0, 0)
        keep = BinaryFuse.from_bytes(right.column("filter")[0].as_py()).has(key_of(left.column("digest")))
        return left.select(["digest"]).filter(pa.array(keep))

    left = incoming.select(bucket(known["buckets"]), F.pmod(F.hash("digest"), F.lit(shares)).alias("share"), "digest")
    right = filters.select("bucket", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), "filter")
    return left.groupBy("bucket", "share").cogroup(right.groupBy("bucket", "share")).applyInArrow(screen, "digest binary")


def matches(spark: SparkSession, batch: DataFrame, groups: DataFrame, snapshot: str, id_col: str, text_col: str) -> DataFrame:
    """digest, and the snapshot's size and best row, for those groups of a batch whose text lies in the snapshot.

    groups: the batch's own, as `grouped` gives them. Only what the filters let through reaches the exact buckets.
    """
    positive = materialize(screened(groups, spark.read.parquet(f"{snapshot}/filters")))
    exact = spark.read.parquet(f"{snapshot}/groups").join(positive, "digest")
    mine = positive.join(groups.select("digest", F.col("best.doc_id").alias("best_id")), "digest")
    texts = digests(batch, id_col, text_col).withColumnsRenamed({"digest": "d", "plain": "p"}).drop("n_points")
    # the best row of each positive group; a repeated id has other digests or the same bytes
    own = mine.join(texts, (F.col("d") == F.col("digest")) & F.col("doc_id").eqNullSafe(F.col("best_id"))).groupBy("digest").agg(F.any_value("p").alias("p"))
    same = exact.join(own, "digest").filter(F.col("plain") == F.col("p"))
    return materialize(same.select("digest", "size", "best"))


def told(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """doc_id, digest, keep_id, group_size, kept, seen_before for rows (doc_id, digest) from their groups (own, size, best, seen_before).

    A row that is alone in its table is told by its group; others join it, those of the largest groups by a broadcast.
    """
    out = [F.col("best.doc_id").alias("keep_id"), F.col("size").alias("group_size")]
    alone = groups.filter("own = 1").select(F.col("own_id").alias("doc_id"), "digest", *out, "seen_before")
    total = groups.agg(F.coalesce(F.sum("own"), F.lit(0))).first()[0]
    many = groups.filter("own > 1").select("digest", *out, "seen_before", (F.col("own") > max(HOT_LEAST, total // HOT_SHARE)).alias("hot"))
    hot = rows.join(F.broadcast(many.filter("hot").drop("hot")), "digest", "left")
    parts = [alone, hot.filter("group_size is not null").select(alone.columns), hot.filter("group_size is null").select("doc_id", "digest").join(many.filter("not hot").drop("hot"), "digest").select(alone.columns)]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.select("doc_id", "digest", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "seen_before")


def merged(groups: DataFrame, others: DataFrame) -> DataFrame:
    """Groups with what the others of the same digest add: own, own_id (as they are alone) and size, best, seen_before (together)."""
    more = others.groupBy("digest").agg(F.sum("size").alias("more"), F.min("best").alias("other"))
    own = groups.select("digest", F.col("size").alias("own"), F.col("best.doc_id").alias("own_id"), F.col("best").alias("mine")).join(more, "digest", "left")
    return own.select("digest", "own", "own_id", (F.col("own") + F.coalesce("more", F.lit(0))).alias("size"), F.least("mine", F.coalesce("other", "mine")).alias("best"), F.col("more").isNotNull().alias("seen_before"))


def dedup(batch: DataFrame, snapshots: list[str], id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[DataFrame]]:
    """Rows of a batch, told against all snapshots and each other; and for each snapshot, digest, size and best of the batch's groups that lie in it."""
    spark = batch.sparkSession
    rows = materialize(digests(batch, id_col, text_col).drop("plain"))
    groups = materialize(grouped(rows))
    found = [matches(spark, batch, groups, path, id_col, text_col) for path in snapshots]
    every = spark.createDataFrame([], groups.schema)
    for one in found:
        every = every.unionByName(one)
    new = [groups.join(one.select("digest"), "digest", "left_semi") for one in found]
    return told(rows.select("doc_id", "digest"), materialize(merged(groups, every))), new


def exact_dedup(docs: DataFrame, in_snapshot: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the rows marked by in_snapshot (a boolean Column) as a snapshot, deduplicate the rest against it and among themselves.

    Returns every row: doc_id, digest, keep_id, group_size, kept, seen_before (its text lies on the other side too).
    """
    spark, path = docs.sparkSession, shared_folder(docs.sparkSession)
    sides = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(in_snapshot, F.lit(False)).alias("old"))
    write_snapshot(sides.filter("old"), path)
    rows, (new,) = dedup(sides.filter("not old"), [path])
    groups = materialize(merged(spark.read.parquet(f"{path}/groups").drop("plain"), new))
    return rows.unionByName(told(spark.read.parquet(f"{path}/rows"), groups))
