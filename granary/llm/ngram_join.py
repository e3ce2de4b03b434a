"""N-gram Jaccard join with set-relation skipping.

Texts link when the Jaccard similarity of their shingle sets reaches a
threshold. The join is exact and goes in steps, each a Spark job:

1. A frequency sketch of all shingles, of fixed size, orders them: rare first,
   then by hash. Any order gives the same result; this one keeps lists short.
2. Equal sets form a class. A class is listed under its first shingles: if two
   sets overlap enough, they share EXTRA of these at least.
3. Relations between sets: in each list, classes of like size elect one as
   head; a class that turns out to be similar to the head it met most often (FAMILY)
   joins the head's family and keeps only its difference from the head.
4. Inside a family the answers are derived from the head's: a member that its difference leaves linked with the head
   needs no other comparison. For the rest, two members share what
   the head has, less what each lacks, plus what their differences share, so products of
   small matrices of differences give all their links at once.
5. The lists are joined between families alone. Lists lie in blocks by position;
   a pair of blocks whose positions and sizes leave too little room is skipped, and so are
   pairs of one family. Heads that met often enough are intersected once; a pair
   of families too far apart for any of its members ends there, and so does one whose members the links found so far
   have all joined. In the others members' answers are derived as in step 4, but where the heads are joined, only for members that aren't.

No list, family or copy group is gathered whole: lists whose sketch says that
they are long are split, and their parts meet in pairs; families meet in parts.
Links go to connected components as spanning forests, so copies are never expanded into
pairs, and no link between different sets that would join two components is lost.

Null texts, and texts without words, have an empty set and link with nothing. Very long
texts are compared whole: their sets are made by a task that reads one of them at a time.
Rows with a null id link with nothing. Rows that repeat an id share its component. An
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.graph import components
from granary.llm.near_vectors import roots
from granary.llm.words import mix, shingle_sets
from granary.session import materialize

U64 = np.uint64
SKETCH_BITS = 18
#: Shared shingles of the lists that a linked pair has at least (fewer for tiny sets).
EXTRA = 3
#: Entries of a bucket of lists, about, and entries of one list from which on it is split.
BUCKET, SPLIT = 400_000, 40_000
#: Similarity to the head from which a set joins a family (less than the threshold), and members of a part of a family.
FAMILY, PART = 0.6, 1024
#: Rows of node, id and digest (32 bytes each) that may be broadcast to fetch texts; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
BLOCK = 256


def raw_texts(column: pa.Array) -> list[bytes]:
    return pc.fill_null(column, "").cast(pa.binary()).to_pylist()


def sketch(rows: DataFrame, hashes) -> np.ndarray:
    """How often hashes of each of 2**SKETCH_BITS buckets occur, summed in a tree of tasks; hashes gives those of a batch."""

    def count(batches):
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            found = hashes(batch)
            if len(found):
                total += np.bincount((found >> U64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total))
        parts = np.split(total, 8)
        yield pa.RecordBatch.from_arrays([pa.array(range(8), pa.int32()), pa.array([TaskContext.get().partitionId()] * 8, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], ["part", "task", "n"])

    def add(key, found):
        total = sum(np.frombuffer(x, np.int64) for x in found.column("n").to_pylist())
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "task": pa.array([key[1].as_py()], pa.int64()), "n": pa.array([total.tobytes()], pa.binary())})

    tasks, got = rows.rdd.getNumPartitions(), rows.mapInArrow(count, "part int, task long, n binary")
    while tasks > 1:
        got = got.withColumn("task", F.floor(F.col("task") / 64)).groupBy("part", "task").applyInArrow(add, "part int, task long, n binary")
        tasks = -(-tasks // 64)
    found = {r["part"]: np.frombuffer(r["n"], np.int64) for r in got.collect()}
    return np.concatenate([found.get(k, np.zeros((1 << SKETCH_BITS) // 8, np.int64)) for k in range(8)])


def of_texts(n: int):
    """The shingles of a batch of texts."""

    def hashes(batch):
        sets = shingle_sets(raw_texts(batch.column(0)), n)
        return np.concatenate(sets) if sets else np.empty(0, np.uint64)

    return hashes


def of_lists(batch) -> np.ndarray:
    """The shingles under which a batch of classes is listed."""
    return np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64)


def ceil_share(n: np.ndarray, num: int, den: int):
    return -(-n * num // den)


def listed(size: int, num: int, den: int) -> int:
    """Shingles under which a set of this size is listed."""
    least = int(ceil_share(size, num, den))
    return size - least + min(EXTRA, least)

#: Parts of a component that meet its smallest id apart.
SPREAD = 32


def described(rows: DataFrame, order: np.ndarray, n: int, num: int, den: int) -> DataFrame:
    """doc_id, size, sha (of the set), lists (the shingles that list it, in order)."""
    shared = rows.sparkSession.sparkContext.broadcast(order)

    def work(batches):
        counts = shared.value
        for batch in batches:
            sets = shingle_sets(raw_texts(batch.column(1)), n)
            sha, first = [], []
            for s in sets:
                sha.append(hashlib.sha256(s.tobytes()).digest()[:16])
                k = listed(len(s), num, den) if len(s) else 0
                first.append(s[np.lexsort((s, counts[(s >> U64(64 - SKETCH_BITS)).astype(np.int64)]))[:k]].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(sha, pa.binary()), pa.array(first, pa.binary())], ["doc_id", "size", "sha", "lists"])

    return rows.select("doc_id", "text").mapInArrow(work, "doc_id long, size long, sha binary, lists binary")


POSTINGS = "bucket long, side int, node long, head long, size int, place int, shingle long"


def postings(classes: DataFrame, buckets: int, lengths: np.ndarray, meeting: bool, split: int) -> DataFrame:
    """Packed entries of lists by bucket: node, head, size, place and shingle arrays.

    A list longer than `split` (by a sketch of all lists, which never counts too low) is cut into
    parts by a hash of the node. With meeting, each two parts of it meet in a bucket
    of their own, where `side` tells them apart; otherwise each part is alone.
    """
    shared = classes.sparkSession.sparkContext.broadcast(lengths)

    def work(batches):
        counts = shared.value
        for batch in batches:
            node, head, size = (batch.column(k).to_numpy() for k in range(3))
            lists = [np.frombuffer(x, np.uint64) for x in batch.column(3).to_pylist()]
            n = np.array([len(x) for x in lists], np.int64)
            if not n.sum():
                continue
            shingle = np.concatenate(lists)
            owner = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(shingle)) - np.repeat(np.cumsum(n) - n, n)
            parts = -(-counts[(shingle >> U64(64 - SKETCH_BITS)).astype(np.int64)] // split)
            bucket = (shingle % U64(buckets)).astype(np.int64)
            mine = (node[owner].astype(np.uint64) * U64(0x9E3779B97F4A7C15) >> U64(40)).astype(np.int64) % np.maximum(parts, 1)
            whole = np.flatnonzero(parts <= 1)
            entries = [(whole, bucket[whole] << 32, np.zeros(len(whole), np.int64))]
            for k in np.flatnonzero(parts > 1):
                m, p = int(mine[k]), int(parts[k])
                for other in range(p) if meeting else (m,):
                    low, high = min(m, other), max(m, other)
                    entries.append((np.array([k]), np.array([(bucket[k] << 32) + 1 + low * p + high]), np.array([0 if m == other else 1 + (m == high)])))
            at, where, side = (np.concatenate(x) for x in zip(*entries, strict=True))
            order_ = np.argsort(where, kind="stable")
            at, where, side = at[order_], where[order_], side[order_]
            cuts = np.flatnonzero(np.diff(where)) + 1
            cols = [side.astype("<i4"), node[owner[at]].astype("<i8"), head[owner[at]].astype("<i8"), size[owner[at]].astype("<i4"), place[at].astype("<i4"), shingle[at].view("<i8")]
            starts = np.concatenate([[0], cuts])
            packed = [[p.tobytes() for p in np.split(c, cuts)] for c in cols]
            yield pa.RecordBatch.from_arrays([pa.array(where[starts])] + [pa.array(p, pa.binary()) for p in packed], ["bucket", "side", "node", "head", "size", "place", "shingle"])

    rows = classes.select("node", "head", "size", "lists")
    return rows.mapInArrow(work, "bucket long, side binary, node binary, head binary, size binary, place binary, shingle binary")


def unpacked(found: pa.Table) -> dict[str, np.ndarray]:
    kinds = {"side": "<i4", "node": "<i8", "head": "<i8", "size": "<i4", "place": "<i4", "shingle": "<i8"}
    return {c: np.frombuffer(b"".join(found.column(c).to_pylist()), t) for c, t in kinds.items()}


def counted(a: np.ndarray, b: np.ndarray, weight: np.ndarray | None = None, need: np.ndarray | None = None) -> pa.Table:
    """Distinct pairs, how often they occur, and the least that is needed of them."""
    if len(a):
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        first = np.concatenate([[0], np.flatnonzero((np.diff(a) != 0) | (np.diff(b) != 0)) + 1])
        n = np.diff(np.concatenate([first, [len(a)]])) if weight is None else np.add.reduceat(weight[order], first)
        need = None if need is None else np.minimum.reduceat(need[order], first)
        a, b = a[first], b[first]
    else:
        n = np.empty(0, np.int64)
    out = {"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64())}
    return pa.table(out if need is None else out | {"need": pa.array(need, pa.int64())})


def elected(lists: DataFrame, num: int, den: int) -> DataFrame:
    """a (class), b (head), n: in each list, the first by a hash of the classes of like size is their head.

    By a hash, so that lists of near copies agree on a typical one.
    """

    def work(key, found):
        e = unpacked(found)
        band = np.floor(np.log(e["size"]) / np.log(den / num) * 0.999).astype(np.int64)
        order = np.lexsort((mix(e["node"].astype(np.uint64)), band, e["shingle"]))
        shingle, band, node = e["shingle"][order], band[order], e["node"][order]
        new = np.concatenate([[True], (np.diff(shingle) != 0) | (np.diff(band) != 0)]) if len(node) else np.empty(0, bool)
        head = node[np.flatnonzero(new)][np.cumsum(new) - 1] if len(node) else node
        return counted(node[~new], head[~new])

    return lists.groupBy("bucket").applyInArrow(work, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def list_pairs(e: dict[str, np.ndarray], num: int, den: int):
    """Pairs of entries of one list, of two families (and two sides, if the list is split), that leave room for a link."""
    left = e["size"] - e["place"] + EXTRA - 1  # the most shingles that can still be shared, and those allowed before
    order = np.lexsort((e["place"], e["shingle"]))
    shingle = e["shingle"][order]
    starts = np.concatenate([[0], np.flatnonzero(np.diff(shingle)) + 1, [len(shingle)]]) if len(shingle) else np.zeros(1, int)
    lengths = np.diff(starts)

    def good(i, j):
        i, j = order[i], order[j]
        x, y = e["size"][i].astype(np.int64), e["size"][j].astype(np.int64)
        ok = (e["head"][i] != e["head"][j]) & (np.minimum(x, y) * den >= np.maximum(x, y) * num)
        ok &= np.minimum(left[i], left[j]) * (num + den) >= (x + y) * num
        ok &= (e["side"][i] == 0) | (e["side"][i] != e["side"][j])
        return i[ok], j[ok]

    for length in np.unique(lengths[lengths > 1]):
        first = starts[:-1][lengths == length]
        if length <= BLOCK:
            i, j = np.triu_indices(length, 1)
            for s in range(0, len(first), max(1, (1 << 20) // len(i))):
                f = first[s : s + max(1, (1 << 20) // len(i)), None]
                yield good((f + i).ravel(), (f + j).ravel())
            continue
        for f in first:  # by blocks of like position
            blocks = [(a, min(a + BLOCK, f + length)) for a in range(f, f + length, BLOCK)]
            room = [left[order[a:b]].max() for a, b in blocks]
            least = [e["size"][order[a:b]].min() for a, b in blocks]
            for p, (a, b) in enumerate(blocks):
                for q in range(p, len(blocks)):
                    if min(room[p], room[q]) * (num + den) < (int(least[p]) + int(least[q])) * num:
                        continue
                    c, d = blocks[q]
                    i, j = (x.ravel() for x in np.meshgrid(np.arange(a, b), np.arange(c, d), indexing="ij"))
                    keep = i < j
                    yield good(i[keep], j[keep])


def met(lists: DataFrame, num: int, den: int) -> DataFrame:
    """a, b (heads, a < b) of families whose members share enough lists that leave room for a link."""

    def work(key, found):
        e = unpacked(found)
        least = np.minimum(EXTRA, ceil_share(e["size"].astype(np.int64), num, den))
        none = np.empty(0, np.int64)
        kept = [none, none, none, none]
        for i, j in list_pairs(e, num, den):
            p, q = e["head"][i], e["head"][j]
            new = [np.minimum(p, q), np.maximum(p, q), np.ones(len(p), np.int64), np.minimum(least[i], least[j])]
            kept = [np.concatenate(x) for x in zip(kept, new, strict=True)]
            if len(kept[0]) > 1 << 21:
                t = counted(*kept)
                kept = [t.column(c).to_numpy() for c in ("a", "b", "n", "need")]
        return counted(*kept)

    found = lists.groupBy("bucket").applyInArrow(work, "a long, b long, n long, need long")
    return found.groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("need").alias("need")).filter("n >= need").select("a", "b")


def sets_of(nodes: DataFrame, classes: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """node, set: the whole shingle sets of those classes, from the texts of their first rows."""
    wanted = materialize(nodes.distinct().join(classes, "node").select("node", F.col("rep").alias("doc_id"), "sha"))
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted

    def work(batches):
        for batch in batches:
            sets = [s.tobytes() for s in shingle_sets(raw_texts(batch.column(2)), n)]
            same = [hashlib.sha256(s).digest()[:16] == h for s, h in zip(sets, batch.column(1).to_pylist(), strict=True)]  # an id may repeat
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "set"]).filter(pa.array(same, pa.bool_()))

    found = rows.join(wanted, "doc_id").select("node", "sha", "text").mapInArrow(work, "node long, set binary")
    return materialize(found.dropDuplicates(["node"]))


def intersected(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, both (size of the intersection), lacks (of b, not in a), adds (of a, not in b) for pairs of classes."""

    def work(batches):
        for batch in batches:
            both, lacks, adds = [], [], []
            for p, q in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                inside = np.isin(x, y, assume_unique=True, kind="sort")
                both.append(int(inside.sum()))
                adds.append(x[~inside].tobytes())
                lacks.append(np.setdiff1d(y, x, assume_unique=True).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(both, pa.int64()), pa.array(lacks, pa.binary()), pa.array(adds, pa.binary())], ["a", "b", "both", "lacks", "adds"])

    joined = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(work, "a long, b long, both long, lacks binary, adds binary")


def linked(both, x, y, num: int, den: int):
    return both * den >= (x + y - both) * num


def shared(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of x has in common with each of y, by products of their incidence, some columns at a time."""
    flat = np.concatenate([*x, *y]) if x or y else np.empty(0, np.uint64)
    seen, at, n = np.unique(flat, return_inverse=True, return_counts=True)
    column = np.full(len(seen), -1, np.int64)
    column[n > 1] = np.arange(int((n > 1).sum()))
    column = column[at]
    row = np.repeat(np.arange(len(x) + len(y)), [len(s) for s in (*x, *y)])
    out = np.zeros((len(x), len(y)), np.float32)
    for a in range(0, int((n > 1).sum()), 4096):
        inside = (column >= a) & (column < a + 4096)
        m = np.zeros((len(x) + len(y), 4096), np.float32)
        m[row[inside], column[inside] - a] = 1
        out += m[: len(x)] @ m[len(x) :].T
    return out.astype(np.int64)


def spanning(x: list[tuple], y: list[tuple], head: int, same: bool, num: int, den: int) -> pa.Table:
    """A spanning forest of the links between members (node, size, lacks, adds; all from one head of a given size)."""
    differ = lambda m: [np.concatenate([r[2], r[3]]) for r in m]
    sizes = lambda m: np.array([r[1] for r in m], np.int64)
    lacks = lambda m: np.array([len(r[2]) for r in m], np.int64)
    both = head - lacks(x)[:, None] - lacks(y)[None] + shared(differ(x), differ(y))
    hit = linked(both, sizes(x)[:, None], sizes(y)[None], num, den)
    i, j = np.nonzero(np.triu(hit, 1) if same else hit)
    nodes = np.array([r[0] for r in (x if same else [*x, *y])], np.int64)
    root = roots(len(nodes), i, j if same else j + len(x))
    some = np.flatnonzero(root != np.arange(len(nodes)))
    return pa.table({"a": pa.array(nodes[some]), "b": pa.array(nodes[root[some]])})


def members_of(found: pa.Table, side: int) -> list[tuple]:
    rows = found.filter(pc.equal(found.column("side"), side))
    lists = [[np.frombuffer(v, np.uint64) for v in rows.column(c).to_pylist()] for c in ("lacks", "adds")]
    return list(zip(rows.column("node").to_pylist(), rows.column("size").to_pylist(), *lists, strict=True))


MEMBER = ["node", "size", "lacks", "adds"]


def inside_families(members: DataFrame, num: int, den: int) -> DataFrame:
    """a, b: edges that connect what is linked inside each family (columns head, head_size, part, parts and MEMBER).

    A member linked with its head needs no more than that edge, which its differences alone decide. Only the others, part by part, are
    compared with all of the family.
    """
    lacks, adds = F.length("lacks") / 8, F.length("adds") / 8
    both = F.col("head_size") - lacks
    near = linked(both, F.col("size"), F.col("head_size"), num, den)
    told = members.withColumn("near", near & (adds + both == F.col("size")))
    stars = told.filter("near and node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    loose = told.filter("not near")
    counts = loose.groupBy("head").agg(F.ceil(F.count("*") / PART).cast("int").alias("loose_parts"))
    loose = loose.join(counts, "head").withColumn("j", F.pmod(F.hash("node"), F.col("loose_parts")))
    left = loose.select("head", "head_size", "j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), *MEMBER, F.lit(0).alias("side"))
    right = members.join(counts, "head").select("head", "head_size", F.explode(F.sequence(F.lit(0), F.col("loose_parts") - 1)).alias("j"), F.col("part").alias("i"), *MEMBER, F.lit(1).alias("side"))

    def work(key, found):
        return spanning(members_of(found, 0), members_of(found, 1), found.column("head_size")[0].as_py(), False, num, den)

    return stars.unionByName(left.unionByName(right).groupBy("head", "i", "j").applyInArrow(work, "a long, b long"))


def between_families(pairs: DataFrame, members: DataFrame, parts: DataFrame, heads: DataFrame, num: int, den: int) -> DataFrame:
    """a, b: a spanning forest of the links between members of each pair of families (heads a and b).

    members: with apart (how far they are from their head) and rest (not in the component of their head); parts: how many parts each
    family has, and of rest members. pairs: with the distance of the heads, and for each family how wide and large its members are. In a pair whose heads are joined already (same) only rest members of either side meet the other side.
    """
    count = parts.select("head", "parts", "rests")
    tasks = pairs.join(count.withColumnsRenamed({"head": "a", "parts": "pa", "rests": "ra"}), "a").join(count.withColumnsRenamed({"head": "b", "parts": "pb", "rests": "rb"}), "b")
    ways = F.when(F.col("same"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0)))
    facts = ["distance", "wide_a", "wide_b", "largest_a", "largest_b"]
    tasks = tasks.select("a", "b", *facts, "pa", "pb", "ra", "rb", F.explode(ways).alias("way")).filter("way = 0 or (way = 1 and ra > 0) or (way = 2 and rb > 0)")
    tasks = tasks.select("a", "b", *facts, "way", F.explode(F.sequence(F.lit(0), F.col("pa") - 1)).alias("i"), "pb").select("a", "b", *facts, "way", "i", F.explode(F.sequence(F.lit(0), F.col("pb") - 1)).alias("j"))
    columns = ["a", "b", "way", "i", "j", *MEMBER]
    sides = []
    for side, (head, part, way, other) in enumerate((("a", "i", 1, "b"), ("b", "j", 2, "a"))):
        t, m = tasks.alias("t"), members.alias("m")
        # a member as near its own head as this can't come near enough to any of the other family
        far = F.col("t.distance") - F.col("m.apart") - F.col(f"t.wide_{other}")
        reach = (F.col("m.size") + F.col(f"t.largest_{other}")) * (den - num)
        wanted = (F.col(f"t.{head}") == F.col("m.head")) & (F.col(f"t.{part}") == F.col("m.part")) & ((F.col("t.way") != way) | F.col("m.rest")) & (far * (den + num) <= reach)
        sides.append(t.join(m, wanted).select(*columns, F.lit(side).alias("side")))
    top = heads.select(F.col("node").alias("h"), "set")
    cores = [tasks.join(top, F.col(c) == F.col("h")).select("a", "b", "way", "i", "j", F.col("h").alias("node"), F.lit(0).cast("long").alias("size"), F.col("set").alias("lacks"), F.lit(b"").alias("adds"), F.lit(s).alias("side")) for c, s in (("a", 2), ("b", 3))]

    def work(key, found):
        mine, theirs = (members_of(found, s)[0][2] for s in (2, 3))
        y = []
        for node, size, lacks, adds in members_of(found, 1):  # as differences from the other head
            whole = np.union1d(np.setdiff1d(theirs, lacks, assume_unique=True), adds)
            y.append((node, size, np.setdiff1d(mine, whole, assume_unique=True), np.setdiff1d(whole, mine, assume_unique=True)))
        return spanning(members_of(found, 0), y, len(mine), False, num, den)

    every = sides[0].unionByName(sides[1]).unionByName(cores[0]).unionByName(cores[1])
    return every.groupBy("a", "b", "way", "i", "j").applyInArrow(work, "a long, b long")


def followed(votes: DataFrame) -> DataFrame:
    """a, b: each class with the head that its head follows in the end. A head precedes its followers by a hash, so this ends."""
    while True:
        ahead = votes.select(F.col("a").alias("b"), F.col("b").alias("far"))
        votes = materialize(votes.select("a", "b").join(ahead, "b", "left").select("a", F.coalesce("far", "b").alias("b"), F.col("far").isNotNull().alias("moved")))
        if votes.filter("moved").isEmpty():
            return votes.select("a", "b")


def similar(pairs: DataFrame, classes: DataFrame, rows: DataFrame, of, n: int) -> DataFrame:
    """Those pairs of classes that are similar enough for a family, with their difference and sizes."""
    pairs = materialize(pairs)
    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")), classes, rows, n)
    hit = intersected(pairs, sets).join(of("a"), "a").join(of("b"), "b")
    return materialize(hit.filter(F.col("both") >= FAMILY * (F.col("size_a") + F.col("size_b") - F.col("both"))))


def ngram_join(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET, split: int = SPLIT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links, itself included), for every row; similarity num / den or more links."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = sketch(rows.select("text"), of_texts(n))
    known = materialize(described(rows, order, n, num, den))
    usable = known.filter("size > 0 and doc_id is not null")
    classes = materialize(usable.groupBy("sha").agg(F.min("doc_id").alias("rep"), F.first("size").alias("size"), F.first("lists").alias("lists")).withColumn("node", F.monotonically_increasing_id()))
    total = classes.agg(F.coalesce(F.sum(F.length("lists") / 8), F.lit(0)).cast("long")).first()[0]
    buckets = max(1, total // bucket)
    lengths = sketch(classes.select("lists"), of_lists)
    # families
    votes = elected(postings(classes.withColumn("head", F.col("node")), buckets, lengths, False, split), num, den)
    best = votes.groupBy("a").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("b"))).alias("v")).select("a", F.col("v.b").alias("b"), (-F.col("v.n")).alias("n"))
    enough = best.join(classes.select(F.col("node").alias("a"), (F.length("lists") / 8).alias("k")), "a").filter("n * 5 >= k")
    sizes = classes.select("node", "size")
    of = lambda c: sizes.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"))
    hit = similar(followed(materialize(enough.select("a", "b"))), classes, rows, of, n)
    member = hit.select(F.col("a").alias("node"), F.col("b").alias("head"), "lacks", "adds", (F.col("size_a") + F.col("size_b") - 2 * F.col("both")).alias("apart"))
    # every class with its family; a head is its own
    none = F.lit(b"")
    whole = classes.join(member, "node", "left").withColumn("head", F.coalesce("head", "node"))
    whole = materialize(whole.select("node", "rep", "head", "size", "lists", F.coalesce("lacks", none).alias("lacks"), F.coalesce("adds", none).alias("adds"), F.coalesce("apart", F.lit(0)).alias("apart")))
    span = materialize(whole.groupBy("head").agg(F.max("apart").alias("wide"), F.count("*").alias("members"), F.max("size").alias("largest"), F.ceil(F.count("*") / PART).cast("int").alias("parts"), F.max(F.when(F.col("node") == F.col("head"), F.col("size"))).alias("head_size")))
    members = whole.select("head", "apart", *MEMBER).join(span.select("head", "parts", "head_size", "members"), "head")
    members = materialize(members.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")))
    edges = materialize(inside_families(members.filter("members > 1"), num, den))
    # between families
    pairs = materialize(met(postings(whole, buckets, lengths, True, split), num, den))
    more = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")), classes, rows, n)
    facts = lambda c: span.select(F.col("head").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("wide", "members", "largest", "head_size")])
    seen = intersected(pairs, more).select("a", "b", "both").join(facts("a"), "a").join(facts("b"), "b")
    # linked members differ in (1 - t) / (1 + t) of the sum of their sizes at most, and heads by as much as their families are wide on top
    most = (F.col("largest_a") + F.col("largest_b")) * (den - num) / (den + num) + F.col("wide_a") + F.col("wide_b")
    heads_link, alone = linked(F.col("both"), F.col("head_size_a"), F.col("head_size_b"), num, den), F.col("members_a") + F.col("members_b") == 2
    seen = seen.withColumn("distance", F.col("head_size_a") + F.col("head_size_b") - 2 * F.col("both"))
    near = F.col("distance") <= most
    seen = materialize(seen.withColumn("link", heads_link).filter(F.when(alone, F.col("link")).otherwise(near)).select("a", "b", "link", alone.alias("alone"), "distance", "wide_a", "wide_b", "largest_a", "largest_b"))
    # the classes that rows of one id lie in belong together
    rep = classes.select("node", "sha", "rep")
    twice = usable.groupBy("doc_id").agg(F.min("sha").alias("p"), F.max("sha").alias("q")).filter("p <> q").select("doc_id")
    apart = materialize(usable.join(twice, "doc_id", "left_semi").select("doc_id", "sha").distinct().join(rep, "sha").select("doc_id", "node"))
    again = apart.join(apart.groupBy("doc_id").agg(F.min("node").alias("b")), "doc_id").select(F.col("node").alias("a"), "b")
    edges = edges.unionByName(seen.filter("link").select("a", "b")).unionByName(again)
    joined = components(edges)
    open_pairs = seen.filter("not alone").drop("link", "alone")
    if not open_pairs.isEmpty():
        # pairs of families whose members are all in one component by now have nothing left to find
        state = members.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
        tops = state.filter("node = head").select("head", F.col("component").alias("main"))
        state = materialize(state.join(tops, "head").withColumn("rest", F.col("component") != F.col("main")))
        parts = materialize(state.groupBy("head", "main").agg(F.max("parts").alias("parts"), F.count_if("rest").alias("rests")))
        fact = lambda c: parts.select(F.col("head").alias(c), F.col("main").alias(f"main_{c}"), F.col("rests").alias(f"rests_{c}"))
        left = open_pairs.join(fact("a"), "a").join(fact("b"), "b").withColumn("same", F.col("main_a") == F.col("main_b"))
        left = materialize(left.filter("not same or rests_a + rests_b > 0").drop("main_a", "main_b", "rests_a", "rests_b"))
        if not left.isEmpty():
            joined = components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(between_families(left, state, parts, more, num, den)))
    named = rep.join(joined, "node", "left").withColumn("linked", F.col("component").isNotNull()).withColumn("component", F.coalesce("component", "node"))
    # a component may hold a third of all classes: they meet its smallest id over several tasks
    ids = named.filter("linked").groupBy("component").agg(F.min("rep").alias("component_id")).select("*", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("salt"))
    placed = named.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SPREAD)).cast("int")).join(ids, ["component", "salt"], "left")
    found = known.join(placed.select("sha", F.coalesce("component_id", "rep").alias("c")), "sha", "left")
    usable_row = (F.col("size") > 0) & F.col("doc_id").isNotNull()
    return found.select("doc_id", F.col("size").alias("n_shingles"), F.when(usable_row, F.col("c")).otherwise(F.col("doc_id")).alias("component_id"))
