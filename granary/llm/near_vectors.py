"""Near-duplicate vectors by PCA-ordered tiled comparison.

Equal vectors of a label form a class; only classes are compared. Unit vectors
are turned onto the principal axes of a bounded sample (which steers the speed,
not the result). Labels too large for one tile are cut by a grid over the
leading axes, whose cells are as wide as two linked vectors can lie apart,
cells into slabs along the next axis, and slabs into tiles. A tile is one packed row, with the box that its
vectors fill on the first LEAD axes and the range of their suffix norms. Only tiles of the same or adjoining cells of a label
are paired, and only if their boxes and norms leave room for a link; so no vector moves for a pair that can't hold one.
Inside a pair of tiles, products are accumulated over the leading axes, the
rest of each product is bounded by the suffix norms, and pairs that can't reach
the threshold stop there. What is left is tested on the original vectors in double precision.
A pair of tiles returns link counts and a spanning forest, never all pairs.

Vectors link with nothing if the label, the id or the vector is null, or if the vector is
empty, zero or holds null or non-finite components; vectors of different lengths never link.
Of a repeated id, every row counts as a vector. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.graph import components
from granary.session import materialize

#: Classes of a tile, about.
TILE = 1536
#: Vectors that fit the axes, at most. Vectors longer than WIDE are turned onto the NARROW leading axes alone.
SAMPLE, WIDE, NARROW = 4096, 2048, 64
#: Axes of the grid, and axes of a tile's box.
AXES, LEAD = 2, 16
#: Below the threshold by which a bound counts as reaching it, for rounding.
SLACK = 1e-9


def prepared(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """vec_id, label, key: the vector's doubles as bytes, null if it links with nothing."""

    def work(batches):
        for batch in batches:
            lists = batch.column(1)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<f8") + 0.0  # a null component becomes NaN
            ends = np.cumsum(sizes)
            ok = (sizes > 0) & batch.column(2).is_valid().to_numpy(zero_copy_only=False) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            count = lambda x: np.concatenate([[0], np.cumsum(x)])[ends] - np.concatenate([[0], np.cumsum(x)])[ends - sizes]
            ok &= (count(~np.isfinite(flat)) == 0) & (count(flat != 0) > 0)
            keys = [flat[e - n : e].tobytes() if good else None for e, n, good in zip(ends, sizes, ok, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(keys, pa.binary())], ["vec_id", "label", "key"])

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label"))
    return rows.mapInArrow(work, "vec_id long, label string, key binary")


def units(keys: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(keys), "<f8").reshape(len(keys), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal_axes(classes: DataFrame, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """For each length of vectors, the axes of a bounded sample by falling variance; for long ones the leading few."""
    by: dict[int, list[bytes]] = {}
    for limit, those in ((sample, F.length("key") <= 8 * WIDE), (sample // 16, F.length("key") > 8 * WIDE)):
        for (key,) in classes.filter(those).orderBy(F.xxhash64("rep"), "rep").limit(limit).select("key").collect():
            by.setdefault(len(key), []).append(bytes(key))
    out = {}
    for n, keys in by.items():
        u = units(keys)
        if n <= 8 * WIDE:
            _, axes = np.linalg.eigh(u.T @ u)
            out[n // 8] = np.ascontiguousarray(axes[:, ::-1])
        else:
            _, _, axes = np.linalg.svd(u, full_matrices=False)
            out[n // 8] = np.ascontiguousarray(axes[:NARROW].T)
    return out


def turned(unit: np.ndarray, axes: np.ndarray | None) -> np.ndarray:
    """Unit vectors on the axes; without axes (a length that the sample doesn't hold), as they are."""
    return unit if axes is None else unit @ axes


def links(a: np.ndarray, b: np.ndarray, axes: np.ndarray | None, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of rows in two tiles of unit vectors that can be linked: all that are, and on axes that don't span all dimensions some that aren't."""
    x, y = turned(a, axes), turned(b, axes)
    width = x.shape[1]
    rest = lambda z, k: np.sqrt(np.maximum(1 - (z[:, :k] ** 2).sum(axis=1), 0)) + SLACK * (k < a.shape[1])
    sums, done, i = np.zeros((len(x), len(y))), 0, None
    for k in (8, 16, 32, width):
        k = min(k, width)
        if done >= k:
            continue
        if i is None:
            sums += x[:, done:k] @ y[:, done:k].T
            can = sums + rest(x, k)[:, None] * rest(y, k)[None] >= threshold - SLACK
            if same:
                can = np.triu(can, 1)
            if can.sum() < 0.05 * can.size or k == width:
                i, j = np.nonzero(can)
                part = sums[i, j]
        else:
            part = part + np.einsum("ij,ij->i", x[i, done:k], y[j, done:k])
            can = part + rest(x, k)[i] * rest(y, k)[j] >= threshold - SLACK
            i, j, part = i[can], j[can], part[can]
        done = k
    return i, j


def exact(i: np.ndarray, j: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs reach the threshold, by the cosine of the original vectors."""
    out = np.zeros(len(i), bool)
    na, nb = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
    for s in range(0, len(i), 1 << 16):
        p, q = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
        out[s : s + (1 << 16)] = np.einsum("ij,ij->i", a[p], b[q]) / (na[p] * nb[q]) >= threshold
    return out


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest place that each of n places is connected with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def tiled(classes: DataFrame, axes: dict[int, np.ndarray], wide: float, tile: int) -> DataFrame:
    """node, label, n, key, dim and the cell and tile of each class; a label that fits one tile has one cell."""

    def place(batches):
        for batch in batches:
            keys = batch.column(3).to_pylist()
            z, sizes = np.zeros((len(keys), AXES + 1)), np.array([len(k) for k in keys], np.int64)
            for size in np.unique(sizes):  # one product for all vectors of a length
                at = np.flatnonzero(sizes == size)
                t = turned(units([keys[k] for k in at]), axes.get(int(size) // 8))[:, : AXES + 1]
                z[at, : t.shape[1]] = t
            cells = np.floor(z[:, :AXES] / wide + 0.5).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * AXES, pa.int32()), pa.array(cells.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, listed, pa.array(z[:, AXES])], [*batch.schema.names, "cell", "along"])

    placed = classes.select("node", "label", "n", "key").mapInArrow(place, "node long, label string, n long, key binary, cell array<int>, along double").withColumn("dim", (F.length("key") / 8).cast("int"))
    placed = materialize(placed)
    sizes = placed.groupBy("label", "dim").agg(F.count("*").alias("m"))
    placed = placed.join(sizes, ["label", "dim"]).withColumn("cell", F.when(F.col("m") > tile, F.col("cell")).otherwise(F.array_repeat(F.lit(0), AXES))).drop("m")
    spans = placed.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / tile).alias("slabs"), F.min("along").alias("low"), F.max("along").alias("high"))
    share = F.coalesce(F.try_divide(F.col("along") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0))
    slabs = placed.join(spans, ["label", "dim", "cell"]).withColumn("slab", F.least(F.col("slabs") - 1, F.floor(share * F.col("slabs"))).cast("int")).drop("slabs", "low", "high", "along")
    slabs = materialize(slabs)
    parts = slabs.groupBy("label", "dim", "cell", "slab").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))
    tile_of = F.struct("slab", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"))
    return slabs.join(parts, ["label", "dim", "cell", "slab"]).select("label", "dim", "cell", tile_of.alias("tile"), "node", "n", "key")


def packed_tiles(placed: DataFrame, axes: dict[int, np.ndarray]) -> DataFrame:
    """A row for each tile: its classes as bytes, the box they fill on the leading axes (low, high), and the range of what is left of their norms (from, to)."""

    def pack(key, found):
        keys = found.column("key").to_pylist()
        z = turned(units(keys), axes.get(len(keys[0]) // 8))[:, :LEAD]
        rest = np.sqrt(np.maximum(1 - (z * z).sum(axis=1), 0))
        box = [pa.array([x.tolist()], pa.list_(pa.float64())) for x in (z.min(axis=0), z.max(axis=0))]
        same = [found.column(c).slice(0, 1) for c in ("label", "dim", "cell", "tile")]
        blobs = [found.column("node").to_numpy().astype("<i8").tobytes(), found.column("n").to_numpy().astype("<i8").tobytes(), b"".join(keys)]
        return pa.table([*same, *[pa.array([x], pa.binary()) for x in blobs], *box, pa.array([rest.min()]), pa.array([rest.max()])], ["label", "dim", "cell", "tile", "nodes", "ns", "keys", "low", "high", "least", "most"])

    kinds = "label string, dim int, cell array<int>, tile struct<slab:int,part:int>, nodes binary, ns binary, keys binary, low array<double>, high array<double>, least double, most double"
    return placed.groupBy("label", "dim", "cell", "tile").applyInArrow(pack, kinds)


def tile_pairs(packed: DataFrame, apart: float) -> DataFrame:
    """t, u: tiles of the same or adjoining cells whose boxes and norms leave room for a link."""
    tiles = packed.select("label", "dim", "cell", "tile", "low", "high", "least", "most")
    near = tiles
    for k in range(AXES):  # the cells around, one axis after the other
        near = near.withColumn(f"d{k}", F.explode(F.array(*[F.lit(d) for d in (-1, 0, 1)])))
    near = near.withColumn("other", F.array(*[F.col("cell")[k] + F.col(f"d{k}") for k in range(AXES)])).drop(*[f"d{k}" for k in range(AXES)])
    gap = lambda a_low, a_high, b_low, b_high: F.greatest(F.lit(0.0), a_low - b_high, b_low - a_high)
    apart_by = F.zip_with(F.arrays_zip("a.low", "a.high"), F.arrays_zip("b.low", "b.high"), lambda x, y: F.pow(gap(x["low"], x["high"], y["low"], y["high"]), F.lit(2.0)))
    square = F.aggregate(apart_by, F.lit(0.0), lambda s, x: s + x) + F.pow(gap(F.col("a.least"), F.col("a.most"), F.col("b.least"), F.col("b.most")), F.lit(2.0))
    name = lambda x: F.struct(*[F.col(f"{x}.{c}") for c in ("label", "dim", "cell", "tile")])
    met = near.alias("a").join(tiles.alias("b"), (F.col("a.label") == F.col("b.label")) & (F.col("a.dim") == F.col("b.dim")) & (F.col("a.other") == F.col("b.cell")))
    return met.filter(name("a") <= name("b")).filter(square <= apart + 1e-6).select(name("a").alias("t"), name("b").alias("u"))


def near_vectors(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", tile: int = TILE) -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id (smallest id reachable), kept, for every row."""
    rows = materialize(prepared(vectors, id_col, vec_col, label_col))
    usable = rows.filter("key is not null")
    classes = materialize(usable.groupBy("label", "key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id()))
    axes = principal_axes(classes)
    apart = max(2 - 2 * threshold, 0.0)  # the square of how far linked unit vectors can lie apart
    wide = float(np.sqrt(apart) + 1e-6)
    placed = tiled(classes, axes, wide, tile)
    packed = materialize(packed_tiles(placed, axes))
    pairs = materialize(tile_pairs(packed, apart))
    mine = packed.select("label", "dim", "cell", "tile", "nodes", "ns", "keys")
    side = lambda x: mine.select(F.struct("label", "dim", "cell", "tile").alias(x), F.col("nodes").alias(f"{x}_nodes"), F.col("ns").alias(f"{x}_ns"), F.col("keys").alias(f"{x}_keys"))
    both = pairs.join(side("t"), "t").join(side("u"), "u").select("t.dim", (F.col("t") == F.col("u")).alias("same"), *[f"{x}_{c}" for x in "tu" for c in ("nodes", "ns", "keys")])

    def meet(batches):
        for batch in batches:
            for dim, same, *blobs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                p, q = ((np.frombuffer(nodes, "<i8"), np.frombuffer(ns, "<i8"), np.frombuffer(keys, "<f8").reshape(-1, dim)) for nodes, ns, keys in (blobs[:3], blobs[3:]))
                x, y = unit_rows(p[2]), unit_rows(q[2])
                i, j = links(x, y, axes.get(dim), threshold, same)
                ok = exact(i, j, p[2], q[2], threshold)
                i, j = i[ok], j[ok] + (0 if same else len(p[0]))
                node, n = (p[0], p[1]) if same else (np.concatenate([p[0], q[0]]), np.concatenate([p[1], q[1]]))
                linked = np.zeros(len(node), np.int64)
                np.add.at(linked, i, n[j])
                np.add.at(linked, j, n[i])
                some = np.flatnonzero(linked)
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[roots(len(node), i, j)[some]]), pa.array(linked[some])], ["a", "b", "n"])

    found = materialize(both.mapInArrow(meet, "a long, b long, n long"))
    linked = found.groupBy("a").agg(F.sum("n").alias("linked")).withColumnRenamed("a", "node")
    joined = components(found.select("a", "b"))
    reps = classes.select("node", "rep", "label", "key", "n").join(joined, "node", "left")
    comps = reps.groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("rep").alias("component_id"))
    known = reps.withColumn("component", F.coalesce("component", "node")).join(comps, "component").join(linked, "node", "left")
    known = known.select("label", "key", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("links"), "component_id")
    out = rows.join(known, ["label", "key"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
