"""Near-duplicate vectors by a subspace pigeonhole join, exact at the given cosine.

Unit vectors with cosine s or more are at most sqrt(2 - 2s) apart. Rotated onto principal axes and split into blocks, such a pair has at
least one block in which its squared distance is within that block's share of the whole budget (shares go by the blocks' variance and
add up to one). Each block is range-joined on its own: its space is cut into cells by a binary
tree over its axes, deeper for labels with more vectors, and a vector goes to every cell that lies within half the
block's range of it. The midpoint of a pair in range lies within half the range of both, so both are in the
midpoint's cell. A pair is counted in one place: in the first block whose budget holds it, and there in the cell of its midpoint; then
the cosine of the original vectors decides, in double precision.

Cells get a vector's coordinates in their own block only, two bytes each; whoever has a neighbour in range there is looked at again with the whole vector.
Cells of more than TILE vectors are worked on in tiles: part with part. Tasks return counts of links by vector and a
spanning forest of the links, never the links.

Equal vectors of a label are one node with a weight. Vectors of each length are joined among themselves. The rotations of the LEARNT commonest lengths
are learnt on a sample of SAMPLE vectors each, other lengths keep their axes, which bears on speed, not on the result.

Defined cases: null labels and vectors that are null, empty, zero or with null, infinite or NaN components link with nothing and are components of their own;
so do vectors of different lengths with one another; repeated ids are nodes of their own, told apart by vector and label; a null id counts as a vector, but is never
the least id, and is not kept; empty tables give empty results. Only the named columns are looked at, whatever others exist. Equal vectors are told by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, lookup, runs
from .components import components
from .words import mix

#: Vectors that a rotation is learnt on, and lengths that have one of their own.
SAMPLE, LEARNT = 10_000, 8
#: Axes of a block.
BLOCK = 16
#: Vectors of a cell that the tree aims at, and of one part of a tile at up to 64 axes; fewer of longer vectors.
CELL, TILE = 4_096, 8_192
MAX_DEPTH = 24


def units(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


class Subspaces:
    """The rotation, the blocks' ranges and the trees' thresholds for vectors of one length. sample: unit vectors, which may be none."""

    def __init__(self, sample: np.ndarray, cosine: float) -> None:
        dim = sample.shape[1]
        budget = 2 - 2 * cosine + 1e-9
        variance, axes = np.linalg.eigh(np.atleast_2d(np.cov(sample.T))) if len(sample) > 1 else (np.ones(dim), np.eye(dim))
        order = np.argsort(-variance, kind="stable")
        variance, axes = np.maximum(variance[order], 1e-12), axes[:, order]
        n = max(1, dim // BLOCK)
        deal = [np.arange(b, dim, n) for b in range(n)]  # axes dealt by turns: blocks of like variance
        self.dim, self.cosine = dim, cosine
        self.axes = np.hstack([axes[:, d] for d in deal])
        self.bounds = np.cumsum([0, *map(len, deal)])
        share = np.array([variance[d].sum() for d in deal])
        self.limit = budget * share / share.sum()
        turned = sample @ self.axes
        self.cutpoints = []
        for b, d in enumerate(deal):
            x = turned[:, self.bounds[b] : self.bounds[b + 1]]
            per_axis = -(-MAX_DEPTH // len(d))
            self.cutpoints.append([[np.quantile(x[:, k], (np.arange(1, 1 << (p + 1), 2)) / (1 << (p + 1))) if len(x) else np.zeros(1 << p) for p in range(per_axis)] for k in range(len(d))])

    def cells(self, x: np.ndarray, block: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of x (block coordinates) and the cells within half the block's range of them: bits of depth splits, each halving a slab of one axis by turns."""
        half = np.sqrt(self.limit[block]) / 2 + 1e-9
        row, code, far = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros((len(x), x.shape[1]))
        slab = np.zeros((len(x), x.shape[1]), np.int64)
        for level in range(depth):
            k, p = level % x.shape[1], level // x.shape[1]
            at = x[row, k] - self.cutpoints[block][k][p][slab[:, k]]
            out = []
            for bit, gap in ((0, np.maximum(at, 0)), (1, np.maximum(-at, 0))):
                f = far.copy()
                f[:, k] = np.maximum(f[:, k], gap)
                keep = np.flatnonzero((f * f).sum(axis=1) <= half * half)
                s = slab[keep].copy()
                s[:, k] = s[:, k] * 2 + bit
                out.append((row[keep], code[keep] * 2 + bit, f[keep], s))
            row, code, far, slab = (np.concatenate(z) for z in zip(*out))
        return row, code

    def home(self, x: np.ndarray, block: int, depth: int) -> np.ndarray:
        """The one cell that each point lies in."""
        code, slab = np.zeros(len(x), np.int64), np.zeros((len(x), x.shape[1]), np.int64)
        for level in range(depth):
            k, p = level % x.shape[1], level // x.shape[1]
            bit = (x[:, k] > self.cutpoints[block][k][p][slab[:, k]]).astype(np.int64)
            code, slab[:, k] = code * 2 + bit, slab[:, k] * 2 + bit
        return code

    def links(self, v: np.ndarray, left: np.ndarray, right: np.ndarray, block: int, depth: int, cell: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows of v, one marked left and one right, that are linked and to be counted here; some rows' pairs at a time."""
        unit = units(v)
        t = unit @ self.axes
        x = t[:, self.bounds[block] : self.bounds[block + 1]]
        for i, j in _in_range(x, left, right, self.limit[block] + 1e-7):
            for k in range(0, len(i), 50_000):
                a, b = i[k : k + 50_000], j[k : k + 50_000]
                ok = np.einsum("ij,ij->i", unit[a], unit[b]) >= self.cosine
                a, b = a[ok], b[ok]
                d = t[a] - t[b]
                inside = np.add.reduceat(d * d, self.bounds[:-1], axis=1) <= self.limit
                ok = inside[:, block] & (inside.argmax(axis=1) == block)
                a, b = a[ok], b[ok]
                ok = self.home((x[a] + x[b]) / 2, block, depth) == cell
                if ok.any():
                    yield a[ok], b[ok]


def _in_range(x: np.ndarray, left: np.ndarray, right: np.ndarray, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a left and a right row within a squared distance, each pair once; a part of the left rows at a time."""
    rows, cols = np.flatnonzero(left), np.flatnonzero(right)
    both, norm, step = left & right, (x * x).sum(axis=1), max(1, (1 << 21) // max(1, len(cols)))
    for k in range(0, len(rows), step):
        r = rows[k : k + step]
        i, j = np.nonzero(norm[r][:, None] + norm[cols][None] - 2 * (x[r] @ x[cols].T) <= limit)
        i, j = r[i], cols[j]
        keep = (i != j) & ((i < j) | ~(both[i] & both[j]))
        if keep.any():
            yield i[keep], j[keep]


class Spaces:
    """Subspaces by length of the vectors."""

    def __init__(self, learnt: dict[int, Subspaces], cosine: float) -> None:
        self.known, self.cosine = learnt, cosine

    def of(self, dim: int) -> Subspaces:
        return self.known.get(dim) or Subspaces(np.zeros((0, dim)), self.cosine)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def learn(nodes: DataFrame, cosine: float) -> Spaces:
    """nodes: dim, node, v. Lengths of one cell's vectors or fewer have nothing to learn."""
    common = nodes.groupBy("dim").agg(F.count("*").alias("m")).filter(F.col("m") > CELL).orderBy(F.desc("m"), "dim").limit(LEARNT).collect()
    out = {}
    for dim in (r["dim"] for r in common):
        got = nodes.filter(F.col("dim") == dim).orderBy(F.xxhash64("node")).limit(max(dim, min(SAMPLE, (4 << 20) // dim))).select("v").toPandas()["v"]
        out[dim] = Subspaces(units(np.stack(got.to_list()).astype(float)), cosine)
    return Spaces(out, cosine)


def _cells(nodes: DataFrame, spaces: Spaces) -> DataFrame:
    """key, block, cell, depth, dim, node and x (coordinates in the block) of every cell that a vector goes to. nodes: part (label and length), node, dim, depth, v."""

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            dims, deep = b.column(2).to_numpy(), b.column(3).to_numpy()
            for dim in np.unique(dims).tolist():
                space = spaces.of(dim)
                for d in np.unique(deep[dims == dim]).tolist():
                    own = np.flatnonzero((dims == dim) & (deep == d))
                    t = units(_matrix(b.column(4).take(pa.array(own)), dim)) @ space.axes
                    part, node = (b.column(k).to_numpy()[own] for k in range(2))
                    for block in range(len(space.limit)):
                        x = t[:, space.bounds[block] : space.bounds[block + 1]]
                        row, code = space.cells(x, block, d)
                        key = mix(mix(part[row].view(np.uint64)) + mix((code * 4096 + block).astype(np.uint64))).view(np.int64)
                        small = np.ascontiguousarray(x.astype("<f2"))
                        n, width = len(row), 2 * x.shape[1]
                        cols = [pa.array(key), pa.array(np.full(n, block, np.int32)), pa.array(code), pa.array(np.full(n, d, np.int32)), pa.array(np.full(n, dim, np.int32)), pa.array(node[row])]
                        raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), n, [None, pa.py_buffer(small[row].tobytes())]).cast(pa.binary())
                        yield pa.RecordBatch.from_arrays([*cols, raw], names=["key", "block", "cell", "depth", "dim", "node", "x"])

    return nodes.select("part", "node", "dim", "depth", "v").mapInArrow(place, "key long, block int, cell long, depth int, dim int, node long, x binary")


PLACE = ("tile", "block", "cell", "depth", "dim", "node", "left", "right")


def _near(cells: DataFrame, spaces: Spaces) -> DataFrame:
    """tile, block, cell, depth, dim, node, left, right: the vectors of each tile that have others in range in its block."""
    side = F.greatest(F.lit(min(512, TILE)), F.least(F.lit(TILE), F.floor(F.lit(TILE * 64) / F.col("dim"))))
    full = cells.groupBy("key", "dim").agg(F.count("*").alias("m")).filter(F.col("m") > side)
    full = cut(full.select("key", "m", F.ceil(F.col("m") / side).cast("int").alias("k")), "vector-tiles")
    tiled = lookup(cells, full, "key", "m").withColumn("k", F.coalesce("k", F.lit(1)))
    tiled = tiled.withColumn("p", F.pmod(F.xxhash64("node"), F.col("k")).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    lo, hi = F.least("p", "q"), F.greatest("p", "q")
    tile = F.when(F.col("k") == 1, F.col("key")).otherwise(F.xxhash64("key", lo, hi))
    tiled = tiled.select(tile.alias("tile"), "block", "cell", "depth", "dim", "node", (F.col("p") == lo).alias("left"), (F.col("p") == hi).alias("right"), "x")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in runs(it):
            if t.num_rows < 2:
                continue
            t = t.combine_chunks()
            x = np.frombuffer(b"".join(t.column("x").to_pylist()), "<f2").reshape(t.num_rows, -1).astype(np.float32)
            left, right = (t.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("left", "right"))
            limit = spaces.of(t.column("dim")[0].as_py()).limit[t.column("block")[0].as_py()]
            near = np.zeros(len(x), bool)
            for i, j in _in_range(x, left, right, (np.sqrt(limit) + 1.2e-3) ** 2 + 1e-5):  # as coarse as two bytes a coordinate
                near[i] = near[j] = True
            if near.any():
                yield from t.drop_columns(["x"]).filter(pa.array(near)).to_batches()

    schema = "tile long, block int, cell long, depth int, dim int, node long, left boolean, right boolean"
    return cut(tiled.repartition("tile").sortWithinPartitions("tile").mapInArrow(run, schema), "vector-near", [full])


def _links(near: DataFrame, nodes: DataFrame, spaces: Spaces) -> DataFrame:
    """node, n, other: how many vectors a node links with in a tile, or (n = 0) an edge of the spanning forest."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in runs(it):
            t = t.combine_chunks()
            block, cell, depth, dim = (t.column(c)[0].as_py() for c in ("block", "cell", "depth", "dim"))
            node, w = t.column("node").to_numpy(), t.column("w").to_numpy()
            left, right = (t.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("left", "right"))
            n, root, edges = np.zeros(len(node)), np.arange(len(node)), []
            for i, j in spaces.of(dim).links(_matrix(t.column("v").chunk(0), dim), left, right, block, depth, cell):
                n += np.bincount(i, weights=w[j], minlength=len(node)) + np.bincount(j, weights=w[i], minlength=len(node))
                open_ = root[i] != root[j]
                for a, b in zip(i[open_].tolist(), j[open_].tolist()):
                    if root[a] != root[b]:
                        edges.append((a, b))
                        root[root == root[b]] = root[a]
            has = np.flatnonzero(n)
            a, b = node[np.array(edges, np.int64).reshape(-1, 2).T]
            if len(has):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in ((node[has], a), (n[has].astype(np.int64), np.zeros(len(a), np.int64)), (node[has], b))], names=["node", "n", "other"])

    rows = near.join(nodes.select("node", "w", "v"), "node").select(*PLACE, "w", "v")
    return cut(rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(run, "node long, n long, other long"), "vector-links", [near])


def join(vectors: DataFrame, cosine: float = 0.98, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id (least id that links reach) and kept (vec_id is component_id) of every row."""
    v = F.col(vector)
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0) & F.col(label).isNotNull()
    narrow = vectors.schema[vector].dataType.simpleString() == "array<float>"  # such are shuffled as they are
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), (v if narrow else v.cast("array<double>")).alias("v"), F.coalesce(sound, F.lit(False)).alias("sound"))
    good, key = rows.filter("sound"), F.xxhash64("label", "v")
    nodes = good.groupBy("label", "v").agg(F.count("*").alias("w"), F.min("vec_id").alias("first_id"))
    nodes = cut(nodes.select("v", "w", "first_id", key.alias("node"), F.size("v").alias("dim"), F.xxhash64("label", F.size("v")).alias("part")), "vectors")
    spaces = learn(nodes, cosine)
    sizes = nodes.groupBy("part").agg(F.count("*").alias("m"))
    depth = F.least(F.lit(MAX_DEPTH), F.greatest(F.lit(0), F.ceil(F.log2(F.col("m") / CELL)))).cast("int")
    sizes = cut(sizes.select("part", "m", depth.alias("depth")), "vector-parts")
    cells = cut(_cells(lookup(nodes, sizes, "part", "m"), spaces), "cells", [sizes])
    near = _near(cells, spaces)
    discard(vectors.sparkSession, cells)
    found = _links(near, nodes, spaces)
    roots = components(found.filter("n = 0").select(F.col("node").alias("a"), F.col("other").alias("b")))
    known = nodes.select("node", "first_id", "w").join(found.groupBy("node").agg(F.sum("n").alias("n")), "node", "left").join(roots, "node", "left")
    # A vector that is alone is its own component; the others are looked up.
    known = cut(known.filter("w > 1 or n > 0").withColumn("root", F.coalesce("root", "node")), "vector-known", [nodes, found])
    least = cut(known.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("__n")), "vector-least")
    known = lookup(known, least, "root", "__n").select("node", "w", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), "component_id")
    known = cut(known, "vector-groups", [known, least])
    out = lookup(good.select("vec_id", key.alias("node")), known, "node", "w")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    rest = rows.filter("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
