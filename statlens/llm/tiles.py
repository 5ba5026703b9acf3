"""Links within groups of candidates, in tiles of bounded size.

A group whose members may link with one another is cut into units. Each unit is compared within itself and with the first unit of its
size band; that joins most of a large group of near copies. Then only what is outside the group's main component is compared with
all members of fitting size; where it is known which members of a group may link at all, with those only. Whatever two members link,
some tile compares them or they are in one component already.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, few, runs
from .components import components

#: Finds links in a tile. It gets the members' payloads as a table, which are on the left and right side, and a function to tell a link found
#: between two members by number; it need not look at pairs that are joined already (see Forest).
Kernel = Callable[[pa.Table, np.ndarray, np.ndarray, "Forest"], None]


class Forest:
    """Spanning edges of what was linked, and each member's root so far."""

    def __init__(self, n: int) -> None:
        self.root, self.edges = np.arange(n), []

    def link(self, i: int, j: int) -> None:
        if self.root[i] != self.root[j]:
            self.edges.append((i, j))
            self.root[self.root == self.root[j]] = self.root[i]


def _tiles(members: DataFrame, tiles: DataFrame, payload: DataFrame, kernel: Kernel, done: list[DataFrame]) -> DataFrame:
    """a, b: links found in tiles, a table of cut(). members: c, g, unit; tiles: g, ua, ub, tile; payload: c and what the kernel reads; done: tables of cut() that nothing reads afterwards."""
    sides = tiles.select("g", F.col("ua").alias("unit"), "tile", F.lit(True).alias("left"), (F.col("ua") == F.col("ub")).alias("right"))
    sides = sides.union(tiles.filter("ua <> ub").select("g", "ub", "tile", F.lit(False), F.lit(True)))
    names = [x for x in payload.columns if x != "c"]
    # Who goes to which tile is a small table beside the payloads, which then move once, to their tiles.
    placed = cut(members.join(sides, ["g", "unit"]).select("tile", "c", "left", "right"), "placed")
    rows = payload.join(few(placed), "c").select("tile", "c", "left", "right", *names)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in runs(it):
            t = t.combine_chunks()
            ids = t.column("c").to_numpy()
            forest = Forest(len(ids))
            kernel(t, *(t.column(x).to_numpy(zero_copy_only=False).astype(bool) for x in ("left", "right")), forest)
            if forest.edges:
                yield pa.RecordBatch.from_arrays([pa.array(ids[list(x)], pa.int64()) for x in zip(*forest.edges)], names=["a", "b"])

    return cut(rows.repartition("tile").sortWithinPartitions("tile", "c").mapInArrow(run, "a long, b long"), "links", [placed, *done])


def _units(members: DataFrame, part: list[str], docs: int, weight: int) -> tuple[DataFrame, DataFrame]:
    """members with a unit number, hashed into as many units as each part needs; and the units: g, unit and part's columns."""
    size = members.groupBy("g", *part).agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    size = size.withColumn("k", F.ceil(F.greatest(F.col("m") / docs, F.col("s") / weight)).cast("int"))
    m = members.join(size.select("g", *part, "k"), ["g", *part]).withColumn("i", F.pmod(F.xxhash64("c"), F.col("k")).cast("int"))
    units = size.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return tuple(x.withColumn("unit", F.xxhash64(*part, "i")) for x in (m, units))


def links(members: DataFrame, payload: DataFrame, kernel: Kernel, ratio: float, docs: int, weight: int, inner: DataFrame | None = None) -> DataFrame:
    """node, root: the components that links form. members: c, g (group), n (size, 1 or more); payload: c and the kernel's columns.

    inner: c, k (smaller groups, that any two members that may link have in common), where these are known; rows may repeat.
    Members link only if their sizes' ratio is `ratio` or more. A unit has about `docs` members, and sizes of `weight` in sum, at most. Both tables are read several times.
    """
    total = members.groupBy("g").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    whole = (F.col("m") <= docs) & (F.col("s") <= weight)
    band = F.when(whole, F.lit(0)).otherwise(F.floor(F.log("n") / -math.log(ratio) + 1e-9)).cast("int")
    banded = cut(members.join(total, "g").select("c", "g", "n", band.alias("band"), whole.alias("whole")), "banded")
    m, units = _units(banded, ["band"], docs, weight)
    own = units.select("g", F.col("unit").alias("ua"), F.col("unit").alias("ub"))
    zero = units.filter("i = 0").select("g", "band", F.col("unit").alias("ub"))
    pivot = units.filter("i > 0").select("g", "band", F.col("unit").alias("ua")).join(zero, ["g", "band"]).select("g", "ua", "ub")
    tile = F.xxhash64("g", "ua", "ub").alias("tile")
    first = _tiles(m, own.union(pivot).select("g", "ua", "ub", tile), payload, kernel, [])
    found = components(first)
    rest = banded.filter(~F.col("whole"))
    if rest.isEmpty():
        discard(first.sparkSession, first), discard(first.sparkSession, banded)
        return found
    rest = rest.join(found.select(F.col("node").alias("c"), "root"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    main = rest.groupBy("g", "root").agg(F.count("*").alias("k")).groupBy("g").agg(F.max_by("root", F.struct("k", "root")).alias("main"))
    rest = cut(rest.join(main, "g").select("c", "n", "g", "band", (F.col("root") == F.col("main")).alias("core")), "rest", [banded])
    if inner is not None:
        close = inner.join(few(rest), "c").select("c", "n", F.col("k").alias("g"), "band", "core").distinct()
        rest = cut(close.join(close.groupBy("g").agg(F.bool_and("core").alias("done")).filter("not done"), "g", "left_semi"), "close", [rest])
    m, units = _units(rest, ["band", "core"], docs, weight)
    a, b = (units.select("g", F.col("unit").alias(f"u{x}"), F.col("band").alias(f"b{x}"), F.col("core").alias(f"c{x}")) for x in "ab")
    near = (F.abs(F.col("ba") - F.col("bb")) <= 1) & ~F.col("ca") & (F.col("cb") | (F.col("ua") <= F.col("ub")))
    second = _tiles(m, a.join(b, "g").filter(near).select("g", "ua", "ub", tile), payload, kernel, [rest])
    found = components(first.union(second))
    discard(first.sparkSession, first), discard(first.sparkSession, second)
    return found
