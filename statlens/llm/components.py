"""Connected components of a graph held as a table of edges.

Large-star and small-star steps by turns (Kiveris et al., 2014): every node's larger neighbours are tied to
the least node around it, then its smaller ones, until each component is a star about its least node. Edges stay tables; each round
is written to the shared folder, so a lost executor costs a task and not the run. Edges of a node that has very many are
not dealt out by that node: what such hubs have to know of themselves is aggregated and broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard

#: Nodes with so many edges, and with more than that share of all edges, are hubs: MAX_HUBS of them at most, by the share.
HUB_EDGES, MAX_HUBS = 200_000, 1_000


def _at(rows: DataFrame, node: str, value: str, least: str, edges: int, wanted: str = "true") -> DataFrame:
    """The wanted rows, with the column `least`: the least `value` among all rows with the same node. `edges`: how many rows there may be."""
    if edges <= HUB_EDGES:
        return rows.withColumn(least, F.min(value).over(Window.partitionBy(node))).filter(wanted)
    found, rows = rows.groupBy(node).agg(F.min(value).alias(least), F.count("*").alias("__n")), rows.filter(wanted)
    hubs = F.broadcast(found.filter(F.col("__n") > max(HUB_EDGES, edges // MAX_HUBS)).drop("__n"))
    return rows.join(hubs, node).unionByName(rows.join(hubs.select(node), node, "left_anti").join(found.drop("__n"), node))


def _pairs(rows: DataFrame, *pairs: tuple[str, str], names: tuple[str, str]) -> DataFrame:
    """A row for each of the pairs of columns in each row, in one pass over rows."""
    each = F.array(*(F.struct(F.col(x).alias(names[0]), F.col(y).alias(names[1])) for x, y in pairs))
    return rows.select(F.explode(each).alias("__pair")).select(*(F.col(f"__pair.{n}") for n in names))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: for every node with an edge to another, the least node of its component. Loops and repeats in edges are ignored."""
    spark = edges.sparkSession
    e = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter("hi <> lo").distinct()
    e = cut(e, "edges")
    before = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(e.select("lo", "lo").distinct())
        before = tuple(now)
        both, n = _pairs(e, ("hi", "lo"), ("lo", "hi"), names=("u", "v")), now[0]
        if 2 * n > HUB_EDGES and both.groupBy("u").count().filter(F.col("count") > max(HUB_EDGES, 2 * n // MAX_HUBS)).isEmpty():
            n = 0  # no node is a hub, in large neither: windows need no care
        large = _at(both, "u", "v", "m", 2 * n, "v > u").select(F.col("v").alias("hi"), F.least("u", "m").alias("lo"))
        least = _at(large, "hi", "lo", "m", n)
        new = cut(_pairs(least, ("lo", "m"), ("hi", "m"), names=("hi", "lo")).filter("hi <> lo").distinct(), "edges")
        discard(spark, e)
        e = new
