"""Merkle fixity audit of record archives held in two replicas.

Records are hashed one by one (level 0). Ordered offset ranges of each file are hashed over the
records that start in them, then every `fanout` ranges into one of the next level, up to one root a
file. The audit compares roots and descends, level by level, only into ranges that differ; records
are compared only inside differing ranges of the lowest level. Two equal replicas cost one comparison of roots.

All of it is grouping and joining of digests; payloads are read once, where they lie, and never shuffled.

Defined cases: a null payload is a lost record and counts as absent from its replica; a null file name is a file of its own;
an empty payload is a record of length 0; repeated rows are records of their own, so an extra copy is reported as `extra`
(or `missing`) once for each; a null offset is taken as -1; empty replicas give an empty report. Only the named columns are used, whatever others exist.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Bytes of offsets in a range of the lowest level.
LEAF_SPAN = 1 << 16
FANOUT = 16


def record_hashes(records: DataFrame, file: str, offset: str, payload: str, record_id: str) -> DataFrame:
    """file, offset, length, hash, id and n: how many records of the replica are the same in all of these."""
    body = F.col(payload).cast("binary")
    out = records.filter(F.col(payload).isNotNull()).select(
        F.coalesce(F.col(file).cast("string"), F.lit("")).alias("file"),
        F.coalesce(F.col(offset).cast("long"), F.lit(-1)).alias("offset"),
        F.length(body).cast("long").alias("length"),
        F.sha2(body, 256).alias("hash"),
        F.col(record_id).cast("long").alias("id"),
    )
    return out.groupBy(*out.columns).agg(F.count("*").alias("n"))


def _digest(order: str, parts: Column) -> Column:
    """The hash of a group's parts in their order."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), parts.alias("p")))), lambda x: F.concat_ws(":", x["o"].cast("string"), x["p"])), "|").cast("binary"), 256)


def leaves(records: DataFrame, span: int) -> DataFrame:
    """Level 1: file, node, hash of each range of offsets."""
    parts = F.concat_ws(":", F.col("length").cast("string"), "hash", F.coalesce(F.col("id").cast("string"), F.lit("-")), F.col("n").cast("string"))
    return records.groupBy("file", F.floor(F.col("offset") / span).cast("long").alias("node")).agg(_digest("offset", parts).alias("hash"))


def above(level: DataFrame, fanout: int) -> DataFrame:
    return level.groupBy("file", F.floor(F.col("node") / fanout).cast("long").alias("parent")).agg(_digest("node", F.col("hash")).alias("hash")).withColumnRenamed("parent", "node")


def tree(level: DataFrame, depth: int, fanout: int) -> list[DataFrame]:
    """Levels 1 to depth over the given level 1; the last has one node a file, or two if offsets below 0 exist."""
    levels = [level]
    while len(levels) < depth:
        levels.append(above(levels[-1], fanout))
    return levels


def depth_of(largest: int, span: int, fanout: int) -> int:
    depth, nodes = 1, largest // span + 1
    while nodes > 1:
        depth, nodes = depth + 1, -(-nodes // fanout)
    return depth


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    other = b.select("file", "node", F.col("hash").alias("other"))
    return a.join(other, ["file", "node"], "full_outer").filter(~F.col("hash").eqNullSafe(F.col("other"))).select("file", "node")


def audit(a: DataFrame, b: DataFrame, file: str = "file", offset: str = "offset", payload: str = "payload", record_id: str = "record_id", span: int = LEAF_SPAN, fanout: int = FANOUT) -> DataFrame:
    """file, offset, length, record_id, status of each record in which replica b departs from a.

    status: `changed` (same place, other bytes, length or id), `missing` (only in a) or `extra` (only in b);
    length and record_id are a's, or b's where a has none.
    """
    ra, rb = (cut(record_hashes(x, file, offset, payload, record_id), "fixity") for x in (a, b))
    return audit_hashed(ra, rb, span, fanout)


def audit_hashed(ra: DataFrame, rb: DataFrame, span: int = LEAF_SPAN, fanout: int = FANOUT) -> DataFrame:
    """audit() of records that are hashed already: file, offset, length, hash, id, n, read several times."""
    largest = functools.reduce(max, (r.agg(F.max("offset")).first()[0] or 0 for r in (ra, rb)), 0)
    depth = depth_of(largest, span, fanout)
    ta, tb = (tree(cut(leaves(r, span), "fixity-leaves"), depth, fanout) for r in (ra, rb))
    bad = _differing(ta[-1], tb[-1])
    for la, lb in zip(ta[-2::-1], tb[-2::-1], strict=True):
        inside = bad.withColumnRenamed("node", "parent")
        under = [x.withColumn("parent", F.floor(F.col("node") / fanout).cast("long")).join(inside, ["file", "parent"], "left_semi") for x in (la, lb)]
        bad = _differing(*under)
    node = F.floor(F.col("offset") / span).cast("long")
    ra, rb = (x.withColumn("node", node).join(bad, ["file", "node"], "left_semi").drop("node") for x in (ra, rb))
    return _records(ra, rb)


def _records(ra: DataFrame, rb: DataFrame) -> DataFrame:
    """Both sides' records that the other lacks, matched place by place."""
    key = ["file", "offset", "length", "hash", "id"]
    signed = ra.withColumn("d", F.col("n")).unionByName(rb.withColumn("d", -F.col("n")))
    left = signed.groupBy(*key).agg(F.sum("d").alias("d")).filter("d <> 0")
    left = left.withColumn("d", F.explode(F.array_repeat(F.sign("d").cast("int"), F.abs("d").cast("int"))))
    place = Window.partitionBy("file", "offset", "d").orderBy("id", "length", "hash")
    left = left.withColumn("k", F.row_number().over(place))
    side = lambda s: F.max(F.when(F.col("d") == s, F.struct("length", "id")))
    out = left.groupBy("file", "offset", "k").agg(side(1).alias("a"), side(-1).alias("b"))
    status = F.when(F.col("a").isNull(), "extra").when(F.col("b").isNull(), "missing").otherwise("changed")
    pick = F.coalesce("a", "b")
    return out.select("file", "offset", pick["length"].alias("length"), pick["id"].alias("record_id"), status.alias("status"))


def warc_record(url: Column, body: Column) -> Column:
    """A response record: header lines, an empty line, the body and the closing lines."""
    text = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), text(url), F.lit("\r\n\r\n"), text(body), F.lit("\r\n\r\n"))


def archive(pages: DataFrame, replica: Column, per_file: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Pages as two replicas of archive files, hashed: what was written (url, html) and what `replica` holds of it (null: lost).

    Pages go to files by id, in id order; a record's offset is the length of those before it in its file.
    Only digests and lengths are shuffled.
    """
    written, held = warc_record(F.col("url"), F.col("html")).cast("binary"), warc_record(F.col("url"), replica).cast("binary")
    rows = pages.select(
        F.concat(F.lit("part-"), F.coalesce(F.floor(F.col("page_id") / per_file).cast("string"), F.lit("none"))).alias("file"),
        F.col("page_id").cast("long").alias("id"),
        F.length(written).cast("long").alias("length"),
        F.sha2(written, 256).alias("hash"),
        F.when(replica.isNotNull() | F.col("html").isNull(), F.sha2(held, 256)).alias("held"),
    )
    before = Window.partitionBy("file").orderBy("id", "length", "hash").rowsBetween(Window.unboundedPreceding, -1)
    rows = cut(rows.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")), "archive")
    one = F.lit(1).cast("long").alias("n")
    return rows.select("file", "offset", "length", "hash", "id", one), rows.filter("held is not null").select("file", "offset", "length", F.col("held").alias("hash"), "id", one)
