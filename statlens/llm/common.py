"""What the corpus operators share: inputs, lineage cuts, Arrow batches."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one pass of array work takes at a time; a longer text makes a pass of its own.
BATCH_BYTES = 512 << 10
#: Rows of up to some 50 bytes that a task may get by broadcast; more are joined by a shuffle, but for the heaviest keys.
BROADCAST_IDS = 1_000_000
HOT_KEYS, HOT_ROWS = 10_000, 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session gets a folder of its own; on a cluster that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        got = spark.sparkContext.getCheckpointDir()
        if not got and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set; it has to name a folder that driver and executors share")
        where = got or os.path.join(tempfile.gettempdir(), "statlens-checkpoints")
        if not got:
            spark.sparkContext.setCheckpointDir(where)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where


def cut(df: DataFrame, name: str = "cut", done: Iterable[DataFrame] = ()) -> DataFrame:
    """The rows of df as a Parquet table in the shared folder: computed once, lineage cut, safe from lost executors. `done`: tables of cut() that nothing reads afterwards."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/statlens/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    for x in done:
        discard(spark, x)
    return out


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Removes the tables of cut() that df reads, once nothing reads them any more."""
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles() if "/statlens/" in x}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def few(found: DataFrame) -> DataFrame:
    """A table of cut() to be joined with a larger one: broadcast if it has up to BROADCAST_IDS rows, else left to a shuffle."""
    return F.broadcast(found) if found.count() <= BROADCAST_IDS else found


def lookup(rows: DataFrame, found: DataFrame, key: str, weight: str) -> DataFrame:
    """rows left-joined to found on `key`. found: a table of cut() with one row a key; its column `weight` tells how many rows have the key, and is dropped.

    Up to BROADCAST_IDS keys are broadcast. Beyond that only the HOT_KEYS heaviest of those with HOT_ROWS or more are, so that their rows stay where they are, and the others meet by a shuffle.
    """
    if found.count() <= BROADCAST_IDS:
        return rows.join(F.broadcast(found.drop(weight)), key, "left")
    hot = F.broadcast(found.filter(F.col(weight) >= HOT_ROWS).orderBy(F.desc(weight), key).limit(HOT_KEYS).drop(weight))
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(found.drop(weight), key, "left"))


def text_bytes(column: pa.Array) -> tuple[list[bytes], list[bool]]:
    """A string column as UTF-8 bytes, and which rows are null (their bytes are empty)."""
    values = column.cast(pa.binary()).to_pylist()
    return [v or b"" for v in values], [v is None for v in values]


def batches(it: Iterable[pa.RecordBatch], text: int, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches whose text column `text` holds about `limit` bytes at most (one row at least)."""
    for b in it:
        if not b.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(b.column(text)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > limit:
                yield b.slice(start, i - start)
                start, total = i, 0
            total += n
        yield b.slice(start)


def crc_mod5(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5: 0 marks held-out documents, null (no id) neither those nor what may be learnt from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def runs(it: Iterable[pa.RecordBatch], key: int = 0) -> Iterator[tuple[object, pa.Table]]:
    """The groups of rows that follow each other with the same key: batches come sorted by it. One group at a time is held."""
    held: list[pa.RecordBatch] = []
    of = None
    for b in it:
        if not b.num_rows:
            continue
        keys = b.column(key)
        last = b.num_rows
        edge = [0, *(pc.indices_nonzero(pc.not_equal(keys.slice(1), keys.slice(0, last - 1))).to_numpy() + 1).tolist(), last]
        for i, j in zip(edge, edge[1:]):
            k = keys[i].as_py()
            if held and k != of:
                yield of, pa.Table.from_batches(held)
                held = []
            of = k
            held.append(b.slice(i, j - i))
    if held:
        yield of, pa.Table.from_batches(held)


def number_runs(it: Iterable[pa.RecordBatch], limit: int) -> Iterator[tuple[bool, list]]:
    """Columns of numbers from batches sorted by the first one, in pieces that hold whole runs of equal keys: (False, columns).

    A run of over `limit` rows comes in parts as it is read, each led by the run's first row: (True, columns). So no more than `limit` rows and one batch are held.
    """
    import numpy as np

    held: list | None = None
    long_key = None
    for b in it:
        if not b.num_rows:
            continue
        new = [b.column(k).to_numpy() for k in range(b.num_columns)]
        cols = new if held is None else [np.concatenate((h, x)) for h, x in zip(held, new)]
        edge = np.flatnonzero(cols[0][1:] != cols[0][:-1]) + 1
        last = int(edge[-1]) if len(edge) else 0
        if long_key is not None:  # the first row held is the long run's
            stop = int(edge[0]) if len(edge) else len(cols[0])
            if stop > 1:
                yield True, [x[:stop] for x in cols]
            if not len(edge):
                held = [x[:1] for x in cols]
                continue
            long_key = None
            cols, last = [x[stop:] for x in cols], last - stop
        if last:
            yield False, [x[:last] for x in cols]
        held = [x[last:] for x in cols]
        if len(held[0]) > limit:
            yield True, held
            long_key, held = held[0][0], [x[:1] for x in held]
    if held is not None and len(held[0]) and long_key is None:
        yield False, held
