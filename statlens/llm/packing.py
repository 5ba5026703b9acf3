"""Token ids of documents, packed into rows of fixed length.

Texts are tokenised with a given byte-level vocabulary and end with one closing token. A document longer than a row is split losslessly:
full pieces make rows of their own, the rest is packed. Packing is best-fit-decreasing: pieces from long to short, each into the row with the least room that
still holds it, which a segment tree over amounts of room finds in log(row length) steps.

A task packs SHARD_TOKENS tokens of its partition at a time, so memory is bounded, and no token is shuffled; each shard leaves its last few rows
partly empty, which at SHARD_TOKENS is far below a thousandth of the rows. Rows are numbered by partition and order, so
a task that is run again on the same input makes the same rows.

Defined cases: a null text is a document without tokens and is in no row; an empty text has its closing token only; ties in
length keep the order of the input; repeated rows are packed as often as they occur; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that this family of vocabularies splits texts by.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LENGTH = 2048
SHARD_TOKENS = 2_000_000


class Tokenizer:
    """Ids of texts. The vocabulary's bytes travel with the task, so executors need no file."""

    def __init__(self, ranks: bytes, pattern: str = PATTERN) -> None:
        self.ranks, self.pattern = ranks, pattern
        self.close = 1 + max(int(line.split()[1]) for line in ranks.splitlines() if line)
        self._made = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_made": None}

    def _make(self):
        import tiktoken

        pairs = (line.split() for line in self.ranks.splitlines() if line)
        self._made = tiktoken.Encoding("packing", pat_str=self.pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
        return self._made

    def ids(self, text: str) -> np.ndarray:
        """The text's ids and the closing token."""
        got = (self._made or self._make()).encode_to_numpy(text, disallowed_special=())
        return np.concatenate((got.astype(np.int32), [np.int32(self.close)]))


class Room:
    """Rows by the room that they have left: a segment tree over amounts of room, with a stack of rows at each leaf."""

    def __init__(self, length: int) -> None:
        self.size = 1 << length.bit_length()
        self.has = bytearray(2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def put(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        at = room + self.size
        while at and not self.has[at]:
            self.has[at] = 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """A row with the least room of `need` or more, and its room; None if there is none."""
        has, at = self.has, need + self.size
        if not has[at]:
            while at > 1 and (at & 1 or not has[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if has[2 * at] else 2 * at + 1
        room = at - self.size
        row = self.rows[room].pop()
        if not self.rows[room]:
            has[at] = 0
            at >>= 1
            while at and not (has[2 * at] or has[2 * at + 1]):
                has[at] = 0
                at >>= 1
        return row, room


def best_fit(lengths: list[int], length: int) -> list[list[int]]:
    """Rows of piece numbers, best-fit-decreasing; each piece is of 1 to `length` tokens."""
    room, rows = Room(length), []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        got = room.take(lengths[k])
        if got is None:
            rows.append([k])
            row, left = len(rows) - 1, length - lengths[k]
        else:
            row, left = got[0], got[1] - lengths[k]
            rows[row].append(k)
        if left:
            room.put(row, left)
    return rows


SCHEMA = "pack_id long, doc_ids array<long>, starts array<int>, cu_seqlens array<int>, n_tokens int, input_ids binary, position_ids binary"


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, length: int = LENGTH, shard: int = SHARD_TOKENS) -> DataFrame:
    """Packed rows: pack_id; doc_ids, starts (token of the document) of its segments; cu_seqlens (0, then where each segment ends); n_tokens;
    input_ids and position_ids: `length` little-endian numbers each (2 bytes where ids and length allow it, else 4), positions starting anew in each segment, the rest filled with the closing token and 0."""
    with open(vocabulary, "rb") as f:
        tokenizer = Tokenizer(f.read())
    kind = "<u2" if max(tokenizer.close, length) < 1 << 16 else "<u4"
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def packed(ids: list[int | None], toks: list[np.ndarray], first: int) -> Iterator[pa.RecordBatch]:
        piece = [(i, s, min(length, len(t) - s)) for i, t in enumerate(toks) for s in range(0, len(t), length)]
        rows = best_fit([n for _, _, n in piece], length)
        for at in range(0, len(rows), 512):
            out: list[list] = [[] for _ in range(7)]
            for k, row in enumerate(rows[at : at + 512], at):
                x, pos, cu = np.full(length, shared.value.close, kind), np.zeros(length, kind), [0]
                for p in row:
                    i, s, n = piece[p]
                    x[cu[-1] : cu[-1] + n] = toks[i][s : s + n]
                    pos[cu[-1] : cu[-1] + n] = np.arange(n)
                    cu.append(cu[-1] + n)
                for column, value in zip(out, (first + k, [ids[piece[p][0]] for p in row], [piece[p][1] for p in row], cu, cu[-1], x.tobytes(), pos.tobytes())):
                    column.append(value)
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["pack_id", "doc_ids", "starts", "cu_seqlens", "n_tokens", "input_ids", "position_ids"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        ids: list[int | None] = []
        toks: list[np.ndarray] = []
        total = 0
        for b in batches(it, 1):
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t is None:
                    continue
                x = shared.value.ids(t)
                ids.append(i), toks.append(x)
                total += len(x)
                if total >= shard:
                    made = 0
                    for out in packed(ids, toks, first):
                        made += out.num_rows
                        yield out
                    first += made
                    ids, toks, total = [], [], 0
        if ids:
            yield from packed(ids, toks, first)

    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(run, SCHEMA)


def digest(packed: DataFrame) -> DataFrame:
    """pack() with the matrices' MD5 in place of their bytes."""
    return packed.select("pack_id", "doc_ids", "starts", "cu_seqlens", "n_tokens", F.md5("input_ids").alias("ids_md5"), F.md5("position_ids").alias("positions_md5"))


def write(packed: DataFrame, folder: str) -> None:
    """Writes packed rows as Parquet: id and position matrices as bytes, cumulative segment lengths as lists."""
    packed.write.mode("overwrite").parquet(folder)
