"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

The words of items and texts are compared without case and ASCII punctuation. All n-grams of an item are seeds, common ones too: an edited
copy may have kept no others. A text's seed hits give windows around the item's diagonal, and the item is aligned locally with each window: a word
that agrees scores MATCH, one that differs MISMATCH, one left out or put in GAP. An item whose best alignment reaches `threshold` of its perfect
score is in the text. Where too few of the item's words occur for that score, in the text or in the window, nothing is aligned; so common seeds cost little.

Items are the query set and go to the executors in blocks of BLOCK_WORDS words, of which the driver holds one at a time; documents are
scanned where they lie, once a block, and nothing of them is shuffled. Where seeds are so common that their hits would fill a worker,
the items are gone through in parts.

Defined cases: null and blank texts hold nothing; items that are null or have fewer than SEED words have no seeds and are found nowhere; items and documents without
id are found like others, with a null id; equal items are found together; repeated rows give repeated results; very long texts are scanned whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, cut, text_bytes
from .words import Words, ngrams

#: Words of a seed.
SEED = 3
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.5
#: Words of benchmark items in one block: 30 MB or so as arrays.
BLOCK_WORDS = 1_000_000
#: Seed hits times the items that a seed stands for, at a time.
MAX_HITS = 2_000_000


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """The best local alignment's score, and the place in window behind its end."""
    k = np.arange(len(window) + 1) * -GAP
    h = np.zeros(len(window) + 1, np.int64)
    best = end = 0
    for word in item:
        x = np.zeros_like(h)
        x[1:] = np.maximum(0, np.maximum(h[:-1] + np.where(window == word, MATCH, MISMATCH), h[1:] + GAP))
        h = np.maximum.accumulate(x + k) - k
        at = int(h.argmax())
        if h[at] > best:
            best, end = int(h[at]), at
    return best, end


class Items:
    """A block of items: their words' hashes, and the sorted seeds with the items and places that they stand for."""

    def __init__(self, ids: list[int | None], texts: list[bytes]) -> None:
        w = Words(texts, plain=True)
        self.ids = pa.array(ids, pa.int64())
        self.words = [w.hash[i:j] for i, j in zip(w.first, w.first[1:])]
        seeds = [(ngrams(x, SEED), k) for k, x in enumerate(self.words)]
        self.gram = np.concatenate([g for g, _ in seeds] or [np.zeros(0, np.uint64)])
        self.item = np.concatenate([np.full(len(g), k) for g, k in seeds] or [np.zeros(0, np.int64)])
        self.place = np.concatenate([np.arange(len(g)) for g, _ in seeds] or [np.zeros(0, np.int64)])
        order = np.lexsort((self.place, self.item, self.gram))
        self.gram, self.item, self.place = self.gram[order], self.item[order], self.place[order]
        self.key = np.unique(self.gram)
        self.known, number = np.unique(np.concatenate(self.words or [np.zeros(0, np.uint64)]), return_inverse=True)
        self.numbers = np.split(number, np.cumsum([len(x) for x in self.words])[:-1]) if self.words else []

    def present(self, hashes: np.ndarray) -> np.ndarray:
        """For each of the items' distinct words whether it is among hashes."""
        out = np.zeros(len(self.known), bool)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        out[at[self.known[at] == hashes]] = True
        return out

    def hits(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Word places in w where a seed stands, and the seed's number among the keys."""
        g = ngrams(w.hash, SEED)
        if not len(g) or not len(self.key):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.key, g), len(self.key) - 1)
        hit = np.flatnonzero((self.key[at] == g) & (w.doc[: len(g)] == w.doc[SEED - 1 :]))
        return hit, at[hit]

    def find(self, w: Words, threshold: float) -> list[tuple[int, int, float, int, int]]:
        """(text number, item number, score, first word, word behind the last) for the items in each text."""
        return self._find(w, threshold, *self.hits(w), 0, len(self.words))

    def _find(self, w: Words, threshold: float, hit: np.ndarray, key: np.ndarray, low: int, high: int) -> list[tuple[int, int, float, int, int]]:
        """find() for the items from low on and before high."""
        own = (self.item >= low) & (self.item < high)
        gram, items, places = self.gram[own], self.item[own], self.place[own]
        lo, hi = np.searchsorted(gram, self.key, "left"), np.searchsorted(gram, self.key, "right")
        n = (hi - lo)[key]
        if n.sum() > MAX_HITS and high - low > 1:
            mid = (low + high) // 2
            return self._find(w, threshold, hit, key, low, mid) + self._find(w, threshold, hit, key, mid, high)
        seed = np.repeat(lo[key] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(key) else np.zeros(0, np.int64)
        where, item = np.repeat(hit, n), items[seed]
        start = where - places[seed]
        doc = w.doc[where]
        order = np.lexsort((start, item, doc))
        out: list[tuple[int, int, float, int, int]] = []
        doc, item, start = doc[order], item[order], start[order]
        edge = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])))) if len(doc) else []
        last, there = -1, np.zeros(0, bool)
        for i, j in zip(edge, [*edge[1:], len(doc)]):
            d, k = int(doc[i]), int(item[i])
            words = self.words[k]
            m, best = len(words), (0, 0, 0)
            if d != last:
                last, there = d, self.present(w.hash[w.first[d] : w.first[d + 1]])
            # A word agrees only where the text has it: with fewer of them than this no alignment reaches the threshold.
            if np.count_nonzero(there[self.numbers[k]]) < threshold * m:
                continue
            slack = m // 2 + 2
            begin, end = np.maximum(start[i:j] - slack, w.first[d]), np.minimum(start[i:j] + m + slack, w.first[d + 1])
            a, b = int(begin[0]), int(end[0])
            for x, y in [*zip(begin[1:].tolist(), end[1:].tolist()), (1 << 60, 0)]:
                if x <= b:
                    b = max(b, y)
                    continue
                if np.count_nonzero(np.isin(words, w.hash[a:b])) >= threshold * m:
                    score, to = align(words, w.hash[a:b])
                    if score > best[0]:
                        best = (score, a, a + to)
                a, b = x, y
            score, a, to = best
            if score and score >= threshold * MATCH * m:
                back, n_back = align(words[::-1], w.hash[a:to][::-1])
                out.append((d, k, score / (MATCH * m), int(to - n_back - w.first[d]), int(to - w.first[d])))
        return out


class Benchmark:
    """The benchmark's items in blocks of bounded size, read anew and made one at a time whenever it is gone through. rows: id and text."""

    def __init__(self, rows: DataFrame) -> None:
        self.rows = rows

    def __iter__(self) -> Iterator[Items]:
        held: list[tuple[int | None, bytes]] = []
        words = 0
        for item, text in self.rows.toLocalIterator():
            held.append((item, text.encode("utf-8", "surrogatepass")))
            words += len(text.split())
            if words >= BLOCK_WORDS:
                yield Items(*map(list, zip(*held)))
                held, words = [], 0
        if held:
            yield Items(*map(list, zip(*held)))


def prepared(docs: DataFrame, bench: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> Benchmark:
    """The items with their seeds. Nothing is learnt from docs: a seed's count there doesn't say whether a copy holds it."""
    return Benchmark(bench.filter(F.col(item_text).isNotNull()).select(F.col(item_id).cast("long"), item_text).orderBy(item_id, item_text))


def _each(blocks: Iterable[Items]) -> Iterator[tuple[Items, bool]]:
    """The blocks, and whether others follow."""
    it = iter(blocks)
    last = next(it, None)
    while last is not None:
        following = next(it, None)
        yield last, following is not None
        last = following


def matches(docs: DataFrame, blocks: Iterable[Items], doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score (share of the item's perfect score), first_word and end_word of each item found in each text. All blocks but the last are done before this returns."""
    schema = "doc_id long, item_id long, score double, first_word int, end_word int"
    out = None
    for items, more in _each(blocks):

        def run(it: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for b in batches(it, 1):
                found = items.find(Words(text_bytes(b.column(1))[0], plain=True), threshold)
                if found:
                    d, k, score, first, end = (np.array(x) for x in zip(*found))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(d)).cast(pa.int64()), items.ids.take(pa.array(k)), pa.array(score), pa.array(first, pa.int32()), pa.array(end, pa.int32())], names=["doc_id", "item_id", "score", "first_word", "end_word"])

        got = docs.select(doc_id, text).mapInArrow(run, schema)
        got = cut(got, "matches") if more else got
        out = got if out is None else out.unionByName(got)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, blocks: Iterable[Items], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that hold no item, with all their columns. All blocks but the last are done before this returns."""
    place = docs.columns.index(text)
    for items, more in _each(blocks):

        def run(it: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for b in batches(it, place):
                bad = {x[0] for x in items.find(Words(text_bytes(b.column(place))[0], plain=True), threshold)}
                yield b.take(pa.array([i for i in range(b.num_rows) if i not in bad], pa.int64())) if bad else b

        docs = docs.mapInArrow(run, docs.schema)
        docs = cut(docs, "clean") if more else docs
    return docs
