"""Fuzzy line deduplication.

Lines are normalised (A-Z lower-cased, what is neither an ASCII letter or digit nor beyond ASCII taken as space, spaces made one). Equal
normalised lines are one class. A class's fingerprint is a SimHash in BLOCKS blocks: each word votes in one block only, which its hash names, and once, so
one word that is edited, put in or left out leaves all but two blocks as they were; beside them stands a SimHash of all words. Classes that agree on AGREE
blocks (with a word in each), whose whole SimHashes differ in FAR bits or fewer and whose lengths fit are candidates; by pigeonholes, these are found
among those that share the key of one choice of AGREE blocks. Edit similarity (1 - distance / longer length, in bytes) decides of candidates:
`percent` or more links. One occurrence of each connected group of lines is kept: the first by doc_id, hash of the text, and place.

Classes with a common key are compared by fingerprint, and a spanning forest of the candidates goes on. Keys that very many classes share, found on a sample,
are compared in tiles of bounded size instead (see tiles.py). Groups of candidates are then compared line by line in tiles, so no link is lost; what a large
group leaves open is compared only within the keys that tied it, as chains of candidates grow much faster than the lines of one key. Only
fingerprints are shuffled until then; lines themselves are read again for candidates, found by the hash of their text and told by their own.

Defined cases: a null text has one row with a null place; an empty one has one empty line; lines that normalise to nothing are always kept; repeated rows
and rows with one id and several texts have a row for each line of each; rows with a null doc_id come first; of lines with the same first
id and place all are kept. Very long lines are compared whole. Lines end at \\n.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tiles
from .common import BROADCAST_IDS, batches, cut, discard, few, lookup, number_runs, text_bytes
from .components import components
from .words import mix, span_sums

#: Blocks of a fingerprint, bits of each, and how many have to agree.
BLOCKS, BITS, AGREE = 5, 24, 2
#: Bits of the SimHash of all words, and how many of them may differ.
WHOLE, FAR = 63, 16
PERCENT = 80
#: One class in SAMPLED shows which keys very many classes share: those of OFTEN of them or more, MAX_OFTEN (8 bytes each) at most.
SAMPLED, OFTEN, MAX_OFTEN = 64, 128, 100_000
#: Classes of one key that a task holds; no more share a key that the sample missed, and if they did, they would be tied without being compared.
HELD = 1 << 16
TILE_LINES, TILE_BYTES, TILE_PRINTS = 256, 1_000_000, 4096

_FOLD = np.full(256, 32, np.uint8)
_FOLD[48:58] = np.arange(48, 58)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_FOLD[10] = 10

PRINTS = [f"p{k}" for k in range(BLOCKS)]


def _distinct(line: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of lines and words, in order of lines."""
    room = 64 - int(line[-1]).bit_length() if len(line) else 64  # bits that the line's number leaves for the word in one number to sort by
    both = (line << np.uint64(room) | word >> np.uint64(64 - room)) if room < 64 else word
    order = np.argsort(both)
    both = both[order]
    order = order[np.concatenate(([True], both[1:] != both[:-1]))] if len(order) else order
    return line[order].astype(np.int64), word[order]


def simhash(word: np.ndarray, of: np.ndarray, n: int, first: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """SimHashes of n sets of words, over `bits` bits of the words' hashes from the bit `first` on; and how many words each has. `of`: each word's set."""
    count = np.bincount(of, minlength=n)
    if bits > 48 and len(of) and count.max() < 1 << 16 and (of[1:] >= of[:-1]).all():
        # Sets that lie one after the other are added up as they lie, with the votes on four bits in one number, 16 bits of it each.
        has, out = np.flatnonzero(count), np.zeros(n, np.int64)
        begin = (np.cumsum(count) - count)[has]
        for bit in range(16):
            total = np.add.reduceat(word >> np.uint64(first + bit) & np.uint64(0x0001000100010001), begin)
            for k in range(bit, bits, 16):
                one = (total >> np.uint64(k - bit) & np.uint64(0xFFFF)).astype(np.int64)
                out[has] |= (2 * one > count[has]).astype(np.int64) << k
        return out, count
    # Votes on three bits are added up in one number, each in 17 bits of it; sets too large for that take one bit at a time.
    lanes = 3 if not len(count) or count.max() < 1 << 17 else 1
    votes = (((np.arange(1 << lanes)[:, None] >> np.arange(lanes)) & 1) << np.arange(lanes) * 17).sum(axis=1).astype(float)
    out = np.zeros(n, np.int64)
    for bit in range(0, bits, lanes):
        total = np.bincount(of, weights=votes[(word >> np.uint64(first + bit)).astype(np.int64) & ((1 << lanes) - 1)], minlength=n).astype(np.int64)
        for k in range(lanes):
            one = total >> 17 * k & (1 << 17) - 1 if lanes > 1 else total
            out |= (2 * one > count).astype(np.int64) << bit + k
    return out, count


def fingerprints(word: np.ndarray, line: np.ndarray, n: int) -> np.ndarray:
    """The blocks of n lines' fingerprints, from the hashes of words and the numbers of their lines. A block without a word is 0, and no other is."""
    block = line * BLOCKS + ((word >> np.uint64(40)) % np.uint64(BLOCKS)).astype(np.int64)
    out, count = simhash(word, block, n * BLOCKS, 8, BITS)
    return np.where(count == 0, 0, np.maximum(out, 1)).reshape(n, BLOCKS)


class Lines:
    """The lines of texts: doc (text number), place (number in the text), hash, prints (blocks of the fingerprint), whole (SimHash of all words) and size in bytes of the normalised line (0: nothing left), chars as they stood."""

    def __init__(self, texts: list[bytes]) -> None:
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        buf = _FOLD[raw]
        ends = np.flatnonzero(buf == 10)
        begins = np.concatenate(([0], ends[:-1] + 1))
        at = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        self.doc = np.searchsorted(at, begins, side="right") - 1
        self.place = np.arange(len(begins)) - np.searchsorted(begins, at)[self.doc]
        self.chars = np.add.reduceat((raw & 0xC0) != 0x80, begins, dtype=np.int64) - 1
        edge = np.flatnonzero(np.diff(np.concatenate(([True], buf < 48))))
        start, end = edge[::2], edge[1::2]
        word = mix(span_sums(buf, start, end) + (end - start).astype(np.uint64))
        n = len(begins)
        first = np.searchsorted(start, begins)
        words = np.diff(np.concatenate((first, [len(start)])))
        size = np.concatenate(([0], np.cumsum(end - start)))
        self.size = size[first + words] - size[first] + np.maximum(words - 1, 0)
        has = np.flatnonzero(words)
        self.hash = np.zeros(n, np.uint64)
        self.hash[has] = mix(span_sums(word, first[has], first[has] + words[has]) + words[has].astype(np.uint64))
        # Each distinct word of a line votes once, or the commonest words would outvote the others.
        line = np.repeat(np.arange(n, dtype=np.uint64), words)
        line, word = _distinct(line, word)
        self.prints, self.whole = fingerprints(word, line, n), simhash(word, line, n, 0, WHOLE)[0]


def normalised(line: bytes) -> bytes:
    return b" ".join(_FOLD[np.frombuffer(line, np.uint8)].tobytes().split())


def _same(a: bytes, b: bytes) -> int:
    """How many leading bytes agree, by halving."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return lo


def edit_distance(a: bytes, b: bytes, most: int) -> int:
    """The edit distance, by bit-parallel steps on numbers as long as a (Myers, 1999); over `most`, some number over it."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    k = _same(a, b)
    a, b = a[k:], b[k:]
    k = _same(a[::-1], b[::-1])
    a, b = a[: len(a) - k], b[: len(b) - k]
    if not a or not b:
        return max(len(a), len(b))
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, d = full, 0, len(a)
    for left, y in zip(range(len(b) - 1, -1, -1), b):
        eq = where.get(y, 0)
        x = (((eq & plus) + plus) ^ plus) | eq | minus
        h_plus, h_minus = minus | (~(x | plus) & full), plus & x
        d += bool(h_plus & top) - bool(h_minus & top)
        if d - left > most:
            return most + 1
        h_plus = h_plus << 1 | 1
        v = eq | minus
        plus, minus = (h_minus << 1 | ~(v | h_plus)) & full, h_plus & v & full
    return d


def within(a: bytes, b: bytes, most: int) -> bool:
    """Whether the edit distance is `most` or less. Words that differ one by one may show it at once."""
    if abs(len(a) - len(b)) > most:
        return False
    x, y = a.split(b" "), b.split(b" ")
    if len(x) == len(y) and sum(max(len(u), len(v)) for u, v in zip(x, y) if u != v) <= most:
        return True
    return edit_distance(a, b, most) <= most


LINES = "doc_id long, t long, place int, chars long, c long, size long, whole long, " + ", ".join(f"{p} int" for p in PRINTS)


def occurrences(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, t (hash of the text), place, chars, c (hash of the normalised line), size, whole (its SimHash) and p0 to p4 (blocks of its fingerprint) of every line; a null text has one row, with null place and size."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 2):
            texts, null = text_bytes(b.column(2))
            x = Lines(texts)
            gone = np.array(null)[x.doc]
            doc = pa.array(x.doc)
            cols = [b.column(0).take(doc), b.column(1).take(doc), pa.array(x.place.astype(np.int32), mask=gone), pa.array(x.chars), pa.array(x.hash.view(np.int64)), pa.array(x.size, mask=gone), pa.array(x.whole), *(pa.array(p.astype(np.int32)) for p in x.prints.T)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "t", "place", "chars", "c", "size", "whole", *PRINTS])

    return docs.select(F.col(doc_id).cast("long"), F.xxhash64(text), text).mapInArrow(run, LINES)


def _keys() -> Column:
    """The keys of all choices of AGREE blocks that have words."""
    out = []
    for k, chosen in enumerate(itertools.combinations(PRINTS, AGREE)):
        words = functools.reduce(Column.__and__, [F.col(p) != 0 for p in chosen])
        out.append(F.when(words, F.xxhash64(F.lit(k), *chosen)))
    return F.array_compact(F.array(*out))


def _near(whole: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether lines i and j may link by their SimHashes and sizes."""
    a, b = size[i].astype(np.int64), size[j].astype(np.int64)
    return (np.bitwise_count(whole[i] ^ whole[j]) <= FAR) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))


def _spread(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """label, the least row that each row is tied to, after ties of rows i with rows j."""
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        for x in (i, j, label[i], label[j]):
            np.minimum.at(new, x, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _ties(key: np.ndarray, whole: np.ndarray, size: np.ndarray, percent: int) -> np.ndarray:
    """For each row the first row that it is tied to; rows come in order of key."""
    label = np.arange(len(key))
    begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    length = np.diff(np.concatenate((begin, [len(key)])))
    found = [(np.zeros(0, np.int64),) * 2]
    for n in np.unique(length[(length > 1) & (length <= 32)]).tolist():
        at = begin[length == n][:, None]
        i, j = ((at + x).ravel() for x in np.triu_indices(n, 1))
        ok = _near(whole, size, i, j, percent)
        found.append((i[ok], j[ok]))
    label = _spread(label, *(np.concatenate(x) for x in zip(*found)))
    for s, n in zip(begin[length > 32].tolist(), length[length > 32].tolist()):
        step = max(1, (1 << 20) // n)
        for k in range(s, s + n, step):
            i, j = (x.ravel() for x in np.meshgrid(np.arange(k, min(k + step, s + n)), np.arange(k + 1, s + n), indexing="ij"))
            open_ = (i < j) & (label[i] != label[j])
            i, j = i[open_], j[open_]
            ok = _near(whole, size, i, j, percent)
            if ok.any():
                label = _spread(label, i[ok], j[ok])
    return label


def candidates(classes: DataFrame, percent: int) -> DataFrame:
    """a, b, k: edges such that any two classes that may link are both ends of edges of one k; repeated sets of classes have one k. classes: c, size, whole, p0 to p4."""
    keyed = classes.select("c", F.col("size").cast("int").alias("size"), "whole", F.explode(_keys()).alias("key"))
    few = classes.filter(F.pmod("c", F.lit(SAMPLED)) == 0).select(F.explode(_keys()).alias("key"))
    often = few.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= OFTEN)
    often = cut(often.orderBy(F.desc("n"), "key").limit(MAX_OFTEN).select("key"), "line-keys")
    ends = []
    if not often.isEmpty():
        hot = cut(keyed.join(F.broadcast(often), "key"), "line-often")
        keyed = keyed.join(F.broadcast(often), "key", "left_anti")

        def kernel(t: pa.Table, left: np.ndarray, right: np.ndarray, forest: tiles.Forest) -> None:
            whole, size = t.column("whole").to_numpy(), t.column("size").to_numpy()
            for i in np.flatnonzero(left).tolist():
                to = np.flatnonzero(right & (forest.root != forest.root[i]))
                for j in to[_near(whole, size, np.full(len(to), i), to, percent)].tolist():
                    forest.link(i, j)

        payload = hot.select("c", "whole", "size").dropDuplicates(["c"])
        pairs = tiles.links(hot.select("c", F.col("key").alias("g"), F.col("size").alias("n")), payload, kernel, percent / 100, TILE_PRINTS, 1 << 62)
        ends.append(pairs.select(F.col("node").alias("a"), F.col("root").alias("b"), F.col("root").alias("k")))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for long, (key, c, size, whole) in number_runs(it, HELD):
            first = np.zeros(len(c), np.int64) if long else _ties(key, whole, size, percent)
            tied = np.flatnonzero(first != np.arange(len(c)))
            if len(tied):
                k = key.view(np.uint64).copy()
                if not long:  # a set of classes is named by its members, so that sets found by several keys are one
                    of = first[tied]
                    k[of] = mix(c[of].view(np.uint64))
                    np.add.at(k, of, mix(c[tied].view(np.uint64)))
                yield pa.RecordBatch.from_arrays([pa.array(c[tied]), pa.array(c[first[tied]]), pa.array(k[first[tied]].view(np.int64))], names=["a", "b", "k"])

    ends.append(keyed.select("key", "c", "size", "whole").repartition("key").sortWithinPartitions("key", "c").mapInArrow(run, "a long, b long, k long"))
    return functools.reduce(DataFrame.union, ends)


def lines_of(docs: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """c, line (normalised) of the wanted classes: c, first (t and place of an occurrence). A line counts only if its own hash is c."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # copies of a text have the same lines
        for b in batches(it, 0):
            c, line = [], []
            for t, h, want in zip(*(x.to_pylist() for x in b.columns)):
                if h in done:
                    continue
                done.add(h)
                parts = t.encode("utf-8", "surrogatepass").split(b"\n")
                for w in want:
                    if w["place"] < len(parts):
                        c.append(w["c"]), line.append(normalised(parts[w["place"]]))
            if c:
                found = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(line, pa.binary())], names=["c", "line"])
                yield found.filter(pa.array(Lines(line).hash.view(np.int64) == np.array(c)))

    places = wanted.select(F.col("first.t").alias("_h"), F.struct("c", "first.place").alias("w")).groupBy("_h").agg(F.collect_list("w").alias("want"))
    places = F.broadcast(places) if wanted.count() <= BROADCAST_IDS else places
    rows = docs.filter(F.col(text).isNotNull()).select(F.col(text).alias("_t"), F.xxhash64(text).alias("_h"))
    return rows.join(places, "_h").select("_t", "_h", "want").mapInArrow(run, "c long, line binary").dropDuplicates(["c"])


def groups(docs: DataFrame, classes: DataFrame, text: str, percent: int) -> DataFrame:
    """node, root: classes of lines in groups of two and more. classes: c, size, whole, p0 to p4, first."""
    ties = cut(candidates(classes, percent), "line-ties")
    found = cut(components(ties).select(F.col("node").alias("c"), F.col("root").alias("g")), "line-candidates")
    members = cut(classes.join(few(found), "c"), "line-members", [found])
    payload = cut(lines_of(docs, members, text).join(members.select("c", "whole", *PRINTS), "c"), "line-texts")

    def kernel(t: pa.Table, left: np.ndarray, right: np.ndarray, forest: tiles.Forest) -> None:
        line, prints = t.column("line").to_pylist(), np.stack([t.column(p).to_numpy() for p in PRINTS], axis=1)
        size, whole = np.array([len(x) for x in line]), t.column("whole").to_numpy()
        prints[prints == 0] = -1  # agrees with none but itself
        both = left & right  # such pairs come up once, from the first of the two
        for i in np.flatnonzero(left).tolist():
            near = np.flatnonzero(right & (forest.root != forest.root[i]))
            near = near[~(both[near] & both[i]) | (near > i)]
            near = near[_near(whole, size, np.full(len(near), i), near, percent)]
            near = near[((prints[near] == prints[i]) & (prints[i] > 0)).sum(axis=1) >= AGREE]
            for j in near.tolist():
                if forest.root[i] != forest.root[j] and within(line[i], line[j], int((100 - percent) * max(size[i], size[j]) // 100)):
                    forest.link(i, j)

    out = tiles.links(members.select("c", "g", F.col("size").alias("n")), payload, kernel, percent / 100, TILE_LINES, TILE_BYTES, ties.select(F.explode(F.array("a", "b")).alias("c"), "k"))
    discard(docs.sparkSession, payload), discard(docs.sparkSession, members), discard(docs.sparkSession, ties)
    return out


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, text_hash, place, chars, kept, class_id (hash of the normalised line) and group_id (that of its group) of every line."""
    lines = cut(occurrences(docs, doc_id, text), "lines")
    real = lines.filter("size > 0")
    first = [F.first(x).alias(x) for x in ("size", "whole", *PRINTS)]
    classes = cut(real.groupBy("c").agg(*first, F.count("*").alias("n"), F.min(F.struct("doc_id", "t", "place")).alias("first")), "line-classes")
    roots = cut(groups(docs, classes, text, percent).withColumnRenamed("node", "c"), "line-roots")
    # A class with one line and no group keeps it; the others are looked up.
    known = cut(classes.join(few(roots), "c", "left").filter("n > 1 or root is not null").select("c", "n", "first", F.coalesce("root", "c").alias("root")), "line-known", [classes, roots])
    least = cut(known.groupBy("root").agg(F.min("first").alias("__first"), F.count("*").alias("__n")), "line-first")
    known = cut(lookup(known.select("c", "n", "root"), least, "root", "__n"), "line-groups", [known, least])
    out = lookup(real, known, "c", "n")
    kept = F.col("__first").isNull() | F.struct("doc_id", "t", "place").eqNullSafe(F.col("__first"))
    out = out.select("doc_id", F.col("t").alias("text_hash"), "place", "chars", kept.alias("kept"), F.col("c").alias("class_id"), F.coalesce("root", "c").alias("group_id"))
    none = F.lit(None).cast("long")
    return out.unionByName(lines.filter("size = 0 or size is null").select("doc_id", F.col("t").alias("text_hash"), "place", "chars", F.lit(True).alias("kept"), none.alias("class_id"), none.alias("group_id")))


def apply(docs: DataFrame, decided: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with only the kept lines in their texts; a text that loses all of them becomes empty. decided: dedup()."""
    gone = decided.filter("not kept").select(F.col("doc_id").alias("__statlens_id"), F.col("text_hash").alias("__statlens_text"), "place").groupBy("__statlens_id", "__statlens_text").agg(F.collect_set("place").alias("__statlens_gone"))
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains("__statlens_gone", i)), "\n")
    same = F.col(doc_id).cast("long").eqNullSafe(F.col("__statlens_id")) & (F.xxhash64(text) == F.col("__statlens_text"))
    return docs.join(gone, same, "left").withColumn(text, F.when(F.col("__statlens_gone").isNull(), F.col(text)).otherwise(kept)).drop("__statlens_id", "__statlens_text", "__statlens_gone")
