"""N-gram Jaccard self-join of documents, exact, and the components that its links form.

Documents with the same n-gram set are one class. Which classes can link is found on prefixes: two sets
with similarity t share at least LEAST n-grams (or all they need to) among the first n - ceil(t*n) + LEAST of
each, in any order that is the same for all. Overlap counts on these are added up pair by pair, and pairs below
the size-derived bounds are dropped. The pairs left form candidate groups, and in each group the document by
n-gram incidence matrix is multiplied with its transpose in blocks, which gives exact overlaps of all pairs.

Frequent n-grams would make all pairs of their documents. So the order is by hash, but with frequent n-grams last; they are
learnt on one class in SAMPLED, which bears on speed alone: any order gives the same links. Classes whose prefix would need frequent ones
(heavy ones: they consist of what many documents share) are joined with one another again, in order of
frequency among them, rarest first. What is then frequent still belongs to large groups of near copies,
which go to the matrix product as a whole, in tiles of bounded size (see tiles.py). No link is lost by that.

Defined cases: a null, empty or blank text has no n-grams, links with nothing and is its own component; a text with
fewer than n words has its whole sequence as the only n-gram. Repeated rows (same id or not) are copies of a class and linked. Null ids take
part, but are the least id of a component only where it has no other. Sets are told apart by 64-bit digests, n-grams by 64-bit hashes; texts are read again by
their hashes, whatever their ids, and told by their digests. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tiles
from .common import BROADCAST_IDS, batches, cut, discard, lookup, text_bytes
from .components import components
from .words import Words, mix, shingle_sets

#: N-grams that two prefixes must share.
LEAST = 3
#: An n-gram in more classes than this makes no pairs: in the first order, where only n-grams that the sample missed are so frequent, and in that by frequency.
HOT, HOT_AGAIN = 192, 48
#: One document in so many shows which n-grams are frequent: those of FREQUENT of them or more, MAX_FREQUENT (8 bytes each) at most.
SAMPLED, FREQUENT, MAX_FREQUENT = 16, 3, 2_000_000
#: Documents and n-grams that one side of a tile holds, on average at most.
TILE_DOCS, TILE_GRAMS = 192, 400_000
#: One class in OFTEN_SAMPLED shows which n-grams are so frequent among prefixes that their classes are tied without a shuffle: those of OFTEN of them or more, MAX_OFTEN at most.
OFTEN_SAMPLED, OFTEN, MAX_OFTEN = 64, 24, 100_000


def _set_digest(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A digest of each set, whatever its order."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(values ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)))
    size = np.diff(offsets).astype(np.uint64)
    return mix((total[offsets[1:]] - total[offsets[:-1]]) + size * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def frequent(docs: DataFrame, n: int, doc_id: str, text: str) -> np.ndarray:
    """N-grams of many documents, by a sample: MAX_FREQUENT at most, the most frequent ones."""
    sample = docs.filter(F.pmod(F.xxhash64(F.col(doc_id)), F.lit(SAMPLED)) == 0).select(text)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 0):
            value, at = shingle_sets(Words(text_bytes(b.column(0))[0]), n)
            yield pa.RecordBatch.from_arrays([pa.array(_set_digest(value, at)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(value.view(np.int64)))], names=["c", "grams"])

    grams = sample.mapInArrow(run, "c long, grams array<long>").dropDuplicates(["c"]).select(F.explode("grams").alias("t"))
    often = grams.groupBy("t").agg(F.count("*").alias("df")).filter(F.col("df") >= FREQUENT)
    return np.sort(often.orderBy(F.desc("df"), "t").limit(MAX_FREQUENT).toPandas()["t"].to_numpy(np.int64).view(np.uint64))


def signatures(docs: DataFrame, n: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, t (hash of the text), n, c (digest of the set), prefix (its least n-gram hashes, frequent ones left out) and heavy (the prefix is short of them) of every row."""
    last = docs.sparkSession.sparkContext.broadcast(frequent(docs, n, doc_id, text))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = last.value
        for b in batches(it, 2):
            value, at = shingle_sets(Words(text_bytes(b.column(2))[0]), n)
            size = np.diff(at)
            digest = _set_digest(value, at)
            owner = np.repeat(np.arange(len(size)), size)
            if len(late):
                soon = late[np.minimum(np.searchsorted(late, value), len(late) - 1)] != value
                value, owner = value[soon], owner[soon]
            left = np.bincount(owner, minlength=len(size))
            at = np.concatenate(([0], np.cumsum(left)))
            want = np.minimum(size, size + (-percent * size // 100) + LEAST)
            keep = np.minimum(left, want)
            ends = np.concatenate(([0], np.cumsum(keep)))
            take = np.repeat(at[:-1] - ends[:-1], keep) + np.arange(ends[-1])
            prefix = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(value[take].view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size), pa.array(digest), pa.array(left < want), prefix], names=["doc_id", "t", "n", "c", "heavy", "prefix"])

    return docs.select(F.col(doc_id).cast("long"), F.xxhash64(text), text).mapInArrow(run, "doc_id long, t long, n long, c long, heavy boolean, prefix array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, n: int, text: str) -> DataFrame:
    """c and grams (sorted hashes) of the classes wanted: c, t (hash of a text with that set), copies (rows with that set). Read from the texts again, which is cheaper than keeping all sets.

    The rows are tables of cut(). Only sets of several rows may be read more than once, so only these are shuffled to keep one of each.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = np.zeros(0, np.int64)  # copies of a text have the same set
        for b in batches(it, 0):
            c = b.column(1).to_numpy()
            _, first = np.unique(c, return_index=True)
            b = b.take(pa.array(np.sort(first[~np.isin(c[first], done)])))
            if not b.num_rows:
                continue
            value, at = shingle_sets(Words(text_bytes(b.column(0))[0]), n)
            keep = np.flatnonzero(_set_digest(value, at) == b.column(1).to_numpy())
            done = np.concatenate((done, b.column(1).to_numpy()[keep]))
            grams = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(value.view(np.int64))).take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(keep)) for k in (1, 2)), grams], names=["c", "copied", "grams"])

    ids = wanted.select("c", F.col("t").alias("_h"), (F.col("copies") > 1).alias("copied"))
    ids = F.broadcast(ids) if wanted.count() <= BROADCAST_IDS else ids
    rows = docs.filter(F.col(text).isNotNull()).select(F.col(text).alias("_t"), F.xxhash64(text).alias("_h")).join(ids, "_h").select("_t", "c", "copied")
    found = rows.mapInArrow(run, "c long, copied boolean, grams array<long>")
    found = cut(found, "sets")
    copied = cut(found.filter("copied").dropDuplicates(["c"]), "copied-sets")
    return found.filter("not copied").union(copied).select("c", "grams")


def _pairs(tokens: DataFrame, percent: int, hot: int) -> DataFrame:
    """a, b: edges such that all links between classes that meet in these prefixes lie in their components. tokens: t, c, n.

    An n-gram of up to `hot` classes makes pairs of fitting sizes, counted once for each n-gram that they share; one of
    more ties all its classes to one of them, which is an edge with a count that suffices. Those of very many classes do so where the classes' rows lie.
    """
    often = tokens.filter(F.pmod(F.xxhash64("c"), F.lit(OFTEN_SAMPLED)) == 0).groupBy("t").agg(F.count("*").alias("m"), F.min("c").alias("b"))
    often = cut(often.filter(F.col("m") >= max(OFTEN, hot // OFTEN_SAMPLED + 1)).orderBy(F.desc("m"), "t").limit(MAX_OFTEN).select("t", "b"), "often")
    tied = None
    if not often.isEmpty():
        tied = tokens.join(F.broadcast(often), "t").filter("c <> b").select(F.col("c").alias("a"), "b")
        tokens = tokens.join(F.broadcast(often), "t", "left_anti")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        for b in _then_none(it):
            if b is not None:
                held = [np.concatenate((h, b.column(k).to_numpy())) for k, h in enumerate(held)]
            t, c, n = held
            if not len(t):
                continue
            new = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
            length = np.diff(np.concatenate((new, [len(t)])))
            # The last run may go on; it is held back, or, if long, all but its first class are sent off.
            done = len(new) if b is None else len(new) - 1
            out = []
            for size in np.unique(length[:done]).tolist():
                if size < 2:
                    continue
                at = new[:done][length[:done] == size]
                if size > hot:
                    for s in at.tolist():
                        out.append((np.full(size - 1, c[s]), c[s + 1 : s + size], np.zeros(size - 1, np.int64), np.zeros(size - 1, np.int64), np.full(size - 1, LEAST)))
                    continue
                i, j = np.triu_indices(size, 1)
                i, j = (at[:, None] + i[None]).ravel(), (at[:, None] + j[None]).ravel()
                ok = (100 * n[i] >= percent * n[j]) & (100 * n[j] >= percent * n[i])
                i, j = i[ok], j[ok]
                swap = c[i] > c[j]
                i, j = np.where(swap, j, i), np.where(swap, i, j)
                out.append((c[i], c[j], n[i], n[j], np.ones(len(i), np.int64)))
            if b is not None:
                s = new[done]
                if length[done] > 4 * hot:  # too long to hold: tie it up now, keep hot + 1 of it so that it stays a long run
                    m = len(t) - s
                    out.append((np.full(m - 1, c[s]), c[s + 1 :], np.zeros(m - 1, np.int64), np.zeros(m - 1, np.int64), np.full(m - 1, LEAST)))
                    held = [x[s : s + hot + 1] for x in held]
                else:
                    held = [x[s:] for x in held]
            else:
                held = [x[:0] for x in held]
            for k in range(0, len(out), 64):
                cols = [np.concatenate(x) for x in zip(*out[k : k + 64])]
                if len(cols[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in cols], names=["a", "b", "na", "nb", "k"])

    rows = tokens.select("t", "c", "n").repartition("t").sortWithinPartitions("t", "c").mapInArrow(run, "a long, b long, na long, nb long, k long")
    need = F.least(F.lit(LEAST), F.ceil((F.col("na") + F.col("nb")) * percent / (100.0 + percent) - 1e-9))
    near = rows.groupBy("a", "b", "na", "nb").agg(F.sum("k").alias("shared")).filter(F.col("shared") >= need).select("a", "b")
    return near if tied is None else near.union(tied)


def _then_none(it: Iterator) -> Iterator:
    yield from it
    yield None


def candidates(docs: DataFrame, rows: DataFrame, prefixes: DataFrame, n: int, percent: int, text: str) -> DataFrame:
    """a, b: edges such that all links lie within the components that they form. rows: signatures(), prefixes left out; prefixes: c, n, prefix of every class, a table of cut() that is removed."""
    pairs = cut(_pairs(prefixes.select("c", "n", F.explode("prefix").alias("t")), percent, HOT), "pairs", [prefixes])
    heavy = cut(rows.filter("heavy").groupBy("c").agg(F.first("n").alias("n"), F.min("t").alias("t"), F.count("*").alias("copies")), "heavy")
    sets = sets_of(docs, heavy, n, text)
    grams = cut(sets.select("c", F.size("grams").alias("n"), F.explode("grams").alias("t")), "heavy-grams", [heavy, sets])
    often = grams.groupBy("t").agg(F.count("*").alias("df")).filter("df > 1")
    ranked = grams.join(often, "t", "left").groupBy("c", "n").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "t"))).alias("all"))
    first = F.least(F.col("n"), F.col("n") + LEAST - F.ceil(F.col("n") * percent / 100.0 - 1e-9)).cast("int")
    rare = ranked.select("c", "n", F.explode(F.slice("all", F.lit(1), first)).alias("x")).select("c", "n", "x.t", "x.df").filter("df > 1")
    rare = cut(rare, "heavy-prefixes", [grams])
    return cut(pairs.union(_pairs(rare, percent, HOT_AGAIN)), "candidates", [pairs, rare])


def _product(docs: list[np.ndarray], rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Overlap counts of the sets docs[rows] with docs[cols]: the incidence matrix times its transpose, a block of n-grams at a time."""
    sizes = np.array([len(d) for d in docs])
    value, owner = np.concatenate(docs), np.repeat(np.arange(len(docs)), sizes)
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    new = np.concatenate(([True], value[1:] != value[:-1]))
    gram = np.cumsum(new) - 1
    shared = np.bincount(gram)[gram] > 1
    gram, owner = gram[shared], owner[shared]
    out = np.zeros((len(rows), len(cols)), np.float32)
    if len(gram):
        gram = np.cumsum(np.concatenate(([0], gram[1:] != gram[:-1])))
        for lo in range(0, int(gram[-1]) + 1, 4096):
            i, j = np.searchsorted(gram, [lo, lo + 4096])
            block = np.zeros((len(docs), 4096), np.float32)
            block[owner[i:j], gram[i:j] - lo] = 1
            out += block[rows] @ block[cols].T
    return out


def _forest(docs: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int, forest: tiles.Forest) -> None:
    """Links among sets of a tile, left ones with right ones (or all of them, where a tile is one unit)."""
    size = np.array([len(d) for d in docs], np.int64)
    rows, cols = np.flatnonzero(left), np.flatnonzero(right)
    both = _product(docs, rows, cols).astype(np.int64)
    linked = 100 * both >= percent * (size[rows][:, None] + size[cols][None] - both)
    for k, i in enumerate(rows.tolist()):
        for j in cols[linked[k]].tolist():
            forest.link(i, j)


def links(docs: DataFrame, rows: DataFrame, prefixes: DataFrame, classes: DataFrame, n: int, percent: int, text: str) -> DataFrame:
    """node, root: the linked classes' components. rows, prefixes: see candidates(); classes: c, n, t, copies."""
    found = candidates(docs, rows, prefixes, n, percent, text)
    groups = components(found)
    members = cut(groups.select(F.col("node").alias("c"), F.col("root").alias("g")).join(classes, "c"), "members", [found])
    sets = sets_of(docs, members, n, text)

    def kernel(t: pa.Table, left: np.ndarray, right: np.ndarray, forest: tiles.Forest) -> None:
        grams = t.column("grams").chunk(0)
        _forest(np.split(grams.flatten().to_numpy(), np.cumsum(grams.value_lengths().to_numpy())[:-1]), left, right, percent, forest)

    out = tiles.links(members.select("c", "g", "n"), sets, kernel, percent / 100, TILE_DOCS, TILE_GRAMS)
    discard(docs.sparkSession, sets), discard(docs.sparkSession, members)
    return out


def join(docs: DataFrame, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id (least id that links reach) and group_id (the same for all of a component; null without n-grams) of every row.

    Two documents link when 100 * |A & B| >= percent * |A | B| for their sets of n-word shingles.
    """
    signed = cut(signatures(docs, n, percent, doc_id, text), "signatures")
    rows = cut(signed.drop("prefix"), "rows")
    full = rows.filter("n > 0")
    prefixes = signed.filter("n > 0").groupBy("c").agg(F.first("n").cast("int").alias("n"), F.first("prefix").alias("prefix"))
    prefixes = cut(prefixes, "prefixes", [signed])
    classes = cut(full.groupBy("c").agg(F.first("n").alias("n"), F.min("t").alias("t"), F.min("doc_id").alias("first_id"), F.count("*").alias("copies")), "classes")
    found = links(docs, rows, prefixes, classes, n, percent, text).withColumnRenamed("node", "c")
    # A class of one document without links is its own component; the others are looked up.
    known = classes.join(found, "c", "left").filter("copies > 1 or root is not null").select("c", "copies", "first_id", F.coalesce("root", "c").alias("root"))
    known = cut(known, "groups", [classes])
    least = cut(known.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("__n")), "least")
    known = cut(lookup(known.select("c", "copies", "root"), least, "root", "__n"), "known", [known, least])
    out = lookup(full.select("doc_id", "t", "n", "c"), known, "c", "copies")
    least_id = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", F.col("t").alias("text_hash"), F.col("n").alias("n_shingles"), least_id.alias("component_id"), F.coalesce("root", "c").alias("group_id"))
    alone = rows.filter("n = 0").select("doc_id", F.col("t").alias("text_hash"), F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("group_id"))
    return out.unionByName(alone)


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without all but one document of each component: the first by id (null last) and hash of its text, and of rows that are the same in both, one. Documents without n-grams stay."""
    found = cut(join(docs, n, percent, doc_id, text).filter("group_id is not null"), "decided")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = cut(found.groupBy("group_id").agg(F.min(order).alias("first"), F.count("*").alias("rows")).filter("rows > 1"), "firsts")
    grouped = lookup(found, first, "group_id", "rows").filter("first is not null")
    grouped = cut(grouped.withColumn("stays", order.eqNullSafe(F.col("first"))).groupBy("doc_id", "text_hash").agg(F.max("stays").alias("stays"), F.count("*").alias("rows")), "grouped", [found, first])
    gone, twice = grouped.filter("not stays"), grouped.filter("stays and rows > 1")
    id_, hash_ = F.col(doc_id).cast("long"), F.xxhash64(text)

    def same(x: DataFrame) -> DataFrame:
        x = x.select(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "text_hash").alias("__statlens_row"))
        return F.broadcast(x) if x.count() <= BROADCAST_IDS else x

    row = F.xxhash64(F.coalesce(id_.cast("string"), F.lit("-")), hash_)
    kept = docs.withColumn("__statlens_row", row).join(same(gone), "__statlens_row", "left_anti")
    if twice.isEmpty():
        return kept.drop("__statlens_row")
    again = same(twice)
    return kept.join(again, "__statlens_row", "left_anti").unionByName(kept.join(again, "__statlens_row", "left_semi").dropDuplicates(["__statlens_row"])).drop("__statlens_row")
