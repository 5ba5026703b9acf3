import random

import numpy as np
import pytest

from statlens.llm import common, tiles
from statlens.llm import fuzzy_lines as fl

from .data import DOCS, clashing, documents


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance():
    rng = random.Random(8)
    for _ in range(500):
        a = bytes(rng.choice(b"ab c") for _ in range(rng.randrange(40)))
        b = bytes(x for x in a if rng.random() < 0.9) if rng.random() < 0.5 else bytes(rng.choice(b"ab c") for _ in range(rng.randrange(40)))
        most, d = rng.randrange(30), plain_distance(a, b)
        got = fl.edit_distance(a, b, most)
        assert got == d if d <= most else got > most


def test_within():
    rng = random.Random(9)
    for _ in range(300):
        a = [rng.choice(["ab", "cde", "f", "ghij"]) for _ in range(rng.randrange(1, 9))]
        b = [w if rng.random() < 0.7 else rng.choice(["x", "yz"]) for w in a]
        a, b, most = " ".join(a).encode(), " ".join(b).encode(), rng.randrange(12)
        assert fl.within(a, b, most) == (plain_distance(a, b) <= most)


def test_one_word_leaves_all_but_two_blocks():
    rng = random.Random(3)
    for n in (2, 5, 12, 40, 300):
        w = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        edits = [w[:k] + ["other"] + w[k + 1 :] for k in range(n)] + [w[:k] + w[k + 1 :] for k in range(n)] + [w[:k] + ["more"] + w[k:] for k in range(n)]
        prints = fl.Lines([" ".join(x).encode() for x in [w, *edits]]).prints
        assert ((prints != prints[0]).sum(axis=1) <= 2).all()


def test_long_lines_take_one_bit_at_a_time(monkeypatch):
    word = np.random.default_rng(1).integers(0, 1 << 63, 300_000).astype(np.uint64) // np.uint64(fl.BLOCKS << 40) * np.uint64(fl.BLOCKS << 40) + np.uint64(123 << 8)
    prints = fl.fingerprints(word, np.zeros(len(word), np.int64), 1)
    assert (prints == fl.fingerprints(word[:1000], np.zeros(1000, np.int64), 1)).all()


def test_simhash_of_sets_that_lie_in_order():
    rng = np.random.default_rng(4)
    word, of = rng.integers(0, 1 << 64, 5000, dtype=np.uint64), np.sort(rng.integers(0, 300, 5000))
    of[of == 17] = 18
    mixed = rng.permutation(5000)
    for x, y in zip(fl.simhash(word, of, 301, 0, fl.WHOLE), fl.simhash(word[mixed], of[mixed], 301, 0, fl.WHOLE)):
        assert (x == y).all()


def lined():
    rng = random.Random(6)
    base = [" ".join(f"w{rng.randrange(10**6):06d}x" .translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(12)) for _ in range(6)]
    out = [None, "", "\n\n", "123\n!!!", "Same line\nsame  LINE!\nother"]
    for k in range(25):
        lines = []
        for _ in range(4):
            w = rng.choice(base).split()
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = rng.choice(["foo", "bar", "q"])
            lines.append(" ".join(w))
        out.append("\n".join(lines) + ("\n" + "z" * 3000 if k == 7 else ""))
    return out


def alike(x, i, j):
    """Whether the fingerprints of lines i and j let them link."""
    return ((x.prints[i] == x.prints[j]) & (x.prints[i] != 0)).sum() >= fl.AGREE and int(x.whole[i] ^ x.whole[j]).bit_count() <= fl.FAR


def brute(rows):
    """rows: id (-1 for none), hash of the text, text."""
    occ = [(i, h, k, fl.normalised(line.encode())) for i, h, t in rows if t is not None for k, line in enumerate(t.split("\n"))]
    lines = sorted({o[3] for o in occ if o[3]})
    marks = fl.Lines(lines)
    root, linked = list(range(len(lines))), 0

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(lines):
        for j in range(i):
            longer = max(len(a), len(lines[j]))
            if alike(marks, i, j) and 5 * abs(len(a) - len(lines[j])) <= longer and 5 * plain_distance(a, lines[j]) <= longer:
                root[find(i)] = find(j)
                linked += 1
    number = {x: i for i, x in enumerate(lines)}
    first = {}
    for i, h, k, line in sorted(set(occ)):
        if line:
            first.setdefault(find(number[line]), (i, h, k))
    return sorted((i, h, k, not line or first[find(number[line])] == (i, h, k)) for i, h, k, line in occ), linked


def odd_ids(df):
    """The first texts under one id, some without any."""
    from pyspark.sql import functions as F

    return df.withColumn("doc_id", F.when(F.col("doc_id") < 16, F.lit(5).cast("long")).when(F.col("doc_id") < 30, F.lit(None).cast("long")).otherwise(F.col("doc_id")))


@pytest.mark.parametrize(("often", "tile", "ids"), [(128, 256, lambda df: df), (1, 3, lambda df: df), (128, 256, odd_ids)])
def test_against_brute_force(spark, monkeypatch, often, tile, ids):
    from pyspark.sql import functions as F

    monkeypatch.setattr(fl, "OFTEN", often)
    monkeypatch.setattr(fl, "SAMPLED", 1 if often == 1 else 64)
    monkeypatch.setattr(fl, "TILE_LINES", tile)
    df = clashing(ids(documents(spark, lined())))
    rows = [(-1 if r[0] is None else r[0], r[1], r[2]) for r in df.select("doc_id", F.xxhash64("text"), "text").collect()]
    want, linked = brute(rows)
    decided = fl.dedup(df)
    assert linked > 20
    got = [(-1 if r["doc_id"] is None else r["doc_id"], r["text_hash"], r["place"], r["kept"]) for r in decided.collect()]
    assert sorted(x for x in got if x[2] is not None) == want
    assert len(got) - len(want) == sum(t is None for _, _, t in rows)
    new = {(r[0], r[1]): r[2] for r in fl.apply(df.withColumn("x", F.xxhash64("text")), decided).select("doc_id", "x", "text").collect()}
    for i, h, t in rows:
        keep = {k for j, g, k, kept in want if (j, g) == (i, h) and kept}
        assert new[(None if i == -1 else i, h)] == (None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k in keep))


def test_numbers_are_compared(spark):
    texts = ["total 123456789", "total 987654321", "2024", "2024", "receipt of the first payment 1234567890 for all of you", "receipt of the first payment 1234567891 for all of you"]
    kept = {r["doc_id"]: r["kept"] for r in fl.dedup(documents(spark, texts, repeated=False)).collect()}
    assert kept == {0: True, 1: True, 2: True, 3: False, 4: True, 5: False}


def recall(words, edits, pairs=400, seed=5):
    """The share of pairs of lines with so many words replaced and edit similarity of 0.8 or more that agree on enough blocks."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 10))) for _ in range(5000)]
    found = total = 0
    while total < pairs:
        a = [rng.choice(vocabulary) for _ in range(words)]
        b = list(a)
        for k in rng.sample(range(words), edits):
            b[k] = rng.choice(vocabulary)
        a, b = " ".join(a).encode(), " ".join(b).encode()
        if a == b or not fl.within(a, b, max(len(a), len(b)) // 5):
            continue
        total += 1
        found += alike(fl.Lines([a, b]), 0, 1)
    return found / total


def test_recall():
    assert min(recall(20, 1), recall(30, 1)) > 0.99
    assert recall(12, 1) > 0.97
    assert recall(8, 1) > 0.9
    assert recall(20, 2) > 0.7


def test_ties():
    rng = np.random.default_rng(4)
    key = np.sort(np.concatenate((rng.integers(0, 60, 300), np.full(90, 7), np.full(40, 8))))
    base = rng.integers(0, 1 << 62, 6)
    whole, size = base[rng.integers(0, 6, len(key))] ^ (1 << rng.integers(0, 62, len(key))), rng.integers(80, 130, len(key))
    near = lambda i, j: key[i] == key[j] and int(whole[i] ^ whole[j]).bit_count() <= fl.FAR and 10 * min(size[i], size[j]) >= 8 * max(size[i], size[j])
    want = list(range(len(key)))
    for i in range(len(key)):
        for j in range(i):
            if near(i, j):
                want = [want[i] if x == want[j] else x for x in want]
    got = fl._ties(key, whole, size, 80).tolist()
    assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


def test_ties_name_their_sets(spark):
    """Classes that any key ties have a k in common, and one k however many keys tie the same set."""
    rows = [(c, 10, 0, *(x,) * fl.BLOCKS) for c, x in ((5, 1), (3, 1), (9, 2), (8, 2), (4, 3))]
    got = fl.candidates(spark.createDataFrame(rows, "c long, size long, whole long, " + ", ".join(f"{p} int" for p in fl.PRINTS)), 80).distinct().collect()
    assert sorted((r["a"], r["b"]) for r in got) == [(5, 3), (9, 8)] and len({r["k"] for r in got}) == 2


def test_large_chains_are_compared_within_keys_only(spark, monkeypatch):
    """A chain of candidates, most of which link with nothing: the second pass grows with the chain, not with its square."""
    placed = []

    def cut(df, name="cut", done=()):
        out = common.cut(df, name, done)
        placed.extend([out.count()] if name == "placed" else [])
        return out

    def kernel(t, left, right, forest):
        c = t.column("c").to_numpy()
        for i in np.flatnonzero(left).tolist():
            for j in np.flatnonzero(right & (np.abs(c - c[i]) == 1) & (np.minimum(c, c[i]) % 5 == 0)).tolist():
                forest.link(i, j)

    monkeypatch.setattr(tiles, "cut", cut)
    n = 400
    members = spark.range(n).selectExpr("id as c", "0L as g", "10L as n")
    inner = spark.range(n - 1).selectExpr("explode(array(id, id + 1)) as c", "id as k")
    got = tiles.links(members, spark.range(n).selectExpr("id as c"), kernel, 0.8, 8, 1 << 40, inner).collect()
    assert {(r["node"], r["root"]) for r in got} == {(x + d, x) for x in range(0, n - 1, 5) for d in (0, 1)}
    assert len(placed) == 2 and placed[1] <= 3 * n


def test_empty(spark):
    df = spark.createDataFrame([], DOCS)
    assert fl.dedup(df).count() == 0
