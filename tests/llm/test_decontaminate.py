import random

import numpy as np
import pytest

from statlens.llm import decontaminate as dc
from statlens.llm.words import Words

from .data import DOCS, clashing, words

ITEMS = "item_id long, text string"


def plain_align(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    return max((h[i].__setitem__(j, max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)) or h[i][j] for i, x in enumerate(a, 1) for j, y in enumerate(b, 1)), default=0)


def test_alignment_against_the_table():
    rng = np.random.default_rng(5)
    for _ in range(100):
        a, b = rng.integers(0, 4, rng.integers(0, 12)), rng.integers(0, 4, rng.integers(0, 20))
        assert dc.align(a, b)[0] == plain_align(a.tolist(), b.tolist())


def made(seed=2):
    rng = random.Random(seed)
    items = [" ".join(words(rng, 30, 5000)) for _ in range(12)]
    docs, want = [], set()
    for k in range(80):
        body = words(rng, rng.randrange(400), 5000)
        if k % 4 == 0:
            n = rng.randrange(len(items))
            leak = items[n].upper().split() if k % 8 else items[n].split()
            for _ in range(4):
                at = rng.randrange(len(leak))
                leak[at : at + 1] = rng.choice([[], ["new"], [leak[at] + ",", "in"]])
            at = rng.randrange(len(body) + 1)
            body[at:at] = leak
            want.add((k, n))
        docs.append(" ".join(body))
    return items, docs, want


def test_finds_edited_copies_and_nothing_else(spark):
    items, docs, want = made()
    bench = spark.createDataFrame([*enumerate(items), (100, None), (101, ""), (102, "two words"), (None, "x y z a b c")], ITEMS)
    df = clashing(spark.createDataFrame([(k, t, None, None, 0) for k, t in enumerate(docs)] + [(900, None, None, None, 0), (901, "", None, None, 0)], DOCS).repartition(3))
    blocks = dc.prepared(df, bench)
    got = dc.matches(df, blocks)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want
    kept = dc.clean(df, blocks)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {k for k in range(80) if k not in {d for d, _ in want}} | {900, 901}


def test_blocks_of_the_benchmark_agree(spark, monkeypatch):
    items, docs, want = made(3)
    monkeypatch.setattr(dc, "BLOCK_WORDS", 60)
    df = spark.createDataFrame([(k, t, None, None, 0) for k, t in enumerate(docs)], DOCS)
    blocks = dc.prepared(df, spark.createDataFrame([*enumerate(items)], ITEMS))
    assert sum(1 for _ in blocks) > 3
    assert {(r["doc_id"], r["item_id"]) for r in dc.matches(df, blocks).collect()} == want


def test_all_pairs_on_the_tables(spark, small):
    """Each document and item of the smallest tables aligned in full."""
    docs, bench = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    d, b = docs.collect(), bench.collect()
    wd, wb = (Words([(r["text"] or "").encode() for r in x], plain=True) for x in (d, b))
    hashes = lambda w, k: w.hash[w.first[k] : w.first[k + 1]]
    want = {(d[i]["doc_id"], b[j]["item_id"]) for i in range(len(d)) for j in range(len(b)) if len(np.intersect1d(hashes(wd, i), hashes(wb, j))) > 3 and dc.align(hashes(wb, j), hashes(wd, i))[0] >= len(hashes(wb, j))}
    assert {(r["doc_id"], r["item_id"]) for r in dc.matches(docs, dc.prepared(docs, bench)).collect()} == want


@pytest.mark.parametrize("which", ["docs", "items"])
def test_empty(spark, which):
    items, docs, _ = made()
    df = spark.createDataFrame([] if which == "docs" else [(1, docs[0], None, None, 0)], DOCS)
    blocks = dc.prepared(df, spark.createDataFrame([] if which == "items" else [(1, items[0])], ITEMS))
    assert dc.matches(df, blocks).count() == 0 and dc.clean(df, blocks).count() == df.count()


@pytest.mark.parametrize(("size", "replaced"), [(20, 4), (20, 5), (30, 6), (30, 7), (60, 12), (60, 15)])
def test_replaced_words_against_full_alignment(spark, size, replaced):
    """Copies with a fifth or a quarter of their words replaced; of some items exact copies too, of others common passages in other documents."""
    rng = random.Random(size + replaced)
    items = [words(rng, size, 5000) for _ in range(20)]
    texts = []
    for k, item in enumerate(items):
        copy = list(item)
        for at in rng.sample(range(size), replaced):
            copy[at] = f"new{rng.randrange(10**6)}"
        texts.append(words(rng, 40, 5000) + copy + words(rng, 40, 5000))
        if k % 3 == 1:
            texts.append(words(rng, 20, 5000) + item)
        if k % 3 == 2:
            texts += [words(rng, 9, 5000) + copy[at : at + size // 3] for at in range(0, size, size // 3) for _ in range(3)]
    numbers = {x: n for n, x in enumerate({x for t in [*items, *texts] for x in t})}
    a, b = ([np.array([numbers[x] for x in t]) for t in z] for z in (items, texts))
    want = {(d, k) for d, t in enumerate(b) for k, x in enumerate(a) if len(np.intersect1d(t, x)) * 2 >= size and dc.align(x, t)[0] >= dc.THRESHOLD * dc.MATCH * size}
    assert len(want) >= len(items)
    df = spark.createDataFrame([(d, " ".join(t), None, None, 0) for d, t in enumerate(texts)], DOCS)
    blocks = dc.prepared(df, spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], ITEMS))
    assert {(r["doc_id"], r["item_id"]) for r in dc.matches(df, blocks).collect()} == want
    assert {r["doc_id"] for r in dc.clean(df, blocks).collect()} == set(range(len(texts))) - {d for d, _ in want}


def test_common_seeds_and_items_without_id(spark, monkeypatch):
    """One phrase that all items share, repeated in a text: the items are gone through in parts, and nothing is lost."""
    items = [f"the same old phrase of all items number{k} ends here" for k in range(40)]
    docs = spark.createDataFrame([(1, " ".join(items)), (None, items[3]), (2, "the same old phrase of all " * 50), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(None if k == 3 else k, t) for k, t in enumerate(items)], "item_id long, text string")
    found = lambda: sorted(map(repr, dc.matches(docs, dc.prepared(docs, bench)).collect()))
    want = found()
    assert {r["item_id"] for r in dc.matches(docs, dc.prepared(docs, bench)).filter("doc_id = 1").collect()} == {None if k == 3 else k for k in range(40)}
    monkeypatch.setattr(dc, "MAX_HITS", 20)
    assert found() == want
    assert [r["doc_id"] for r in dc.clean(docs, dc.prepared(docs, bench)).filter("text is null or length(text) < 80").collect()] == [3]
