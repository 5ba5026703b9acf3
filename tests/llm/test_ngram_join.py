import re
from collections import Counter, defaultdict

import pytest

from statlens.llm import common, ngram_join, tiles

from .data import DOCS, clashing, documents


def sets(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def brute(rows, n, percent):
    """(doc_id, set size, component) of each row, by comparing all pairs that share an n-gram."""
    s = [sets(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = defaultdict(list)
    for k, grams in enumerate(s):
        shared = Counter(j for g in grams for j in where[g])
        for j, both in shared.items():
            if 100 * both >= percent * (len(grams) + len(s[j]) - both):
                root[find(k)] = find(j)
        for g in grams:
            where[g].append(k)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return sorted(((i if i is not None else -1), len(s[k]), least.get(find(k), -1)) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize(("n", "percent", "hot", "docs", "sampled"), [(4, 85, 192, 192, 16), (4, 85, 2, 3, 1), (4, 85, 3, 2, 10**6), (5, 80, 192, 192, 16), (5, 80, 2, 3, 1)])
def test_against_brute_force(spark, monkeypatch, n, percent, hot, docs, sampled):
    """With limits so low that each way of treating frequent n-grams and large groups is taken."""
    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(ngram_join, "HOT_AGAIN", hot)
    monkeypatch.setattr(ngram_join, "TILE_DOCS", docs)
    monkeypatch.setattr(ngram_join, "SAMPLED", sampled)
    if sampled != 16:
        monkeypatch.setattr(ngram_join, "OFTEN_SAMPLED", 1)
        monkeypatch.setattr(ngram_join, "OFTEN", 2)
    df = clashing(documents(spark))
    got = sorted((r[0] if r[0] is not None else -1, r[1], r[2] if r[2] is not None else -1) for r in ngram_join.join(df, n, percent).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute([(r["doc_id"], r["text"]) for r in df.collect()], n, percent)
    assert len({g[2] for g in got}) < len(got) - 10


def test_ids_by_shuffle(spark, monkeypatch):
    for module in (ngram_join, common):
        monkeypatch.setattr(module, "BROADCAST_IDS", 0)
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    df = documents(spark, ["a b c d e f g h"] * 3 + ["a b c d e f g h i j k l m n o p q r s t u v w x y z", "a b c d e f g h i j k l m n o p q r s t u v w x y 1"], repeated=False)
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.join(df).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3}


def test_one_of_each(spark):
    df = documents(spark)
    want = brute([(r["doc_id"], r["text"]) for r in df.collect()], 5, 80)
    kept = ngram_join.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in kept.collect()) == sorted({i for i, n, c in want if i == c or n == 0})
    plain = documents(spark, repeated=False)
    assert ngram_join.one_of_each(plain).count() == len({c for i, n, c in brute([(r["doc_id"], r["text"]) for r in plain.collect()], 5, 80) if i == c})


def test_one_of_each_without_ids(spark):
    text = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    rows = [(None, text), (None, text), (None, text[:-1] + "1"), (5, text[:-1] + "2"), (5, text[:-1] + "3"), (6, text), (7, "other words of a text"), (None, None), (None, None)]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    got = [r["doc_id"] for r in ngram_join.one_of_each(df).collect()]
    assert sorted(-1 if i is None else i for i in got) == [-1, -1, 5, 7]


def test_empty(spark):
    df = spark.createDataFrame([], DOCS)
    assert ngram_join.join(df).count() == 0
    assert ngram_join.one_of_each(df).count() == 0


def test_forest():
    f = tiles.Forest(4)
    f.link(0, 1), f.link(1, 0), f.link(2, 3), f.link(0, 3)
    assert f.edges == [(0, 1), (2, 3), (0, 3)] and len(set(f.root.tolist())) == 1
