import random
import re

import pytest
from pyspark.sql import functions as F

from statlens.llm import mixing

from .data import DOCS, clashing, documents


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def shares(sizes, weights=(1, 2, 3), most=3):
    """Targets by sharing again and again what capped sources leave."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    out, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        each = left / sum(w[s] for s in open_)
        full = {s for s in open_ if each * w[s] >= most * sizes[s]}
        if not full:
            return out | {s: each * w[s] for s in open_}
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ -= full
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets_and_budgets(spark, seed):
    rng = random.Random(seed)
    rows = [(k, " ".join(["w"] * rng.choice([0, 1, 5, 50])) if k % 11 else None, "en", rng.choice([None, "a", "b", "B", "é", "rare"]) if k % 50 else f"only{k}", 0) for k in range(400)]
    got = mixing.mix(clashing(spark.createDataFrame(rows, DOCS).repartition(4))).select("doc_id", "source", "mix.*").collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] for r in rows}
    sizes = {}
    for k, t, _, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want, taken = shares(sizes), {}
    for r in got:
        assert r["size"] == size(text[r["doc_id"]]) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-9, abs=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert taken == {s: int(t + 0.5) for s, t in want.items()}
    again = mixing.mix(spark.createDataFrame(rows, DOCS).repartition(2)).select("doc_id", "mix.taken").collect()
    assert {r["doc_id"]: r["taken"] for r in again} == {r["doc_id"]: r["taken"] for r in got}


def test_repeated_rows_share_the_cut(spark):
    rows = [(1, "a b c d e f g h", "en", "s", 0)] * 7 + [(2, "a b", "en", "t", 0)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).select("source", "mix.*").collect()
    one = {r["taken"] for r in got if r["source"] == "s"}
    assert len(one) == 1 and abs(7 * one.pop() - got[0]["target"]) < 8


def test_texts_of_the_mix(spark):
    df = documents(spark, ["a b\nc d  e", "x y z", "", None, "1 2 3 4 5 6 7 8 9"] * 5)
    mixed = mixing.mix(df)
    taken = {}
    for r in mixed.select("doc_id", "text", "mix.taken").collect():
        taken.setdefault(r["doc_id"], []).append((r["text"], r["taken"]))
    out = {}
    for r in mixing.repeated(mixed).collect():
        out.setdefault(r["doc_id"], []).append(r["text"])
    for i, rows in taken.items():
        assert sum(size(t) for t in out.get(i, [])) == sum(n for _, n in rows)
        assert all(rows[0][0].startswith(t) for t in out.get(i, []))
    assert mixing.repeated(mixed).columns == df.columns


def test_empty(spark):
    df = spark.createDataFrame([], DOCS)
    assert mixing.mix(df).count() == 0
    assert mixing.mix(spark.createDataFrame([(1, None, None, None, None)], DOCS)).select("mix.target", F.col("mix.taken")).first() == (0.0, 0)
