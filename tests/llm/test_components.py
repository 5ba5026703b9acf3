import random

import pytest

from statlens.llm import components as module
from statlens.llm.components import components


@pytest.mark.parametrize("hub_edges", [module.HUB_EDGES, 20])
def test_random_graphs(spark, monkeypatch, hub_edges):
    monkeypatch.setattr(module, "HUB_EDGES", hub_edges)
    monkeypatch.setattr(module, "MAX_HUBS", 20)
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(k, k + 1) for k in range(300, 340)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len(want) and {r["node"]: r["root"] for r in got} == want


def test_windows_serve_while_there_is_no_hub(spark, monkeypatch):
    monkeypatch.setattr(module, "HUB_EDGES", 20)
    seen, at = [], module._at
    monkeypatch.setattr(module, "_at", lambda *a, **k: seen.append(a[4]) or at(*a, **k))
    got = components(spark.range(300).selectExpr("id - id % 3 as a", "id as b")).collect()
    assert {(r["node"], r["root"]) for r in got} == {(k, k - k % 3) for k in range(300)}
    assert set(seen) == {0}


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
