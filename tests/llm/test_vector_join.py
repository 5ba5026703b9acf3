import numpy as np
import pytest

from statlens.llm import vector_join

from .data import clashing

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine=0.98):
    n, comp = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    def sound(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    for i, (_, v, a) in enumerate(rows):
        for j, (_, w, b) in enumerate(rows[:i]):
            if a is not None and a == b and sound(v) and sound(w) and len(v) == len(w):
                x, y = np.array(v, np.float32).astype(float), np.array(w, np.float32).astype(float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                    n[i], n[j] = n[i] + 1, n[j] + 1
                    comp[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((r[0], n[i], least[find(i)], least[find(i)] == r[0]) for i, r in enumerate(rows))


@pytest.mark.parametrize(("cell", "tile", "dim"), [(1500, 1024, 64), (4, 3, 64), (2, 100, 24), (3, 5, 3)])
def test_against_brute_force(spark, monkeypatch, cell, tile, dim):
    monkeypatch.setattr(vector_join, "CELL", cell)
    monkeypatch.setattr(vector_join, "TILE", tile)
    rng = np.random.default_rng(4)
    rows = []
    for k in range(25):
        centre = rng.normal(size=dim) * 10.0 ** rng.integers(-3, 4)
        for _ in range(1 + k % 6):
            rows.append((len(rows), [float(x) for x in centre + rng.normal(size=dim) * np.linalg.norm(centre) / np.sqrt(dim) * rng.choice([0.02, 0.1, 0.13])], k % 3))
    rows += [(1000, rows[3][1], rows[3][2]), (1001, rows[3][1], rows[3][2]), (1002, rows[3][1], None), (1003, None, 1), (1004, [0.0] * dim, 1), (1005, [float("nan")] + [1.0] * (dim - 1), 1)]
    rows += [(1006, [None] + [1.0] * (dim - 1), 1), (1007, [float("inf")] * dim, 1), (1008, [], 1), (1009, [1.0, 2.0], 1)]
    # Other lengths with the same labels, a zero with a sign, ids that repeat, and columns with the operator's own names.
    rows += [(1010, [1.0, 2.01], 1), (1011, [2.0, 4.0], 1), (1012, [1.0] * 5, 2), (1013, [2.0] * 5, 2), (1014, [0.0, 1.0], 2), (1015, [-0.0, 1.0], 2), (1016, [1e30, 1e-30], 2), (1017, [1e25, 0.0], 2)]
    rows += [(7, rows[0][1], rows[0][2]), (7, [5.0, 1.0], 0)]
    df = clashing(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = vector_join.join(df)
    assert sorted(tuple(r) for r in got.select("vec_id", "n_links", "component_id", "kept").collect()) == brute(rows)


def test_empty(spark):
    assert vector_join.join(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [tuple(r) for r in vector_join.join(spark.createDataFrame([(1, None, None)], SCHEMA)).collect()] == [(1, 0, 1, True)]
