import random

import pytest

from statlens.llm import fixity

SCHEMA = "file string, offset long, payload string, record_id long, hash string"


def replicas(seed):
    rng = random.Random(seed)
    a, b, want = [], [], []
    for f in range(4):
        at = 0
        for k in range(rng.randrange(60)):
            body = "x" * rng.randrange(200) + str(rng.random())
            a.append((f"f{f}", at, body, len(a), "clash"))
            fate = rng.random()
            if fate < 0.05:
                want.append((f"f{f}", at, "missing"))
            elif fate < 0.1:
                b.append((f"f{f}", at, "y" + body, len(a) - 1, "?"))
                want.append((f"f{f}", at, "changed"))
            else:
                b.append((*a[-1][:4], "?"))
            at += len(body)
    b.append(("new", 0, "", 999, "?"))
    want.append(("new", 0, "extra"))
    return a, b, sorted(want)


@pytest.mark.parametrize(("seed", "span", "fanout"), [(1, 1 << 16, 16), (2, 256, 2), (3, 64, 4)])
def test_finds_exactly_what_differs(spark, seed, span, fanout):
    a, b, want = replicas(seed)
    got = fixity.audit(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA).repartition(3), span=span, fanout=fanout)
    assert sorted((r["file"], r["offset"], r["status"]) for r in got.collect()) == want


def test_odd_rows(spark):
    a = spark.createDataFrame([("f", 0, None, 1, ""), (None, None, "x", None, ""), ("f", 5, "", 2, ""), ("f", 9, "r", 3, ""), ("f", 9, "r", 3, "")], SCHEMA)
    assert fixity.audit(a, a).count() == 0
    b = spark.createDataFrame([("f", 0, "now there", 1, ""), (None, None, "x", None, ""), ("f", 9, "r", 3, "")], SCHEMA)
    assert sorted((r["file"], r["offset"], r["status"]) for r in fixity.audit(a, b).collect()) == [("f", 0, "extra"), ("f", 5, "missing"), ("f", 9, "missing")]


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert fixity.audit(none, none).count() == 0
    assert [r["status"] for r in fixity.audit(none, spark.createDataFrame([("f", 3, "x", 1, "")], SCHEMA)).collect()] == ["extra"]


def test_equal_replicas_stop_at_the_roots(spark):
    """The root differs with any byte below it."""
    a, b, _ = replicas(4)
    ra = fixity.record_hashes(spark.createDataFrame(a, SCHEMA), "file", "offset", "payload", "record_id")
    depth = fixity.depth_of(max(x[1] for x in a), 64, 4)
    roots = fixity.tree(fixity.leaves(ra, 64), depth, 4)[-1].collect()
    assert len(roots) == len({r["file"] for r in roots}) == len({x[0] for x in a})
