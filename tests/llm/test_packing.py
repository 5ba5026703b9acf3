import os
import random

import numpy as np
import pytest

from statlens.llm import packing

from .data import DOCS, clashing, documents

needs_vocabulary = pytest.mark.skipif(not os.path.exists(packing.VOCABULARY), reason="no vocabulary")


def plain_best_fit(lengths, length):
    room = []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        fits = [r for r in room if r >= lengths[k]]
        if fits:
            room.remove(min(fits))
        room.append((min(fits) if fits else length) - lengths[k])
    return sorted(room)


def test_best_fit_against_plain_search():
    rng = random.Random(1)
    for length in (1, 7, 64, 100):
        lengths = [rng.randrange(1, length + 1) for _ in range(300)]
        rows = packing.best_fit(lengths, length)
        assert sorted(k for r in rows for k in r) == list(range(300))
        assert sorted(length - sum(lengths[k] for k in r) for r in rows) == plain_best_fit(lengths, length)


@needs_vocabulary
@pytest.mark.parametrize(("length", "shard"), [(64, 500), (2048, 2_000_000)])
def test_round_trip(spark, length, shard):
    df = clashing(documents(spark))
    with open(packing.VOCABULARY, "rb") as f:
        tokenizer = packing.Tokenizer(f.read())
    got = packing.pack(df, length=length, shard=shard).collect()
    pieces = {}
    for r in got:
        x, pos = np.frombuffer(r["input_ids"], "<u2"), np.frombuffer(r["position_ids"], "<u2")
        cu = r["cu_seqlens"]
        assert len(x) == length and cu[0] == 0 and cu[-1] == r["n_tokens"] <= length and len(cu) == len(r["doc_ids"]) + 1
        for i, s, a, b in zip(r["doc_ids"], r["starts"], cu, cu[1:]):
            assert b > a and (pos[a:b] == np.arange(b - a)).all()
            pieces.setdefault((i, s), []).append(x[a:b].tolist())
        assert (x[cu[-1] :] == tokenizer.close).all() and not pos[cu[-1] :].any()
    want = {}
    for r in df.collect():
        if r["text"] is not None:
            ids = tokenizer.ids(r["text"]).tolist()
            for s in range(0, len(ids), length):
                want.setdefault((r["doc_id"], s), []).append(ids[s : s + length])
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    assert len({r["pack_id"] for r in got}) == len(got)
    assert tokenizer._make().decode(tokenizer.ids("Ein Text, été 漢字")[:-1].tolist()) == "Ein Text, été 漢字"


@needs_vocabulary
def test_write_and_empty(spark, tmp_path):
    packed = packing.pack(documents(spark, ["a b c", None, ""], repeated=False), length=16)
    packing.write(packed, str(tmp_path / "rows"))
    assert spark.read.parquet(str(tmp_path / "rows")).schema == packed.schema
    assert packing.digest(packed).count() == packed.count() > 0
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0
