import numpy as np

from statlens.llm import quality, queries

from .data import DOCS, clashing, texts


def test_features_are_of_the_text_alone():
    t = [(x or "").encode() for x in texts()]
    one, each = quality.shape(t), np.vstack([quality.shape([x]) for x in t])
    assert one.shape == (len(t), quality.BASE) and np.isfinite(one).all() and np.allclose(one, each)
    assert np.allclose(quality.shape([b"a a\nb!\na a"])[0, [10, 11, 12, 14]], [2 / 5, 4 / 5, 2 / 5, 2 / 3])


def test_recovers_a_planted_class(spark):
    """Two kinds of texts, labels for a part of one of them."""
    rng = np.random.default_rng(3)
    rows = [(k, " ".join("word" + "abcdefghij"[rng.integers(10)] * rng.integers(1, 5) + (", " if rng.random() < 0.1 else " ") for _ in range(40)) if k % 4 else "BUY NOW!!! $$$ " * rng.integers(3, 9), "", None, 0) for k in range(3000)]
    x = quality.features(clashing(spark.createDataFrame(rows, DOCS)))
    good = x.withColumn("positive", (x.doc_id % 4 != 0) & (x.doc_id % 3 == 0))
    model = quality.fit(good)
    assert 0.6 < model.prior < 0.9
    got = {r["doc_id"]: r["score"] for r in quality.score(good, model).collect()}
    assert len(got) == 3000 and sum((got[k] >= 0.3) == bool(k % 4) for k in got) >= 2940


def test_minimises_the_clamped_risk():
    """Against small steps down the same risk, written out plainly, and with positives that can be told so well that the clamp bites."""
    rng = np.random.default_rng(5)
    pos = np.arange(3000) < 800
    for shift, prior in ((0.4, 0.5), (2.0, 0.8), (3.0, 0.6)):
        x = rng.normal(size=(3000, quality.D))
        x[:, 0] += shift * (np.arange(3000) < 1500)
        x[:, -1] = 1
        mean_pos = x[pos].mean(axis=0)

        def risk(w):
            g = x @ w
            p, bad = 1 / (1 + np.exp(-g)), np.logaddexp(0, g)
            h = p * (1 - p)
            sums = np.concatenate(([bad.sum(), np.logaddexp(0, -g[pos]).sum(), bad[pos].sum()], x.T @ p, x[pos].T @ p[pos], ((x * h[:, None]).T @ x).ravel(), ((x[pos] * h[pos, None]).T @ x[pos]).ravel()))
            return quality.Risk(sums, 3000, pos.sum(), prior, mean_pos, w)

        def plain(w):
            g = x @ w
            return prior * np.logaddexp(0, -g[pos]).mean() + max(0, np.logaddexp(0, g).mean() - prior * np.logaddexp(0, g[pos]).mean()) + quality.RIDGE / 2 * w @ w

        w = np.full(quality.D, 0.01)
        slope = [(plain(w + 1e-6 * e) - plain(w - 1e-6 * e)) / 2e-6 for e in np.eye(quality.D)]
        assert np.allclose(slope, risk(w).gradient, atol=1e-5)
        got = quality.minimise(risk, np.zeros(quality.D), 40)
        assert abs(plain(got) - risk(got).value) < 1e-9 and plain(got) >= 0
        w = best = np.zeros(quality.D)
        for k in range(800):
            w = w - 0.5 / (1 + k / 100) * risk(w).gradient
            best = w if plain(w) < plain(best) else best
        assert plain(got) <= plain(best) + 0.01


def test_no_positives_and_empty(spark):
    from pyspark.sql import functions as F

    x = quality.features(spark.createDataFrame([(1, None, None, None, 0), (None, "", None, None, 0)], DOCS)).withColumn("positive", F.lit(False))
    assert quality.fit(x) is None
    assert {r["score"] for r in quality.score(x, None).collect()} == {0.5}
    assert quality.fit(x.limit(0)) is None


def test_held_out_accuracy(spark, small):
    got = queries.op8_quality_pu(spark, small.replace("0.001", "0.01")).join(spark.read.parquet(f"{small.replace('0.001', '0.01')}/labels.parquet"), "doc_id").filter("held_out")
    assert got.filter("predicted = quality").count() >= 0.95 * got.count()
