import numpy as np
import pytest
from pyspark.sql import functions as F

from statlens.llm import language, queries

from .data import DOCS, clashing


def sample(spark):
    english = "the quick brown fox jumps over the lazy dog while the rain falls on the plain and they think about their things"
    german = "der schnelle braune fuchs springt über den faulen hund während der regen fällt und sie über ihre dinge nachdenken"
    rows = [(k, t, lang, None, 0) for k in range(60) for t, lang in [((english, "en"), (german, "de"))[k % 2]]]
    return spark.createDataFrame(rows, DOCS), english, german


def test_mixtures_and_odd_texts(spark):
    train, english, german = sample(spark)
    model = language.Model.fit(language.count(clashing(train), F.lit(True)))
    assert model.languages == ["de", "en"]
    texts = [english, german.upper(), f"{english} {german}", None, "", "123 !!! ...", "\U0001f600", " ".join([english] * 300), "the"]
    df = spark.createDataFrame([(k, t, "?", None, 0) for k, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r["language"] for r in language.identify(clashing(df), model).collect()}
    assert [got[k]["lang_pred"] for k in range(9)] == ["en", "de", got[2]["lang_pred"], "und", "und", "und", "und", "en", "en"]
    assert {x["lang"] for x in got[2]["languages"]} == {"en", "de"} and sum(x["share"] for x in got[2]["languages"]) == pytest.approx(1)
    assert all(0 <= g["score"] <= 1 for g in got.values()) and got[3]["score"] == 0


def test_em_finds_the_likeliest_shares():
    """Against a fine grid of shares for two languages."""
    rng = np.random.default_rng(1)
    like = rng.random((2, 40))
    pi = language._em(like, np.array([0]), np.zeros(40, int), np.full((2, 1), 0.5), 500)
    grid = np.linspace(0.001, 0.999, 999)
    fit = np.log(grid[:, None] * like[0] + (1 - grid[:, None]) * like[1]).sum(axis=1)
    assert abs(pi[0, 0] - grid[fit.argmax()]) < 2e-3


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "some text", None, None, 0), (2, None, "en", None, 0)], DOCS)
    model = language.Model.fit(language.count(df, F.lit(True)))
    assert {r["language"]["lang_pred"] for r in language.identify(df, model).collect()} == {"und"}
    assert language.identify(spark.createDataFrame([], DOCS), model).count() == 0


def test_as_many_languages_as_the_text_mixes(spark):
    """Seven languages, each with letters of its own; texts that mix two to seven of them evenly."""
    rng = np.random.default_rng(4)
    word = lambda k: "".join(chr(0x4E00 + 5 * k + x) for x in rng.integers(0, 5, 6))
    names = [f"l{k}" for k in range(7)]
    train = spark.createDataFrame([(20 * k + j, " ".join(word(k) for _ in range(50)), names[k], None, 0) for k in range(7) for j in range(5)], DOCS)
    model = language.Model.fit(language.count(train, F.lit(True)))
    texts = [" ".join(word(k) for _ in range(30) for k in range(n)) for n in range(2, 8)]
    got = language.identify(spark.createDataFrame([(n, t, None, None, 0) for n, t in enumerate(texts, 2)], DOCS), model)
    for r in got.collect():
        shares = {x["lang"]: x["share"] for x in r["language"]["languages"]}
        assert shares == pytest.approx(dict.fromkeys(names[: r["doc_id"]], 1 / r["doc_id"]), abs=0.02)


def test_held_out_accuracy(spark, small):
    got = queries.op5_language_mixture(spark, small).join(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.filter("lang = lang_pred").count() >= 0.97 * got.count()
