"""Small documents with every odd case, and near copies."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=300):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def texts(seed=1, n=30):
    """Unrelated texts, near copies with drifting edits, exact copies, a passage that many share, and odd ones."""
    rng = random.Random(seed)
    passage = " ".join(words(rng, 60))
    out = [None, "", "   ", "one", "One two", "one two three", "a b c d", "A B C D", "\t\n", "...", "x" * 5000, "é ü ß 漢字 \U0001f600"]
    base = words(rng, 120)
    for k in range(n):
        out.append(" ".join(words(rng, rng.randrange(5, 150))))
        out.append(" ".join(words(rng, rng.randrange(5, 90))) + " " + passage)
        copy = list(base)
        for _ in range(k % 9):
            copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    out += [out[20], out[20], " ".join(words(rng, 6000))]
    return out


def documents(spark, items=None, repeated=True):
    """Documents with ids in the order of items; with a row repeated and one without id unless told otherwise."""
    rows = [(k, t, "en", f"s{k % 3}" if k % 7 else None, len(t or "")) for k, t in enumerate(texts() if items is None else items)]
    if repeated:
        rows += [rows[-1], (None, "no id at all here", None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def clashing(df):
    """df with further columns that bear names which operators use inside."""
    from pyspark.sql import functions as F

    for c in ("n", "c", "mix", "row", "language", "key", "size", "_id", "_size", "x", "prefix", "tile", "node", "root", "bucket"):
        df = df.withColumn(c, F.lit("?"))
    return df
