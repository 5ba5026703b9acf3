"""Text quality by positive-unlabelled learning.

Trusted positives are rows labelled 1; every document, labelled or not, is unlabelled web text. A logistic model
over features of the text's shape minimises the non-negative unbiased risk
    prior * E_pos[l(g)] + max(0, E_unl[l(-g)] - prior * E_pos[l(-g)])
with the logistic loss l. The class prior is the least ratio of unlabelled to positive mass above a score, over scores of a
first fit. All rows take part: each try of a Newton step is one pass over the stored features that returns 2*D*D sums; a step is halved until
the clamped risk goes down, and where the unlabelled part is clamped only the positive part is followed.

Defined cases: null and empty texts have the features of an empty text and get a score; a document with several
labels counts as positive only if all of them are 1; without positives every score is 0.5; repeated rows
count as often as they occur; labels of unknown documents are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, text_bytes
from .words import Words, mix, span_sums

BASE = 17
#: Features, their squares and a constant.
D = 2 * BASE + 1
STEPS, HALVINGS = 12, 5
RIDGE = 1e-4
BINS = 200
#: Positive mass that a score has to have above it to count for the prior; less is at the mercy of chance.
LEAST_MASS = 0.8

_KIND = np.full(256, 5, np.uint8)  # other ASCII signs
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 0, 1, 2, 3
for _c in b".,;:'\"?-()":
    _KIND[_c] = 4
for _c in b" \t\r\v\f":
    _KIND[_c] = 6
_KIND[ord("\n")], _KIND[ord("!")], _KIND[ord("|")] = 7, 8, 9


def shape(texts: list[bytes]) -> np.ndarray:
    """BASE features of each text, all between 0 and about 1 but for the logarithms."""
    n = len(texts)
    w = Words(texts)
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    kind = _KIND[raw]
    lens = np.diff(w.at)
    of = np.repeat(np.arange(n), lens)
    c = np.bincount(of * 10 + kind, minlength=n * 10).reshape(n, 10).astype(float)
    size, words = np.maximum(lens - 1.0, 1), np.maximum(w.count, 1.0)
    distinct, most, same = np.zeros(n), np.zeros(n), np.zeros(n)
    for i, (a, b) in enumerate(zip(w.first.tolist(), w.first[1:].tolist(), strict=False)):
        if b > a:
            h = w.hash[a:b]
            same[i] = np.count_nonzero(h[1:] == h[:-1])
            at = np.flatnonzero(np.diff(np.sort(h)))
            runs = np.diff(np.concatenate(([-1], at, [b - a - 1])))
            distinct[i], most[i] = len(runs), runs.max()
    last = kind[w.end - 1] if len(w.end) else np.zeros(0, np.uint8)
    signs = np.bincount(w.doc, weights=np.isin(last, (5, 8)), minlength=n)
    # Lines: the bytes between line ends, hashed like words.
    ends = np.flatnonzero((kind == 7) | np.isin(np.arange(len(raw)), w.at[1:] - 1))
    begins = np.concatenate(([0], ends[:-1] + 1))
    line = mix(span_sums(raw, begins, ends) + (ends - begins).astype(np.uint64))
    owner = of[ends]
    keep = ends > begins
    line, owner = line[keep], owner[keep]
    lines = np.bincount(owner, minlength=n)
    order = np.lexsort((line, owner))
    new = np.concatenate(([True], (line[order][1:] != line[order][:-1]) | (owner[order][1:] != owner[order][:-1]))) if len(order) else np.zeros(0, bool)
    fresh = np.bincount(owner[order][new], minlength=n)
    letters = np.maximum(c[:, 0] + c[:, 1], 1)
    x = [
        c[:, 0] / letters, c[:, 2] / size, c[:, 3] / size, c[:, 4] / size, c[:, 5] / size, c[:, 7] / words, c[:, 8] / words, c[:, 9] / words,
        np.log1p(size / words) / 3, np.log1p(w.count) / 10, distinct / words, most / words, same / words, signs / words,
        fresh / np.maximum(lines, 1), np.log1p(w.count / np.maximum(lines, 1)) / 10, (w.count == 0).astype(float),
    ]
    return np.stack(x, axis=1)


def features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and x, the text's features."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 1):
            x = shape(text_bytes(b.column(1))[0]).astype(np.float32)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * BASE), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), rows], names=["doc_id", "x"])

    return docs.select(doc_id, text).mapInArrow(run, "doc_id long, x array<float>")


def _matrix(column: pa.Array, scale: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, BASE)
    x = np.hstack([x, x * x])
    return x if scale is None else np.hstack([np.clip((x - scale[0]) / scale[1], -8, 8), np.ones((len(x), 1))])


def _sums(rows: DataFrame, f) -> np.ndarray:
    """The sum over all rows of f(x, positive), a fixed number of values, added up by Spark."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in it:
            if b.num_rows:
                got = f(b.column(0), b.column(1).to_numpy(zero_copy_only=False).astype(bool))
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["k", "v"])

    got = rows.select("x", "positive").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
    return got.sort_values("k")["v"].to_numpy()


class Model:
    def __init__(self, mean: np.ndarray, sd: np.ndarray, w: np.ndarray, prior: float) -> None:
        self.mean, self.sd, self.w, self.prior = mean, sd, w, prior

    def score(self, column: pa.Array) -> np.ndarray:
        return _sigmoid(_matrix(column, (self.mean, self.sd)) @ self.w)


def _sigmoid(g: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(g, -40, 40)))


class Risk:
    """The clamped risk at w, its gradient and curvature, from one pass over the rows.

    Where the unlabelled rows' negative risk is below 0 it counts as 0, and only the positives' risk is left to go down.
    """

    def __init__(self, sums: np.ndarray, n: float, n_pos: float, prior: float, mean_pos: np.ndarray, w: np.ndarray) -> None:
        """sums: loss of all rows as negatives, of positives as such and as negatives, gradient and curvature of all rows, and of positives, as negatives."""
        every, good, bad = sums[0] / n, sums[1] / n_pos, sums[2] / n_pos
        self.negative = every - prior * bad
        self.value = prior * good + max(0.0, self.negative) + RIDGE / 2 * float(w @ w)
        at = [3, 3 + D, 3 + 2 * D, 3 + 2 * D + D * D, 3 + 2 * D + 2 * D * D]
        g_all, g_pos, h_all, h_pos = (sums[i:j] for i, j in zip(at, at[1:]))
        # A positive's loss as such has the gradient (p - 1) x, as a negative p x. What the unlabelled part subtracts of positives cancels
        # but for a constant, so with it the curvature is that of all rows, and that of the positives alone where it is clamped.
        ridge = RIDGE * w, RIDGE * np.eye(D)
        whole = g_all / n - prior * mean_pos + ridge[0], h_all.reshape(D, D) / n + ridge[1]
        clamped = prior * (g_pos / n_pos - mean_pos) + ridge[0], prior * h_pos.reshape(D, D) / n_pos + ridge[1]
        #: Gradient and curvature, and behind them those on the other side of the clamp, which lead on where the minimum lies at its edge.
        self.sides = (clamped, whole) if self.negative < 0 else (whole, clamped)
        self.gradient = self.sides[0][0]


def minimise(risk, w: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Newton steps on risk(w) from w on, each halved until the risk goes down; the best w seen. Stops where no step gains anything."""
    here = risk(w)
    for _ in range(steps):
        for gradient, curvature in here.sides:
            step = -np.linalg.solve(curvature, gradient)
            step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
            for _ in range(HALVINGS):
                there = risk(w + step)
                if there.value < here.value - 1e-6:
                    break
                step = step / 2
            else:
                continue
            break
        else:
            return w
        w, here = w + step, there
    return w


def risk_of(rows: DataFrame, scale, mean_pos: np.ndarray, n: float, n_pos: float, prior: float):
    """The clamped risk as a function of w; each call is one pass over rows."""

    def at(w: np.ndarray) -> Risk:
        def pass_(col: pa.Array, pos: np.ndarray) -> np.ndarray:
            x = _matrix(col, scale)
            g = x @ w
            p, bad = _sigmoid(g), np.logaddexp(0, g)
            weight, good = p * (1 - p), x[pos]
            h, h_pos = (x * weight[:, None]).T @ x, (good * weight[pos][:, None]).T @ good
            return np.concatenate(([bad.sum(), np.logaddexp(0, -g[pos]).sum(), bad[pos].sum()], x.T @ p, good.T @ p[pos], h.ravel(), h_pos.ravel()))

        return Risk(_sums(rows, pass_), n, n_pos, prior, mean_pos, w)

    return at


def fit(rows: DataFrame) -> Model | None:
    """rows: x and positive (trusted), read several times. None if nothing is positive."""

    def moments(col: pa.Array, pos: np.ndarray) -> np.ndarray:
        x = _matrix(col, None)
        return np.concatenate(([len(x), pos.sum()], x.sum(axis=0), (x * x).sum(axis=0)))

    got = _sums(rows, moments)
    if not len(got) or not got[1]:
        return None
    n, n_pos = got[0], got[1]
    mean = got[2 : 1 + D] / n
    scale = (mean, np.sqrt(np.maximum(got[1 + D :] / n - mean**2, 1e-8)))
    mean_pos = _sums(rows, lambda col, pos: _matrix(col, scale)[pos].sum(axis=0)) / n_pos
    w = minimise(risk_of(rows, scale, mean_pos, n, n_pos, 0.5), np.zeros(D))

    def histogram(col: pa.Array, pos: np.ndarray) -> np.ndarray:
        at = np.minimum((_sigmoid(_matrix(col, scale) @ w) * BINS).astype(int), BINS - 1)
        return np.concatenate((np.bincount(at, minlength=BINS), np.bincount(at[pos], minlength=BINS))).astype(float)

    got = _sums(rows, histogram)
    unl, pos = np.cumsum(got[:BINS][::-1]) / n, np.cumsum(got[BINS:][::-1]) / n_pos
    prior = float(np.clip((unl / np.maximum(pos, 1e-9))[pos >= LEAST_MASS].min(), 0.01, 0.99))
    return Model(*scale, minimise(risk_of(rows, scale, mean_pos, n, n_pos, prior), w), prior)


def score(rows: DataFrame, model: Model | None) -> DataFrame:
    """rows with a column score; x and positive are dropped."""
    columns = [c for c in rows.columns if c not in ("x", "positive")]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                got = np.full(b.num_rows, 0.5) if model is None else model.score(b.column(len(columns)))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(got)], names=[*columns, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*columns).schema.fields)
    return rows.select(*columns, "x").mapInArrow(run, f"{fields}, score double")
