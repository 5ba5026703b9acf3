"""Language identification by multilingual mixture inference.

Each language has a distribution over character trigrams (hashed into a fixed number of buckets), counted over
all training documents. A text is a mixture of languages: expectation-maximisation over its words estimates
each language's share, where a word's likelihood in a language is the product of its trigrams'. Languages
are added in order of share as long as the penalised likelihood (each language costs PENALTY * log(words)) grows.

Defined cases: a null text, or one without a letter, is `und` with score 0; so is every text if no training document has a
language. Only rows with text and language train. Very long texts are read whole. Ties between languages go to the first by name.
Repeated rows count as often as they occur. Of other columns only one named `language` is touched: the result takes its place.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, batches

#: Trigram buckets; the model has so many numbers for each language, however large the corpus.
BUCKETS = 1 << 15
#: Languages a model can tell apart; more is an error, as the model is sent to every executor.
MAX_LANGUAGES = 500
SMOOTHING = 0.5
PENALTY = 2.0
#: Shares are estimated until none of a text changes by more than this; ROUNDS is a stop for texts that hardly move any more.
TOLERANCE, ROUNDS = 1e-4, 500
RANKING_ROUNDS = 3


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point of the first plane: itself in lower case if it is a letter, else 0."""
    out = np.zeros(1 << 16, np.uint32)
    for c in range(1 << 16):
        if chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram buckets of all words; where each word's trigrams begin; each word's text number."""
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    letters = _letters()
    c = letters[np.minimum(codes, 0xFFFF)]
    if (far := codes > 0xFFFF).any():
        c[far] = [x if chr(x).isalpha() else 0 for x in codes[far].tolist()]
    keep = np.flatnonzero((c != 0) | np.concatenate(([True], c[:-1] != 0)))
    c = np.concatenate(([0], c[keep], [0])).astype(np.uint64)
    mid = np.flatnonzero(c[1:-1]) + 1
    h = c[mid - 1] * np.uint64(0x9E3779B97F4A7C15) + c[mid] * np.uint64(0xC2B2AE3D27D4EB4F) + c[mid + 1] * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    gram = (h >> np.uint64(40)).astype(np.int64) % BUCKETS
    begin = np.flatnonzero(c[mid - 1] == 0)
    doc = np.searchsorted(at, keep[mid[begin] - 1], side="right") - 1 if len(begin) else np.zeros(0, np.int64)
    return gram, begin, doc


def count(docs: DataFrame, train: Column, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, bucket, n over the documents for which `train` holds."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches(it, 0):
            langs, texts = np.array(b.column(1).to_pylist(), object), b.column(0).to_pylist()
            for name in set(langs):
                gram, _, _ = words_of([texts[i] for i in np.flatnonzero(langs == name)])
                got = np.bincount(gram, minlength=BUCKETS)
                total[name] = total[name] + got if name in total else got
        for name, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "bucket", "n"])

    rows = docs.filter(train & F.col(text).isNotNull() & F.col(lang).isNotNull()).select(text, lang)
    return rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Languages in order of name, and log-likelihoods of trigram buckets: one row for each bucket."""

    def __init__(self, languages: list[str], log_p: np.ndarray) -> None:
        self.languages, self.log_p = languages, log_p

    @staticmethod
    def fit(counts: DataFrame) -> Model:
        """Collects counts: BUCKETS numbers for each of MAX_LANGUAGES languages at most."""
        languages = sorted(r[0] for r in counts.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
        if len(languages) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages")
        n = np.zeros((BUCKETS, len(languages)))
        got = counts.toPandas()
        n[got["bucket"].to_numpy(int), [languages.index(x) for x in got["lang"]]] = got["n"]
        n += SMOOTHING
        return Model(languages, np.log(n / n.sum(axis=0, keepdims=True)).astype(np.float32))

    def infer(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each text the languages' shares, 0 outside the chosen set, and the number of its words."""
        gram, begin, doc = words_of(texts)
        docs, k = len(texts), len(self.languages)
        shares, words = np.zeros((docs, k)), np.bincount(doc, minlength=docs)
        if not len(begin) or not k:
            return shares, words
        ll = np.add.reduceat(self.log_p[gram], begin, axis=0).astype(np.float64)
        has = np.flatnonzero(words)
        first = np.concatenate(([0], np.cumsum(words[has])[:-1]))
        best = ll.max(axis=1, keepdims=True)
        like, floor = np.exp(ll - best), np.add.reduceat(best[:, 0], first)
        alone = np.add.reduceat(ll, first, axis=0)
        top = alone.max(axis=1)
        cost = PENALTY * np.log(words[has] + 1.0)
        chosen, value = np.zeros((len(has), k)), top - cost
        chosen[np.arange(len(has)), alone.argmax(axis=1)] = 1.0
        # More than one language can only pay where the words' own best languages beat the best single one by the cost.
        some = np.flatnonzero((floor - top > cost) & (k > 1))
        if len(some):
            rows = np.concatenate([np.arange(first[i], first[i] + words[has[i]]) for i in some])
            at = np.concatenate(([0], np.cumsum(words[has[some]])[:-1]))
            of, part = np.repeat(np.arange(len(some)), words[has[some]]), like[rows]
            part = np.ascontiguousarray(part.T)
            full = _em(part, at, of, np.full((k, len(some)), 1.0 / k), RANKING_ROUNDS)
            order = np.argsort(-full, axis=0, kind="stable")
            for size in range(2, k + 1):
                # The next language has to hold a word's worth, and the set without it has to have been worth it.
                pays = np.take_along_axis(full, order[size - 1 : size], axis=0)[0] * words[has[some]] >= 1
                pays &= (size == 2) | ((chosen[some] > 0).sum(axis=1) == size - 1)
                if not pays.any():
                    break
                sub = np.flatnonzero(pays)
                take = pays[of]
                n = words[has[some[sub]]]
                start = np.zeros((k, len(sub)))
                np.put_along_axis(start, order[:size, sub], 1.0 / size, axis=0)
                sub_part, sub_at, sub_of = part[:, take], np.concatenate(([0], np.cumsum(n)[:-1])), np.repeat(np.arange(len(sub)), n)
                pi = _em(sub_part, sub_at, sub_of, start, ROUNDS)
                fit = np.add.reduceat(np.log(np.maximum(_mixed(sub_part, sub_of, pi)[1], 1e-300)), sub_at)
                gain = fit + floor[some[sub]] - size * cost[some[sub]]
                better = gain > value[some[sub]]
                chosen[some[sub[better]]], value[some[sub[better]]] = pi.T[better], gain[better]
        shares[has] = chosen
        return shares, words


def _mixed(like: np.ndarray, doc: np.ndarray, pi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's likelihood in each language times the language's share in its text, and their sums; languages lie in rows."""
    parts = np.take(pi, doc, axis=1)
    parts *= like
    return parts, parts.sum(axis=0)


def _em(like: np.ndarray, first: np.ndarray, doc: np.ndarray, pi: np.ndarray, rounds: int) -> np.ndarray:
    """The shares from pi on, after so many rounds or when they stand still; texts that do are set aside."""
    out, rest = pi.copy(), np.arange(pi.shape[1])
    n = np.diff(np.concatenate((first, [len(doc)])))
    for k in range(rounds):
        parts, total = _mixed(like, doc, pi)
        parts /= np.maximum(total, 1e-300)
        new = np.add.reduceat(parts, first, axis=1) / n
        moved, pi = np.abs(new - pi).max(axis=0) > TOLERANCE, new
        if not moved.any():
            break
        if k % 4 == 3 and np.count_nonzero(moved) < 0.8 * len(moved):
            out[:, rest[~moved]] = pi[:, ~moved]
            take, rest, pi, n = moved[doc], rest[moved], pi[:, moved], n[moved]
            like, doc = like[:, take], np.repeat(np.arange(len(n)), n)
            first = np.concatenate(([0], np.cumsum(n)[:-1]))
    out[:, rest] = pi
    return out


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with a struct `language`: lang_pred, score (that language's share) and languages (names and shares, largest first), in place of a column of that name."""
    docs = docs.drop("language")
    names = [*model.languages]
    columns = [c for c in docs.columns]
    place = columns.index(text)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, place, max(1 << 14, BATCH_BYTES * 8 // max(8, len(names)))):  # fewer texts at a time for more languages
            shares, words = model.infer([x or "" for x in b.column(place).to_pylist()])
            order = np.argsort(-shares, axis=1, kind="stable")
            out = []
            for i, n in enumerate(words.tolist()):
                if not n or not names:
                    out.append({"lang_pred": "und", "score": 0.0, "languages": []})
                    continue
                found = [{"lang": names[j], "share": float(shares[i, j])} for j in order[i] if shares[i, j] > 0]
                out.append({"lang_pred": found[0]["lang"], "score": min(1.0, found[0]["share"]), "languages": found})
            kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, kind)], names=[*columns, "language"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, language struct<lang_pred:string,score:double,languages:array<struct<lang:string,share:double>>>")
