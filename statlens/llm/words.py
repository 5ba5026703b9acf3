"""Words and word n-grams of many texts at once, as 64-bit hashes.

A word is a run of bytes other than space and the bytes 9 to 13; A-Z are lower-cased, nothing else
changes. All of it works on one concatenated byte buffer with numpy, since a Python loop over words
would cost most of the run.
"""

from __future__ import annotations

import functools

import numpy as np

_M = np.uint64(0x9E3779B97F4A7C15 | 1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_PLAIN = _FOLD.copy()
_PLAIN[[c for c in range(33, 127) if not chr(c).isalnum()]] = 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    for shift, k in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(k)
    x ^= x >> np.uint64(31)
    return x


#: Bytes whose prefix sums are held at a time.
CHUNK = 1 << 20


@functools.lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of _M and of its inverse modulo 2**64."""
    inverse = pow(int(_M), -1, 1 << 64)
    up, down = np.full(CHUNK, _M, np.uint64), np.full(CHUNK, np.uint64(inverse), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def span_sums(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each span of values, ascending and without overlap: the sum of (value + 1) * _M**place modulo 2**64, places counted within the span.

    Prefix sums are taken of CHUNK values at a time, so memory doesn't grow with the longest text; a longer span is added up in parts.
    """
    up, down = _powers()
    out, one = np.zeros(len(start), np.uint64), np.uint64(1)
    i = 0
    while i < len(start):
        j = int(np.searchsorted(end, start[i] + CHUNK - 1, "right"))
        if j <= i:
            total = 0
            for k, s in enumerate(range(int(start[i]), int(end[i]), CHUNK)):
                part = values[s : min(s + CHUNK, int(end[i]))].astype(np.uint64) + one
                total += int((part * up[: len(part)]).sum(dtype=np.uint64)) * pow(int(_M), k * CHUNK, 1 << 64)
            out[i] = np.uint64(total % (1 << 64))
            i += 1
            continue
        lo, hi = start[i], end[j - 1]
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((values[lo:hi].astype(np.uint64) + one) * up[: hi - lo], dtype=np.uint64, out=total[1:])
        out[i:j] = (total[end[i:j] - lo] - total[start[i:j] - lo]) * down[start[i:j] - lo]
        i = j
    return out


class Words:
    """The words of texts given as UTF-8 bytes.

    start, end: byte places of each word in buf (the texts joined by a space); doc: its text's number;
    first: for each text the number of its first word, with one more at the end; hash: of each word.
    """

    def __init__(self, texts: list[bytes], plain: bool = False) -> None:
        """plain: ASCII punctuation and signs count as spaces."""
        self.buf = (_PLAIN if plain else _FOLD)[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
        space = _SPACE[self.buf]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space))))
        self.start, self.end = edge[::2], edge[1::2]
        self.at = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts]))).astype(np.int64)
        self.first = np.searchsorted(self.start, self.at)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.count)
        self.hash = mix(span_sums(self.buf, self.start, self.end) + (self.end - self.start).astype(np.uint64))


_ODD = np.array([0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165], np.uint64) | np.uint64(1)


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of each window of n word hashes; windows may cross texts, the caller drops those."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out += hashes[k : len(hashes) - n + 1 + k] * _ODD[k]
    return mix(out)


def shingle_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-word shingles of each text, ascending: values, and offsets by text.

    A text of fewer than n words has its whole sequence as the one shingle; one without words has none.
    """
    grams = ngrams(words.hash, n)
    docs = len(words.count)
    whole = np.flatnonzero(words.count >= n)
    lens = words.count[whole] - n + 1
    take = np.repeat(words.first[whole] - np.concatenate(([0], np.cumsum(lens)[:-1])), lens) + np.arange(lens.sum())
    value, owner = grams[take] if len(take) else np.zeros(0, np.uint64), np.repeat(whole, lens)
    short = np.flatnonzero((words.count > 0) & (words.count < n))
    if len(short):
        one = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            has = words.count[short] > k
            one[has] += words.hash[words.first[short[has]] + k] * _ODD[k]
        value, owner = np.concatenate((value, mix(one + words.count[short].astype(np.uint64)))), np.concatenate((owner, short))
    if len(short):
        order = np.argsort(owner, kind="stable")
        value, owner = value[order], owner[order]
    bound = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=docs)))).tolist()
    for i, j in zip(bound, bound[1:]):
        value[i:j].sort()
    if len(value):
        new = np.concatenate(([True], (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])))
        value, owner = value[new], owner[new]
    return value, np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=docs)))).astype(np.int64)
