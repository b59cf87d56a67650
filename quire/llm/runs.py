"""Runs: stretches of words that repeat with a period, and texts without the repeats (operator 13).

Runs are found on the harmonic grid: for each period p, places x and x + p at multiples of p are compared by
the longest common extension (LCE) of the words from there on, and of the words before. The forward LCE of
two places is the minimum over a range of the LCP array of the text's suffix array, the backward one the same
on the reversed text. The two together give the whole stretch of period p around x.

A run that counts spans four periods or more, so its places x with an equal word at x + p span three; every
second multiple of p, x = 2jp, suffices to meet each run, with at least p such places from x on. A place whose
word (or next word, for p > 1) differs has no extension and is not asked further, and a text with no such
place needs no suffix array.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import slices

LEAST, TIMES = 6, 4  # a run's least length in words, and in periods
GRID = 1 << 20  # grid places that are looked at together


class RangeMin:
    """Minima of ranges of an array: a sparse table over blocks, and running minima inside them."""

    BLOCK = 16

    def __init__(self, a: np.ndarray):
        pad = -len(a) % self.BLOCK
        rows = np.append(a, np.full(pad, np.iinfo(a.dtype).max, a.dtype)).reshape(-1, self.BLOCK)
        self.a, self.head = rows.ravel(), np.minimum.accumulate(rows, axis=1).ravel()
        self.tail = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        level = [rows.min(axis=1)]
        while 2 ** len(level) <= len(rows):
            k, top = 2 ** (len(level) - 1), level[-1]
            level.append(np.append(np.minimum(top[:-k], top[k:]), top[len(top) - k :]))
        self.level = np.stack(level)

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minima from ``lo`` to ``hi``, both included."""
        first, last = lo // self.BLOCK + 1, hi // self.BLOCK  # whole blocks between: first to last - 1
        out = np.minimum(self.tail[lo], self.head[hi])
        between = last - first
        k = np.frexp(np.maximum(between, 1))[1] - 1  # floor(log2)
        some = between > 0
        out[some] = np.minimum(out[some], np.minimum(self.level[k[some], first[some]], self.level[k[some], (last - (1 << k))[some]]))
        inside = between < 0
        if inside.any():
            x, y = lo[inside], hi[inside]
            out[inside] = self.a[np.minimum(x[:, None] + np.arange(self.BLOCK), y[:, None])].min(axis=1)
        return out


class Extension:
    """Longest common extensions of the suffixes of a sequence: suffix array by doubling, LCP array, range minima."""

    def __init__(self, s: np.ndarray):
        n = len(s)
        self.n, step, ranks = n, 1, []
        new = np.unique(s, return_inverse=True)[1].astype(np.int64)
        while True:
            ranks.append(new.astype(np.int32))
            key = new * (n + 1)
            key[: max(0, n - step)] += new[step:] + 1
            order = np.argsort(key, kind="stable")
            new = np.empty(n, np.int64)
            new[order] = np.cumsum(np.append(0, np.diff(key[order]) != 0))
            step *= 2
            if new[order[-1]] == n - 1:
                break
        self.rank = new
        a, b = order[:-1].copy(), order[1:].copy()
        lcp = np.zeros(n - 1, np.int64)
        for k in range(len(ranks) - 1, -1, -1):  # equal ranks of doubling k: the next 2**k symbols agree
            rank = np.append(ranks[k], -1)
            more = (rank[a] == rank[b]) * (1 << k)
            a, b, lcp = a + more, b + more, lcp + more
        self.least = RangeMin(np.append(lcp, 0))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at ``i`` < ``j``; 0 at the end of the sequence."""
        x, y = self.rank[np.minimum(i, self.n - 1)], self.rank[np.minimum(j, self.n - 1)]
        out = np.zeros(len(i), np.int64)
        real = (i < self.n) & (j < self.n)
        x, y = x[real], y[real]
        out[real] = self.least(np.minimum(x, y), np.maximum(x, y) - 1)
        return out


def _grid(s: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places x = 2jp and periods p whose words agree at x and x + p, and behind them if p > 1; in parts."""
    n, p = len(s), 1
    padded = np.append(s, -1)
    while TIMES * p <= n:
        ps = np.arange(p, min(n // TIMES, p + max(1, GRID * 2 * p // n)) + 1)
        many = -(-(n - ps) // (2 * ps))
        period = np.repeat(ps, many)
        x = (np.arange(len(period)) - np.repeat(np.cumsum(many) - many, many)) * 2 * period
        y = x + period
        keep = np.flatnonzero(s[x] == s[y])
        x, y, period = x[keep], y[keep], period[keep]
        keep = (period == 1) | (padded[x + 1] == padded[y + 1])
        yield x[keep], period[keep]
        p = int(ps[-1]) + 1


def find_runs(s: np.ndarray) -> np.ndarray:
    """All runs of a sequence of numbers (not negative) as rows (start, length, period), by start and then period."""
    n, found, forward = len(s), np.empty((0, 3), np.int64), None
    for x, p in _grid(s):
        if not len(x):
            continue
        if forward is None:
            forward, backward = Extension(s), Extension(s[::-1])
        for at in range(0, len(x), GRID):
            i, q = x[at : at + GRID], p[at : at + GRID]
            before = backward(n - i - q, n - i)
            rows = np.stack([i - before, before + forward(i, i + q) + q, q], axis=1)
            found = np.concatenate([found, rows[rows[:, 1] >= np.maximum(LEAST, TIMES * q)]])
            # a stretch is met with multiples of its period too; the smallest is the period
            found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
            found = found[np.append(True, (np.diff(found[:, :2], axis=0) != 0).any(axis=1))[: len(found)]]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def repeated_tail(n: int, doc_id: int | None) -> np.ndarray:
    """For each of ``n`` words the word that stands there: every tenth document's tail repeats with a period."""
    at = np.arange(n)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return at
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.where(at < a, at, a + (at - a) % p)


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def describe(words: list[bytes], place: np.ndarray) -> tuple:
    """The row of a text whose word i is ``words[place[i]]``."""
    names: dict[bytes, int] = {}
    s = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))[place]
    runs = find_runs(s)
    best = (None,) * 4
    kept = place
    if len(runs):
        start, length, period = runs.T
        ratio = length / period
        top = runs[ratio >= ratio.max() * (1 - 1e-9)].tolist()
        one = max(top, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
        best = (*one, 1000 * one[1] // one[2])
        inside = np.zeros(len(s) + 1, np.int64)
        np.add.at(inside, start + period, 1)
        np.add.at(inside, start + length, -1)
        kept = place[np.cumsum(inside)[:-1] == 0]
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs.tolist())
    return len(runs), *best, _sha(listed.encode()), _sha(b" ".join([words[i] for i in kept.tolist()]))


NAMES = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def _rows(tail: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (text.as_py() or b"").split()
                rows.append(describe(words, repeated_tail(len(words), doc_id) if tail else np.arange(len(words))))
            cols = zip(*rows, strict=True) if rows else [()] * len(NAMES)
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", *NAMES])

    return run


def periodic_runs(docs: DataFrame, tail: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs of every text: ``doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256``.

    Words are split at ASCII white space and numbered from 0. A run is a stretch of words with smallest period
    q, of at least 6 words and 4 periods, that no neighbouring word extends. The row names the run with the
    greatest length / period (ties: smallest start, then period; nulls without a run), the hash of all runs'
    ``start,length,period`` lines, and the hash of the text without what a run repeats after its first period.
    ``tail`` first makes the tails of a tenth of the documents repeat, by their ids.

    Null, empty and blank texts have no words. A null id's text is taken as it is. Every row is judged by
    itself, so repeated rows give repeated rows; other columns, whatever their names, are not read. Texts are
    read whole, one at a time; a text needs memory for its words, and 4 bytes a word for each doubling of its
    longest repeat. There is no shuffle.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    longs = ", ".join(f"{n} long" for n in NAMES[:5])
    return base.mapInArrow(_rows(tail), f"doc_id long, {longs}, runs_sha256 string, collapsed_sha256 string")
