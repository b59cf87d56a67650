"""Periodic runs against a version that tries every stretch."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from quire.llm import queries, runs


def plain_runs(s):
    """Every maximal stretch for every period, the smallest period of a stretch only."""
    n, found = len(s), {}
    for q in range(1, n // 4 + 1):
        at = 0
        while at + q < n:
            if s[at] != s[at + q]:
                at += 1
                continue
            end = at
            while end + q < n and s[end] == s[end + q]:
                end += 1
            if end + q - at >= max(6, 4 * q):
                found.setdefault((at, end + q - at), q)
            at = end
    return sorted((a, length, q) for (a, length), q in found.items())


def plain_row(doc_id, text, tail=True):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if tail and n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {i for a, length, q in found for i in range(a + q, a + length)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    listed = "".join(f"{a},{length},{q}\n" for a, length, q in sorted(found, key=lambda r: (r[0], r[2])))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(listed.encode()), sha(kept))


@pytest.mark.parametrize("letters", [1, 2, 3])
def test_random_sequences(letters):
    rng = random.Random(letters)
    for _ in range(400):
        s = [rng.randrange(letters) for _ in range(rng.randrange(60))]
        if rng.random() < 0.5:
            s = s[:10] + s[:7] * rng.randrange(8) + s
        assert [tuple(r) for r in runs.find_runs(np.array(s, np.int64)).tolist()] == plain_runs(s)


def test_extension_and_range_minima():
    rng = np.random.default_rng(3)
    for n in (1, 2, 15, 16, 17, 100, 700):
        a = rng.integers(0, 50, n)
        lo = rng.integers(0, n, 300)
        hi = np.minimum(n - 1, lo + rng.integers(0, n, 300))
        assert runs.RangeMin(a)(lo, hi).tolist() == [int(a[x : y + 1].min()) for x, y in zip(lo, hi)]
        if n > 1:
            s = rng.integers(0, 2, n)
            ext = runs.Extension(s)
            i = rng.integers(0, n - 1, 300)
            j = i + 1 + rng.integers(0, n - i)
            want = [next((k for k in range(n) if y + k >= n or s[x + k] != s[y + k]), n) for x, y in zip(i.tolist(), j.tolist())]
            assert ext(i, j).tolist() == want


def test_grid_in_parts(monkeypatch):
    s = np.array([0, 1, 2] * 60 + [3] + [4, 4] * 30 + [5, 6, 7, 8] * 9, np.int64)
    want = runs.find_runs(s).tolist()
    monkeypatch.setattr(runs, "GRID", 7)
    assert runs.find_runs(s).tolist() == want == [list(r) for r in plain_runs(s.tolist())]


def test_given_documents_match_the_plain_version(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    short = [r for r in rows if len(r.text.split()) < 3000]
    got = {r.doc_id: tuple(r) for r in queries.op13_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(rows) and len(short) > 0.9 * len(rows)
    assert sum(1 for r in got.values() if r[1]) > 10
    for r in short:
        assert got[r.doc_id] == plain_row(r.doc_id, r.text)


def test_odd_input(spark):
    texts = [None, "", " \n\t", "one", "a " * 5, "a " * 6, "a b " * 4, "A a " * 4, "x\xa0x x\xa0x " * 9, "la la la la la la la di da " * 5, "long " * 300_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "one"), (3, "one"), (None, "a b c " * 5)]
    d = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, start int, runs_sha256 string")
    got = runs.periodic_runs(d).collect()
    want = [plain_row(i, t, tail=False) for i, t in rows if t is None or len(t) < 10**6]
    assert sorted(map(str, (tuple(r) for r in got if r.length != 300_000))) == sorted(map(str, want))
    assert [r[1:6] for r in got if r.length == 300_000] == [(1, 0, 300_000, 1, 300_000_000)]
    assert runs.periodic_runs(d.limit(0)).count() == 0
    tail = {r.doc_id: r for r in runs.periodic_runs(d.where("doc_id IS NOT NULL AND doc_id < 10"), tail=True).collect()}
    assert all(tuple(tail[i]) == plain_row(i, texts[i]) for i in range(10))
