"""SimHash fingerprints and BK-tree links against plain versions."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quire.llm import queries, shared, simhash


def plain_fingerprint(text):
    words = (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))).split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(marks, radius):
    """Smallest id reachable, by comparing all pairs of (id, mark)."""
    comp = {i: i for i, _ in marks}

    def top(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for x, (i, a) in enumerate(marks):
        for j, b in marks[:x]:
            if (a ^ b).bit_count() <= radius:
                p, q = sorted((top(i), top(j)))
                comp[q] = p
    return {i: top(i) for i in comp}


TEXTS = [None, "", " \t\r\n", "One", "one two", "One TWO three", "a b c d", "ÄÖ ä ö", "x " * 9, "漢字　一つ two\vthree\ffour", "word\xa0glued no split"]


@pytest.mark.parametrize("text", TEXTS + ["the quick brown fox jumps over it " * 50 + "end"])
def test_fingerprint_matches_the_definition(text):
    assert simhash.fingerprint(text.encode() if text is not None else None) == plain_fingerprint(text)


def test_words_in_parts_cut_no_word():
    rng = random.Random(1)
    for size in (1, 2, 3, 7, 50):
        text = "".join(rng.choice("ab \n") for _ in range(400)).encode()
        assert sum(shared.words_in_parts(text, size), []) == text.split()
    assert list(shared.words_in_parts(b"")) == []


def test_fingerprint_is_spark_xxhash64_of_a_single_shingle(spark):
    h = spark.sql("select xxhash64('one two three') as h").first().h
    assert simhash.fingerprint(b"one Two three") == h % 2**64


def clusters(rng, n, spread):
    out = set()
    while len(out) < n:
        centre = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 12)):
            out.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(spread))))
    return np.array(sorted(out), np.uint64)


def test_trees_find_all_pairs_of_a_shard():
    rng = random.Random(2)
    codes = np.concatenate([clusters(rng, 300, 6)[:300], clusters(rng, 1, 2)[:1], clusters(rng, 200, 4)])
    shard = np.repeat([5, 7, 9], [300, 1, len(codes) - 301])
    for radius in (0, 1, 2, 3):
        a, b = simhash.BKTrees(codes, shard).within(radius)
        got = {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist())}
        c = codes.tolist()
        want = {(i, j) for i in range(len(c)) for j in range(i + 1, len(c)) if shard[i] == shard[j] and (c[i] ^ c[j]).bit_count() <= radius}
        assert got == want and len(got) == len(a)


def test_splits_leave_small_shards_and_keep_every_pair():
    splits = simhash.bit_splits(2)
    assert len(splits) < 400
    finer = {}
    for mask, f, last in splits:
        finer.setdefault(mask % 2**64, []).append((f % 2**64, last))
    rng = random.Random(3)
    for _ in range(200):
        away = sum(1 << b for b in rng.sample(range(64), 2))
        meet = [(0, False)]  # the masks on which the pair agrees, step by step
        while not all(last for _, last in meet):
            assert meet
            meet = [(f, end) for m, last in meet for f, end in ([(m, True)] if last else finer[m]) if not f & away]
        assert meet and all(64 - m.bit_count() <= simhash.ROOM for m, _ in meet)


@pytest.mark.parametrize("dense", [False, True])
def test_links_join_what_all_pairs_join(spark, monkeypatch, dense):
    """Also where shards hold so many fingerprints that they are split, to the last bits."""
    monkeypatch.setattr(simhash, "SHARD", 4)
    rng = random.Random(4)
    if dense:
        base = rng.getrandbits(64)
        codes = sorted({base ^ rng.getrandbits(9) << 20 ^ (rng.getrandbits(1) << 60) for _ in range(250)})
    else:
        codes = clusters(rng, 400, 5).tolist()
    marks = spark.createDataFrame([(c - 2**64 if c >> 63 else c,) for c in codes], "mark long")
    links = simhash.tree_links(spark, shared.Scratch(spark, "t"), marks, 2).collect()
    low = simhash.stars(len(codes), *(np.array([codes.index(r[k] % 2**64) for r in links], np.int64) for k in (0, 1)))
    want = plain_components(list(enumerate(codes)), 2)
    assert low.tolist() == [want[i] for i in range(len(codes))]


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in queries.op11_simhash_bk_tree(spark, "/root/testdata/sf0.001").collect()}
    marks = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.orderBy("doc_id").collect()]
    want = plain_components(marks, 2)
    assert len(got) == len(marks) and len(set(want.values())) < len(marks)
    for i, mark in marks:
        assert got[i].fingerprint == f"{mark:016x}" and got[i].component_id == want[i] and got[i].kept == (want[i] == i)


def test_odd_input(spark):
    long = "many words of one very long text " * 40_000
    rows = [(5, "a b c d e"), (3, "A B c D e"), (3, "A B c D e"), (9, None), (8, ""), (7, " \n"), (None, "a b c d e"), (None, "nobody has this text"), (1, long), (2, long + "more")]
    d = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], "doc_id long, text string, mark int, hash string, component_id double")
    got = simhash.near_copies(d).collect()
    assert len(got) == len(rows)
    at = {}
    for r in got:
        at.setdefault(r.doc_id, []).append(r)
    assert [r.component_id for i in (5, 3) for r in at[i]] == [3, 3, 3] and [r.kept for r in at[3]] == [True, True] and not at[5][0].kept
    assert all(at[i][0].component_id == 7 and at[i][0].fingerprint == "0" * 16 for i in (7, 8, 9))
    assert sorted((r.component_id or 0, r.kept) for r in at[None]) == [(0, True), (3, True)]
    assert at[1][0].component_id == at[2][0].component_id == 1
    assert simhash.near_copies(d.limit(0)).count() == 0
    alone = simhash.near_copies(d.where(F.col("doc_id") == 5)).collect()
    assert len(alone) == 1 and alone[0].component_id == 5
