"""Vector codes against a plain version in Python numbers."""

import hashlib
import math
import random

import numpy as np

from quire.llm import queries, vector_codes


def plain(rows, rounds=6, parts=8):
    """(vec_id, vector, label) rows, all usable and of one length, to the operator's rows."""
    rows = sorted(((i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows), key=lambda r: (r[0] is None, r[0], r[1]))
    w = len(rows[0][1]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    books = [[cut(v, p) for _, v, _ in rows[:16]] for p in range(parts)]
    near = lambda p, v: min(range(len(books[p])), key=lambda e: (gap(books[p][e], cut(v, p)), e))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            at = {}
            for _, v, _ in rows:
                at.setdefault(near(p, v), []).append(cut(v, p))
            new.append([[sum(c) // len(at[e]) for c in zip(*at[e])] if e in at else old for e, old in enumerate(books[p])])
        books = new
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, total = [], {}
    for i, v, label in rows:
        code = [near(p, v) for p in range(parts)]
        error = sum(gap(books[p][c], cut(v, p)) for p, c in enumerate(code))
        total[label] = total.get(label, 0) + error
        out.append((i, "".join(f"{c:02x}" for c in code), error, label))
    return sorted(((i, c, e, total[label], sha) for i, c, e, label in out), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_given_vectors_match_the_plain_version(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    out = queries.op12_va_file_codes(spark, "/root/testdata/sf0.001")
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert got(out) == plain([(r.vec_id, r.embedding, r.label) for r in rows])


def test_bounds_hold_and_spare_most_entries():
    rng = np.random.default_rng(1)
    for dim, spread in ((8, 3000), (1, 5), (3, 1), (8, 200_000)):
        entries, asked = rng.integers(-spread, spread + 1, (16, dim)), rng.integers(-2 * spread, 2 * spread + 1, (500, dim))
        f = vector_codes.CellFilter(entries)
        lower, upper = f.bounds(asked)
        exact = ((asked[:, None] - entries) ** 2).sum(axis=2)
        assert (lower <= exact).all() and (exact <= upper).all()
        best, gap = f.nearest(asked)
        assert (best == exact.argmin(axis=1)).all() and (gap == exact.min(axis=1)).all()
        if spread > 100:
            assert (lower <= upper.min(axis=1, keepdims=True)).mean() < 0.5


def test_odd_input(spark):
    rng = random.Random(6)
    v = lambda: [rng.choice([-1.5, -0.25, 0.0, 0.1, 0.7]) for _ in range(16)]
    rows = [(i, v(), rng.choice(["a", "b", None])) for i in range(40, 5, -1)]
    rows += [rows[0], rows[0], (7, rows[3][1], None), (None, v(), "a"), (None, v(), None)]  # repeated rows and ids, ties, null ids
    odd = [(1, None, "a"), (2, [], "a"), (3, [float("nan")] * 16, "b"), (4, [1.0, None] * 8, None), (5, [float("inf")] * 16, "a"), (50, [0.5] * 8, "a"), (51, [0.5] * 17, "b")]
    kind = "vec_id long, embedding array<double>, label string, part int, code int, n string"
    d = spark.createDataFrame([(*r, 1, 2, "x") for r in rows + odd], kind)
    assert got(vector_codes.compress(d)) == plain(rows)
    assert got(vector_codes.compress(d.where("vec_id IN (20, 21)"))) == plain([r for r in rows if r[0] in (20, 21)])
    assert vector_codes.compress(d.where("vec_id < 5")).count() == 0 and vector_codes.compress(d.limit(0)).count() == 0


def test_equal_vectors(spark):
    d = spark.createDataFrame([(i, [0.25] * 8, None) for i in range(30)], "vec_id long, embedding array<float>, label int")
    assert {(r.code, r.error, r.label_error) for r in vector_codes.compress(d).collect()} == {("00" * 8, 0, 0)}


def test_a_round_is_one_pass_however_many_partitions(spark):
    rng = random.Random(8)
    rows = [(i, [rng.random() for _ in range(8)], None) for i in range(60)]
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {c: spark.conf.get(c) for c in conf}
    for c, v in conf.items():
        spark.conf.set(c, v)
    spark.sparkContext.setJobGroup("codes", "")
    try:
        assert got(vector_codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))) == plain(rows)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("codes"))
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs < 40
