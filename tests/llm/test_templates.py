"""Texts that share a template and are not alike: their pairs are not compared, and links among them are found."""

import random

from pyspark.sql import functions as F

from quire.llm import line_dedup, near_dedup, shared


def compared(spark, scratch, meeting, sets, unpack, percent=80, few=64):
    """How many pairs the second round looks at when nothing is linked yet."""
    none = spark.createDataFrame([], "node long, component long")
    narrow, least = shared.narrowed(scratch, meeting, none, sets, unpack, percent, few)
    pairs, blocks = shared.across(narrow, none, few, 128, 256, least)
    sides = blocks.groupBy("band", "block", "piece").pivot("side", [0, 1]).count()
    return pairs.count() + (sides.agg(F.sum(F.col("0") * F.col("1"))).first()[0] or 0)


def log_lines(n, rng):
    return [f"2024-05-01 12:00:00 worker finished request id={rng.randrange(10**19, 10**20)} with status 200 in time" for _ in range(n)]


def test_template_lines_are_not_compared_with_each_other(spark):
    rng = random.Random(1)
    lines = log_lines(20_000, rng)
    keys = [line_dedup.line_id(x) for x in lines]
    bands = line_dedup.band_hashes(lines)
    rows = spark.createDataFrame([(int(b), k) for k, bs in zip(keys, bands) for b in bs], "band long, id long")
    scratch = shared.Scratch(spark, "t")
    meeting = scratch.write(shared.met(rows), "met")
    sets = spark.createDataFrame(list(zip(keys, lines)), "id long, line string")
    n = compared(spark, scratch, meeting, sets, lambda b: line_dedup.shingle_sets(b.column(1).to_pylist()))
    assert meeting.groupBy("band").count().agg(F.max("count")).first()[0] > 1000  # they do meet in bands
    assert n < 50 * len(lines)  # of 20,000 a line; chance meetings: five digits are few


def test_links_among_template_lines_are_found(spark):
    rng = random.Random(2)
    lines = log_lines(1000, rng)
    near = [x.replace("status 200", f"status {rng.randrange(201, 599)}") for x in lines[:300]]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines + near)], "doc_id long, text string")
    got = {r.doc_id: r.lines_kept for r in line_dedup.dedup_lines(docs).collect()}
    sets = [set(s.tolist()) for s in line_dedup.shingle_sets(lines[:300] + near)]
    alike = [100 * len(a & b) >= 80 * len(a | b) for a, b in zip(sets[:300], sets[300:])]
    assert sum(alike) > 250
    assert all(got[1000 + i] == (not alike[i]) for i in range(300)) and all(got[i] == 1 for i in range(1000))


def test_documents_with_one_head(spark):
    rng = random.Random(3)
    head = " ".join(f"head{i}" for i in range(150))
    texts = [head + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(75)) for _ in range(1500)]
    near = [t + " a few more words" for t in texts[:100]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + near)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()}
    assert all(got[i] == i for i in range(1500)) and all(got[1500 + i] == i for i in range(100))
    sets = [near_dedup.word_shingles(t, 5) for t in texts]
    keys = [near_dedup.set_key(s) for s in sets]
    bands = [[int(near_dedup.minima(s)[4 * j : 4 * j + 4].astype("u8").dot([1, 3, 5, 7])) * 24 + j for j in range(24)] for s in sets]
    rows = spark.createDataFrame([(b, k) for k, bs in zip(keys, bands) for b in bs], "band long, id long")
    scratch = shared.Scratch(spark, "t")
    meeting = scratch.write(shared.met(rows), "met")
    table = spark.createDataFrame([(k, s.tobytes()) for k, s in zip(keys, sets)], "id long, shingles binary")
    assert compared(spark, scratch, meeting, table, near_dedup._unpacked) < 20 * len(texts)


def test_crowded_bands_are_exchanged_inside_themselves(spark):
    rng = random.Random(4)
    lines = log_lines(20_000, rng)
    near = [x.replace("status 200", "status 404") for x in lines[:200]]
    sets = line_dedup.shingle_sets(lines[:200] + near)
    linked = [(a, b) for a, b, x, y in zip(lines, near, sets[:200], sets[200:]) if line_dedup.alike(x, y, 80)]
    keys = {x: line_dedup.line_id(x) for x in lines + near}
    rows = [(int(b), k) for k, bs in zip(keys.values(), line_dedup.band_hashes(list(keys))) for b in bs]
    scratch, none = shared.Scratch(spark, "t"), spark.createDataFrame([], "node long, component long")
    meeting = scratch.write(shared.met(spark.createDataFrame(rows, "band long, id long")), "met")
    table = spark.createDataFrame([(k, x) for x, k in keys.items()], "id long, line string")
    plain, rare = shared.exchanged(scratch, meeting, none, table, lambda b: line_dedup.shingle_sets(b.column(1).to_pylist()), 80, 256)
    assert plain.groupBy("band").count().agg(F.max("count")).first()[0] <= 257  # nothing is linked yet
    pairs, blocks = shared.across(rare, none, 64, 128, 256, 2)
    sides = blocks.groupBy("band", "block", "piece").pivot("side", [0, 1]).count()
    assert pairs.count() + (sides.agg(F.sum(F.col("0") * F.col("1"))).first()[0] or 0) < 20 * len(lines)
    # pairs that meet in a crowded band and are alike still meet, and no others do
    banded = dict()
    for b, k in rows:
        banded.setdefault(k, set()).add(b)
    crowded = {r.band for r in meeting.where("nth = 257").select("band").collect()}
    now = {frozenset(r) for r in pairs.collect()}
    for a, b in linked:
        if banded[keys[a]] & banded[keys[b]] & crowded:
            assert frozenset((keys[a], keys[b])) in now
    assert all(banded[a] & banded[b] & crowded for a, b in now)


def test_no_band_is_crowded(spark):
    new, none = lambda: shared.Scratch(spark, "t"), spark.createDataFrame([], "node long, component long")
    meeting = shared.met(spark.createDataFrame([(b, i) for b in range(3) for i in range(9)], "band long, id long"))
    sets = spark.createDataFrame([(i, f"line {i}") for i in range(9)], "id long, line string")
    unpack = lambda b: line_dedup.shingle_sets(b.column(1).to_pylist())
    plain, rare = shared.exchanged(new(), meeting, none, sets, unpack, 80, 8)
    assert rare is None and plain.count() == 27
    plain, rare = shared.exchanged(new(), meeting, none, sets, unpack, 80, 7)
    assert plain.isEmpty() and rare is not None
    linked = spark.createDataFrame([(i, 0) for i in range(1, 9)], "node long, component long")
    assert shared.exchanged(new(), meeting, linked, sets, unpack, 80, 7)[1] is None


def test_common_counts(spark):
    rng = random.Random(5)
    lines = log_lines(40, rng) + ["abc", "", "x" * 9000, "".join(rng.choice("abcdefgh") for _ in range(30_000))]
    sets = line_dedup.shingle_sets(lines)
    got = line_dedup.common_counts(sets[:20], sets)
    assert got.tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets[:20]]
    got = line_dedup.common_counts(sets[40:], sets[38:])  # more than one part of columns
    assert got.tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in sets[38:]] for a in sets[40:]]
    assert line_dedup.common_counts([], sets).shape == (0, len(sets))


def test_members_of_bands_are_placed_once(spark, monkeypatch):
    """The second round reads which component an id is in; it does not join that anew for every form of its pairs."""
    plans, write = {}, shared.Scratch.write

    def seen(self, df, table, **options):
        plans[table] = df._jdf.queryExecution().optimizedPlan().toString()
        return write(self, df, table, **options)

    monkeypatch.setattr(shared.Scratch, "write", seen)
    rng = random.Random(9)
    head = " ".join(f"head{i}" for i in range(60))
    texts = [f"{head} " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(25)) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for run in (lambda: near_dedup.near_duplicates(docs), lambda: line_dedup.dedup_lines(docs)):
        plans.clear()
        run().count()
        assert {"wide", "across"} <= set(plans)
        assert not [t for t in ("several", "crowd", "links-2") if "LeftOuter" in plans.get(t, "")]


def test_components_with_and_without_hubs(spark, monkeypatch):
    """A node that many know, next to small components; only the rows of such a node are dealt over eight keys."""
    plans, write = [], shared.Scratch.write

    def seen(self, df, table, **options):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(self, df, table, **options)

    monkeypatch.setattr(shared.Scratch, "write", seen)
    for hub in (shared.HUB // 2, 4 * shared.HUB):
        plans.clear()
        edges = [(0, i) for i in range(1, hub)] + [(hub - 1, 10_000)] + [(i + 1, i) for i in range(20_000, 20_040)] + [(7, 7), (None, 3)]
        got = shared.components(shared.Scratch(spark, "t"), spark.createDataFrame(edges, "a long, b long")).collect()
        want = {i: 0 for i in range(1, hub)} | {10_000: 0} | {i: 20_000 for i in range(20_001, 20_041)}
        assert {r.node: r.component for r in got} == want and len(got) == len(want)
        assert any("Generate" in p for p in plans) == (hub > shared.HUB)
