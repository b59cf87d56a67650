"""Stitching of scrolling captures on small frames."""

import random

import pytest

from quire.operators import frames
from quire.sources import layouts


def table(spark, captures):
    rows = [(c, f, y, r) for c, fs in captures.items() for f, frame in fs.items() for y, r in enumerate(frame)]
    return spark.createDataFrame(rows, "capture_id long, frame long, py long, row string")


def image(df):
    out = {}
    for r in df.orderBy("capture_id", "py").collect():
        out.setdefault(r.capture_id, []).append((r.py, r.row))
    assert all([y for y, _ in rows] == list(range(len(rows))) for rows in out.values())  # no gap, no row twice
    return {c: "".join(r for _, r in rows) for c, rows in out.items()}


def cut(page, *spans):
    return {i: page[a:b] for i, (a, b) in enumerate(spans)}


def test_cases(spark):
    page = "abcdefghijklmnopqrstuvwxyz"
    got = image(frames.stitched(table(spark, {
        1: cut(page, (0, 10), (4, 14), (11, 22), (19, 26)),
        2: cut(page, (0, 10), (0, 10), (3, 13)),  # a frame twice
        3: {0: page[:6], 1: "UVWXYZ"},  # no overlap
        4: {7: page},  # one frame
        5: {0: "xyxyxyxy", 1: "xyxyxyxyz"},  # a repeated pattern: as much as agrees
        6: {0: "........a", 1: "....a....", 2: "a........"},  # empty rows
        7: {0: page[:12], 2: page[7:12], 5: page[9:18]},  # a short frame that adds nothing, numbers with gaps
        8: {0: "aaaaaaaa", 1: "aaaaaaaa"},
        9: {0: page[:10], 1: page[8:20]},  # fewer rows in common than asked for
    }), least=3))
    assert got[1] == page and got[2] == page[:13] and got[3] == page[:6] + "UVWXYZ" and got[4] == page
    assert got[5] == "xyxyxyxyz" and got[6] == "........a........" and got[8] == "aaaaaaaa" and got[9] == page[:10] + page[8:20]
    assert got[7] == page[:18]


def test_random_pages_come_back(spark):
    rng = random.Random(3)
    pages, captures = {}, {}
    for c in range(40):
        letters = "ab" if c % 2 else "abcdefghijklmnop"
        page = "".join(rng.choice(letters) for _ in range(120))
        spans, at = [(0, 30)], 0
        while spans[-1][1] < 120:
            at += rng.randrange(1, 18)
            spans.append((at, min(120, at + 30)))
        pages[c], captures[c] = page, cut(page, *spans)
    got = image(frames.stitched(table(spark, captures), least=10))
    assert all(got[c] == pages[c] for c in pages if not c % 2)
    assert all(got[c][-30:] == pages[c][-30:] and len(got[c]) <= 120 for c in pages)


def test_a_stopped_capture_keeps_its_part_and_two_runs_agree(spark):
    rows = layouts.scrolled(layouts.sheet_rows(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")))
    whole = {(r.capture_id, r.py): r.row for r in frames.stitched(rows).collect()}
    part = {(r.capture_id, r.py): r.row for r in frames.stitched(rows.where("frame < 2")).collect()}
    assert len(part) < len(whole) and all(whole[k] == v for k, v in part.items())
    assert whole == {(r.capture_id, r.py): r.row for r in frames.stitched(rows.repartition(7)).collect()}


def test_empty(spark):
    assert frames.stitched(table(spark, {})).count() == 0


@pytest.mark.parametrize("n", [0, 1, 5, 1000, 2**20 - 1])
def test_power(spark, n):
    from pyspark.sql import functions as F

    got = spark.range(n, n + 1).select(frames._power(48_271, F.col("id")).alias("p")).first().p
    assert got == pow(48_271, n, frames.PRIME)
