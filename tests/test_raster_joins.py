"""Operators on pixel rows: nothing as large as the pixels is broadcast, and places are found without joins."""

import re

import numpy as np
import pytest

from quire.operators import raster
from quire.plans import catalog


def broadcast_pixels(df):
    """The parts of a plan that send pixel rows, neither counted nor cut to one row an image, to every executor."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda line: len(re.match(r"[\s:+\-]*", line).group())
    found = []
    for i, line in enumerate(lines):
        if "BroadcastExchange" not in line:
            continue
        below = []
        for more in lines[i + 1 :]:
            if depth(more) <= depth(line):
                break
            below.append(more)
        text = "\n".join(below)
        one_each = re.search(r"Filter .*= 0\)", text)
        if "Generate" in text and "Aggregate" not in text and not one_each:
            found.append(text)
    return found


@pytest.mark.parametrize("name", ["c1_overlay_class", "c2_c3_overlay_evidence", "r14_deviation_outside_text_page", "r15_region_growing", "r7_tighten_by_variance", "r8_auto_crop", "r3_content_map_page"])
def test_no_pixels_are_broadcast(spark, name):
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b"
    assert not broadcast_pixels(catalog.queries()[name](spark, "/root/testdata/sf0.001"))


@pytest.mark.parametrize("size", [(1, 1), (3, 7), (40, 5), (17, 64)])
def test_resized_and_cells_on_odd_sizes(spark, size):
    h, w = size
    img = np.random.default_rng(h).integers(0, 256, (h, w, 3))
    rows = [(1, w, h, x, y, *(int(v) for v in img[y, x])) for y in range(h) for x in range(w)]
    p = spark.createDataFrame(rows, "capture_id long, width long, height long, px long, py long, r long, g long, b long")
    got = {(r.px, r.py): (r.r, r.g, r.b) for r in raster.resized(p, 12, 9).collect()}
    assert got == {(x, y): tuple(int(v) for v in img[y * h // 9, x * w // 12]) for x in range(12) for y in range(9)}
    text = spark.createDataFrame([(1, 0.1, 0.2, 0.5, 0.3), (2, 0.0, 0.0, 1.0, 1.0)], "capture_id long, x double, y double, w double, h double")
    cells = {(r.gx, r.gy): r.cell for r in raster.content_map(p, text, 20).collect()}
    assert len(cells) == 400
    assert all((cells[x, y] == "text") == (0.1 <= (x + 0.5) / 20 < 0.6 and 0.2 <= 1 - (y + 0.5) / 20 < 0.5) for x, y in cells)
