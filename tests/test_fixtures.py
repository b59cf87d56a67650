"""Literal cases with known outcomes, and brute-force or naive versions of what SQL does not express."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import geometry as g
from quire.operators import overlays, raster, reading, regions, relations, reports, scoring, screens
from quire.sources import files
from quire.streaming import folds

BOX = "capture_id long, block_id long, x double, y double, w double, h double"


def blocks(spark, boxes):
    return spark.createDataFrame([(1, i, *map(float, b)) for i, b in enumerate(boxes)], BOX)


def order(spark, boxes):
    return [r.block_id for r in reading.reading_order(blocks(spark, boxes)).orderBy("reading_pos").collect()]


@pytest.mark.parametrize(
    "boxes, want",
    [
        ([(0.6, 0.5, 0.2, 0.05), (0.1, 0.5, 0.2, 0.05)], [1, 0]),
        ([(0.1, 0.1, 0.3, 0.05), (0.1, 0.8, 0.3, 0.05)], [1, 0]),
        ([(0.55, 0.8, 0.4, 0.05), (0.05, 0.7, 0.4, 0.05), (0.05, 0.8, 0.4, 0.05), (0.55, 0.7, 0.4, 0.05)], [2, 1, 0, 3]),
        ([(0.05, 0.9, 0.9, 0.05), (0.55, 0.8, 0.4, 0.05), (0.05, 0.7, 0.4, 0.05), (0.05, 0.8, 0.4, 0.05), (0.55, 0.7, 0.4, 0.05)], [0, 3, 2, 1, 4]),
        ([(0.05, 0.5, 0.2, 0.05), (0.55, 0.5, 0.2, 0.05), (0.05, 0.3, 0.5, 0.05)], [0, 1, 2]),
    ],
)
def test_reading_order(spark, boxes, want):
    assert order(spark, boxes) == want


@pytest.mark.parametrize(
    "boxes, want",
    [
        ([], [(0.0, 1.0)]),
        ([(0, 0, 1, 1)], []),
        ([(0, 0.8, 1, 0.2)], [(0.0, 0.8)]),
        ([(0, 0, 1, 0.2)], [(0.2, 0.8)]),
        ([(0, 0, 1, 0.2), (0, 0.7, 1, 0.3)], [(0.2, 0.5)]),
        ([(0, 0, 1, 0.1), (0, 0.3, 1, 0.1), (0, 0.6, 1, 0.1)], [(0.1, 0.2), (0.4, 0.2), (0.7, 0.3)]),
        ([(0, 0, 1, 0.48), (0, 0.52, 1, 0.48)], []),
        ([(0, 0.05, 1, 0.2), (0, 0.3, 1, 0.7)], [(0.25, 0.05)]),
    ],
)
def test_gaps(spark, boxes, want):
    captures = spark.createDataFrame([(1,)], "capture_id long")
    got = [(round(r.y, 6), round(r.h, 6)) for r in reading.text_gaps(captures, blocks(spark, boxes)).orderBy("y").collect()]
    assert got == want


def test_groups(spark):
    one = [(0.05, 0.8 - 0.02 * i, 0.9, 0.015) for i in range(10)]
    two = [(x, 0.8 - 0.02 * i, 0.4, 0.015) for i in range(5) for x in (0.05, 0.55)]
    apart = [(0.05, y, 0.9, 0.015) for y in (0.8, 0.78, 0.5, 0.48)]
    count = lambda b: regions.text_groups(blocks(spark, b)).select("group_id").distinct().count()
    assert [count(one), count(two), count(apart), count([])] == [1, 2, 2, 0]


@pytest.mark.parametrize(
    "boxes, n",
    [([(0, 0, 0.2, 0.2), (0.5, 0.5, 0.2, 0.2)], 2), ([(0, 0, 0.4, 0.4), (0.05, 0.05, 0.4, 0.4)], 1), ([(0, 0, 0.3, 0.3), (0.2, 0.2, 0.3, 0.3)], 2), ([(0, 0, 0.2, 0.1), (0, 0, 0.1, 0.1)], 2), ([(0, 0, 0.2, 0.2)] * 2, 1)],
)
def test_merge(boxes, n):
    assert len(regions.merge_boxes(boxes, regions.like_enough())) == n


def test_merge_grows_while_scanning():
    # the second joins the first only after the first has taken in the third
    chain = [(0.0, 0.0, 0.40, 0.40), (0.0, 0.14, 0.40, 0.40), (0.0, 0.05, 0.40, 0.40)]
    assert len(regions.merge_boxes(chain, regions.like_enough())) == 1
    assert regions.merge_boxes([(0, 0, 0.2, 0.2), (0.24, 0, 0.2, 0.2)], regions.side_by_side()) == [(0, 0, pytest.approx(0.44), 0.2)]


@pytest.mark.parametrize(
    "region, texts, ok",
    [
        ((0, 0.2, 0.8, 0.4), [(0, 0.2, 0.3, 0.4)], lambda b: b[0] >= 0.3),
        ((0.1, 0, 0.4, 0.8), [(0.1, 0.5, 0.4, 0.3)], lambda b: b[1] + b[3] <= 0.5 + 1e-9),
        ((0.1, 0.2, 0.8, 0.4), [(0.6, 0.2, 0.3, 0.4)], lambda b: b[0] + b[2] <= 0.6 + 1e-9),
        ((0.1, 0, 0.4, 0.8), [(0.1, 0, 0.4, 0.3)], lambda b: b[1] >= 0.3),
        ((0.5, 0.5, 0.3, 0.3), [(0, 0, 0.2, 0.2)], lambda b: b == (0.5, 0.5, 0.3, 0.3)),
        ((0.2, 0.2, 0.5, 0.5), [(0.15, 0.65, 0.6, 0.1)], lambda b: b[1] + b[3] <= 0.65 + 1e-9 and b[1] == 0.2),
        ((0, 0, 0.9, 0.9), [(0.3, 0.3, 0.3, 0.3)], lambda b: b[2] >= 0.72 and b[3] >= 0.72),
    ],
)
def test_trim(region, texts, ok):
    assert ok(regions.trim_box(region, texts))


@pytest.mark.parametrize(
    "figure, text, want",
    [
        ((0.05, 0.20, 0.30, 0.60), (0.37, 0.30, 0.50, 0.03), "adjacentRight"), ((0.50, 0.20, 0.40, 0.60), (0.18, 0.30, 0.30, 0.03), "adjacentLeft"), ((0.05, 0.40, 0.90, 0.50), (0.10, 0.35, 0.70, 0.03), "adjacentBelow"),
        ((0.05, 0.10, 0.90, 0.30), (0.10, 0.42, 0.70, 0.03), "adjacentAbove"), ((0.10, 0.20, 0.50, 0.50), (0.30, 0.40, 0.40, 0.03), "overlapping"), ((0.05, 0.05, 0.20, 0.20), (0.70, 0.70, 0.20, 0.03), "disjoint"),
        ((0.04, 0.35, 0.329, 0.57), (0.368, 0.47, 0.60, 0.03), "adjacentRight"), ((0, 0.50, 1, 0.40), (0.05, 0.45, 0.85, 0.03), "adjacentBelow"),
    ],
)
def test_relation(spark, figure, text, want):
    assert spark.range(1).select(g.relation(g.Rect(*figure), g.Rect(*text)).alias("r")).first().r == want


def values(spark, r, *more):
    row = spark.range(1).select(*r.named(), *more).first()
    return [None if v is None else round(v, 6) for v in row]


def none():
    return {e: F.lit(False) for e in relations.EDGES}


def test_scalar_geometry(spark):
    assert values(spark, g.flip_on_display(g.Rect(100, 800, 400, 200), 1920, 1080)) == [100, 80, 400, 200]
    assert values(spark, g.flip_on_display(g.Rect(1800, 500, 400, 200), 1920, 1080))[2] == 120
    assert values(spark, g.flip_on_display(g.Rect(2000, 0, 100, 100), 1920, 1080)) == [None] * 4
    assert values(spark, g.expanded(g.Rect(0.3, 0.3, 0.3, 0.3), none())) == [0.26, 0.26, 0.38, 0.38]
    assert values(spark, g.snapped(g.Rect(0, 0.5, 0.7, 0.3), none()))[2] == 1
    assert values(spark, g.snapped(g.Rect(0, 0.3, 0.7, 0.4), none() | {"right": F.lit(True)}))[2] < 0.8
    assert values(spark, g.snapped(g.Rect(0.2, 0.3, 0.4, 0.3), none()))[2] == 0.4
    assert values(spark, g.clamp_overlay(g.Rect(1.3, 1.3, 0.3, 0.3))) == [0.7, 0.7, 0.3, 0.3]
    assert values(spark, g.normalized(g.Rect(1, 2, 3, 4), 0, 10)) == [0, 0, 0, 0]
    assert spark.range(1).select(g.iou(g.Rect(0, 0, 1, 1), g.Rect(0, 0, 1, 1)).alias("v"), g.iou(g.Rect(0, 0, 1, 1), g.Rect(1, 0, 1, 1)).alias("u")).first() == (1.0, 0.0)


def image(spark, width, height, color):
    p = spark.range(width * height).select(F.lit(1).cast("long").alias("capture_id"), F.lit(width).cast("long").alias("width"), F.lit(height).cast("long").alias("height"), (F.col("id") % width).alias("px"), F.floor(F.col("id") / width).alias("py"))
    r, gr, b = color(F.col("px"), F.col("py"))
    return p.select("*", r.cast("long").alias("r"), gr.cast("long").alias("g"), b.cast("long").alias("b"))


def flat(r, gr, b):
    return lambda x, y: (F.lit(r), F.lit(gr), F.lit(b))


def test_background(spark):
    assert [tuple(raster.background(image(spark, 200, 200, flat(*c))).first())[1:] for c in ((255, 255, 255), (45, 45, 45), (245, 240, 232))] == [(255, 255, 255), (45, 45, 45), (245, 240, 232)]
    inside = lambda x, y: (x >= 40) & (x < 160) & (y >= 40) & (y < 160)
    p = image(spark, 200, 200, lambda x, y: tuple(F.when(inside(x, y), c).otherwise(240) for c in (30, 80, 150)))
    r = raster.background(p).first()
    assert (r.r + r.g + r.b) / 3 > 230


def test_auto_crop_and_tighten(spark):
    blue = lambda x, y: tuple(F.when((x >= 30) & (x < 70) & (y >= 30) & (y < 70), c).otherwise(255) for c in (30, 80, 200))
    r = raster.auto_cropped(image(spark, 100, 100, blue)).first()
    assert 40 <= r.w < 70 and 40 <= r.h < 70
    dark = raster.auto_cropped(image(spark, 50, 50, flat(20, 20, 20))).first()
    assert (dark.x, dark.y, dark.w, dark.h) == (0, 0, 50, 50)
    same = raster.tightened(image(spark, 50, 50, flat(200, 200, 200))).first()
    assert (same.w, same.h) == (50, 50)


def test_masks_and_damage(spark):
    size = raster.sizes(image(spark, 100, 100, flat(180, 180, 180)))
    text = spark.createDataFrame([(1, 0.2, 0.3, 0.4, 0.1)], "capture_id long, x double, y double, w double, h double")
    assert raster.text_mask(size, text, least=0, proportional=0).count() == 400
    assert raster.text_mask(size, text.limit(0)).count() == 0
    grey = image(spark, 100, 100, flat(180, 180, 180))
    red = image(spark, 100, 100, lambda x, y: tuple(F.when((x >= 30) & (x < 60) & (y >= 30) & (y < 60), c).otherwise(180) for c in (255, 0, 0)))
    box = spark.createDataFrame([(1, 30, 30, 30, 30)], "capture_id long, x long, y long, w long, h long")
    mask = red.where("r = 255").select("capture_id", "px", "py")
    assert raster.ring_damage(grey, red, mask, box).first().damage < 0.1
    strip = red.withColumn("b", F.when((F.col("px") >= 64) & (F.col("px") < 76) & (F.col("py") >= 30) & (F.col("py") < 42), 255).otherwise(F.col("b")))
    assert raster.ring_damage(grey, strip, mask, box).first().damage > 0.1
    assert raster.preserved(grey, grey).first().accepted


def test_components_match_naive(spark):
    rng = random.Random(5)
    cells = {(rng.randrange(12), rng.randrange(12)) for _ in range(70)}
    mask = spark.createDataFrame([(1, 12, 12, x, y) for x, y in cells], "capture_id long, width long, height long, px long, py long")
    got = sorted(sorted(r.members) for r in raster.pixel_components(mask, 1).collect())
    label = {c: i for i, c in enumerate(cells)}
    for _ in range(200):
        for x, y in cells:
            label[x, y] = min([label[x, y]] + [label[n] for n in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)) if n in cells])
    want = {}
    for (x, y), i in label.items():
        want.setdefault(i, []).append(y * 12 + x)
    assert got == sorted(map(sorted, want.values()))


def test_nms_matches_naive(spark):
    rng = random.Random(3)
    rows = [(1, i, rng.random(), rng.randrange(2), rng.random(), rng.random(), 0.2 + rng.random() / 4, 0.2 + rng.random() / 4) for i in range(60)]
    d = spark.createDataFrame(rows, "capture_id long, det_id long, confidence double, class_id long, x double, y double, w double, h double")
    kept = []
    for r in sorted(rows, key=lambda r: -r[2]):
        s = [regions.shared(r[4:], k[4:]) / (r[6] * r[7] + k[6] * k[7] - regions.shared(r[4:], k[4:])) for k in kept if k[3] == r[3]]
        if all(v <= 0.45 for v in s):
            kept.append(r)
    assert sorted(r.det_id for r in regions.suppressed(d).collect()) == sorted(k[1] for k in kept)


def test_overlay_class(spark):
    c = lambda *v: spark.range(1).select(scoring.overlay_class(*(F.lit(x) for x in v)).alias("c")).first().c
    assert c(0.2, 1.0, 1.0, 1.0, 0.0, "top") == "pageText"
    assert c(1.0, 0.5, 0.5, 0.0, 0.5, "top") == "overlay"
    assert c(1.0, 0.6, 0.0, 0.5, 0.1, "bottom") == "edgeOverlay"
    assert c(1.0, 0.6, 0.0, 0.5, 0.1, "top") == "uncertain"
    assert c(1.0, 0.1, 0.1, 0.1, 0.1, "top") == "pageText"


def test_moves_are_clamped_in_turn(spark):
    o = spark.createDataFrame([(1, 1, 0.1, 0.2, 0.3, 0.4), (1, 2, 0.8, 0.8, 0.3, 0.3)], "capture_id long, overlay_id long, x double, y double, w double, h double")
    e = spark.createDataFrame([(1, 1, 1, "move", 0.05, 0.1), (1, 2, 1, "move", 0.5, 0.5), (1, 2, 2, "move", -0.1, 0.0)], "capture_id long, overlay_id long, seq long, op string, dx double, dy double")
    got = {r.overlay_id: (r.x, r.y) for r in overlays.moved(o, e).collect()}
    assert got == {1: (0.15, 0.3), 2: (0.6, 0.7)}


def test_log_job(spark, tmp_path):
    lines = ['◇ Suite "A" started.', '✔ Test "one" passed after 1 s.', '◇ Suite "B" started.', '✘ Test "two" recorded an issue: x', '✘ Test "two" recorded an issue at f: Expectation failed: (a) == b', '✔ Suite "B" passed.', '✘ Test "three" failed.', '➜ Test "four" skipped.', '✔ Test "one" passed again.']
    (tmp_path / "run.log").write_text("\n".join(lines))
    got = {r.name: (r.suite, r.status, r.message) for r in reports.parsed(files.read_log(spark, str(tmp_path / "run.log"))).collect()}
    assert got == {"one": ("A", "PASS", None), "two": ("B", "FAIL", "Expectation failed: (a) == b"), "three": ("A", "FAIL", None), "four": ("A", "SKIP", None)}


def test_file_sources(spark, tmp_path):
    (tmp_path / "cov.json").write_text('{"data":[{"files":[{"filename":"/r/Sources/A.x","summary":{"lines":{"count":10,"covered":9,"percent":90.0}}},{"filename":"/r/Tests/B.x","summary":{"lines":{"count":1,"covered":1,"percent":100.0}}}]}]}')
    (tmp_path / "cat.json").write_text('{"one":{"category":"core","description":"d"}}')
    assert [(r.path, r.covered) for r in files.read_coverage(spark, str(tmp_path / "cov.json")).collect()] == [("/r/Sources/A.x", 9)]
    assert [tuple(r) for r in files.read_catalog(spark, str(tmp_path / "cat.json")).collect()] == [("one", "core", "d")]
    files.write_dashboard(spark.createDataFrame([(1, 2)], "b long, a long"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first().value == '{"a":2,"b":1}'
    texts = spark.createDataFrame([(7, "x\ny")], "capture_id long, full_text string")
    files.export(texts, str(tmp_path / "md"))
    assert "# Capture 7" in [r.value for r in spark.read.text(str(tmp_path / "md")).collect()]
    crop = spark.createDataFrame([(7, 1, 2, 1, 1, 0, 9, 9, 9), (7, 1, 2, 1, 0, 0, 1, 2, 3)], "capture_id long, fig_no int, width long, height long, px long, py long, r long, g long, b long")
    for selection, want in (("figuresOnly", {"capture-7-figure-1.ppm"}), ("textOnly", {"capture-7.md"}), ("textAndFigures", {"capture-7.md", "capture-7-figure-1.ppm"})):
        files.export(texts, str(tmp_path / selection), selection, crop)
        assert {r.path for r in spark.read.text(str(tmp_path / selection)).collect()} == want
    assert files.portable_pixmaps(crop).first().content == "P3\n2 1\n255\n1 2 3\n9 9 9\n"


def test_window_not_found(spark):
    w = spark.createDataFrame([(1, "t", "a", 60.0, 60.0)], "window_id long, title string, app_name string, w double, h double")
    assert screens.find_window(w, 1).first().width == 120
    with pytest.raises(Exception, match="not found"):
        screens.find_window(w, 2).collect()


def test_stream_equals_table(spark, tmp_path):
    rows = [(i % 3, i % 5, i, ["select", "toggle", "add", "move", "delete"][i * 7 % 5]) for i in range(40)]
    d = spark.createDataFrame(rows, "capture_id long, overlay_id long, seq long, op string")
    d.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = folds.sink(folds.overlay_states(stream), "overlay_states_test", str(tmp_path / "cp"), "complete")
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("overlay_states_test").collect())) == sorted(map(tuple, folds.overlay_states(d).collect()))


def test_confidence_is_bounded(spark):
    names = ["compactness", "uniformity", "shape_balance", "boundary_contrast", "anchor_proximity", "text_coverage", "delta"]
    full = {n: F.lit(100.0 if n == "boundary_contrast" else 1.0) for n in names} | {"relative_area": F.lit(0.0), "merged": F.lit(True)}
    assert math.isclose(spark.range(1).select(scoring.blob_confidence(full).alias("c")).first().c, 1.0)


def test_flow_layout_takes_all_lines(spark, tmp_path):
    from quire.plans import catalog

    spark.createDataFrame([(1, "\n".join(f"a{i} b{i}" for i in range(50)))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.queries()["g32_flow_layout"](spark, str(tmp_path)).toPandas()
    assert sorted(got.word_no) == list(range(100))


@pytest.mark.parametrize("page", [(255, 255, 255), (45, 45, 45), (245, 240, 232)])
def test_growing_fills_a_picture_and_stops_at_the_page(spark, page):
    """A block of 160 x 50 pixels on a page of 200 x 100, from a seed inside it; text at its right edge stops it."""
    image = np.full((100, 200, 3), page, np.int64)
    image[10:60, 20:180] = (30, 80, 150)
    rows = [(1, 200, 100, x, y, *map(int, image[y, x])) for y in range(100) for x in range(200)]
    pixels = spark.createDataFrame(rows, "capture_id long, width long, height long, px long, py long, r long, g long, b long")
    seeds = spark.createDataFrame([(1, 5, 0.35, 0.55, 0.2, 0.1)], "capture_id long, cand_id long, x double, y double, w double, h double")
    none = spark.createDataFrame([], "capture_id long, x double, y double, w double, h double")
    r = scoring.grown_regions(seeds, none, pixels).first()
    assert r.cand_id == 5 and 0.78 <= r.w <= 0.90 and 0.48 <= r.h <= 0.58
    text = spark.createDataFrame([(1, 0.7, 0.4, 0.1, 0.5)], "capture_id long, x double, y double, w double, h double")
    assert scoring.grown_regions(seeds, text, pixels).first().w < r.w - 0.1


def naive_grow(image, box, texts, page, step=0.02, blank=0.6, off=60.0):
    """Pixel by pixel and step by step."""
    h, w = image.shape[:2]
    x, y, bw, bh = box
    top, bottom, left, right = int((1.0 - (y + bh)) * h), int((1.0 - y) * h), int(x * w), int((x + bw) * w)
    top, bottom, left, right = max(0, min(h - 1, top)), max(0, min(h, bottom)), max(0, min(w - 1, left)), max(0, min(w, right))

    def blocked(points):
        return any(tx <= px / w < tx + tw and ty <= 1.0 - py / h < ty + th for px, py in points for tx, ty, tw, th in texts)

    def bare(points):
        return bool(points) and sum(sum(abs(int(image[py, px, k]) - page[k]) for k in range(3)) <= off for px, py in points) / len(points) >= blank

    for side in ("top", "bottom", "left", "right"):
        n, empty = max(1, int(step * (h if side in ("top", "bottom") else w))), 0
        while True:
            at, most = {"top": (top, 0), "bottom": (bottom, h), "left": (left, 0), "right": (right, w)}[side]
            to = at - n if side in ("top", "left") else at + n
            if to < 0 or to > (most or to):
                break
            line = to if side in ("top", "left") else min((h if side == "bottom" else w) - 1, to - 1)
            lo, hi = (left, right) if side in ("top", "bottom") else (top, bottom)
            points = lambda k: [(v, line) if side in ("top", "bottom") else (line, v) for v in range(lo, hi, max(1, (hi - lo) // k))]  # noqa: B023, E731
            empty = empty + 1 if bare(points(20)) else 0
            if blocked(points(10)) or empty == 2:
                break
            top, bottom, left, right = (to if side == s else v for s, v in (("top", top), ("bottom", bottom), ("left", left), ("right", right)))
    return left / w, 1.0 - bottom / h, (right - left) / w, (bottom - top) / h


def test_growing_matches_a_plain_version():
    rng = np.random.default_rng(6)
    for _ in range(60):
        h, w = rng.integers(11, 90, 2)
        image = np.where(rng.random((h // 6 + 1, w // 6 + 1)).repeat(6, 0).repeat(6, 1)[:h, :w, None] < 0.5, 200, 40) + rng.integers(0, 9, (h, w, 3))
        texts = np.array([(*rng.random(2), 0.1, 0.1) for _ in range(rng.integers(0, 3))]).reshape(-1, 4)
        box, page = (*(rng.random(2) * 0.7), 0.2, 0.15), [200.0, 200.0, 200.0]
        corners = np.column_stack((texts[:, 0], texts[:, 1], texts[:, 0] + texts[:, 2], texts[:, 1] + texts[:, 3]))
        assert scoring.grow(image, box, corners, np.array(page), 0.02, 0.6, 60.0) == naive_grow(image, box, texts.tolist(), page)


def test_components_match_flood_fill():
    rng = np.random.default_rng(7)
    for _ in range(40):
        h, w = rng.integers(1, 30, 2)
        image = rng.random((h, w)) < 0.6
        y, x = np.nonzero(image)
        if not len(x):
            continue
        left, want = set(zip(y.tolist(), x.tolist())), []
        for start in sorted(left):
            if start in left:
                part, todo = set(), [start]
                while todo:
                    c = todo.pop()
                    if c in left:
                        left.discard(c)
                        part.add(c)
                        todo += [(c[0] + dy, c[1] + dx) for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0))]
                want.append(part)
        got = [set(zip(y[p].tolist(), x[p].tolist())) for p in raster._components(x, y)]
        assert got == want
