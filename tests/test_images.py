"""Packed images and the rebuilt preview against plain versions and worked examples."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import images as I
from quire.operators import retouch


def packed(spark, pages):
    rows = [(c, img.shape[1], img.shape[0], *(img[:, :, k].tobytes() for k in range(3))) for c, img in pages.items()]
    return spark.createDataFrame(rows, "capture_id long, width long, height long, r binary, g binary, b binary")


def images_of(df):
    return {r.capture_id: I.pixels_of(r.asDict()) for r in df.collect()}


def canvas(w, h, grey=0.75):
    return np.full((h, w, 3), round(grey * 255), np.uint8)


def paint(img, box, colour):
    """A box with a bottom-left origin."""
    x, y, w, h = box
    img[img.shape[0] - y - h : img.shape[0] - y, x : x + w] = [round(v * 255) for v in colour]
    return img


def test_box_sums_and_masks():
    rng = np.random.default_rng(1)
    img = rng.integers(0, 256, (30, 41, 3)).astype(np.uint8)
    sums = I.BoxSums(img)
    for _ in range(50):
        x1, x2 = sorted(rng.integers(-5, 50, 2).tolist())
        y1, y2 = sorted(rng.integers(-5, 40, 2).tolist())
        part = img[max(0, y1) : max(0, y2), max(0, x1) : max(0, x2)].astype(float)
        want = part.reshape(-1, 3).var(axis=0).mean() if part.size > 3 else 0.0
        assert sums.variance(x1, y1, x2, y2) == pytest.approx(want, abs=1e-8)
    boxes = [(0, 0, 3, 3), (2, 1, 41, 2), (40, 29, 41, 30)]
    want = np.zeros((30, 41), bool)
    for x1, y1, x2, y2 in boxes:
        want[y1:y2, x1:x2] = True
    assert (I.in_boxes((30, 41), boxes) == want).all()


@pytest.mark.parametrize("radius", [0, 1, 3, 9, 60])
def test_dilation_is_a_disc(radius):
    rng = np.random.default_rng(radius)
    m = rng.random((23, 31)) < 0.01
    y, x = np.nonzero(m)
    yy, xx = np.indices(m.shape)
    want = ((yy[..., None] - y) ** 2 + (xx[..., None] - x) ** 2 <= radius**2).any(axis=2)
    assert (I.dilate(m, radius) == want).all()


def test_fill_restores_a_ramp_and_depends_on_its_own_ring_alone():
    y, x = np.indices((40, 60))
    ramp = np.stack([x * 3 + y, 200 - x, y * 4 + 10], axis=2).astype(np.uint8)
    mask = np.zeros((40, 60), bool)
    mask[5:20, 8:30] = mask[25:38, 40:55] = True
    broken = ramp.copy()
    broken[mask] = 0
    assert (I.filled(broken, mask) == ramp).all()
    other = broken.copy()
    other[24:39, 39:56][~mask[24:39, 39:56]] = 99  # the second ring
    a, b = I.filled(broken, mask), I.filled(other, mask)
    assert (a[5:20, 8:30] == b[5:20, 8:30]).all() and (b[25:38, 40:55] == 99).all()
    assert (I.filled(broken, np.ones_like(mask)) == broken).all() and (I.filled(broken, ~np.ones_like(mask)) == broken).all()
    edge = mask.copy()
    edge[:, :3] = True  # at the image's edge there are fewer neighbours
    got = I.filled(ramp, edge)
    assert (got[~edge] == ramp[~edge]).all() and got[:, 0, 0].min() >= ramp[:, 3, 0].min() and got[:, 0, 0].max() <= ramp[:, 3, 0].max()


def test_fill_against_dense_equations():
    rng = np.random.default_rng(5)
    img, mask = rng.integers(0, 256, (9, 11, 3)).astype(np.uint8), rng.random((9, 11)) < 0.6
    spots = [tuple(p) for p in np.argwhere(mask)]
    a, b = np.zeros((len(spots), len(spots))), np.zeros((len(spots), 3))
    for i, (y, x) in enumerate(spots):
        for q in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
            if 0 <= q[0] < 9 and 0 <= q[1] < 11:
                a[i, i] += 1
                if mask[q]:
                    a[i, spots.index(q)] -= 1
                else:
                    b[i] += img[q]
    want = img.copy()
    want[mask] = np.floor(np.linalg.solve(a, b) + 0.5 + 1e-6)
    assert (I.filled(img, mask) == want).all()


def figure(crop, first, texts):
    """A row as ``first_pass`` gives it; texts have a bottom-left origin in pixels."""
    h, w = crop.shape[:2]
    flipped = [(float(x), float(h - y - th), float(tw), float(th)) for x, y, tw, th in texts]
    return (1, 0, 0, 0, flipped, w, h, crop.tobytes(), np.zeros((h, w), np.uint8).tobytes(), first.tobytes())


FIGURES = "capture_id long, fig_idx int, x1 int, y1 int, texts array<struct<x:double,y:double,w:double,h:double>>, width int, height int, crop binary, mask binary, first binary"


def residue(spark, crop, first, texts, least):
    return retouch.residue(spark.createDataFrame([figure(crop, first, texts)], FIGURES), least).collect()


def test_residue_of_worked_examples(spark):
    red, gap = (48, 30, 44, 24), (65, 34, 10, 14)
    before = paint(paint(canvas(200, 120), red, (0.85, 0.1, 0.1)), gap, (1, 1, 1))
    (better,) = residue(spark, before, paint(canvas(200, 120), red, (0.85, 0.1, 0.1)), [gap], 0.45)
    (same,) = residue(spark, before, before, [gap], 0.45)
    assert better.n == 916 and better.reject_reason is None and better.radius >= 3 and better.text_coverage > 0.5
    assert better.confidence == pytest.approx(0.895, abs=5e-4) and same.confidence == pytest.approx(0.850, abs=5e-4)
    assert better.delta == pytest.approx(0.449, abs=5e-4) and same.delta == 0 and better.n < better.w * better.h

    badge, gap = (56, 34, 52, 26), (74, 39, 12, 14)
    before = paint(paint(canvas(220, 140), badge, (0.32,) * 3), gap, (1, 1, 1))
    (found,) = residue(spark, before, paint(canvas(220, 140), badge, (0.32,) * 3), [gap], 0.45)
    assert found.n == 1032 and found.reject_reason is None and found.confidence > 0.85 and found.delta == pytest.approx(0.25, abs=5e-4)
    assert found.anchor_proximity > 0.5 and found.text_coverage > 0.4 and found.delta > 0.1

    label, remote, gap = (36, 122, 88, 34), (42, 72, 96, 36), (64, 130, 24, 18)
    after = paint(paint(canvas(280, 180), label, (0.35,) * 3), remote, (0.35,) * 3)
    before = paint(after.copy(), gap, (1, 1, 1))
    rows = {r.y < 60: r for r in residue(spark, before, after, [gap], 0.50)}
    assert rows[True].n == 2224 and rows[True].reject_reason is None and rows[True].confidence > 0.85
    assert rows[False].reject_reason is not None  # what lies farther away is left alone, and listed


OVERLAYS = "capture_id long, overlay_id long, kind string, x double, y double, w double, h double, is_excluded boolean, source_figure_index int, source_text_block_ids array<long>, classification string, associated_figure_overlay_id long"


def page(spark, excluded, cls="overlay", second=False):
    """A page with two figures; the first has a button with a text, the second a text on plain ground."""
    img = canvas(400, 300, 0.9)
    paint(img, (20, 60, 160, 200), (0.75,) * 3)
    paint(img, (60, 120, 44, 24), (0.85, 0.1, 0.1))
    paint(img, (77, 124, 10, 14), (1, 1, 1))
    paint(img, (220, 60, 160, 200), (0.5,) * 3)
    paint(img, (280, 150, 20, 10), (0, 0, 0))
    n = lambda x, y, w, h: (x / 400, y / 300, w / 400, h / 300)
    t = lambda x, y, w, h: (x / 400, 1 - (y + h) / 300, w / 400, h / 300)
    overlays = [(1, 0, "figure", *t(20, 60, 160, 200), False, 0, [], None, None), (1, 1, "figure", *t(220, 60, 160, 200), False, 1, [], None, None), (1, 2, "text", *t(77, 124, 10, 14), excluded, None, [7], cls, 0), (1, 3, "text", *t(280, 150, 20, 10), second, None, [8], "edgeOverlay", 1)]
    blocks = spark.createDataFrame([(1, 7, *n(77, 124, 10, 14)), (1, 8, *n(280, 150, 20, 10))], "capture_id long, block_id long, x double, y double, w double, h double")
    return img, packed(spark, {1: img, 2: img}), spark.createDataFrame(overlays, OVERLAYS), blocks


def test_preview_removes_the_text_and_what_surrounds_it(spark):
    img, pages, overlays, blocks = page(spark, True)
    got = images_of(retouch.preview(pages, overlays, blocks))
    assert (got[2] == img).all()  # a page without edits
    changed = (got[1] != img).any(axis=2)
    y, x = np.nonzero(changed)
    assert 20 <= x.min() and x.max() < 180 and 300 - 260 <= y.min() and y.max() < 300 - 60
    assert (got[1][300 - 144 : 300 - 120, 60:104] == round(0.75 * 255)).all()  # the button is gone with its text


def test_preview_restores_and_ignores_page_text(spark):
    for args in ((False,), (True, "pageText"), (True, None), (True, "uncertain")):
        img, pages, overlays, blocks = page(spark, *args)
        assert (images_of(retouch.preview(pages, overlays, blocks))[1] == img).all()


def test_each_figure_changes_for_its_own_texts_alone(spark):
    one, both, other = (images_of(retouch.preview(*page(spark, a, second=b)[1:]))[1] for a, b in ((True, False), (True, True), (False, True)))
    assert (both[:, :200] == one[:, :200]).all() and (both[:, 200:] == other[:, 200:]).all()
    assert (other[300 - 160 : 300 - 150, 280:300] == round(0.5 * 255)).all()


def test_second_pass_steps_back_where_it_does_harm(spark):
    rng = np.random.default_rng(2)
    crop = rng.integers(0, 256, (60, 80, 3)).astype(np.uint8)  # all would be lost in so large a mask
    row = {"crop": crop.tobytes(), "first": crop.tobytes(), "mask": np.zeros((60, 80), np.uint8).tobytes(), "width": 80, "height": 60, "blobs": [{"members": np.arange(1500, 3300, 7, dtype=np.int32).tobytes(), "radius": 12}]}
    assert retouch._second(row) == [(crop.tobytes(), 1)]
    plain = canvas(80, 60)
    plain[30, 40] = 0
    row |= {"crop": plain.tobytes(), "first": plain.tobytes(), "blobs": [{"members": np.array([30 * 80 + 40], np.int32).tobytes(), "radius": 3}]}
    (final, passes), = retouch._second(row)
    assert passes == 2 and final == canvas(80, 60).tobytes()
    assert retouch._second(row | {"blobs": []}) == [(plain.tobytes(), 1)]


def test_figures_off_the_page_and_empty_tables(spark):
    img, pages, overlays, blocks = page(spark, True)
    gone = overlays.withColumn("x", F.when(F.col("kind") == "figure", F.col("x") + 5).otherwise(F.col("x")))
    assert (images_of(retouch.preview(pages, gone, blocks))[1] == img).all()
    assert (images_of(retouch.preview(pages, overlays.limit(0), blocks))[1] == img).all()
    assert retouch.preview(pages.limit(0), overlays, blocks).count() == 0


def test_ring_damage():
    a, mask = canvas(100, 100, 180 / 255), np.zeros((100, 100), bool)
    mask[30:60, 30:60] = True
    b = paint(a.copy(), (30, 40, 30, 30), (1, 0, 0))
    assert I.ring_damage(a, b, mask, (30, 30, 60, 60)) < 0.1
    c = b.copy()
    c[30:60, 64:76] = (0, 0, 255)
    assert I.ring_damage(a, c, mask, (30, 30, 60, 60)) > 0.1
    assert I.ring_damage(a, c, np.ones_like(mask), (30, 30, 60, 60)) == 0 and math.isclose(I.preserved(a, a)[0], 100)
