"""The detector as one job, and its packed kernels against the pixel operators."""

import numpy as np
import pytest

from quire.operators import detection as D
from quire.operators import images as I
from quire.operators import raster
from test_images import canvas, packed, paint


def page_images():
    rng = np.random.default_rng(4)
    pages = {}
    for c in range(8):
        h, w = (60, 90) if c % 2 else (170, 60)
        img = canvas(w, h, (0.95, 0.9, 0.2, 0.6)[c % 4])
        y, x = sorted(rng.integers(0, h, 2)), sorted(rng.integers(0, w, 2))
        img[y[0] : y[1] + 1, x[0] : x[1] + 1] = rng.integers(0, 256, (y[1] - y[0] + 1, x[1] - x[0] + 1, 3))
        pages[c] = img
    return pages


def test_kernels_match_the_pixel_operators(spark):
    pages = page_images()
    images = packed(spark, pages)
    pixels = I.unpacked(images).cache()
    bg = {r.capture_id: (r.r, r.g, r.b) for r in raster.background(pixels).collect()}
    deviation = {r.capture_id: r.variance for r in raster.color_variance(pixels).collect()}
    texts = spark.createDataFrame([(c, 0, 0.1, 0.2, 0.3, 0.3) for c in (0, 1, 5)], "capture_id long, block_id long, x double, y double, w double, h double")
    cells = lambda df: {(r.capture_id, r.gx, r.gy): r.cell for r in df.collect()}
    assert cells(D.content_map(images, texts, 20)) == cells(raster.content_map(pixels, texts, 20))
    boxes = lambda df: {r.capture_id: (r.x, r.y, r.w, r.h) for r in df.collect()}
    light = spark.createDataFrame([(c, 240.0 if c % 2 else 100.0) for c in pages], "capture_id long, brightness double")
    plain, lit, tight = boxes(raster.auto_cropped(pixels)), boxes(raster.auto_cropped(pixels, light)), boxes(raster.tightened(pixels))
    for c, img in pages.items():
        assert D.background(img) == pytest.approx(bg[c], abs=1e-6) and D.colour_deviation(img) == pytest.approx(deviation[c], abs=1e-5)
        assert D.auto_crop(img) == plain[c] and D.auto_crop(img, 240.0 if c % 2 else 100.0) == lit[c] and D.tighten(img) == tight[c]
    assert any(plain[c] != (0, 0, pages[c].shape[1], pages[c].shape[0]) for c in pages)


BOX = "x double, y double, w double, h double"


def test_job_with_fallback(spark):
    rng = np.random.default_rng(1)
    photo = rng.integers(0, 256, (200, 150, 3)).astype(np.uint8)
    page = canvas(400, 300, 1.0)
    page[50:250, 30:180] = photo
    other = canvas(400, 300, 1.0)
    other[80:280, 200:350] = photo
    images = packed(spark, {1: page, 2: other, 3: canvas(400, 300, 1.0)})
    n = lambda x, y, w, h: (x / 400, 1 - (y + h) / 300, w / 400, h / 300)
    cands = [(1, 0, "saliency", 0.5, *n(20, 40, 170, 220)), (1, 1, "saliency", 0.4, *n(25, 45, 160, 210)), (2, 0, "saliency", 0.9, *n(10, 10, 12, 280)), (3, 0, "saliency", 0.9, *n(50, 50, 200, 200))]
    candidates = spark.createDataFrame(cands, f"capture_id long, cand_id long, source string, confidence double, {BOX}")
    texts = spark.createDataFrame([(1, 0, *n(250, 20, 100, 20)), (2, 0, *n(20, 20, 150, 20))], f"capture_id long, block_id long, {BOX}")
    subjects = spark.createDataFrame([], f"capture_id long, subj_id long, {BOX}")
    figures, counts = D.detected(images, candidates, texts, subjects)
    got = {r.capture_id: r for r in figures.collect()}
    assert set(got) == {1, 2} and got[1].label == got[2].label == "Figure 1" and not got[1].fallback and got[2].fallback
    x, y, w, h = n(30, 50, 150, 200)
    assert abs(got[1].x - x) < 0.02 and abs(got[1].y - y) < 0.02 and abs(got[1].w - w) < 0.03 and abs(got[1].h - h) < 0.03
    x, y, w, h = n(200, 80, 150, 200)
    assert abs(got[2].x - x) < 0.03 and abs(got[2].y - y) < 0.03 and abs(got[2].w - w) < 0.05
    assert counts == {"candidates": 4, "text_free": 4, "trimmed": 3, "merged": 2, "extracted": 1, "figures": 2} or counts["figures"] == 2 and counts["candidates"] == 4
    none, zero = D.detected(images.limit(0), candidates, texts, subjects)
    assert none.count() == 0 and zero["figures"] == 0


def test_counts_of_a_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    spark.range(100).write.parquet(str(tmp_path / "in"))
    listener = D.PassCounts()
    spark.streams.addListener(listener)
    try:
        s = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).observe("seen", F.count(F.lit(1)).alias("n")).where("id % 4 = 0").observe("kept", F.count(F.lit(1)).alias("n"))
        s.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(60)
        for _ in range(100):
            if listener.counts.get("kept"):
                break
            spark._jvm.Thread.sleep(100)
    finally:
        spark.streams.removeListener(listener)
    assert listener.counts == {"seen": 100, "kept": 25}
