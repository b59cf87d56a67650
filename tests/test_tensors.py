"""Resampling, tensors and formatted text on small cases."""

import numpy as np
import pytest

from quire.operators import images as I
from quire.operators import reading
from quire.operators import tensors as T
from test_images import images_of, packed


@pytest.mark.parametrize("old,new", [(1, 1), (1, 5), (5, 1), (8, 3), (3, 8), (100, 99), (7, 7), (640, 100)])
def test_weights(old, new):
    w = T.weights(old, new)
    assert w.shape == (new, old) and np.allclose(w.sum(axis=1), 1) and (w >= 0).all()
    if new <= old:
        assert np.allclose(w.sum(axis=0), new / old)  # every pixel counts alike
    else:
        assert np.count_nonzero(w, axis=1).max() <= 2


def plain(img, width, height):
    """Pixel by pixel: areas where an axis shrinks, between two neighbours where it grows."""

    def along(n_old, n_new, i):
        if n_new <= n_old:
            a, b = i * n_old / n_new, (i + 1) * n_old / n_new
            return [(j, (min(b, j + 1) - max(a, j)) * n_new / n_old) for j in range(n_old) if min(b, j + 1) > max(a, j)]
        c = min(n_old - 1, max(0, (i + 0.5) * n_old / n_new - 0.5))
        j = int(c)
        return [(j, 1 - (c - j))] + ([(j + 1, c - j)] if c > j else [])

    out = np.zeros((height, width, 3))
    for y in range(height):
        for x in range(width):
            out[y, x] = sum(u * v * img[j, i].astype(float) for j, u in along(img.shape[0], height, y) for i, v in along(img.shape[1], width, x))
    return np.floor(np.round(out, 6) + 0.5).astype(np.uint8)


def test_resample_matches_a_plain_version(spark):
    rng = np.random.default_rng(1)
    img = rng.integers(0, 256, (9, 13, 3)).astype(np.uint8)
    for size in ((13, 9), (5, 4), (20, 4), (5, 17), (31, 30), (1, 1)):
        assert (T.resample(img, *size) == plain(img, *size)).all()
    flat = np.full((7, 5, 3), 77, np.uint8)
    assert (T.resample(flat, 11, 3) == 77).all()
    assert images_of(T.resampled(packed(spark, {1: img}), 5, 4))[1].tolist() == plain(img, 5, 4).tolist()
    assert T.resampled(packed(spark, {1: img}).limit(0), 5, 4).count() == 0


def test_pixels_to_tensors_and_back(spark):
    rng = np.random.default_rng(2)
    pages = {1: rng.integers(0, 256, (40, 64, 3)).astype(np.uint8), 2: rng.integers(0, 256, (64, 33, 3)).astype(np.uint8)}
    t = T.to_tensors(packed(spark, pages), 64)
    rows = {r.capture_id: r for r in t.collect()}
    assert (rows[1].tensor_width, rows[1].tensor_height, rows[1].left, rows[1].top) == (64, 64, 0, 12)
    assert (rows[2].tensor_width, rows[2].tensor_height, rows[2].left, rows[2].top) == (64, 64, 15, 0)
    v = np.array(rows[1].data, np.float32).reshape(3, 64, 64)
    assert np.allclose(v[:, :12], 114 / 255) and np.allclose(v[:, 12:52].transpose(1, 2, 0), pages[1] / 255)
    back = images_of(T.from_tensors(t))
    assert all((back[c] == pages[c]).all() for c in pages)
    from pyspark.sql import functions as F

    wild = t.withColumn("data", F.transform("data", lambda x: (x - 0.5) * 1000))
    assert set(np.unique(images_of(T.from_tensors(wild, 1.0))[1])) <= set(range(256))  # clamped
    assert set(np.unique(images_of(T.from_tensors(wild, 1.0))[1])) >= {0, 255}
    masks = spark.createDataFrame([(1, 4, 1, bytes([0, 128, 129, 255]))], "capture_id long, width long, height long, mask binary")
    assert T.mask_tensors(masks).first().data == [0, 0, 1, 1]


def test_formatted_text(spark):
    line = lambda c, b, text, x, y, w=0.3: (c, b, text, x, y, w, 0.02)
    rows = [
        line(1, 0, "first", 0.1, 0.90), line(1, 1, "second", 0.1, 0.87), line(1, 2, "new paragraph", 0.1, 0.75), line(1, 3, "third one", 0.1, 0.60),
        line(2, 0, "title", 0.05, 0.95, 0.9), line(2, 1, "left 1", 0.05, 0.90), line(2, 2, "right 1", 0.55, 0.90), line(2, 3, "left 2", 0.05, 0.87), line(2, 4, "right 2", 0.55, 0.87),
        line(3, 0, "list", 0.1, 0.90), line(3, 1, "- item", 0.12, 0.87), line(3, 2, "- sub", 0.141, 0.84), line(3, 3, "- item", 0.119, 0.81),
    ]
    d = spark.createDataFrame(rows, "capture_id long, block_id long, text string, x double, y double, w double, h double")
    got = {r.capture_id: r.formatted_text for r in reading.formatted_text(d).collect()}
    assert got[1] == "first\nsecond\n\nnew paragraph\n\nthird one"
    assert got[2] == "title\n\nleft 1\nleft 2\n\nright 1\nright 2"
    assert got[3] == "list\n  - item\n    - sub\n  - item"
    assert reading.formatted_text(d.limit(0)).count() == 0 and I.PLANES == ["r", "g", "b"]
