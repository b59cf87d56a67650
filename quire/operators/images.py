"""Page images packed in one row each, and the raster statistics on them at a page's size.

``images``: capture_id, width, height, r, g, b, where each colour is a binary plane, row by row from the top. Where
pixels are missing, ``there`` (a plane of 0 and 1, null for whole images) says which there are: the others are in no
sum, mask or result. An
image moves as one row and is looked at by one small kernel, so a join or shuffle counts images, not pixels.
Sums over boxes come from summed-area tables: four reads a box, however large it is. Boxes in pixels are half
open (x1, y1, x2, y2); boxes of texts and figures are normalized with a bottom-left origin.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quire.functions import geometry as g
from quire.operators.raster import _components

PLANES = ["r", "g", "b"]
BOX = "x1 int, y1 int, x2 int, y2 int"


def per_image(rows: DataFrame, keep: list[str], kernel: Callable[[dict], list[tuple]], schema: str) -> DataFrame:
    """``kernel(row)`` for every row, which holds an image or parts of one; its tuples follow the ``keep`` columns."""

    def arrays(row: dict, kinds: list[pa.DataType]) -> list[pa.Array]:
        found = [(*(row[k] for k in keep), *t) for t in kernel(row)]
        return [pa.array(c, kind) for c, kind in zip(zip(*found, strict=True), kinds, strict=True)] if found else []

    return _per_image(rows, keep, arrays, schema)


def points(rows: DataFrame, keep: list[str], kernel: Callable[[dict], list[np.ndarray]], schema: str) -> DataFrame:
    """As ``per_image`` for many rows an image: the kernel gives whole columns of numbers."""

    def arrays(row: dict, kinds: list[pa.DataType]) -> list[pa.Array]:
        found = kernel(row)
        return [*(pa.repeat(pa.scalar(row[k], kind), len(found[0])) for k, kind in zip(keep, kinds)), *(pa.array(c, kind) for c, kind in zip(found, kinds[len(keep) :], strict=True))]

    return _per_image(rows, keep, arrays, schema)


def _per_image(rows: DataFrame, keep: list[str], arrays: Callable[[dict, list[pa.DataType]], list[pa.Array]], schema: str) -> DataFrame:
    out = StructType([*(rows.schema[k] for k in keep), *StructType.fromDDL(schema).fields])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one image at a time, so a task holds no more than that
                if found := arrays(batch.slice(i, 1).to_pylist()[0], arrow.types):
                    yield pa.RecordBatch.from_arrays(found, schema=arrow)

    return rows.mapInArrow(run, out)


def pixels_of(row: dict) -> np.ndarray:
    """The image of a row as height x width x 3."""
    return np.stack([np.frombuffer(row[c], np.uint8) for c in PLANES], axis=1).reshape(row["height"], row["width"], 3)


def there_of(row: dict) -> np.ndarray | None:
    """The pixels that a row's image has; nothing if it has all."""
    return np.frombuffer(row["there"], np.uint8).reshape(row["height"], row["width"]) > 0 if row.get("there") else None


def joined(images: DataFrame, other: DataFrame, how: str = "inner") -> DataFrame:
    """``images`` with what ``other`` has for them. Images are streamed: they are far larger than Spark estimates, and neither broadcast nor sorted."""
    return images.join(other.hint("shuffle_hash"), "capture_id", how)


def unpacked(images: DataFrame) -> DataFrame:
    """A row a pixel, as the operators of ``raster`` take it."""

    def kernel(row: dict) -> list[np.ndarray]:
        there = there_of(row)
        at = np.arange(row["width"] * row["height"]) if there is None else np.flatnonzero(there)
        return [at % row["width"], at // row["width"], *(np.frombuffer(row[c], np.uint8)[at] for c in PLANES)]

    return points(images, ["capture_id", "width", "height"], kernel, "px long, py long, r long, g long, b long")


def rows_of(images: DataFrame) -> DataFrame:
    """``capture_id, py, r, g, b``: an image row a row, each colour as hexadecimal digits; pixels that are not there are as they were packed."""

    def kernel(row: dict) -> list[tuple]:
        planes = [np.frombuffer(row[c], np.uint8).reshape(row["height"], row["width"]) for c in PLANES]
        return [(y, *(p[y].tobytes().hex() for p in planes)) for y in range(row["height"])]

    return per_image(images, ["capture_id"], kernel, "py long, r string, g string, b string")


class BoxSums:
    """Summed-area tables of an image's channels and of their squares."""

    def __init__(self, image: np.ndarray, there: np.ndarray | None = None):
        v = image.astype(np.int64)
        both = np.concatenate([v, v * v], axis=2)
        if there is not None:
            both = np.concatenate([both * there[:, :, None], there[:, :, None]], axis=2)
        self.counted = there is not None
        self.table = np.zeros((image.shape[0] + 1, image.shape[1] + 1, both.shape[2]), np.int64)
        self.table[1:, 1:] = both.cumsum(axis=0).cumsum(axis=1)

    def __call__(self, x1: int, y1: int, x2: int, y2: int) -> tuple[int, np.ndarray, np.ndarray]:
        """Pixels, sums and sums of squares of each channel inside the box, clipped to the image."""
        h, w = self.table.shape[0] - 1, self.table.shape[1] - 1
        x1, x2, y1, y2 = max(0, min(w, x1)), max(0, min(w, x2)), max(0, min(h, y1)), max(0, min(h, y2))
        if x1 >= x2 or y1 >= y2:
            return 0, np.zeros(3, np.int64), np.zeros(3, np.int64)
        s = self.table[y2, x2] - self.table[y1, x2] - self.table[y2, x1] + self.table[y1, x1]
        return int(s[6]) if self.counted else (x2 - x1) * (y2 - y1), s[:3], s[3:6]

    def variance(self, *box: int) -> float:
        """Mean of the channels' variances; 0 for less than two pixels."""
        n, s, q = self(*box)
        return float((q / n - (s / n) ** 2).mean()) if n > 1 else 0.0


def in_boxes(shape: tuple[int, int], boxes: list[tuple[int, int, int, int]]) -> np.ndarray:
    """The pixels under any of the boxes: corners are marked in a difference table and summed."""
    marks = np.zeros((shape[0] + 1, shape[1] + 1), np.int64)
    for x1, y1, x2, y2 in boxes:
        marks[y1, x1] += 1
        marks[y2, x2] += 1
        marks[y1, x2] -= 1
        marks[y2, x1] -= 1
    return marks.cumsum(axis=0).cumsum(axis=1)[:-1, :-1] > 0


def padded_boxes(texts: Column, width: Column, height: Column, least: float = 4, proportional: float = 0.6) -> Column:
    """Pixel boxes of texts (an array of boxes in pixels from the top left), padded by a share of their height and clipped."""

    def box(t: Column) -> Column:
        pad = F.greatest(F.lit(float(least)), F.round(t["h"] * proportional, 9))
        low = lambda v: F.floor(F.greatest(F.lit(0.0), F.round(v - pad, 6))).cast("int")
        high = lambda v, size: F.ceil(F.least(size.cast("double"), F.round(v + pad, 6))).cast("int")
        return F.struct(low(t["x"]).alias("x1"), low(t["y"]).alias("y1"), high(t["x"] + t["w"], width).alias("x2"), high(t["y"] + t["h"], height).alias("y2"))

    return F.filter(F.transform(texts, box), lambda b: (b["x2"] > b["x1"]) & (b["y2"] > b["y1"]))


def in_pixels(texts: DataFrame, key: str = "capture_id") -> DataFrame:
    """``key, texts``: the normalized boxes of each page in one array, to be scaled by the image they meet."""
    return texts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*(F.col(k).cast("double").alias(k) for k in "xywh")))).alias("texts"))


def scaled_boxes(texts: Column, width: Column, height: Column) -> Column:
    """Normalized boxes with a bottom-left origin as boxes in pixels from the top left."""

    def box(t: Column) -> Column:
        p = g.Rect(t["x"], t["y"], t["w"], t["h"]).flipped().scaled(width, height)
        return F.struct(*p.named(places=6))

    return F.transform(texts, box)


def with_texts(images: DataFrame, texts: DataFrame) -> DataFrame:
    """``images`` with the boxes of their texts in pixels; none where a page has no text."""
    d = joined(images, in_pixels(texts), "left")
    none = F.array().cast("array<struct<x:double,y:double,w:double,h:double>>")
    return d.withColumn("texts", F.coalesce(scaled_boxes(F.col("texts"), F.col("width"), F.col("height")), none))


def text_mask(images: DataFrame, texts: DataFrame, least: float = 4, proportional: float = 0.6) -> DataFrame:
    """``capture_id, width, height, mask``: the pixels under padded texts as a binary plane of 0 and 1."""
    d = with_texts(images, texts).withColumn("boxes", padded_boxes(F.col("texts"), F.col("width"), F.col("height"), least, proportional))

    def kernel(row: dict) -> list[tuple]:
        boxes = [(b["x1"], b["y1"], b["x2"], b["y2"]) for b in row["boxes"]]
        mask, there = in_boxes((row["height"], row["width"]), boxes), there_of(row)
        return [((mask if there is None else mask & there).astype(np.uint8).tobytes(),)]

    return per_image(d.select("capture_id", "width", "height", "boxes", *(c for c in d.columns if c == "there")), ["capture_id", "width", "height"], kernel, "mask binary")


def mask_pixels(masks: DataFrame) -> DataFrame:
    """``capture_id, px, py`` of the set pixels of masks."""

    def kernel(row: dict) -> list[np.ndarray]:
        return list(np.nonzero(np.frombuffer(row["mask"], np.uint8).reshape(row["height"], row["width"])))[::-1]

    return points(masks, ["capture_id"], kernel, "px long, py long")


def dilate(mask: np.ndarray, radius: int) -> np.ndarray:
    """The pixels within ``radius`` of the mask: for each row offset a running count as wide as the disc is there."""
    h, w = mask.shape
    count = np.zeros((h, w + 1), np.int64)
    count[:, 1:] = mask.cumsum(axis=1)
    out = np.zeros((h, w), bool)
    at = np.arange(w)
    for dy in range(-min(radius, h - 1), min(radius, h - 1) + 1):
        half = math.isqrt(radius * radius - dy * dy)
        near = count[:, np.minimum(w, at + half + 1)] > count[:, np.maximum(0, at - half)]
        if dy >= 0:
            out[dy:] |= near[: h - dy]
        else:
            out[:dy] |= near[-dy:]
    return out


def dilated(masks: DataFrame, radius: int) -> DataFrame:
    """``masks`` grown by a disc; the work follows the image and the radius, not the number of set pixels."""

    def kernel(row: dict) -> list[tuple]:
        m = np.frombuffer(row["mask"], np.uint8).reshape(row["height"], row["width"]) > 0
        return [(dilate(m, radius).astype(np.uint8).tobytes(),)]

    return per_image(masks, ["capture_id", "width", "height"], kernel, "mask binary")


def region_variance(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """``capture_id, box_id, variance`` of each pixel box (capture_id, box_id, x, y, w, h from the top left).

    Boxes that hold none of the pixels of an image with missing ones have no row.
    """
    b = boxes.groupBy("capture_id").agg(F.collect_list(F.struct("box_id", *(F.col(k).cast("int").alias(k) for k in "xywh"))).alias("boxes"))

    def kernel(row: dict) -> list[tuple]:
        sums = BoxSums(pixels_of(row), there_of(row))
        boxes = [(b["box_id"], (b["x"], b["y"], b["x"] + b["w"], b["y"] + b["h"])) for b in row["boxes"]]
        return [(i, round(sums.variance(*b), 6)) for i, b in boxes if not sums.counted or sums(*b)[0]]

    return per_image(joined(images, b), ["capture_id"], kernel, "box_id long, variance double")


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of the channels' differences at each pixel; a third of it is the mean difference."""
    return np.abs(a.astype(np.int64) - b).sum(axis=2)


def preserved(original: np.ndarray, changed: np.ndarray, same: float = 15, least: float = 70, most: float = 5, there: np.ndarray | None = None) -> tuple[float, float, bool]:
    """Percent of pixels that a change leaves nearly alone, their mean difference, and whether that is enough."""
    d = difference(original, changed)
    d = d if there is None else d[there]
    kept = d < 3 * same
    percent = round(int(kept.sum()) / d.size * 100, 6)
    mean = round(int(d[kept].sum()) / 3 / int(kept.sum()), 6) if kept.any() else 999.0
    return percent, mean, percent >= least and mean <= most


def ring_damage(first: np.ndarray, second: np.ndarray, mask: np.ndarray, box: tuple[int, int, int, int], margin: int = 20, threshold: float = 20) -> float:
    """Percent of the pixels around a box, outside it and the mask, that differ strongly between two images; 0 without any."""
    x1, y1, x2, y2 = box
    top, left = max(0, y1 - margin), max(0, x1 - margin)
    near = np.s_[top : y2 + margin, left : x2 + margin]
    outside = ~mask[near]
    outside[max(0, y1 - top) : max(0, y2 - top), max(0, x1 - left) : max(0, x2 - left)] = False
    n = int(outside.sum())
    hit = difference(first[near], second[near]) > 3 * threshold
    return round(int((hit & outside).sum()) / n * 100, 6) if n else 0.0


def validated(original: DataFrame, changed: DataFrame, mask: DataFrame, boxes: DataFrame, margin: int = 20) -> DataFrame:
    """``capture_id, percent, mean_diff, accepted, damage`` of two versions of an image and one box a capture."""
    other = changed.select("capture_id", *(F.col(c).alias(f"o{c}") for c in PLANES))
    d = original.join(other, "capture_id").join(mask.select("capture_id", "mask"), "capture_id").join(boxes.select("capture_id", *(F.col(k).cast("int").alias(k) for k in "xywh")), "capture_id")

    def kernel(row: dict) -> list[tuple]:
        a, b = pixels_of(row), pixels_of(row | {c: row[f"o{c}"] for c in PLANES})
        m = np.frombuffer(row["mask"], np.uint8).reshape(row["height"], row["width"]) > 0
        box = (row["x"], row["y"], row["x"] + row["w"], row["y"] + row["h"])
        there = there_of(row)
        return [(*preserved(a, b, there=there), ring_damage(a, b, m if there is None else m | ~there, box, margin))]

    return per_image(d, ["capture_id"], kernel, "percent double, mean_diff double, accepted boolean, damage double")


def saturated(image: np.ndarray, saturation: float = 0.40, value: float = 0.25) -> np.ndarray:
    """The pixels of strong colour."""
    high, low = image.max(axis=2).astype(float), image.min(axis=2)
    return (np.where(high > 10, (high - low) / np.maximum(high, 1), 0.0) > saturation) & (high / 255.0 > value)


def flat(image: np.ndarray, most: float = 26, there: np.ndarray | None = None) -> np.ndarray:
    """The pixels whose 3 x 3 neighbourhood spans at most ``most`` in every channel."""
    h, w = image.shape[:2]

    def end(best: Callable, missing: int) -> np.ndarray:  # along one axis, then along the other
        v = image.astype(np.int16)
        if there is not None:
            v[~there] = missing
        pad = np.pad(v, ((1, 1), (1, 1), (0, 0)), mode="edge")
        pad = best(best(pad[:h], pad[1 : h + 1]), pad[2:])
        return best(best(pad[:, :w], pad[:, 1 : w + 1]), pad[:, 2:])

    return (end(np.maximum, -1) - end(np.minimum, 256)).max(axis=2) <= most


def anchor_colour(first: np.ndarray, original: np.ndarray, anchors: np.ndarray, wide: float = 0.45, long: float = 4.5, colour: float = 44, reach: float = 1.75, most: float = 26, there: np.ndarray | None = None) -> np.ndarray:
    """Pixels near an anchor (rows x, y, w, h in pixels) in the colour of the ring around it, in flat surroundings."""
    h, w = original.shape[:2]
    sums, out, even = BoxSums(first, there), np.zeros((h, w), bool), flat(first, most, there)
    for x, y, aw, ah in anchors.tolist():
        if aw / w > wide or max(aw, ah) / max(1.0, min(aw, ah)) > long:
            continue
        box = lambda m: (math.floor(x - m), math.floor(y - m), math.ceil(x + aw + m), math.ceil(y + ah + m))  # noqa: B023, E731
        n, s, _ = sums(*box(3.0))
        inner = (math.ceil(x), math.ceil(y), math.ceil(x + aw), math.ceil(y + ah))  # pixels whose corner lies on the anchor
        n_in, s_in, _ = sums(*inner)
        if n == n_in:
            continue
        fill = (s - s_in) / (n - n_in)
        x1, y1, x2, y2 = box(ah * reach)
        part = np.s_[max(0, y1) : max(0, y2), max(0, x1) : max(0, x2)]
        away = np.sqrt(((original[part] - fill) ** 2).sum(axis=2))
        out[part] |= np.round(away, 9) <= colour
    return out & even if there is None else out & even & there


def components(mask: np.ndarray, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows and columns of the mask's four-connected components with at least ``least`` pixels, by their first pixel."""
    y, x = np.nonzero(mask)
    return [(y[p], x[p]) for p in _components(x, y) if len(p) >= least] if len(y) else []


def shape(y: np.ndarray, x: np.ndarray) -> tuple[int, int, int, int, float, float]:
    """Box (x, y, w, h), compactness and balance of a component."""
    x1, y1, w, h = int(x.min()), int(y.min()), int(np.ptp(x)) + 1, int(np.ptp(y)) + 1
    return x1, y1, w, h, len(x) / (w * h), min(w, h) / max(w, h)


def surface(image: np.ndarray, y: np.ndarray, x: np.ndarray, present: np.ndarray | None = None) -> tuple[float, float]:
    """Uniformity of a component's colour, and the mean colour step from about 200 of its pixels to those outside."""
    v = image[y, x].astype(np.int64)
    n = len(v)
    variance = float((np.square(v).sum(axis=0) / n - (v.sum(axis=0) / n) ** 2).sum() / 3)
    inside = np.zeros((image.shape[0] + 2, image.shape[1] + 2), bool)
    inside[y + 1, x + 1] = True
    if present is not None:
        inside[1:-1, 1:-1] |= ~present
    pick = np.arange(0, n, max(1, n // 200))
    total, count = 0, 0
    for dx, dy in ((-1, 0), (1, 0), (0, -1), (0, 1)):
        ny, nx = y[pick] + dy, x[pick] + dx
        there = (ny >= 0) & (nx >= 0) & (ny < image.shape[0]) & (nx < image.shape[1]) & ~inside[ny + 1, nx + 1]
        total += int(np.abs(v[pick][there] - image[ny[there], nx[there]]).sum())
        count += int(there.sum())
    return 1 / (1 + variance / 2000), total / count / 3 if count else 0.0


def component_stats(images: DataFrame, masks: DataFrame, least: int = 50) -> DataFrame:
    """Components of at least ``least`` mask pixels of each image with shape, uniformity and boundary contrast."""
    d = images.join(masks.select("capture_id", "mask"), "capture_id")

    def kernel(row: dict) -> list[tuple]:
        img, there, out = pixels_of(row), there_of(row), []
        m = np.frombuffer(row["mask"], np.uint8).reshape(row["height"], row["width"]) > 0
        m = m if there is None else m & there
        for y, x in components(m, least):
            x1, y1, w, h, compact, balance = shape(y, x)
            uniform, contrast = surface(img, y, x, there)
            out.append((int(y[0]) * row["width"] + int(x[0]), x1, y1, w, h, len(x), *(round(v, 6) for v in (compact, balance, uniform, contrast))))
        return out

    return per_image(d, ["capture_id"], kernel, "first_pixel long, x long, y long, w long, h long, n long, compactness double, shape_balance double, uniformity double, boundary_contrast double")


def masked(images: DataFrame, rule: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``capture_id, width, height, mask`` by a rule on the image (height x width x 3)."""
    kernel = lambda row: [(rule(pixels_of(row)).astype(np.uint8).tobytes(),)]
    return per_image(images, ["capture_id", "width", "height"], kernel, "mask binary")


def filled(image: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Retouching substitute: masked pixels become the harmonic surface over the pixels around them.

    Every masked pixel is the mean of its neighbours in the image, so each masked component depends on its own
    ring alone and a linear ramp comes back exactly. Values half-way between two numbers go up. An image
    without an unmasked pixel stays as it is.
    """
    out = image.copy()
    if mask.all():
        return out
    for y, x in components(mask, 1):
        y1, y2, x1, x2 = (int(v) for v in (max(0, y.min() - 1), y.max() + 2, max(0, x.min() - 1), x.max() + 2))
        part, own = image[y1:y2, x1:x2].astype(float), np.zeros((min(y2, mask.shape[0]) - y1, min(x2, mask.shape[1]) - x1), bool)
        own[y - y1, x - x1] = True
        out[y, x] = np.clip(np.floor(_harmonic(part, own)[own] + 0.5 + 1e-6), 0, 255).astype(np.uint8)
    return out


def _harmonic(part: np.ndarray, own: np.ndarray, close: float = 1e-18) -> np.ndarray:
    """The equations of one masked component (``own``), by conjugate gradients on its pixels alone; what lies outside it is given."""
    y, x = np.nonzero(own)
    n = len(y)
    at = np.full((own.shape[0] + 2, own.shape[1] + 2), n)  # the place of each pixel of the component; n elsewhere
    at[y + 1, x + 1] = np.arange(n)
    given = np.zeros((own.shape[0] + 2, own.shape[1] + 2, 3))
    given[1:-1, 1:-1] = np.where(own[:, :, None], 0, part)
    there = np.zeros(at.shape)
    there[1:-1, 1:-1] = 1
    near = [(y + 1 + dy, x + 1 + dx) for dy, dx in ((-1, 0), (1, 0), (0, -1), (0, 1))]
    beside = [at[p] for p in near]
    degree = sum(there[p] for p in near)[:, None]

    def times(v: np.ndarray) -> np.ndarray:  # v has a row of zeros behind
        out = degree * v[:-1]
        for k in beside:
            out -= v.take(k, axis=0)
        return out

    v, d = np.zeros((n + 1, 3)), np.zeros((n + 1, 3))
    v[:-1] = part[~own].mean(axis=0)
    r = sum(given[p] for p in near) - times(v)
    d[:-1] = r
    size = (r * r).sum(axis=0)
    for _ in range(4 * n + 100):
        if size.max() <= close:
            break
        q = times(d)
        step = size / np.maximum((d[:-1] * q).sum(axis=0), 1e-300)
        v += step * d
        r -= step * q
        new = (r * r).sum(axis=0)
        d[:-1] *= new / np.maximum(size, 1e-300)
        d[:-1] += r
        size = new
    out = part.copy()
    out[y, x] = v[:-1]
    return out


def harmonic_fill(images: DataFrame, masks: DataFrame) -> DataFrame:
    """``images`` with the pixels of their masks retouched, see ``filled``."""
    d = images.join(masks.select("capture_id", "mask"), "capture_id")

    def kernel(row: dict) -> list[tuple]:
        m = np.frombuffer(row["mask"], np.uint8).reshape(row["height"], row["width"]) > 0
        img = filled(pixels_of(row), m)
        return [tuple(np.ascontiguousarray(img[:, :, k]).tobytes() for k in range(3))]

    return per_image(d, ["capture_id", "width", "height"], kernel, "r binary, g binary, b binary")
