"""The figure detector as one job: candidates to figures, and a second way for pages where none is left.

``candidates``: capture_id, cand_id, source, confidence, x, y, w, h; ``texts``: capture_id, block_id, x, y, w, h;
``subjects``: capture_id, subj_id, x, y, w, h (all normalized, bottom-left); ``images`` packed. Each pass is a
DataFrame; its rows are counted by observations while the job runs, so no count is a scan of its own.
"""

from __future__ import annotations

import numpy as np
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.window import Window

from quire.functions import geometry as g
from quire.operators import images as I
from quire.operators import raster, regions, relations
from quire.sources.files import shared_path

LEAST_AREA = 0.03


def _stride(size: int, samples: int) -> int:
    return max(1, size // samples)


def background(image: np.ndarray, there: np.ndarray | None = None) -> np.ndarray | None:
    """Mean colour of the patches in the most frequent brightness class, as ``raster.background``; nothing if no patch has a pixel."""
    h, w = image.shape[:2]
    patch = min(8, min(w, h) // 4)
    inset = max(patch, min(w, h) // 30)
    bins: dict[int, list[np.ndarray]] = {}
    for gx in range(4):
        for gy in range(4):
            at = [inset + (size - 2 * inset - patch) * k // 3 for size, k in ((h, gy), (w, gx))]
            rows, cols = (np.minimum(size - 1, a + np.arange(max(patch, 1))) for a, size in zip(at, (h, w), strict=True))
            part = image[np.ix_(rows, cols)].reshape(-1, 3)
            part = part if there is None else part[there[np.ix_(rows, cols)].ravel()]
            if not len(part):
                continue
            mean = part.mean(axis=0)
            bins.setdefault(int(mean.sum() / 3 // 40), []).append(np.round(mean, 9))
    if not bins:
        return None
    best = min(bins, key=lambda b: (-len(bins[b]), b))
    return np.round(np.mean(bins[best], axis=0), 6)


def content_cells(image: np.ndarray, texts: list[dict], grid: int, threshold: float, there: np.ndarray | None = None) -> list[np.ndarray]:
    """Column, row and kind (0 background, 1 text, 2 content) of every grid cell whose centre is there, judged at it."""
    page = background(image, there)
    if page is None:
        return [np.zeros(0, int)] * 3
    h, w = image.shape[:2]
    mid = (np.arange(grid) + 0.5) / grid
    nx, ny = (v.ravel() for v in np.meshgrid(mid, 1 - mid))
    px = np.clip(np.floor(np.round(nx * w, 9)), 0, w - 1).astype(int)
    py = np.clip(np.floor(np.round((1 - ny) * h, 9)), 0, h - 1).astype(int)
    kind = np.where(np.round(np.abs(image[py, px] - page).sum(axis=1), 6) > 3 * threshold, 2, 0)
    for t in texts:
        kind[(nx >= t["x"]) & (nx < t["x"] + t["w"]) & (ny >= t["y"]) & (ny < t["y"] + t["h"])] = 1
    at = np.arange(grid * grid) if there is None else np.flatnonzero(there[py, px])
    return [at % grid, at // grid, kind[at]]


def content_map(images: DataFrame, texts: DataFrame, grid: int = 50, threshold: float = 20.0) -> DataFrame:
    """``capture_id, gx, gy, cell`` of packed images, as ``raster.content_map``."""
    none = F.array().cast("array<struct<x:double,y:double,w:double,h:double>>")
    d = I.joined(images, I.in_pixels(texts), "left").withColumn("texts", F.coalesce("texts", none))
    cells = I.points(d, ["capture_id"], lambda row: content_cells(I.pixels_of(row), row["texts"], grid, threshold, I.there_of(row)), "gx int, gy int, kind int")
    names = F.array(F.lit("background"), F.lit("text"), F.lit("content"))
    return cells.select("capture_id", "gx", "gy", F.get(names, F.col("kind")).alias("cell"))


def colour_deviation(image: np.ndarray, most: int = 100, there: np.ndarray | None = None) -> float:
    """Root of the summed channel variances over pixels at strides, at most about ``most`` a side; 0 without pixels."""
    at = np.s_[:: _stride(image.shape[0], most), :: _stride(image.shape[1], most)]
    s = image[at].reshape(-1, 3).astype(np.int64)
    s = s if there is None else s[there[at].ravel()]
    n = len(s)
    if not n:
        return 0.0
    return round(float(np.sqrt(max(0.0, ((s * s).sum(axis=0) / n - (s.sum(axis=0) / n) ** 2).sum()))), 6)


def auto_crop(image: np.ndarray, page: float | None = None, threshold: float = 20.0, bright: float = 200.0, share: float = 0.05) -> tuple[int, int, int, int]:
    """The box (x, y, w, h) inside a light margin, as ``raster.auto_cropped``."""
    h, w = image.shape[:2]
    whole, total = (0, 0, w, h), image.astype(np.int64).sum(axis=2)
    rows, cols = np.s_[:: _stride(h, 20)], np.s_[:: _stride(w, 20)]
    top, bottom, left, right = (round(float(v.mean() / 3.0), 6) for v in (total[0, cols], total[-1, cols], total[rows, 0], total[rows, -1]))
    bg = page if page is not None and page > bright else max(top, bottom, left, right)
    if bg <= bright or w <= 4 or h <= 4:
        return whole
    off = np.abs(total / 3.0 - bg) > threshold

    def ends(at: np.ndarray, n: int) -> tuple[int, int]:
        has = np.flatnonzero(at >= share)
        return (int(has[0]), int(has[-1])) if len(has) else (0, n - 1)

    x1, x2 = ends(off[:: _stride(h, 40)].mean(axis=0), w)
    y1, y2 = ends(off[:, :: _stride(w, 40)].mean(axis=1), h)
    edge = max(2, min(w, h) // 50)
    pad = lambda gap: 0 if gap >= 4 else edge
    cx, cy = max(0, x1 - pad(x1)), max(0, y1 - pad(y1))
    cw, ch = min(w - 1, x2 + pad(w - 1 - x2)) - cx + 1, min(h - 1, y2 + pad(h - 1 - y2)) - cy + 1
    guard = max(w, h) / min(w, h) > 2 and 1 - min(cw, ch) / min(w, h) > 0.10
    up, down = (0 if guard and top < 240 and y1 > 0 else cy), (h if guard and bottom < 240 else cy + ch)
    use = x1 < x2 and y1 < y2 and (cw < w - 4 or ch < h - 4) and cw > 4 and down - up > 4
    return (cx, up, cw, down - up) if use else whole


def tighten(image: np.ndarray, floor: float = 15.0, least_size: int = 20) -> tuple[int, int, int, int]:
    """The box left when low-variance strips at the edges go, as ``raster.tightened``."""
    h, w = image.shape[:2]
    total = image.astype(np.int64).sum(axis=2)

    def ends(strips: np.ndarray) -> tuple[int, int] | None:
        n = strips.shape[1]
        var = (np.square(strips).sum(axis=1) / n - (strips.sum(axis=1) / n) ** 2) / 9.0
        dev = np.round(np.sqrt(np.maximum(0.0, var)), 6) if n > 1 else np.zeros(len(strips))
        over = np.flatnonzero(dev >= max(np.sort(dev)[len(dev) // 2] * 1.5, floor))
        return (int(over[0]), int(over[-1])) if len(over) else None

    across, down = ends(total[:: _stride(h, 30)].T), ends(total[:, :: _stride(w, 30)])
    if across is None or down is None or w <= least_size or h <= least_size:
        return 0, 0, w, h
    box = []
    for (a, b), size in ((across, w), (down, h)):
        margin = max(4, (b - a) // 20)
        low = max(0, a - margin)
        box += [low, min(size - low, b - a + 2 * margin)]
    x, cw, y, ch = box
    enough = cw < w * 0.85 or ch < h * 0.85
    guarded = max(w, h) / min(w, h) > 2 and 1 - min(cw, ch) / min(w, h) > 0.20
    use = across[0] < across[1] and down[0] < down[1] and enough and not guarded and cw > 10 and ch > 10
    return (x, y, cw, ch) if use else (0, 0, w, h)


def extracted(candidates: DataFrame, images: DataFrame, texts: DataFrame, subjects: DataFrame, least_deviation: float = 20.0, refine: bool = True) -> DataFrame:
    """``capture_id, cand_id, x, y, w, h`` of the candidates that hold a figure, cut to what they show.

    Thin strips, candidates with over a tenth of their area under text, and crops of little colour go. What
    stays is cropped of light margins, then of strips of low variance unless a subject confirms it; a crop that
    would keep less than 15 % stays whole. ``refine`` false leaves the boxes as they are.
    """
    a, b = g.rect("a"), g.rect("b")
    d = candidates.select("capture_id", "cand_id", *(F.col(k).cast("double").alias(k) for k in "xywh")).where(F.col("w") / F.greatest("h", F.lit(0.001)) >= 0.15)
    d = relations.text_overlap(d, texts).where(F.col("text_overlap") <= 0.10).drop("text_overlap")
    held = relations.pairs(d, subjects, ["cand_id"], []).where(F.round(g.share_inside(b, a), 9) > 0.20).select("capture_id", "cand_id").distinct().withColumn("sure", F.lit(True))
    d = d.join(held, ["capture_id", "cand_id"], "left").groupBy("capture_id").agg(F.array_sort(F.collect_list(F.struct("cand_id", "x", "y", "w", "h", F.coalesce("sure", F.lit(False)).alias("sure")))).alias("found"))

    def kernel(row: dict) -> list[tuple]:
        img, out = I.pixels_of(row), []
        h, w = img.shape[:2]
        there = I.there_of(row)
        bg = background(img, there)
        for c in row["found"]:
            edge = lambda v, size, f: int(min(size, max(0, f(round(v, 6)))))
            x1, x2 = edge(c["x"] * w, w, np.floor), edge((c["x"] + c["w"]) * w, w, np.ceil)
            y1, y2 = edge((1 - c["y"] - c["h"]) * h, h, np.floor), edge((1 - c["y"]) * h, h, np.ceil)
            crop = img[y1:y2, x1:x2]
            if not crop.size or colour_deviation(crop, there=None if there is None else there[y1:y2, x1:x2]) < least_deviation:
                continue
            cut = auto_crop(crop, None if bg is None else float(bg.sum() / 3)) if refine else (0, 0, x2 - x1, y2 - y1)
            if refine and not c["sure"]:
                tx, ty, tw, th = tighten(crop[cut[1] : cut[1] + cut[3], cut[0] : cut[0] + cut[2]])
                cut = (cut[0] + tx, cut[1] + ty, tw, th)
            if cut[2] * cut[3] < 0.15 * crop.shape[0] * crop.shape[1] or cut[2:] == (x2 - x1, y2 - y1):
                out.append((c["cand_id"], *(round(c[k], 6) for k in "xywh")))
            else:
                out.append((c["cand_id"], round((x1 + cut[0]) / w, 6), round(1 - (y1 + cut[1] + cut[3]) / h, 6), round(cut[2] / w, 6), round(cut[3] / h, 6)))
        return out

    return I.per_image(I.joined(images, d), ["capture_id"], kernel, "cand_id long, x double, y double, w double, h double")


def fallback_candidates(images: DataFrame, texts: DataFrame) -> DataFrame:
    """``capture_id, cand_id, x, y, w, h``: the large connected content regions of whole pages."""
    found = raster.content_regions(content_map(images, texts))
    return found.where(F.round(F.col("w") * F.col("h"), 9) >= LEAST_AREA).select("capture_id", F.col("region_id").alias("cand_id"), "x", "y", "w", "h")


def with_fallback(found: DataFrame, images: DataFrame, texts: DataFrame, subjects: DataFrame, refine: bool = True) -> DataFrame:
    """``found`` with ``fallback`` false, and what whole-page content gives on pages that have none, with true."""
    left = I.joined(images, found.select("capture_id").distinct(), "left_anti")
    more = extracted(fallback_candidates(left, texts), left, texts, subjects, refine=refine)
    return found.withColumn("fallback", F.lit(False)).unionByName(more.withColumn("fallback", F.lit(True)))


def detected(images: DataFrame, candidates: DataFrame, texts: DataFrame, subjects: DataFrame, refine: bool = True) -> tuple[DataFrame, dict[str, int]]:
    """``capture_id, label, x, y, w, h, fallback`` of all figures, and how many rows each pass gave.

    First pass: candidates free of text, trimmed of it, large enough, with what subjects add to their
    confidence; second: overlapping ones merged in the order of their ids, then such side by side; third:
    cut out and judged (``extracted``); last: pages without a figure go the second way. What the first passes
    find is written to the shared folder, as both ways read it.
    """
    spark, seen = images.sparkSession, {}

    def counted(df: DataFrame, name: str) -> DataFrame:
        seen[name] = Observation(name)
        return df.observe(seen[name], F.count(F.lit(1)).alias("n"))

    free = counted(relations.text_free(counted(candidates, "candidates"), texts).drop("text_overlap"), "text_free")
    cut = regions.trimmed(free, texts).where(F.round(F.col("w") * F.col("h"), 9) >= LEAST_AREA)
    large = counted(cut, "trimmed")
    merged = regions.merged(large, regions.like_enough()).withColumnRenamed("merged_id", "cand_id")
    merged = counted(regions.merged(merged, regions.side_by_side()).withColumnRenamed("merged_id", "cand_id"), "merged")
    found = counted(extracted(merged, images, texts, subjects, refine=refine), "extracted")
    path = shared_path(spark, "figures")
    found.write.parquet(f"{path}/main")
    every = counted(with_fallback(spark.read.schema(found.schema).parquet(f"{path}/main"), images, texts, subjects, refine), "figures")
    every.write.parquet(f"{path}/all")
    every = spark.read.schema(every.schema).parquet(f"{path}/all")
    number = F.row_number().over(Window.partitionBy("capture_id").orderBy("cand_id")).cast("string")
    figures = every.select("capture_id", F.concat(F.lit("Figure "), number).alias("label"), "x", "y", "w", "h", "fallback")
    return figures, {k: _observed(o) for k, o in seen.items()}


def _observed(o: Observation) -> int:
    """The count of an observation; 0 where Spark left its part of the plan out, as its input is known to be empty."""
    try:
        return o.get["n"]
    except Py4JJavaError:
        return 0


class PassCounts(StreamingQueryListener):
    """Sums the counts that a stream's plan observes, batch by batch, under the names of the observations."""

    def __init__(self) -> None:
        self.counts: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for name, row in (event.progress.observedMetrics or {}).items():
            self.counts[name] = self.counts.get(name, 0) + row.n

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
