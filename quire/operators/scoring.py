"""Classification of overlay text, boundary hypotheses, and scoring of what a retouch left behind."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import geometry as g
from quire.operators import raster, relations


def text_pixels(text: g.Rect, width: Column, height: Column) -> dict[str, Column]:
    """The pixel rows and columns that a text covers, both ends included."""
    at = lambda v, size, low: F.floor(F.round(F.greatest(F.lit(0.0), v * size) if low else F.least(size - 1.0, v * size), 6)).cast("long")
    return {"x1": at(text.x, width, True), "x2": at(text.x2, width, False), "y1": at(1 - text.y2, height, True), "y2": at(1 - text.y, height, False)}


def overlay_evidence(pairs: DataFrame, pixels: DataFrame, page: DataFrame, off: float = 50.0, dark: float = 180.0) -> DataFrame:
    """``capture_id, block_id, fig_idx, above, below, coherence`` for text (b*) and figure (a*) pairs.

    ``above`` and ``below``: the share of sampled columns in which unbroken picture reaches at least half a
    text height beyond the text; ``coherence``: the share of sampled pixels under the text that are picture.
    Picture is what differs from the page's colour; a dark page counts as nearly white.
    """
    keys = ["capture_id", "block_id", "fig_idx"]
    size = raster.sizes(pixels)
    d = pairs.join(size, "capture_id").withColumns(text_pixels(g.rect("b"), F.col("width"), F.col("height")))
    th, tw = F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")
    count = F.greatest(F.lit(3), F.least(F.lit(20), F.floor(tw / 30) + 1)).cast("int")
    step = F.greatest(F.lit(1), F.floor(tw / count))
    cols = F.filter(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.col("x1") + F.floor(step / 2) + step * i), lambda x: x <= F.col("x2"))
    d = d.select(*keys, "x1", "x2", "y1", "y2", "height", F.greatest(F.lit(3), F.floor(th / 2)).alias("reach"), F.greatest(F.lit(20), th * 3).alias("pad"), F.when(F.size(cols) > 0, cols).otherwise(F.array(F.floor((F.col("x1") + F.col("x2")) / 2))).alias("cols"))
    bg = page.select("capture_id", *(F.when((F.col("r") + F.col("g") + F.col("b")) / 3.0 < dark, 250.0).otherwise(F.col(c)).alias(f"bg_{c}") for c in "rgb"))
    d = d.join(bg, "capture_id")
    paper = [f"bg_{c}" for c in "rgb"]
    picture = (F.round(sum((F.abs(F.col(c) - F.col(f"bg_{c}")) for c in "rgb"), F.lit(0.0)), 6) > off).alias("picture")
    p = pixels.select("capture_id", "px", "py", "r", "g", "b")
    # pixels are streamed past the samples: they are far more than Spark estimates, and must not be broadcast
    at = lambda points, *on: points.hint("shuffle_hash").join(p, ["capture_id", *on]).select("*", picture)
    # an unbroken run ends at the first background row: its distance is a minimum over rows
    col = d.select(*keys, *paper, "y1", "y2", "reach", F.greatest(F.lit(0), F.col("y1") - F.col("pad")).alias("top"), F.least(F.col("height") - 1, F.col("y2") + F.col("pad")).alias("low"), F.explode("cols").alias("px"))
    met = at(col, "px")
    up = (F.col("py") < F.col("y1")) & (F.col("py") >= F.col("top"))
    down = (F.col("py") > F.col("y2")) & (F.col("py") <= F.col("low"))
    runs = met.groupBy(*keys, "px", "y1", "y2", "reach", "top", "low").agg(F.max(F.when(up & ~F.col("picture"), F.col("py"))).alias("stop_up"), F.min(F.when(down & ~F.col("picture"), F.col("py"))).alias("stop_down"))
    above = F.col("y1") - 1 - F.coalesce("stop_up", F.col("top") - 1)
    below = F.coalesce("stop_down", F.col("low") + 1) - F.col("y2") - 1
    share = lambda run: F.count_if(run >= F.col("reach")) / F.count("*")
    vertical = runs.groupBy(*keys).agg(share(above).alias("above"), share(below).alias("below"))
    rows, columns = F.greatest(F.lit(1), F.floor((th + 1) / 5)), F.greatest(F.lit(1), F.floor((tw + 1) / 15))
    under = d.select(*keys, *paper, F.explode(F.sequence("y1", "y2", rows)).alias("py"), F.sequence("x1", "x2", columns).alias("xs")).select(*keys, *paper, "py", F.explode("xs").alias("px"))
    inside = at(under, "px", "py").groupBy(*keys).agg((F.count_if("picture") / F.count("*")).alias("coherence"))
    return vertical.join(inside, keys)


def overlay_class(inside_share: Column, above: Column, below: Column, coherence: Column, near: Column, edge: Column) -> Column:
    """overlay, edgeOverlay, pageText or uncertain from the evidence; a text that is hardly on the figure is page text.

    A text without evidence (no column to sample) is uncertain.
    """
    strong = (F.when(edge == "bottom", above).when(edge == "top", below).otherwise(F.greatest(above, below))) >= 0.5
    return (
        F.when(inside_share.isNull() | (inside_share <= 0.3), "pageText")
        .when(above.isNull() | below.isNull() | coherence.isNull(), "uncertain")
        .when((above >= 0.5) & (below >= 0.5), "overlay")
        .when((near < 0.20) & (coherence > 0.4) & strong, "edgeOverlay")
        .when((above < 0.3) & (below < 0.3) & (coherence < 0.3), "pageText")
        .when((coherence > 0.4) | (above >= 0.3) | (below >= 0.3), "uncertain")
        .otherwise("pageText")
    )


def classified_overlays(figures: DataFrame, texts: DataFrame, pixels: DataFrame) -> DataFrame:
    """``capture_id, block_id, fig_idx, class`` for every text and figure of a page."""
    a, b = g.rect("a"), g.rect("b")
    met = relations.pairs(figures, texts, ["fig_idx"], ["block_id"])
    found = overlay_evidence(met.where(F.round(g.share_inside(b, a), 9) > 0.3), pixels, raster.background(pixels))
    d = met.join(found, ["capture_id", "block_id", "fig_idx"], "left")
    near = g.edge_proximity(a, b)
    return d.select("capture_id", "block_id", "fig_idx", overlay_class(F.round(g.share_inside(b, a), 9), F.col("above"), F.col("below"), F.col("coherence"), F.round(near["near"], 9), near["edge"]).alias("class"))


def for_trimming(classes: DataFrame) -> DataFrame:
    """Only texts of the page itself are trimmed away from figures."""
    return classes.where(F.col("class") == "pageText")


def hypotheses(candidates: DataFrame, cells: DataFrame, regions: DataFrame, texts: DataFrame, subjects: DataFrame, grid: int = 50) -> DataFrame:
    """``capture_id, cand_id, strategy, x, y, w, h, score``: what each candidate's true bounds could be.

    contentFit: the content region that shares most with the candidate (clipped to a wider margin where less
    than half of it is shared; else the box of all content); saliencyAnchored: the candidate itself;
    subjectAnchored: its subjects with their largest content region, dearer the more it grows; textGap: the
    room between the texts above and below.
    """
    key = ["capture_id", "cand_id"]
    a, b, c = g.rect("a"), g.rect("b"), g.rect()
    met = relations.pairs(candidates, regions, ["cand_id"], ["region_id"]).where(g.meets(a, b))
    best = met.groupBy(*key).agg(F.max(F.struct(F.round(g.shared_area(a, b), 9).alias("s"), (-F.col("region_id")).alias("o"), *a.named("a"), *b.named("b"))).alias("m")).select(*key, "m.*")
    wide = g.intersection(g.Rect(F.greatest(F.lit(0.0), a.x - a.w * 0.3), F.greatest(F.lit(0.0), a.y - a.h * 0.3), F.least(F.lit(1.0), a.w * 1.6), F.least(F.lit(1.0), a.h * 1.6)), g.Rect(0, 0, 1, 1))
    fit = best.select(*key, *b.when(F.round(F.col("s") / b.area, 9) < 0.5, g.intersection(b, wide)).named())
    whole = candidates.join(best, key, "left_anti").select(*key).join(raster.content_box(cells, grid), "capture_id")
    subj = relations.pairs(candidates, subjects, ["cand_id"], []).where(F.round(g.share_inside(b, a), 9) > 0.10)
    hull = subj.groupBy(*key).agg(F.min("bx").alias("x1"), F.min("by").alias("y1"), F.max(b.x2).alias("x2"), F.max(b.y2).alias("y2"), F.first(a.area).alias("cand_area"))
    hull = hull.select(*key, "cand_area", *g.corners(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).named("a"))
    big = hull.join(relations.boxed(regions, "b", "region_id"), "capture_id").where(g.meets(a, b)).groupBy(*key).agg(F.max(F.struct(F.round(b.area, 9).alias("s"), (-F.col("region_id")).alias("o"), *b.named("b"))).alias("m")).select(*key, *(F.col(f"m.b{k}").alias(f"b{k}") for k in "xywh"))
    hull = hull.join(big, key, "left")
    anchored = hull.select(*key, "cand_area", *a.when(F.col("bx").isNotNull(), g.union(a, b)).named())
    named = lambda df, s: df.select(*key, F.lit(s[0]).alias("ordinal"), F.lit(s[1]).alias("strategy"), "x", "y", "w", "h")
    every = named(fit.unionByName(whole.select(*key, "x", "y", "w", "h")), (0, "contentFit")).unionByName(named(candidates, (1, "saliencyAnchored"))).unionByName(named(anchored, (2, "subjectAnchored"))).unionByName(named(relations.text_gap_bounds(candidates, texts), (3, "textGap")))
    every = every.withColumn("hyp", F.concat_ws("/", F.col("cand_id").cast("string"), "strategy"))
    scored = every.join(raster.content_scores(cells, every, "hyp", grid).select("capture_id", "hyp", "score"), ["capture_id", "hyp"])
    grown = scored.join(anchored.select(*key, "cand_area"), key, "left")
    ratio = c.area / F.greatest("cand_area", F.lit(0.001))
    dear = F.when((F.col("strategy") == "subjectAnchored") & (ratio > 1.2), F.least(F.lit(1.0), 1.2 / ratio)).otherwise(1.0)
    return grown.select(*key, "ordinal", "strategy", "x", "y", "w", "h", F.round(F.col("score") * dear, 6).alias("score"))


def best_hypothesis(found: DataFrame) -> DataFrame:
    """The first of the best scores for each candidate."""
    best = found.groupBy("capture_id", "cand_id").agg(F.max(F.struct("score", (-F.col("ordinal")).alias("o"), "strategy", "x", "y", "w", "h")).alias("m"))
    return best.select("capture_id", "cand_id", "m.strategy", "m.x", "m.y", "m.w", "m.h", "m.score")


def crop_sane(retained: Column, least: float = 0.15) -> Column:
    """Whether a crop keeps enough of what it was cut from."""
    return retained >= least


def scaled(v: Column, floor: float, ceiling: float) -> Column:
    return g.clamp((v - floor) / (ceiling - floor), 0, 1)


def delta_score(fragments: Column, compactness: Column, variance: Column) -> Column:
    """How much the first pass improved a region, from three gains."""
    return g.clamp(fragments, 0, 1) * 0.45 + F.least(F.lit(1.0), F.greatest(F.lit(0.0), compactness) / 0.20) * 0.30 + F.least(F.lit(1.0), F.greatest(F.lit(0.0), variance) / 0.35) * 0.25


def blob_confidence(b: dict[str, Column]) -> Column:
    """Weighted signals that a leftover blob belongs to removed text."""
    size = F.when(b["relative_area"] <= 0.05, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - (b["relative_area"] - 0.05) / 0.05))
    parts = [  # fixed values: weights of the signals
        (scaled(b["compactness"], 0.20, 0.60), 0.16), (scaled(b["uniformity"], 0.45, 0.85), 0.08), (scaled(b["shape_balance"], 0.18, 0.45), 0.08), (g.clamp(b["boundary_contrast"] / 40.0, 0, 1), 0.06), (size, 0.07),
        (g.clamp(b["anchor_proximity"], 0, 1), 0.24), (g.clamp(b["text_coverage"], 0, 1), 0.16), (b["delta"], 0.10), (F.when(b["merged"], 1.0).otherwise(0.0), 0.05),
    ]
    return sum((v * w for v, w in parts), F.lit(0.0))


def reject_reason(relative_area: Column, area_ratio: Column, coupling: Column, confidence: Column, least: float = 0.50) -> Column:
    """Why a blob is left alone; null if it is accepted."""
    return F.when(relative_area > 0.05, "relative area").when((area_ratio > 3) & (coupling < 0.25), "weak text coupling").when(confidence < least, "confidence")


def coupling(text_coverage: Column, delta: Column, anchor_proximity: Column) -> Column:
    return g.clamp(text_coverage * 0.55 + delta * 0.30 + anchor_proximity * 0.15, 0, 1)


def dilation_radius(w: Column, h: Column, text_height: Column, text_coverage: Column, proximity: Column, compactness: Column, balance: Column, delta: Column) -> Column:
    """How far around a blob the mask grows, 3 to 28 pixels; more where the blob plainly encloses text."""
    side = F.greatest(w, h)
    strong = (text_coverage >= 0.80) & (proximity >= 0.85) & (compactness >= 0.55) & (balance >= 0.22)
    extra = F.when(strong, F.greatest(side * 0.16, text_height * 0.65)).otherwise(0.0) + F.when(strong & (delta >= 0.35), text_height * 0.25).otherwise(0.0)
    return g.clamp(F.round(F.greatest(side * 0.10, text_height * 0.45) + extra), 3, 28).cast("int")


def worth_a_look(blobs: DataFrame, least: int = 120, delta: float = 0.45) -> DataFrame:
    """Without small blobs that the first pass hardly changed."""
    return blobs.where((F.col("n") >= least) | (F.col("delta") >= delta))


def anchor_colour(first_pass: DataFrame, original: DataFrame, anchors: DataFrame, wide: float = 0.45, long: float = 4.5, colour: float = 44, flat: float = 26, reach: float = 1.75) -> DataFrame:
    """Pixels near a text whose colour is that of the ring around it, in flat surroundings.

    Texts wider than ``wide`` of the image or longer than ``long`` times their height are skipped.
    """
    size = raster.sizes(first_pass)
    t = size.join(anchors.select("capture_id", "block_id", *g.rect().named()), "capture_id")
    p = g.rect().flipped().scaled(F.col("width"), F.col("height"))
    t = t.select("capture_id", "block_id", "width", "height", *g.Rect(p.x, p.y, F.greatest(F.lit(1.0), p.w), F.greatest(F.lit(1.0), p.h)).named("a", places=6))
    a = g.rect("a")
    t = t.where((a.w / F.col("width") <= wide) & (F.greatest(a.w, a.h) / F.greatest(F.lit(1.0), F.least(a.w, a.h)) <= long))

    def within(df: DataFrame, margin: Column) -> DataFrame:
        return df.join(t.drop("width", "height"), "capture_id").where((F.col("px") >= F.floor(a.x - margin)) & (F.col("px") < F.ceil(a.x2 + margin)) & (F.col("py") >= F.floor(a.y - margin)) & (F.col("py") < F.ceil(a.y2 + margin)))

    ring = within(first_pass, F.lit(3.0)).where(~g.contains_point(a, F.col("px"), F.col("py")))
    fill = ring.groupBy("capture_id", "block_id").agg(*((F.sum(c) / F.count("*")).alias(f"f{c}") for c in "rgb"))
    even = raster.neighbour_range(first_pass).where(F.col("range3") <= flat).select("capture_id", "px", "py")
    near = within(original, a.h * reach).join(fill, ["capture_id", "block_id"])
    away = F.sqrt(sum(((F.col(c) - F.col(f"f{c}")) * (F.col(c) - F.col(f"f{c}")) for c in "rgb"), F.lit(0.0)))
    return near.where(F.round(away, 9) <= colour).select(*raster.SIZE, "px", "py").distinct().join(even, ["capture_id", "px", "py"]).select(*raster.SIZE, "px", "py")


def evidence_mask(original: DataFrame, first_pass: DataFrame, anchors: DataFrame) -> DataFrame:
    """Strongly coloured pixels and pixels in a text's surrounding colour."""
    return raster.saturated(original).select(*raster.SIZE, "px", "py").union(anchor_colour(first_pass, original, anchors)).distinct()


def fragments(mask: DataFrame, boxes: DataFrame, least: int = 20) -> DataFrame:
    """For each box the number of mask components in it, and compactness and size of the largest (the more compact on ties)."""
    q = boxes.select("capture_id", *(F.col(c).alias(f"q{c}") for c in "xywh"))
    inside = mask.join(q, "capture_id").where("px >= qx AND px < qx + qw AND py >= qy AND py < qy + qh").select(*mask.columns)
    parts = raster.pixel_components(inside, least).groupBy("capture_id").agg(F.count("*").alias("fragments"), F.max(F.struct("n", "compactness")).alias("m"))
    out = boxes.select("capture_id").join(parts, "capture_id", "left")
    return out.select("capture_id", F.coalesce("fragments", F.lit(0)).cast("long").alias("fragments"), F.coalesce("m.n", F.lit(0)).cast("long").alias("largest"), F.coalesce("m.compactness", F.lit(0.0)).alias("compactness"))


def _advance(image: np.ndarray, boxes: np.ndarray, background: np.ndarray, start: int, low: int, high: int, step: int, from_top: np.ndarray, across: np.ndarray, off: float, blank: float) -> int:
    """How far a region's lower edge moves down from row ``start`` over the columns ``low`` to ``high``.

    ``from_top`` and ``across`` have the normalized place of each row and column, ``boxes`` the texts in the
    same sense (rows x1, y1, x2, y2, half open). The edge moves in steps; before a strip with text, or the
    second background strip in a row, it stops.
    """
    steps = (len(image) - start) // step
    rows = np.minimum(len(image) - 1, start + step * np.arange(1, steps + 1) - 1)
    if not len(rows) or high <= low:
        return start + step * len(rows)
    strips = image[rows][:, low : high : max(1, (high - low) // 20)]
    empty = (np.abs(strips - background).sum(axis=2) <= off).mean(axis=1) >= blank
    x, y = across[low : high : max(1, (high - low) // 10)], from_top[rows]
    on = (x[None, :, None] >= boxes[:, 0]) & (x[None, :, None] < boxes[:, 2]) & (y[:, None, None] >= boxes[:, 1]) & (y[:, None, None] < boxes[:, 3])
    stop = on.any(axis=(1, 2)) | (empty & np.append(False, empty[:-1]))
    return start + step * int(np.argmax(stop) if stop.any() else len(rows))


def grow(image: np.ndarray, box: tuple[float, float, float, float], texts: np.ndarray, background: np.ndarray, step: float, blank: float, off: float) -> tuple[float, float, float, float]:
    """A seed grown in whole pixels at the top, bottom, left and right in turn; boxes have a bottom-left origin."""
    height, width = image.shape[:2]
    if min(width, height) <= 10:
        return box
    x, y, w, h = box
    edge = lambda v, size, most: max(0, min(most, int(v * size)))
    top, bottom = edge(1.0 - (y + h), height, height - 1), edge(1.0 - y, height, height)
    left, right = edge(x, width, width - 1), edge(x + w, width, width)
    down, right_of = 1.0 - np.arange(height) / height, np.arange(width) / width
    sx, sy = max(1, int(step * width)), max(1, int(step * height))
    move = lambda img, t, at, lo, hi, n, rows, cols: _advance(img, t, background, at, lo, hi, n, rows, cols, off, blank)
    top = height - move(image[::-1], texts, height - top, left, right, sy, down[::-1], right_of)
    bottom = move(image, texts, bottom, left, right, sy, down, right_of)
    turned, sideways = image.transpose(1, 0, 2), texts[:, [1, 0, 3, 2]]
    left = width - move(turned[::-1], sideways, width - left, top, bottom, sx, right_of[::-1], down)
    right = move(turned, sideways, right, top, bottom, sx, right_of, down)
    return left / width, 1.0 - bottom / height, (right - left) / width, (bottom - top) / height


def grown_regions(seeds: DataFrame, texts: DataFrame, pixels: DataFrame, step: float = 0.02, blank: float = 0.60, off: float = 60.0) -> DataFrame:
    """``capture_id, cand_id`` and each seed's box grown until text or background stops each side; see ``grow``.

    A strip is background where ``blank`` of about 20 of its pixels are within ``off`` of the page's colour.
    Images pass as arrays of numbers, one a capture; images of ten pixels or less leave the seed as it is.
    """
    bg = raster.background(pixels).select("capture_id", F.array("r", "g", "b").alias("bg"))
    image = pixels.groupBy("capture_id").agg(F.first("width").alias("width"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("py", "px", "r", "g", "b"))), lambda p: F.array(p["r"], p["g"], p["b"]))).alias("image"))
    r = g.rect()
    t = texts.groupBy("capture_id").agg(F.flatten(F.collect_list(F.array(r.x, r.y, r.x2, r.y2))).alias("texts"))
    d = seeds.join(image.hint("merge"), "capture_id").join(bg, "capture_id").join(t, "capture_id", "left")  # an image is larger than Spark estimates: never broadcast
    d = d.select("capture_id", "cand_id", *(F.col(k).cast("double").alias(k) for k in "xywh"), "width", F.col("image").cast("array<short>").alias("image"), "bg", F.coalesce("texts", F.array().cast("array<double>")).alias("texts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = lambda name, i: np.asarray(batch[name][i].values)  # noqa: B023, E731
            found = []
            for i in range(batch.num_rows):
                img = numbers("image", i).reshape(-1, batch["width"][i].as_py(), 3)
                box = tuple(batch[k][i].as_py() for k in "xywh")
                found.append([round(v, 6) for v in grow(img, box, numbers("texts", i).reshape(-1, 4), numbers("bg", i), step, blank, off)])
            columns = np.array(found, np.float64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays([batch["capture_id"], batch["cand_id"], *(pa.array(c) for c in columns)], ["capture_id", "cand_id", "x", "y", "w", "h"])

    return d.mapInArrow(run, "capture_id long, cand_id long, x double, y double, w double, h double")
