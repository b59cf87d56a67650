"""Statistics and masks of page images, on one row a pixel.

``pixels``: capture_id, width, height, px, py (from the top left), r, g, b. Samples are taken at the strides
given here before anything is joined, so only sampled pixels move. Channel sums are whole numbers; means are
rounded to nine places. Boxes of texts and figures are normalized with a bottom-left origin.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import geometry as g
from quire.operators.captures import per_capture_arrays

SIZE = ["capture_id", "width", "height"]


def brightness() -> Column:
    return (F.col("r") + F.col("g") + F.col("b")) / 3.0


def stride(size: Column, samples: int) -> Column:
    return F.greatest(F.lit(1), F.floor(size / samples))


def sizes(pixels: DataFrame) -> DataFrame:
    return pixels.where("px = 0 AND py = 0").select(*SIZE)


def _hits(at: Column, size: Column, first: Column, count: Column) -> Column:
    """How many of ``count`` places from ``first`` on, clipped to the image, are the place ``at``."""
    last = size - 1
    return F.when(at < last, ((at >= first) & (at < first + count)).cast("long")).otherwise(F.greatest(F.lit(0), F.least(count, first + count - last)).cast("long"))


def background(pixels: DataFrame) -> DataFrame:
    """``capture_id, r, g, b``: mean of the patches in the most frequent brightness class (the darker on ties).

    Sixteen patches of at most 8 x 8 pixels stand on a 4 x 4 grid inset from the edges; classes are 40 wide.
    Every pixel knows from its place which patches it is in, so no image is joined.
    """
    short = F.least("width", "height")
    patch = F.least(F.lit(8), F.floor(short / 4))
    inset = F.greatest(patch, F.floor(short / 30))
    side = F.greatest(patch, F.lit(1))
    first = lambda size, step: inset + F.floor((F.col(size) - 2 * inset - patch) * F.lit(step) / 3)
    hits = lambda at, size: [_hits(F.col(at), F.col(size), first(size, k), side) for k in range(4)]
    within = lambda n: F.explode(F.array(*(F.struct(F.lit(k).alias("at"), c.alias("n")) for k, c in enumerate(n))))
    d = pixels.where(F.greatest(*hits("px", "width")) > 0).where(F.greatest(*hits("py", "height")) > 0)
    d = d.select("*", within(hits("px", "width")).alias("gx")).where("gx.n > 0").select("*", within(hits("py", "height")).alias("gy")).where("gy.n > 0")
    d = d.select("capture_id", F.col("gx.at").alias("gx"), F.col("gy.at").alias("gy"), (F.col("gx.n") * F.col("gy.n")).alias("n"), "r", "g", "b")
    patches = d.groupBy("capture_id", "gx", "gy").agg(*((F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c) for c in "rgb"))
    bins = patches.withColumn("bin", F.floor(brightness() / 40)).groupBy("capture_id", "bin").agg(F.count("*").alias("n"), *(F.round(F.avg(F.round(c, 9).cast("decimal(18,9)")).cast("double"), 6).alias(c) for c in "rgb"))
    best = bins.groupBy("capture_id").agg(F.max(F.struct("n", (-F.col("bin")).alias("o"), "r", "g", "b")).alias("m"))
    return best.select("capture_id", "m.r", "m.g", "m.b")


def mask_box(mask: DataFrame) -> DataFrame:
    """The box around a mask's pixels, normalized with a bottom-left origin."""
    m = mask.groupBy(*SIZE).agg(F.min("px").alias("x1"), F.min("py").alias("y1"), (F.max("px") + 1).alias("x2"), (F.max("py") + 1).alias("y2"))
    box = g.corners(F.col("x1") / F.col("width"), 1 - F.col("y2") / F.col("height"), F.col("x2") / F.col("width"), 1 - F.col("y1") / F.col("height"))
    return m.select("capture_id", *box.named(places=6))


def inside_texts(points: DataFrame, texts: DataFrame, x: Column, y: Column) -> DataFrame:
    """``points`` with ``in_text``: whether a text's box holds the point. A capture's texts travel as one row."""
    boxes = texts.groupBy("capture_id").agg(F.collect_list(F.struct(*g.rect().named())).alias("text_boxes"))
    held = F.exists("text_boxes", lambda t: g.contains_point(g.Rect(*(t[k] for k in "xywh")), x, y))
    return points.join(boxes, "capture_id", "left").withColumn("in_text", F.coalesce(held, F.lit(False))).drop("text_boxes")


def content_map(pixels: DataFrame, texts: DataFrame, grid: int = 50, threshold: float = 20.0) -> DataFrame:
    """``capture_id, gx, gy, cell``: each grid cell is text, background or content, judged at its centre.

    Every pixel knows from its place of which cells it is the centre, so no image is joined.
    """
    n = F.lit(float(grid))
    nx, ny = (F.col("gx") + 0.5) / n, 1 - (F.col("gy") + 0.5) / n
    at = lambda v, size: F.least(F.col(size) - 1, F.greatest(F.lit(0), F.floor(F.round(v * F.col(size), 9))))
    low = lambda p, size: F.when(F.col(p) <= 0, 0).otherwise(F.greatest(F.lit(0), F.ceil(F.col(p) * n / F.col(size) - 0.500001))).cast("int")
    high = lambda p, size: F.when(F.col(p) >= F.col(size) - 1, grid - 1).otherwise(F.least(F.lit(grid - 1), F.floor((F.col(p) + 1) * n / F.col(size) - 0.499999))).cast("int")
    cells = pixels.where((low("px", "width") <= high("px", "width")) & (low("py", "height") <= high("py", "height")))
    cells = cells.select("*", F.explode(F.sequence(low("px", "width"), high("px", "width"))).alias("gx")).where(at(nx, "width") == F.col("px"))
    cells = cells.select("*", F.explode(F.sequence(low("py", "height"), high("py", "height"))).alias("gy")).where(at(1 - ny, "height") == F.col("py"))
    seen = inside_texts(cells.select("capture_id", "gx", "gy", "r", "g", "b"), texts, nx, ny)
    seen = seen.join(background(pixels).select("capture_id", *(F.col(c).alias(f"bg_{c}") for c in "rgb")), "capture_id")
    far = F.round(F.abs(F.col("r") - F.col("bg_r")) + F.abs(F.col("g") - F.col("bg_g")) + F.abs(F.col("b") - F.col("bg_b")), 6)
    return seen.select("capture_id", "gx", "gy", F.when(F.col("in_text"), "text").when(far <= threshold * 3, "background").otherwise("content").alias("cell"))


def content_box(cells: DataFrame, grid: int = 50) -> DataFrame:
    """The box around all content cells; captures without content have no row."""
    c = cells.where("cell = 'content'").groupBy("capture_id").agg(F.min("gx").alias("x1"), F.max("gx").alias("x2"), F.min("gy").alias("y1"), F.max("gy").alias("y2"))
    n = float(grid)
    return c.select("capture_id", *g.corners(F.col("x1") / n, 1 - (F.col("y2") + 1) / n, (F.col("x2") + 1) / n, 1 - F.col("y1") / n).named(places=6))


def content_scores(cells: DataFrame, regions: DataFrame, key: str, grid: int = 50) -> DataFrame:
    """``density``, ``coverage``, ``text_exclusion`` and ``score`` of each region over the content map.

    Density: content among the cells inside; coverage: the share of all content inside; exclusion: cells inside
    that are not text (1 without cells). Score: 0.4, 0.4 and 0.2 of these.
    """
    n = float(grid)
    r = regions.select("capture_id", key, *g.rect().named("q"))
    met = cells.join(r, "capture_id").withColumn("inside", g.contains_point(g.rect("q"), F.round((F.col("gx") + 0.5) / n, 9), F.round(1 - (F.col("gy") + 0.5) / n, 9)))
    cnt = lambda c: F.count_if(c).cast("double")
    inside, content, text = F.col("inside"), F.col("cell") == "content", F.col("cell") == "text"
    s = met.groupBy("capture_id", key).agg(cnt(inside).alias("all"), cnt(inside & content).alias("c"), cnt(inside & text).alias("t"), cnt(content).alias("whole"))
    share = lambda a, b, none: F.when(F.col(b) > 0, F.col(a) / F.when(F.col(b) > 0, F.col(b))).otherwise(F.lit(none))
    s = s.select("capture_id", key, share("c", "all", 0.0).alias("density"), share("c", "whole", 0.0).alias("coverage"), (1 - share("t", "all", 0.0)).alias("text_exclusion"))
    return s.withColumn("score", F.col("density") * 0.4 + F.col("coverage") * 0.4 + F.col("text_exclusion") * 0.2)


def _components(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Four-connected components of cells that come row by row: the places of each one's cells, in the order of their first cell."""
    wide = int(x.max()) + 2
    key = y.astype(np.int64) * wide + x
    beside = np.flatnonzero(np.diff(key) == 1)
    below = np.searchsorted(key, key + wide)
    met = below < len(key)
    met[met] = key[below[met]] == key[met] + wide
    a = np.concatenate((beside, np.flatnonzero(met)))
    b = np.concatenate((beside + 1, below[met]))
    label = np.arange(len(key))
    while True:  # each round the smaller label passes along all edges, and labels point to their roots
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    order = np.argsort(label, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(label[order])) + 1)


def content_regions(cells: DataFrame, grid: int = 50) -> DataFrame:
    """Boxes of the connected content regions of each capture, numbered from the top left."""

    def kernel(c: dict[str, np.ndarray]) -> list[tuple]:
        out = []
        for i, part in enumerate(_components(c["gx"], c["gy"])):
            x1, x2, y1, y2 = (int(v) for v in (c["gx"][part].min(), c["gx"][part].max(), c["gy"][part].min(), c["gy"][part].max()))
            out.append((i, round(x1 / grid, 6), round(1 - (y2 + 1) / grid, 6), round((x2 - x1 + 1) / grid, 6), round((y2 - y1 + 1) / grid, 6), len(part)))
        return out

    return per_capture_arrays(cells.where("cell = 'content'"), ["gy", "gx"], [], kernel, "region_id long, x double, y double, w double, h double, cells long")


def pixel_components(mask: DataFrame, least: int = 50) -> DataFrame:
    """Four-connected components of a mask's pixels with at least ``least`` of them: box, compactness, balance, members row by row."""

    def kernel(c: dict[str, np.ndarray]) -> list[tuple]:
        out = []
        for i, part in enumerate(_components(c["px"], c["py"])):
            if len(part) < least:
                continue
            x, y = c["px"][part], c["py"][part]
            x1, y1, w, h = int(x.min()), int(y.min()), int(x.max() - x.min()) + 1, int(y.max() - y.min()) + 1
            out.append((i, x1, y1, w, h, len(part), round(len(part) / (w * h), 6), round(min(w, h) / max(w, h), 6), y.astype(np.int64) * int(c["width"][0]) + x))
        return out

    schema = "blob_id long, x long, y long, w long, h long, n long, compactness double, shape_balance double, members array<long>"
    return per_capture_arrays(mask, ["py", "px"], ["width"], kernel, schema)


def component_stats(components: DataFrame, pixels: DataFrame) -> DataFrame:
    """``components`` with ``uniformity`` (from colour variance) and ``boundary_contrast``.

    The contrast is the mean colour step from about 200 of the members to their neighbours outside.
    """
    flat = pixels.select("capture_id", (F.col("py") * F.col("width") + F.col("px")).alias("at"), "px", "py", "r", "g", "b")
    m = components.select("capture_id", "blob_id", "n", F.posexplode("members").alias("nth", "at")).join(flat, ["capture_id", "at"])
    var = lambda c: F.sum(F.col(c) * F.col(c)) / F.count("*") - (F.sum(c) / F.count("*")) * (F.sum(c) / F.count("*"))
    own = m.groupBy("capture_id", "blob_id").agg(F.round(1 / (1 + (var("r") + var("g") + var("b")) / 3 / 2000), 6).alias("uniformity"))
    sampled = m.where(F.col("nth") % stride(F.col("n"), 200) == 0)
    step = F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((-1, 0), (1, 0), (0, -1), (0, 1)))))
    near = sampled.select("capture_id", "blob_id", "r", "g", "b", "px", "py", step.alias("s")).withColumns({"px": F.col("px") + F.col("s.dx"), "py": F.col("py") + F.col("s.dy")})
    other = flat.select("capture_id", "px", "py", "at", *(F.col(c).alias(f"o{c}") for c in "rgb"))
    mine = components.select("capture_id", "blob_id", F.explode("members").alias("at"))
    out = near.join(other, ["capture_id", "px", "py"]).join(mine, ["capture_id", "blob_id", "at"], "left_anti")
    diff = F.abs(F.col("r") - F.col("or")) + F.abs(F.col("g") - F.col("og")) + F.abs(F.col("b") - F.col("ob"))
    edge = out.groupBy("capture_id", "blob_id").agg(F.round(F.sum(diff) / F.count("*") / 3.0, 6).alias("boundary_contrast"))
    return components.join(own, ["capture_id", "blob_id"]).join(edge, ["capture_id", "blob_id"], "left").withColumn("boundary_contrast", F.coalesce("boundary_contrast", F.lit(0.0)))


def color_variance(pixels: DataFrame, most: int = 100) -> DataFrame:
    """Root of the summed channel variances over at most ``most`` x ``most`` pixels, taken at a stride."""
    s = pixels.where((F.col("px") % stride(F.col("width"), most) == 0) & (F.col("py") % stride(F.col("height"), most) == 0))
    var = lambda c: F.sum(F.col(c) * F.col(c)) / F.count("*") - (F.sum(c) / F.count("*")) * (F.sum(c) / F.count("*"))
    return s.groupBy("capture_id").agg(F.round(F.sqrt(F.greatest(F.lit(0.0), var("r") + var("g") + var("b"))), 6).alias("variance"))


def strips(pixels: DataFrame, columns: bool, samples: int = 30) -> DataFrame:
    """``capture_id, at, deviation``: brightness deviation of each column or row over about ``samples`` pixels."""
    at, along, size = ("px", "py", "height") if columns else ("py", "px", "width")
    s = pixels.where(F.col(along) % stride(F.col(size), samples) == 0).withColumn("v", F.col("r") + F.col("g") + F.col("b"))
    n = F.count("*")
    var = (F.sum(F.col("v") * F.col("v")) / n - (F.sum("v") / n) * (F.sum("v") / n)) / 9.0
    return s.groupBy("capture_id", F.col(at).alias("at")).agg(F.when(n > 1, F.round(F.sqrt(F.greatest(F.lit(0.0), var)), 6)).otherwise(F.lit(0.0)).alias("deviation"))


def tightened(pixels: DataFrame, floor: float = 15.0, least_size: int = 20) -> DataFrame:
    """The pixel box left when low-variance strips at the edges go, or the whole image where little would go.

    A strip stays from the first to the last that reaches 1.5 medians (at least ``floor``); a margin of a
    twentieth is kept; a long image keeps four fifths of its short side.
    """

    def ends(columns: bool, name: str) -> DataFrame:
        s = strips(pixels, columns)
        med = s.groupBy("capture_id").agg(F.get(F.array_sort(F.collect_list("deviation")), F.floor(F.count("*") / 2).cast("int")).alias("median"))
        s = s.join(med, "capture_id").where(F.col("deviation") >= F.greatest(F.col("median") * 1.5, F.lit(floor)))
        return s.groupBy("capture_id").agg(F.min("at").alias(f"{name}1"), F.max("at").alias(f"{name}2"))

    d = sizes(pixels).join(ends(True, "x"), "capture_id", "left").join(ends(False, "y"), "capture_id", "left")
    margin = lambda n: F.greatest(F.lit(4), F.floor((F.col(f"{n}2") - F.col(f"{n}1")) / 20))
    low = lambda n: F.greatest(F.lit(0), F.col(f"{n}1") - margin(n))
    span = lambda n, size: F.least(F.col(size) - low(n), F.col(f"{n}2") - F.col(f"{n}1") + 2 * margin(n))
    d = d.withColumns({"x": low("x"), "y": low("y"), "w": span("x", "width"), "h": span("y", "height")})
    long_side, short = F.greatest("width", "height"), F.least("width", "height")
    enough = (F.col("w") < F.col("width") * 0.85) | (F.col("h") < F.col("height") * 0.85)
    guarded = (long_side / short > 2) & (1 - F.least("w", "h") / short > 0.20)
    use = (F.col("width") > least_size) & (F.col("height") > least_size) & (F.col("x1") < F.col("x2")) & (F.col("y1") < F.col("y2")) & enough & ~guarded & (F.col("w") > 10) & (F.col("h") > 10)
    pick = lambda c, whole: F.when(F.coalesce(use, F.lit(False)), F.col(c)).otherwise(whole).cast("long").alias(c)
    return d.select("capture_id", pick("x", F.lit(0)), pick("y", F.lit(0)), pick("w", F.col("width")), pick("h", F.col("height")))


def edge_means(pixels: DataFrame, samples: int = 20) -> DataFrame:
    """Mean brightness along the four edges, over about ``samples`` pixels each."""
    col = F.col("py") % stride(F.col("height"), samples) == 0
    row = F.col("px") % stride(F.col("width"), samples) == 0
    edges = {"top": (F.col("py") == 0) & row, "bottom": (F.col("py") == F.col("height") - 1) & row, "left": (F.col("px") == 0) & col, "right": (F.col("px") == F.col("width") - 1) & col}
    v = F.col("r") + F.col("g") + F.col("b")
    return pixels.groupBy(*SIZE).agg(*(F.round(F.sum(F.when(on, v)) / F.count(F.when(on, v)) / 3.0, 6).alias(e) for e, on in edges.items()))


def auto_cropped(pixels: DataFrame, page_brightness: DataFrame | None = None, threshold: float = 20.0, bright: float = 200.0, share: float = 0.05, samples: int = 40) -> DataFrame:
    """The pixel box inside a light margin, or the whole image where there is none worth cutting.

    The margin's brightness is the page's where that is light, else the lightest edge's. A row or column has
    content where ``share`` of its samples differ by more than ``threshold``. A long image whose outer rows
    are not pure white keeps them when the crop would cost over a tenth of its short side.
    """
    d = edge_means(pixels)
    lightest = F.greatest("top", "bottom", "left", "right")
    if page_brightness is not None:
        d = d.join(page_brightness.select("capture_id", F.col("brightness").alias("page")), "capture_id", "left")
        lightest = F.when(F.col("page") > bright, F.col("page")).otherwise(lightest)
    d = d.withColumn("bg", lightest)
    p = pixels.join(d.where(F.col("bg") > bright).select("capture_id", "bg"), "capture_id")
    off = F.abs(brightness() - F.col("bg")) > threshold

    def ends(at: str, along: str, size: str, name: str) -> DataFrame:
        s = p.where(F.col(along) % stride(F.col(size), samples) == 0).groupBy("capture_id", at).agg((F.count_if(off) / F.count("*") >= share).alias("has"))
        return s.groupBy("capture_id").agg(F.coalesce(F.min(F.when(F.col("has"), F.col(at))), F.lit(0)).alias(f"{name}1"), F.coalesce(F.max(F.when(F.col("has"), F.col(at))), F.max(at)).alias(f"{name}2"))

    d = d.join(ends("px", "py", "height", "x"), "capture_id", "left").join(ends("py", "px", "width", "y"), "capture_id", "left")
    edge = F.greatest(F.lit(2), F.floor(F.least("width", "height") / 50))
    pad = lambda gap: F.when(gap >= 4, 0).otherwise(edge)
    x = F.greatest(F.lit(0), F.col("x1") - pad(F.col("x1")))
    y = F.greatest(F.lit(0), F.col("y1") - pad(F.col("y1")))
    x2 = F.least(F.col("width") - 1, F.col("x2") + pad(F.col("width") - 1 - F.col("x2")))
    y2 = F.least(F.col("height") - 1, F.col("y2") + pad(F.col("height") - 1 - F.col("y2")))
    d = d.withColumns({"cx": x, "cy": y, "cw": x2 - x + 1, "ch": y2 - y + 1})
    enough = (F.col("cw") < F.col("width") - 4) | (F.col("ch") < F.col("height") - 4)
    long_side, short = F.greatest("width", "height"), F.least("width", "height")
    guard = (long_side / short > 2) & (1 - F.least("cw", "ch") / short > 0.10)
    up, down = guard & (F.col("top") < 240) & (F.col("y1") > 0), guard & (F.col("bottom") < 240)
    top = F.when(up, 0).otherwise(F.col("cy"))
    bottom = F.when(down, F.col("height")).otherwise(F.col("cy") + F.col("ch"))
    use = F.coalesce((F.col("bg") > bright) & (F.col("width") > 4) & (F.col("height") > 4) & (F.col("x1") < F.col("x2")) & (F.col("y1") < F.col("y2")) & enough & (F.col("cw") > 4) & (bottom - top > 4), F.lit(False))
    pick = lambda v, whole, name: F.when(use, v).otherwise(whole).cast("long").alias(name)
    return d.select("capture_id", pick(F.col("cx"), F.lit(0), "x"), pick(top, F.lit(0), "y"), pick(F.col("cw"), F.col("width"), "w"), pick(bottom - top, F.col("height"), "h"))


def saturated(pixels: DataFrame, saturation: float = 0.40, value: float = 0.25) -> DataFrame:
    """The pixels of strong colour."""
    high, low = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    s = F.when(high > 10, (high - low) / F.when(high > 10, high)).otherwise(0.0)
    return pixels.where((s > saturation) & (high / 255.0 > value))


def text_mask(sizes: DataFrame, texts: DataFrame, least: float = 4, proportional: float = 0.6) -> DataFrame:
    """Pixels under the texts' boxes, padded by a share of the text's height and clipped to the image."""
    t = sizes.join(texts.select("capture_id", *g.rect().named()), "capture_id")
    tall = F.col("h") * F.col("height")
    pad = F.greatest(F.lit(float(least)), F.round(tall * proportional, 9))
    lower = lambda v, size: F.greatest(F.lit(0), F.round(v, 6)).cast("double")
    upper = lambda v, size: F.least(F.col(size).cast("double"), F.round(v, 6))
    p = g.rect().flipped().scaled(F.col("width"), F.col("height"))
    box = t.select(*SIZE, F.floor(lower(p.x - pad, "width")).alias("x1"), F.ceil(upper(p.x2 + pad, "width")).alias("x2"), F.floor(lower(p.y - pad, "height")).alias("y1"), F.ceil(upper(p.y2 + pad, "height")).alias("y2"))
    box = box.where("x2 > x1 AND y2 > y1")
    px = box.select(*SIZE, "y1", "y2", F.explode(F.sequence("x1", F.col("x2") - 1)).alias("px"))
    return px.select(*SIZE, "px", F.explode(F.sequence("y1", F.col("y2") - 1)).alias("py")).distinct()


def dilated(mask: DataFrame, members: DataFrame, radius: int) -> DataFrame:
    """``mask`` and every pixel within ``radius`` of a member, clipped to the image."""
    r = int(radius)
    disc = F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in range(-r, r + 1) for dy in range(-r, r + 1) if dx * dx + dy * dy <= r * r)))
    grown = members.select(*SIZE, "px", "py", disc.alias("d")).select(*SIZE, (F.col("px") + F.col("d.dx")).alias("px"), (F.col("py") + F.col("d.dy")).alias("py"))
    grown = grown.where("px >= 0 AND py >= 0 AND px < width AND py < height")
    return mask.select(*SIZE, "px", "py").unionByName(grown).distinct()


def region_variance(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """Mean of the channels' variances inside pixel boxes (x, y, w, h from the top left)."""
    p = pixels.join(boxes.select("capture_id", *(F.col(c).alias(f"q{c}") for c in "xywh")), "capture_id").where("px >= qx AND px < qx + qw AND py >= qy AND py < qy + qh")
    var = lambda c: F.sum(F.col(c) * F.col(c)) / F.count("*") - (F.sum(c) / F.count("*")) * (F.sum(c) / F.count("*"))
    return p.groupBy("capture_id").agg(F.round((var("r") + var("g") + var("b")) / 3.0, 6).alias("variance"))


def deviation_outside_text(pixels: DataFrame, texts: DataFrame, samples: int = 200) -> DataFrame:
    """Deviation of brightness over about ``samples`` x ``samples`` pixels that no text covers."""
    s = pixels.where((F.col("px") % stride(F.col("width"), samples) == 0) & (F.col("py") % stride(F.col("height"), samples) == 0))
    s = inside_texts(s, texts, F.col("px") / F.col("width"), 1 - F.col("py") / F.col("height")).where("NOT in_text").withColumn("v", F.col("r") + F.col("g") + F.col("b"))
    n = F.count("*")
    return s.groupBy("capture_id").agg(F.round(F.sqrt(F.greatest(F.lit(0.0), (F.sum(F.col("v") * F.col("v")) / n - (F.sum("v") / n) * (F.sum("v") / n)) / 9.0)), 6).alias("deviation"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean channel difference of two images, pixel by pixel."""
    other = b.select("capture_id", "px", "py", *(F.col(c).alias(f"o{c}") for c in "rgb"))
    d = (F.abs(F.col("r") - F.col("or")) + F.abs(F.col("g") - F.col("og")) + F.abs(F.col("b") - F.col("ob"))) / 3.0
    return a.join(other, ["capture_id", "px", "py"]).select(*SIZE, "px", "py", d.alias("diff"))


def preserved(original: DataFrame, changed: DataFrame, same: float = 15, least: float = 70, most: float = 5) -> DataFrame:
    """How much of an image a change left alone: ``percent``, ``mean_diff`` of that, and ``accepted``."""
    d = difference(original, changed)
    d = d.groupBy("capture_id").agg(F.round(F.count_if(F.col("diff") < same) / F.count("*") * 100, 6).alias("percent"), F.round(F.coalesce(F.avg(F.when(F.col("diff") < same, F.round("diff", 6).cast("decimal(18,6)"))).cast("double"), F.lit(999.0)), 6).alias("mean_diff"))
    return d.withColumn("accepted", (F.col("percent") >= least) & (F.col("mean_diff") <= most))


def ring_damage(first: DataFrame, second: DataFrame, mask: DataFrame, boxes: DataFrame, margin: int = 20, threshold: float = 20) -> DataFrame:
    """Percent of pixels in a ring around each box, outside the mask, that the second image changes strongly; 0 without any."""
    d = difference(first, second).join(mask.select("capture_id", "px", "py"), ["capture_id", "px", "py"], "left_anti")
    q = boxes.select("capture_id", *(F.col(c).alias(f"q{c}") for c in "xywh"))
    ring = f"px >= qx - {margin} AND px < qx + qw + {margin} AND py >= qy - {margin} AND py < qy + qh + {margin} AND NOT (px >= qx AND px < qx + qw AND py >= qy AND py < qy + qh)"
    hit = d.join(q, "capture_id").where(ring).groupBy("capture_id").agg(F.round(F.count_if(F.col("diff") > threshold) / F.count("*") * 100, 6).alias("damage"))
    return boxes.join(hit, "capture_id", "left").withColumn("damage", F.coalesce("damage", F.lit(0.0)))


def cropped(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """The pixels inside each capture's pixel box, counted from the box's corner."""
    p = pixels.drop("width", "height").join(boxes.select("capture_id", *(F.col(c).alias(f"q{c}") for c in "xywh")), "capture_id").where("px >= qx AND px < qx + qw AND py >= qy AND py < qy + qh")
    return p.select("capture_id", F.col("qw").alias("width"), F.col("qh").alias("height"), (F.col("px") - F.col("qx")).alias("px"), (F.col("py") - F.col("qy")).alias("py"), "r", "g", "b")


def resized(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Nearest-pixel resize: every source pixel knows from its place which target pixels take it, so no image is joined."""
    first = lambda p, size, new: F.ceil(p * new / F.col(size))
    spots = lambda at, size, new: F.sequence(first(F.col(at), size, new), first(F.col(at) + 1, size, new) - 1)
    some = lambda at, size, new: first(F.col(at), size, new) < first(F.col(at) + 1, size, new)
    d = pixels.where(some("px", "width", width) & some("py", "height", height))
    d = d.select("*", F.explode(spots("px", "width", width)).alias("nx")).select("*", F.explode(spots("py", "height", height)).alias("ny"))
    return d.select("capture_id", F.lit(width).cast("long").alias("width"), F.lit(height).cast("long").alias("height"), F.col("nx").alias("px"), F.col("ny").alias("py"), "r", "g", "b")


def composite(base: DataFrame, patch: DataFrame, boxes: DataFrame) -> DataFrame:
    """``base`` with a patch's pixels laid over it at each capture's box corner."""
    placed = patch.join(boxes.select("capture_id", F.col("x").alias("qx"), F.col("y").alias("qy")), "capture_id").select("capture_id", (F.col("px") + F.col("qx")).alias("px"), (F.col("py") + F.col("qy")).alias("py"), *(F.col(c).alias(f"n{c}") for c in "rgb"))
    out = base.join(placed, ["capture_id", "px", "py"], "left")
    return out.select(*SIZE, "px", "py", *(F.coalesce(f"n{c}", c).alias(c) for c in "rgb"))


def ring_fill(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """Retouching substitute: masked pixels take the mean colour of the unmasked pixels of the image.

    Stands in for an image model whose weights are not available; see the README.
    """
    m = mask.select("capture_id", "px", "py").withColumn("masked", F.lit(True))
    d = pixels.join(m, ["capture_id", "px", "py"], "left").withColumn("masked", F.coalesce("masked", F.lit(False)))
    fill = d.where("NOT masked").groupBy("capture_id").agg(*(F.floor(F.sum(c) / F.count("*")).alias(f"f{c}") for c in "rgb"))
    d = d.join(fill, "capture_id", "left")
    return d.select(*SIZE, "px", "py", *(F.when(F.col("masked"), F.coalesce(f"f{c}", c)).otherwise(F.col(c)).alias(c) for c in "rgb"))


def tensor(pixels: DataFrame, size: int, fill: int = 114) -> DataFrame:
    """``capture_id, data``: channel after channel, row by row, scaled to 0..1, padded on the right and below with ``fill``."""
    spot = F.explode(F.sequence(F.lit(0), F.lit(3 * size * size - 1)))
    grid = sizes(pixels).select("capture_id", spot.alias("at")).withColumns({"ch": F.floor(F.col("at") / (size * size)).cast("int"), "px": (F.col("at") % size).cast("long"), "py": F.floor(F.col("at") % (size * size) / size)})
    v = grid.join(pixels.select("capture_id", "px", "py", F.array("r", "g", "b").alias("v")), ["capture_id", "px", "py"], "left")
    v = v.select("capture_id", F.struct("at", (F.coalesce(F.get("v", F.col("ch")), F.lit(fill)) / 255.0).cast("float").alias("v")).alias("s"))
    return v.groupBy("capture_id").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["v"]).alias("data"))


def neighbour_range(pixels: DataFrame) -> DataFrame:
    """``pixels`` with ``range3``: the largest channel range in the 3 x 3 neighbourhood, by windows along both axes."""
    across = Window.partitionBy("capture_id", "py").orderBy("px").rangeBetween(-1, 1)
    down = Window.partitionBy("capture_id", "px").orderBy("py").rangeBetween(-1, 1)
    d = pixels
    for c in "rgb":
        d = d.withColumns({f"lo_{c}": F.min(c).over(across), f"hi_{c}": F.max(c).over(across)})
    spread = F.greatest(*(F.max(f"hi_{c}").over(down) - F.min(f"lo_{c}").over(down) for c in "rgb"))
    return d.withColumn("range3", spread).drop(*(f"{e}_{c}" for e in ("lo", "hi") for c in "rgb"))
