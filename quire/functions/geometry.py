"""Rectangles as Column expressions (scalar operators of the layout library).

Coordinates: ``bl`` is normalized with the origin at the bottom left (pages), ``tl`` normalized with the
origin at the top left (overlays), ``px`` pixels from the top left. Two rectangles meet where they share
area; touching edges do not. Nulls in any part give null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


@dataclass
class Rect:
    """Left, lower (or upper) edge, width and height."""

    x: Column
    y: Column
    w: Column
    h: Column

    def __post_init__(self):
        self.x, self.y, self.w, self.h = (_c(v) for v in (self.x, self.y, self.w, self.h))

    @property
    def x2(self) -> Column:
        return self.x + self.w

    @property
    def y2(self) -> Column:
        return self.y + self.h

    @property
    def area(self) -> Column:
        return self.w * self.h

    @property
    def mid_y(self) -> Column:
        return self.y + self.h / 2

    def named(self, prefix: str = "", places: int | None = None) -> list[Column]:
        parts = zip("xywh", (self.x, self.y, self.w, self.h), strict=True)
        return [(v if places is None else F.round(v, places)).alias(prefix + k) for k, v in parts]

    def when(self, condition: Column, other: Rect) -> Rect:
        """``other`` where the condition holds, this one elsewhere."""
        return Rect(*(F.when(condition, b).otherwise(a) for a, b in zip((self.x, self.y, self.w, self.h), (other.x, other.y, other.w, other.h), strict=True)))

    def scaled(self, width, height) -> Rect:
        return Rect(self.x * width, self.y * height, self.w * width, self.h * height)

    def flipped(self) -> Rect:
        """From bottom-left to top-left origin or back."""
        return Rect(self.x, 1 - self.y - self.h, self.w, self.h)


def rect(prefix: str = "") -> Rect:
    return Rect(*(F.col(prefix + k) for k in "xywh"))


def corners(x1: Column, y1: Column, x2: Column, y2: Column) -> Rect:
    return Rect(x1, y1, x2 - x1, y2 - y1)


def overlap_x(a: Rect, b: Rect) -> Column:
    return F.least(a.x2, b.x2) - F.greatest(a.x, b.x)


def overlap_y(a: Rect, b: Rect) -> Column:
    return F.least(a.y2, b.y2) - F.greatest(a.y, b.y)


def meets(a: Rect, b: Rect) -> Column:
    return (overlap_x(a, b) > 0) & (overlap_y(a, b) > 0)


def shared_area(a: Rect, b: Rect) -> Column:
    return F.when(meets(a, b), overlap_x(a, b) * overlap_y(a, b)).otherwise(F.lit(0.0))


def intersection(a: Rect, b: Rect) -> Rect:
    return corners(F.greatest(a.x, b.x), F.greatest(a.y, b.y), F.least(a.x2, b.x2), F.least(a.y2, b.y2))


def union(a: Rect, b: Rect) -> Rect:
    return corners(F.least(a.x, b.x), F.least(a.y, b.y), F.greatest(a.x2, b.x2), F.greatest(a.y2, b.y2))


def contains_point(r: Rect, px: Column, py: Column) -> Column:
    """Half open: the left and lower edges belong to the rectangle, the others do not."""
    return (px >= r.x) & (px < r.x2) & (py >= r.y) & (py < r.y2)


def iou(a: Rect, b: Rect) -> Column:
    """Intersection over union; 0 for disjoint rectangles and for an empty union."""
    shared = shared_area(a, b)
    whole = a.area + b.area - shared
    return F.when(whole > 0, shared / F.when(whole > 0, whole)).otherwise(F.lit(0.0))


def share_inside(part: Rect, whole: Rect) -> Column:
    """The share of ``part`` that lies in ``whole``; 0 for an empty part."""
    return F.when(part.area > 0, shared_area(part, whole) / F.when(part.area > 0, part.area)).otherwise(F.lit(0.0))


def normalized(px: Rect, width, height) -> Rect:
    """Pixels to normalized; the zero rectangle if the size is not positive."""
    width, height = _c(width), _c(height)
    ok = (width > 0) & (height > 0)
    w, h = F.when(ok, width), F.when(ok, height)
    return Rect(*(F.coalesce(v, F.lit(0.0)) for v in (px.x / w, px.y / h, px.w / w, px.h / h)))


def pixel_crop(r: Rect, width, height) -> Rect:
    """Bottom-left normalized to whole pixels from the top left: flipped, widened to whole pixels, clipped."""
    width, height = _c(width), _c(height)
    p = r.flipped().scaled(width, height)
    whole = corners(F.floor(p.x).cast("double"), F.floor(p.y).cast("double"), F.ceil(p.x2).cast("double"), F.ceil(p.y2).cast("double"))
    return intersection(whole, Rect(0, 0, width, height))


def clamp_overlay(r: Rect, least: float = 0.01) -> Rect:
    """Kept on the page: the origin by the size as it was, then the size to at least ``least`` and at most 1."""
    size = lambda v: F.greatest(F.lit(least), F.least(F.lit(1.0), v))
    origin = lambda at, v: F.greatest(F.lit(0.0), F.least(1 - v, at))
    return Rect(origin(r.x, r.w), origin(r.y, r.h), size(r.w), size(r.h))


def flip_on_display(r: Rect, width, height) -> Rect:
    """A bottom-left screen rectangle in top-left display pixels, clipped to the display; null if nothing is left."""
    width, height = _c(width), _c(height)
    flipped = Rect(r.x, height - r.y - r.h, r.w, r.h)
    inside = intersection(flipped, Rect(0, 0, width, height))
    ok = (inside.w > 0) & (inside.h > 0)
    return Rect(*(F.when(ok, v) for v in (inside.x, inside.y, inside.w, inside.h)))


def relation(figure: Rect, text: Rect, proximity: float = 0.03, overlap: float = 0.05, projection: float = 0.30) -> Column:
    """How a text stands to a figure; sideways neighbourhood is tested before above and below."""
    across = F.when(F.least(figure.h, text.h) > 0, F.greatest(F.lit(0.0), overlap_y(figure, text)) / F.least(figure.h, text.h)).otherwise(F.lit(0.0))
    along = F.when(F.least(figure.w, text.w) > 0, F.greatest(F.lit(0.0), overlap_x(figure, text)) / F.least(figure.w, text.w)).otherwise(F.lit(0.0))
    near = lambda gap: F.abs(gap) < proximity
    return (
        F.when(share_inside(text, figure) > overlap, "overlapping")
        .when((across > projection) & near(text.x - figure.x2), "adjacentRight")
        .when((across > projection) & near(figure.x - text.x2), "adjacentLeft")
        .when((along > projection) & near(text.y - figure.y2), "adjacentAbove")
        .when((along > projection) & near(figure.y - text.y2), "adjacentBelow")
        .otherwise("disjoint")
    )


def distance(a: Rect, b: Rect) -> Column:
    """Euclidean gap between two rectangles, 0 where they meet."""
    dx = F.greatest(F.lit(0.0), F.greatest(b.x - a.x2, a.x - b.x2))
    dy = F.greatest(F.lit(0.0), F.greatest(b.y - a.y2, a.y - b.y2))
    return F.sqrt(dx * dx + dy * dy)


def snapped(r: Rect, blocked: dict[str, Column], threshold: float = 0.6, reach: float = 0.40) -> Rect:
    """Extended to the page's edges where the rectangle is large, the gap is small and no text is in the way."""
    wide, gap = r.w >= threshold, lambda g: (g > 0) & (g < reach)
    out = r.when(wide & gap(r.x) & ~blocked["left"], Rect(F.lit(0.0), r.y, r.x2, r.h))
    out = out.when(wide & gap(1 - r.x2) & ~blocked["right"], Rect(out.x, out.y, 1 - out.x, out.h))
    tall = r.h >= F.when(out.w > 0.95, threshold * 0.5).otherwise(threshold)
    low, high = tall & gap(r.y) & ~blocked["bottom"], tall & gap(1 - r.y2) & ~blocked["top"]
    out = out.when(low, Rect(out.x, F.lit(0.0), out.w, out.y2))
    return out.when(high, Rect(out.x, out.y, out.w, 1 - out.y))


def expanded(r: Rect, blocked: dict[str, Column], margin: float = 0.04) -> Rect:
    """Grown by a margin on the edges that no text blocks, kept on the page."""
    m = {side: F.when(b, 0.0).otherwise(margin) for side, b in blocked.items()}
    x, y = F.greatest(F.lit(0.0), r.x - m["left"]), F.greatest(F.lit(0.0), r.y - m["bottom"])
    return Rect(x, y, F.least(1 - x, r.w + m["left"] + m["right"]), F.least(1 - y, r.h + m["bottom"] + m["top"]))


def edge_proximity(figure: Rect, text: Rect) -> Column:
    """``struct(near, edge)``: the text's least relative distance to an edge of the figure it lies in; ties by order."""
    sides = [("top", (figure.y2 - text.y2) / figure.h), ("bottom", (text.y - figure.y) / figure.h), ("left", (text.x - figure.x) / figure.w), ("right", (figure.x2 - text.x2) / figure.w)]
    best = F.array_min(F.array(*(F.struct(d.alias("near"), F.lit(i).alias("at")) for i, (_, d) in enumerate(sides))))
    return F.struct(best["near"].alias("near"), F.get(F.array(*(F.lit(n) for n, _ in sides)), best["at"]).alias("edge"))


def drawn(x1: Column, y1: Column, x2: Column, y2: Column) -> Rect:
    """The rectangle between two points, whichever way it was drawn."""
    return Rect(F.least(x1, x2), F.least(y1, y2), F.abs(x2 - x1), F.abs(y2 - y1))


def resized(r: Rect, handle: Column, dx: Column, dy: Column) -> Rect:
    """Dragging one of eight handles (top-left origin): edges on the handle's side move, the others stay."""
    left, right = handle.contains("Left") | (handle == "left"), handle.contains("Right") | (handle == "right")
    top, bottom = handle.startswith("top"), handle.startswith("bottom")
    return Rect(r.x + F.when(left, dx).otherwise(0.0), r.y + F.when(top, dy).otherwise(0.0), r.w + F.when(right, dx).when(left, -dx).otherwise(0.0), r.h + F.when(bottom, dy).when(top, -dy).otherwise(0.0))


def aspect_fit(width: Column, height: Column, into_w, into_h) -> tuple[Column, Column, Column]:
    """Scale and left and top offset that centre an image in a view; scale 0 for an empty image."""
    into_w, into_h = _c(into_w), _c(into_h)
    ok = (width > 0) & (height > 0)
    scale = F.when(ok, F.least(into_w / F.when(ok, width), into_h / F.when(ok, height))).otherwise(F.lit(0.0))
    return scale, (into_w - width * scale) / 2, (into_h - height * scale) / 2


def letterbox(width: Column, height: Column, target: int = 1024, stride: int = 32) -> dict[str, Column]:
    """How an image is scaled into ``target`` pixels and padded to a multiple of ``stride``."""
    scale = F.least(target / width, target / height)
    w, h = F.round(width * scale).cast("long"), F.round(height * scale).cast("long")
    pad_w, pad_h = F.pmod(-w, F.lit(stride)), F.pmod(-h, F.lit(stride))
    return {"scale": scale, "new_w": w, "new_h": h, "pad_left": F.floor(pad_w / 2), "pad_top": F.floor(pad_h / 2), "full_w": w + pad_w, "full_h": h + pad_h}


def clamp(v: Column, low, high) -> Column:
    return F.greatest(_c(low), F.least(_c(high), v))
