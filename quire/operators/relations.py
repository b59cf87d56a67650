"""How texts, figures, subjects and candidates of a page stand to each other: joins on the capture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import geometry as g

EDGES = {"top": "adjacentAbove", "bottom": "adjacentBelow", "left": "adjacentLeft", "right": "adjacentRight"}


def boxed(df: DataFrame, prefix: str, *keep: str) -> DataFrame:
    """Key, kept columns and the box under prefixed names, for a join with another table of boxes."""
    return df.select("capture_id", *keep, *(F.col(k).alias(prefix + k) for k in "xywh"))


def pairs(left: DataFrame, right: DataFrame, left_keep: list[str], right_keep: list[str], how: str = "inner") -> DataFrame:
    """Boxes ``a*`` and ``b*`` of the same capture."""
    return boxed(left, "a", *left_keep).join(boxed(right, "b", *right_keep), "capture_id", how)


def text_overlap(regions: DataFrame, blocks: DataFrame, key: str = "cand_id") -> DataFrame:
    """``regions`` with ``text_overlap``: the texts' areas inside over the region's, at most 1; 0 without text.

    Texts that overlap count twice. Sums are rounded to nine places, so the order of rows has no effect.
    """
    a, b = g.rect("a"), g.rect("b")
    met = pairs(regions, blocks, [key], [], "left")
    area = F.first(a.area)
    share = F.when(area > 0, F.least(F.lit(1.0), F.round(F.sum(F.coalesce(F.when(F.col("bx").isNotNull(), g.shared_area(a, b)), F.lit(0.0))) / F.when(area > 0, area), 9))).otherwise(F.lit(0.0))
    return regions.join(met.groupBy("capture_id", key).agg(share.alias("text_overlap")), ["capture_id", key])


def text_free(regions: DataFrame, blocks: DataFrame, most: float = 0.4, key: str = "cand_id") -> DataFrame:
    """Regions with less than ``most`` of their area under text."""
    return text_overlap(regions, blocks, key).where(F.col("text_overlap") < most)


def classified(figures: DataFrame, blocks: DataFrame, key: str = "fig_idx", **limits) -> DataFrame:
    """Every text of a page with its relation to every figure of the page."""
    met = pairs(figures, blocks, [key], ["block_id"])
    return met.select("capture_id", key, "block_id", g.relation(g.rect("a"), g.rect("b"), **limits).alias("relation"))


def blocked_edges(figures: DataFrame, blocks: DataFrame, key: str = "fig_idx", **limits) -> DataFrame:
    """``figures`` with ``blocked_top`` and so on: whether a text stands close at that edge."""
    found = classified(figures, blocks, key, **limits).groupBy("capture_id", key).agg(*(F.max(F.col("relation") == r).alias(f"blocked_{e}") for e, r in EDGES.items()))
    out = figures.join(found, ["capture_id", key], "left")
    return out.withColumns({f"blocked_{e}": F.coalesce(f"blocked_{e}", F.lit(False)) for e in EDGES})


def blocked() -> dict[str, Column]:
    return {e: F.col(f"blocked_{e}") for e in EDGES}


def best_of(candidates: DataFrame, boxes: DataFrame, key: str = "merged_id") -> DataFrame:
    """For each box the most confident candidate that meets it (the first on ties): its id, source and confidence."""
    met = pairs(boxes, candidates, [key], ["cand_id", "source", "confidence"]).where(g.meets(g.rect("a"), g.rect("b")))
    best = met.groupBy("capture_id", key).agg(F.max(F.struct("confidence", (-F.col("cand_id")).alias("o"), "cand_id", "source")).alias("m"))
    return boxes.join(best.select("capture_id", key, F.col("m.cand_id").alias("cand_id"), F.col("m.source").alias("source"), F.col("m.confidence").alias("confidence")), ["capture_id", key])


def held_share(subjects: DataFrame, candidates: DataFrame, share: float = 0.20) -> DataFrame:
    """``subjects`` with ``covered``: whether more than ``share`` of it lies in one candidate."""
    a, b = g.rect("a"), g.rect("b")
    met = pairs(subjects, candidates, ["subj_id"], []).groupBy("capture_id", "subj_id").agg(F.max(F.round(g.share_inside(a, b), 9) > share).alias("covered"))
    return subjects.join(met, ["capture_id", "subj_id"], "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def boosted(candidates: DataFrame, subjects: DataFrame, share: float = 0.20, boost: float = 0.3) -> DataFrame:
    """``candidates`` with ``has_subject``, and more confidence and evidence where a subject lies in them."""
    a, b = g.rect("a"), g.rect("b")
    met = pairs(candidates, subjects, ["cand_id"], []).groupBy("capture_id", "cand_id").agg(F.max(F.round(g.share_inside(b, a), 9) > share).alias("has_subject"))
    out = candidates.join(met, ["capture_id", "cand_id"], "left").withColumn("has_subject", F.coalesce("has_subject", F.lit(False)))
    return out.withColumn("confidence", F.col("confidence") + F.when(F.col("has_subject"), boost).otherwise(0.0)).withColumn("evidence", F.when(F.col("has_subject"), F.array_union("evidence", F.array(F.lit("hasSubject")))).otherwise(F.col("evidence")))


def nearest_anchor(parts: DataFrame, anchors: DataFrame, key: str = "blob_id", factor: float = 4.0) -> DataFrame:
    """The nearest text of each part within ``factor`` text heights; ties to the smaller id; parts without one have no row."""
    met = pairs(parts, anchors, [key], ["block_id"]).withColumn("distance", F.round(g.distance(g.rect("a"), g.rect("b")), 9))
    near = met.where(F.col("distance") <= F.round(factor * F.col("bh"), 9))
    return near.groupBy("capture_id", key).agg(F.min(F.struct("distance", "block_id")).alias("m")).select("capture_id", key, F.col("m.block_id").alias("block_id"), F.col("m.distance").alias("distance"))


def text_gap_bounds(regions: DataFrame, blocks: DataFrame, key: str = "cand_id", overlap: float = 0.2, least: float = 0.05) -> DataFrame:
    """The room between the nearest texts above and below each region's middle; regions without enough have no row."""
    a, b = g.rect("a"), g.rect("b")
    wide = F.round(g.overlap_x(a, b) - a.w * overlap, 9) > 0
    met = pairs(regions, blocks, [key], [])
    room = met.groupBy("capture_id", key, *(f"a{k}" for k in "xywh")).agg(
        F.min(F.when(wide & (F.round(b.y - a.mid_y, 9) > 0), b.y)).alias("top"), F.max(F.when(wide & (F.round(b.y2 - a.mid_y, 9) < 0), b.y2)).alias("floor")
    )
    low, high = F.greatest(F.lit(0.0), F.coalesce("floor", F.lit(0.0))), F.least(F.lit(1.0), F.coalesce("top", F.lit(1.0)))
    out = room.select("capture_id", key, F.col("ax").alias("x"), F.round(low, 9).alias("y"), F.col("aw").alias("w"), F.round(high - low, 9).alias("h"))
    return out.where(F.col("h") > least)


def first_overlay_figure(classes: DataFrame) -> DataFrame:
    """For each text the first figure of which it is an overlay: ``capture_id, block_id, fig_idx, class``."""
    w = Window.partitionBy("capture_id", "block_id").orderBy("fig_idx")
    on = classes.where(F.col("class").isin("overlay", "edgeOverlay"))
    return on.withColumn("n", F.row_number().over(w)).where("n = 1").select("capture_id", "block_id", "fig_idx", "class")


def with_subjects(rects: DataFrame, subjects: DataFrame, blocks: DataFrame, key: str = "fig_idx", share: float = 0.20, most: float = 0.30) -> DataFrame:
    """Each rectangle grown to the subjects that lie in it by more than ``share``; less where text blocks the edge."""
    a, b = g.rect("a"), g.rect("b")
    met = pairs(rects, subjects, [key], []).where(F.round(g.share_inside(b, a), 9) > share)
    hull = met.groupBy("capture_id", key).agg(F.min("bx").alias("x1"), F.min("by").alias("y1"), F.max(b.x2).alias("x2"), F.max(b.y2).alias("y2"))
    d = rects.join(hull, ["capture_id", key])
    u = g.union(g.rect(), g.corners(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))
    x, y = F.greatest(F.lit(0.0), u.x), F.greatest(F.lit(0.0), u.y)
    grown = g.Rect(x, y, F.least(1 - x, u.w), F.least(1 - y, u.h))
    big = d.select("capture_id", key, *(F.col(k).alias(f"o{k}") for k in "xywh"), *grown.named())
    e, o, stop = g.rect(), g.rect("o"), blocked()
    low_y = F.when(stop["bottom"], F.greatest(e.y, o.y - o.h * most)).otherwise(e.y)
    high_y = F.when(stop["top"], F.least(e.y2, o.y2 + o.h * most)).otherwise(e.y2)
    low_x = F.when(stop["left"], F.greatest(e.x, o.x - o.w * most)).otherwise(e.x)
    high_x = F.when(stop["right"], F.least(e.x2, o.x2 + o.w * most)).otherwise(e.x2)
    done = blocked_edges(big, blocks, key).select("capture_id", key, *g.corners(low_x, low_y, high_x, high_y).named("n"))
    out = rects.join(done, ["capture_id", key], "left")
    return out.withColumns({k: F.coalesce(f"n{k}", k) for k in "xywh"}).drop("nx", "ny", "nw", "nh")


def promoted(subjects: DataFrame, blocks: DataFrame, margin: float = 0.2, key: str = "subj_id") -> DataFrame:
    """Subjects grown by a margin and pulled back to the nearest text on each side, one side after the other."""
    r = g.rect()
    d = subjects.select("capture_id", key, *g.corners(F.greatest(F.lit(0.0), r.x - r.w * margin), F.greatest(F.lit(0.0), r.y - r.h * margin), F.least(F.lit(1.0), r.x2 + r.w * margin), F.least(F.lit(1.0), r.y2 + r.h * margin)).named())
    for edge in ("right", "left", "top", "bottom"):
        a, b = g.rect("a"), g.rect("b")
        near = pairs(d, blocks, [key], ["block_id"]).where(g.relation(a, b) == EDGES[edge])
        stop = {"right": F.min(b.x), "left": F.max(b.x2), "top": F.min(b.y), "bottom": F.max(b.y2)}[edge]
        d = d.join(near.groupBy("capture_id", key).agg(stop.alias("stop")), ["capture_id", key], "left")
        s, r = F.col("stop"), g.rect()
        cut = {"right": g.Rect(r.x, r.y, s - r.x, r.h), "left": g.Rect(s, r.y, r.x2 - s, r.h), "top": g.Rect(r.x, r.y, r.w, s - r.y), "bottom": g.Rect(r.x, s, r.w, r.y2 - s)}[edge]
        d = d.select("capture_id", key, *r.when(s.isNotNull(), cut).named())
    return d
