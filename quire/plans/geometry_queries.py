"""Queries of the scalar geometry operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import geometry as g
from quire.operators import relations
from quire.plans.registry import query
from quire.sources import layouts as L
from quire.sources.layouts import with_sql

KEY = ["capture_id", "block_id"]


def blocks(spark: SparkSession, d: str) -> DataFrame:
    return L.text_blocks(L.table(spark, d, "lineitem"))


def figures(spark: SparkSession, d: str) -> DataFrame:
    return L.figures(L.table(spark, d, "orders"))


def one_figure(spark: SparkSession, d: str, key: str) -> DataFrame:
    return figures(spark, d).withColumn(key, F.lit(0).cast("long"))


def both(spark: SparkSession, d: str) -> DataFrame:
    """Figure (a) and text (b) of a page."""
    return relations.pairs(figures(spark, d), blocks(spark, d), [], ["block_id"])


class _Box:
    """A rectangle of prefixed columns whose columns are made when they are used: modules load without a session."""

    def __init__(self, prefix: str):
        self._prefix = prefix

    def __getattr__(self, name: str):
        return getattr(g.rect(self._prefix), name)


A, B = _Box("a"), _Box("b")
BOTH = "SELECT capture_id, block_id, f.x AS ax, f.y AS ay, f.w AS aw, f.h AS ah, t.x AS bx, t.y AS by_, t.w AS bw, t.h AS bh FROM fig f JOIN tb t USING (capture_id)"
#: Overlaps of figure (a) and text (b) on both axes.
OX, OY = "(least(ax+aw,bx+bw)-greatest(ax,bx))", "(least(ay+ah,by_+bh)-greatest(ay,by_))"
INTER = f"(CASE WHEN {OX}>0 AND {OY}>0 THEN {OX}*{OY} ELSE 0 END)"
REL = f"""CASE WHEN {INTER}/(bw*bh)>0.05 THEN 'overlapping'
 WHEN greatest(0,{OY})/least(ah,bh)>0.3 AND abs(bx-(ax+aw))<0.03 THEN 'adjacentRight'
 WHEN greatest(0,{OY})/least(ah,bh)>0.3 AND abs(ax-(bx+bw))<0.03 THEN 'adjacentLeft'
 WHEN greatest(0,{OX})/least(aw,bw)>0.3 AND abs(by_-(ay+ah))<0.03 THEN 'adjacentAbove'
 WHEN greatest(0,{OX})/least(aw,bw)>0.3 AND abs(ay-(by_+bh))<0.03 THEN 'adjacentBelow' ELSE 'disjoint' END"""
EDGES_SQL = f""", both_ AS ({BOTH}), rel AS (SELECT *, {REL} AS relation FROM both_),
blk AS (SELECT f.capture_id, f.x, f.y, f.w, f.h, coalesce(bool_or(relation='adjacentAbove'), false) AS bt, coalesce(bool_or(relation='adjacentBelow'), false) AS bb,
  coalesce(bool_or(relation='adjacentLeft'), false) AS bl, coalesce(bool_or(relation='adjacentRight'), false) AS br
  FROM fig f LEFT JOIN rel USING (capture_id) GROUP BY f.capture_id, f.x, f.y, f.w, f.h) """


@query("g1_pixel_rect", with_sql("tb", "SELECT capture_id, block_id, round(x*1920,6) AS x, round(y*1080,6) AS y, round(w*1920,6) AS w, round(h*1080,6) AS h FROM tb"))
def pixel_rect(spark, d):
    return blocks(spark, d).select(*KEY, *g.rect().scaled(1920, 1080).named(places=6))


@query("g2_normalized_bounds", with_sql("tb", "SELECT capture_id, block_id, CASE WHEN s>0 THEN round(xi/s,9) ELSE 0 END AS x, CASE WHEN s>0 THEN round(yi/1080.0::DOUBLE,9) ELSE 0 END AS y, CASE WHEN s>0 THEN round(wi/s,9) ELSE 0 END AS w, CASE WHEN s>0 THEN round(hi/1080.0::DOUBLE,9) ELSE 0 END AS h FROM (SELECT *, ((class_id*1920))::DOUBLE AS s FROM tb)"))
def normalized_bounds(spark, d):
    px = g.Rect(*(F.col(f"{k}i").cast("double") for k in "xywh"))
    return blocks(spark, d).select(*KEY, *g.normalized(px, (F.col("class_id") * 1920).cast("double"), 1080).named(places=9))


@query("g3_flip", with_sql("tb", "SELECT capture_id, block_id, x, round(1-y-h,6) AS y, w, h FROM tb"))
def flip(spark, d):
    r = g.rect().flipped()
    return blocks(spark, d).select(*KEY, "x", F.round(r.y, 6).alias("y"), "w", "h")


@query("g4_pixel_crop", with_sql("tb", "SELECT capture_id, block_id, greatest(floor(x*1920),0.0) AS x, greatest(floor((1-y-h)*1080),0.0) AS y, least(ceil(x*1920+w*1920),1920.0)-greatest(floor(x*1920),0.0) AS w, least(ceil((1-y-h)*1080+h*1080),1080.0)-greatest(floor((1-y-h)*1080),0.0) AS h FROM tb"))
def pixel_crop(spark, d):
    return blocks(spark, d).select(*KEY, *g.pixel_crop(g.rect(), 1920, 1080).named())


@query("g5_clamp_bounds", with_sql("tb", "SELECT capture_id, block_id, round(greatest(0,least(1-2*w,x*2)),6) AS x, round(greatest(0,least(1-h,y*2)),6) AS y, greatest(0.01,least(1,2*w)) AS w, greatest(0.01,least(1,h)) AS h FROM tb"))
def clamp_bounds(spark, d):
    r = g.rect()
    return blocks(spark, d).select(*KEY, *g.clamp_overlay(g.Rect(r.x * 2, r.y * 2, r.w * 2, r.h)).named(places=6))


@query("g6_flip_on_display", with_sql("tb", ", r AS (SELECT capture_id, block_id, greatest(xi*4,0)::DOUBLE AS x1, greatest(1080-yi*2-hi,0)::DOUBLE AS y1, least(xi*4+wi,1920)::DOUBLE AS x2, least(1080-yi*2,1080)::DOUBLE AS y2 FROM tb) SELECT capture_id, block_id, CASE WHEN x2>x1 AND y2>y1 THEN x1 END AS x, CASE WHEN x2>x1 AND y2>y1 THEN y1 END AS y, CASE WHEN x2>x1 AND y2>y1 THEN x2-x1 END AS w, CASE WHEN x2>x1 AND y2>y1 THEN y2-y1 END AS h FROM r"))
def flip_on_display(spark, d):
    r = g.Rect((F.col("xi") * 4).cast("double"), (F.col("yi") * 2).cast("double"), F.col("wi").cast("double"), F.col("hi").cast("double"))
    return blocks(spark, d).select(*KEY, *g.flip_on_display(r, 1920, 1080).named())


@query("g7_iou", with_sql("fig tb", f", both_ AS ({BOTH}) SELECT capture_id, block_id, round({INTER}/(aw*ah+bw*bh-{INTER}),6) AS iou, round(aw*ah,6) AS area FROM both_"))
def iou(spark, d):
    return both(spark, d).select(*KEY, F.round(g.iou(A, B), 6).alias("iou"), F.round(A.area, 6).alias("area"))


@query("g8_text_overlap", with_sql("fig tb", f", both_ AS ({BOTH}), s AS (SELECT capture_id, sum({INTER}) AS s FROM both_ GROUP BY 1) SELECT capture_id, least(1, round(coalesce(s,0)/(w*h),9)) AS text_overlap FROM fig LEFT JOIN s USING (capture_id)"))
def text_overlap(spark, d):
    return relations.text_overlap(one_figure(spark, d, "cand_id"), blocks(spark, d)).select("capture_id", "text_overlap")


@query("g9_text_free_regions", with_sql("fig tb", f", both_ AS ({BOTH}), s AS (SELECT capture_id, sum({INTER}) AS s FROM both_ GROUP BY 1) SELECT capture_id, x, y, w, h FROM fig LEFT JOIN s USING (capture_id) WHERE round(coalesce(s,0)/(w*h),9)<0.04"))
def text_free(spark, d):
    return relations.text_free(one_figure(spark, d, "cand_id"), blocks(spark, d), most=0.04).select("capture_id", "x", "y", "w", "h")


@query("g10_text_relation", with_sql("fig tb", f", both_ AS ({BOTH}) SELECT capture_id, block_id, {REL} AS relation FROM both_"))
def text_relation(spark, d):
    return relations.classified(one_figure(spark, d, "fig_idx"), blocks(spark, d)).select(*KEY, "relation")


@query("g11_blocked_edges", with_sql("fig tb", EDGES_SQL + "SELECT capture_id, bt AS blocked_top, bb AS blocked_bottom, bl AS blocked_left, br AS blocked_right FROM blk"))
def blocked_edges(spark, d):
    return relations.blocked_edges(one_figure(spark, d, "fig_idx"), blocks(spark, d)).select("capture_id", *(f"blocked_{e}" for e in relations.EDGES))


@query("g12_rect_distance", with_sql("fig tb", f", both_ AS ({BOTH}) SELECT capture_id, block_id, round(sqrt(greatest(0,-{OX})*greatest(0,-{OX})+greatest(0,-{OY})*greatest(0,-{OY})),6) AS distance FROM both_"))
def rect_distance(spark, d):
    return both(spark, d).select(*KEY, F.round(g.distance(A, B), 6).alias("distance"))


SNAP_SQL = EDGES_SQL + """, s1 AS (SELECT *, CASE WHEN w>=0.4 AND x>0 AND x<0.4 AND NOT bl THEN 0 ELSE x END AS nx, CASE WHEN w>=0.4 AND 1-(x+w)>0 AND 1-(x+w)<0.4 AND NOT br THEN 1 ELSE x+w END AS nx2 FROM blk),
s2 AS (SELECT *, h>=CASE WHEN nx2-nx>0.95 THEN 0.2 ELSE 0.4 END AS tall FROM s1),
s3 AS (SELECT *, CASE WHEN tall AND y>0 AND y<0.4 AND NOT bb THEN 0 ELSE y END AS ny, CASE WHEN tall AND 1-(y+h)>0 AND 1-(y+h)<0.4 AND NOT bt THEN 1 ELSE y+h END AS ny2 FROM s2)
SELECT capture_id, round(nx,6) AS x, round(ny,6) AS y, round(nx2-nx,6) AS w, round(ny2-ny,6) AS h FROM s3"""


@query("g13_snap_to_edges", with_sql("fig tb", SNAP_SQL))
def snap(spark, d):
    f = relations.blocked_edges(one_figure(spark, d, "fig_idx"), blocks(spark, d))
    return f.select("capture_id", *g.snapped(g.rect(), relations.blocked(), threshold=0.4).named(places=6))


@query("g14_directional_expand", with_sql("fig tb", EDGES_SQL + ", m AS (SELECT *, CASE WHEN bl THEN 0 ELSE 0.04 END AS ml, CASE WHEN br THEN 0 ELSE 0.04 END AS mr, CASE WHEN bt THEN 0 ELSE 0.04 END AS mt, CASE WHEN bb THEN 0 ELSE 0.04 END AS mb FROM blk) SELECT capture_id, round(greatest(0,x-ml),6) AS x, round(greatest(0,y-mb),6) AS y, round(least(1-greatest(0,x-ml),w+ml+mr),6) AS w, round(least(1-greatest(0,y-mb),h+mb+mt),6) AS h FROM m"))
def expand(spark, d):
    f = relations.blocked_edges(one_figure(spark, d, "fig_idx"), blocks(spark, d))
    return f.select("capture_id", *g.expanded(g.rect(), relations.blocked()).named(places=6))


GAP_AREA = "(greatest(0, least(bx+bw,ax)-greatest(bx,0))*greatest(0,{oy}))".format(oy=OY)


@query("g17_text_in_gap", with_sql("fig tb", f", both_ AS ({BOTH}) SELECT capture_id, round(sum({GAP_AREA})/(max(ax)*max(ah)),9)>=0.05 AS significant FROM both_ WHERE ax>0 GROUP BY capture_id"))
def text_in_gap(spark, d):
    """Whether text covers at least a twentieth of the strip to the left of each figure."""
    f = one_figure(spark, d, "cand_id").where("x > 0").withColumns({"w": F.col("x"), "x": F.lit(0.0)})
    return relations.text_overlap(f, blocks(spark, d)).join(blocks(spark, d).select("capture_id").distinct(), "capture_id", "left_semi").select("capture_id", (F.col("text_overlap") >= 0.05).alias("significant"))


@query("g18_size_filter", with_sql("fig", "SELECT capture_id, x, y, w, h FROM fig WHERE round(w*h,9)>=0.1"))
def size_filter(spark, d):
    return figures(spark, d).where(F.round(g.rect().area, 9) >= 0.1).select("capture_id", "x", "y", "w", "h")


@query("g19_aspect_filter", with_sql("tb", "SELECT capture_id, block_id, w/greatest(h,0.001) AS aspect FROM tb WHERE w/greatest(h,0.001)>=15"))
def aspect_filter(spark, d):
    aspect = F.col("w") / F.greatest("h", F.lit(0.001))
    return blocks(spark, d).where(aspect >= 15).select(*KEY, aspect.alias("aspect"))


@query("g20_text_bleed_filter", with_sql("fig tb", f", both_ AS ({BOTH}), s AS (SELECT capture_id, sum({INTER}) AS s FROM both_ GROUP BY 1) SELECT capture_id, round(coalesce(s,0)/(w*h),9) AS bleed FROM fig LEFT JOIN s USING (capture_id) WHERE round(coalesce(s,0)/(w*h),9)<=0.10"))
def text_bleed(spark, d):
    f = relations.text_overlap(one_figure(spark, d, "cand_id"), blocks(spark, d))
    return f.where("text_overlap <= 0.10").select("capture_id", F.col("text_overlap").alias("bleed"))


@query("g21_low_confidence", with_sql("tb", "SELECT capture_id, bool_or(round(confidence,9)<0.7) AS has_low, sum((round(confidence,9)<0.7)::INT)::BIGINT AS low_words FROM tb GROUP BY capture_id"))
def low_confidence(spark, d):
    words = blocks(spark, d).groupBy("capture_id").agg(F.collect_list(F.round("confidence", 9)).alias("c"))
    return words.select("capture_id", F.exists("c", lambda c: c < 0.7).alias("has_low"), F.size(F.filter("c", lambda c: c < 0.7)).cast("long").alias("low_words"))


@query("g22_edge_proximity", with_sql("fig tb", f", both_ AS ({BOTH}), e AS (SELECT capture_id, block_id, (ay+ah-(by_+bh))/ah AS t, (by_-ay)/ah AS b, (bx-ax)/aw AS l, (ax+aw-(bx+bw))/aw AS r FROM both_ WHERE {INTER}>0) SELECT capture_id, block_id, round(least(t,b,l,r),6) AS near, CASE least(t,b,l,r) WHEN t THEN 'top' WHEN b THEN 'bottom' WHEN l THEN 'left' ELSE 'right' END AS edge FROM e"))
def edge_proximity(spark, d):
    near = g.edge_proximity(A, B)
    return both(spark, d).where(g.meets(A, B)).select(*KEY, F.round(near["near"], 6).alias("near"), near["edge"].alias("edge"))


@query("g23_text_in_crop", with_sql("fig tb", f", both_ AS ({BOTH}) SELECT capture_id, block_id, round((greatest(ax,bx)-ax)/aw,6) AS x, round((greatest(ay,by_)-ay)/ah,6) AS y, round({OX}/aw,6) AS w, round({OY}/ah,6) AS h FROM both_ WHERE {INTER}>0"))
def text_in_crop(spark, d):
    i = g.intersection(A, B)
    return both(spark, d).where(g.meets(A, B)).select(*KEY, *g.Rect((i.x - A.x) / A.w, (i.y - A.y) / A.h, i.w / A.w, i.h / A.h).named(places=6))


@query("g24_text_coverage", with_sql("fig tb", f", both_ AS ({BOTH}) SELECT capture_id, block_id, round(least(1,greatest(0,{INTER}/(bw*bh))),6) AS coverage FROM both_"))
def text_coverage(spark, d):
    return both(spark, d).select(*KEY, F.round(g.clamp(g.share_inside(B, A), 0, 1), 6).alias("coverage"))


@query("g25_drawn_rect", with_sql("fig tb", f", both_ AS ({BOTH}) SELECT capture_id, block_id, least(ax,bx) AS x, least(ay,by_) AS y, round(abs(bx-ax),6) AS w, round(abs(by_-ay),6) AS h FROM both_ WHERE round(abs(bx-ax),6)>0.02 AND round(abs(by_-ay),6)>0.02"))
def drawn_rect(spark, d):
    r = g.drawn(A.x, A.y, B.x, B.y)
    return both(spark, d).select(*KEY, *r.named(places=6)).where("w > 0.02 AND h > 0.02")


HANDLES = ["topLeft", "top", "topRight", "right", "bottomRight", "bottom", "bottomLeft", "left"]


@query("g26_resize_handle", with_sql("tb", ", q AS (SELECT *, list_extract(['topLeft','top','topRight','right','bottomRight','bottom','bottomLeft','left'], (block_id%8+1)::INT) AS hd, class_id*0.02-0.01 AS dx, 0.005 AS dy FROM tb), s AS (SELECT *, (hd LIKE '%Left' OR hd='left') AS le, (hd LIKE '%Right' OR hd='right') AS ri, hd LIKE 'top%' AS tp, hd LIKE 'bottom%' AS bo FROM q) SELECT capture_id, block_id, hd AS handle, round(x+CASE WHEN le THEN dx ELSE 0 END,6) AS x, round(y+CASE WHEN tp THEN dy ELSE 0 END,6) AS y, round(w+CASE WHEN ri THEN dx WHEN le THEN -dx ELSE 0 END,6) AS w, round(h+CASE WHEN bo THEN dy WHEN tp THEN -dy ELSE 0 END,6) AS h FROM s"))
def resize_handle(spark, d):
    b = blocks(spark, d).withColumn("handle", F.get(F.array(*map(F.lit, HANDLES)), (F.col("block_id") % 8).cast("int")))
    return b.select(*KEY, "handle", *g.resized(g.rect(), F.col("handle"), F.col("class_id") * 0.02 - 0.01, F.lit(0.005)).named(places=6))


@query("g27_aspect_fit", with_sql("tb", "SELECT capture_id, block_id, round(least(800.0/wi,600.0/hi),6) AS scale, round((800-wi*least(800.0/wi,600.0/hi))/2,6) AS off_x, round((600-hi*least(800.0/wi,600.0/hi))/2,6) AS off_y FROM tb"))
def aspect_fit(spark, d):
    s, x, y = g.aspect_fit(F.col("wi").cast("double"), F.col("hi").cast("double"), 800, 600)
    return blocks(spark, d).select(*KEY, F.round(s, 6).alias("scale"), F.round(x, 6).alias("off_x"), F.round(y, 6).alias("off_y"))


@query("g28_letterbox", with_sql("tb", ", s AS (SELECT capture_id, block_id, wi, hi, least(1024.0::DOUBLE/wi,1024.0::DOUBLE/hi) AS scale FROM tb), n AS (SELECT *, round(wi*scale)::BIGINT AS new_w, round(hi*scale)::BIGINT AS new_h FROM s) SELECT capture_id, block_id, round(scale,6) AS scale, new_w, new_h, ((32-new_w%32)%32)//2 AS pad_left, ((32-new_h%32)%32)//2 AS pad_top, new_w+(32-new_w%32)%32 AS full_w, new_h+(32-new_h%32)%32 AS full_h FROM n"))
def letterbox(spark, d):
    plan = g.letterbox(F.col("wi").cast("double"), F.col("hi").cast("double"))
    return blocks(spark, d).select(*KEY, *(F.round(v, 6).alias(k) if k == "scale" else v.cast("long").alias(k) for k, v in plan.items()))


@query("g29_decode_detections", with_sql("tb", ", q AS (SELECT *, 1-confidence+0.1*class_id AS conf, (xi-20)/1.5::DOUBLE AS x1, (yi-10)/1.5::DOUBLE AS y1, (xi+wi-20)/1.5::DOUBLE AS x2, (yi+hi-10)/1.5::DOUBLE AS y2, (block_id%12)::BIGINT AS cls FROM tb), c AS (SELECT *, least(1,greatest(0,x1/600)) AS a, least(1,greatest(0,y1/600)) AS b, least(1,greatest(0,x2/600)) AS c, least(1,greatest(0,y2/600)) AS d FROM q WHERE round(conf,9)>=0.15 AND cls<10) SELECT capture_id, block_id, cls AS class_id, round(a,6) AS x, round(b,6) AS y, round(c-a,6) AS w, round(d-b,6) AS h FROM c WHERE c-a>0 AND d-b>0"))
def decode(spark, d):
    """Letterboxed detections back on the page: confidence filter, known classes, clamped, empty ones dropped."""
    b = blocks(spark, d).withColumn("conf", F.round(1 - F.col("confidence") + 0.1 * F.col("class_id"), 9)).withColumn("class_id", F.col("block_id") % 12)
    b = b.where("conf >= 0.15 AND class_id < 10")
    at = lambda v, pad: g.clamp((v - pad) / 1.5 / 600, 0, 1)
    r = g.corners(at(F.col("xi"), 20), at(F.col("yi"), 10), at(F.col("xi") + F.col("wi"), 20), at(F.col("yi") + F.col("hi"), 10))
    return b.where((r.w > 0) & (r.h > 0)).select(*KEY, "class_id", *r.named(places=6))


@query("g30_region_selection", with_sql("fig tb", ", b AS (SELECT f.capture_id, t.block_id, least(f.xi,t.xi) AS x, least(f.yi,t.yi) AS y, abs(t.xi-f.xi) AS w, abs(t.yi-f.yi) AS h FROM fig f JOIN tb t USING (capture_id)) SELECT capture_id, block_id, CASE WHEN w>10 AND h>10 THEN (x+100)::DOUBLE END AS x, CASE WHEN w>10 AND h>10 THEN (y+50)::DOUBLE END AS y, CASE WHEN w>10 AND h>10 THEN w::DOUBLE END AS w, CASE WHEN w>10 AND h>10 THEN h::DOUBLE END AS h FROM b"))
def region_selection(spark, d):
    """A region drawn in a view at (100, 50) of the screen; null where it is too small to count."""
    p = figures(spark, d).select("capture_id", F.col("xi").alias("ax"), F.col("yi").alias("ay")).join(blocks(spark, d).select(*KEY, "xi", "yi"), "capture_id")
    r = g.drawn(F.col("ax").cast("double"), F.col("ay").cast("double"), F.col("xi").cast("double"), F.col("yi").cast("double"))
    ok = (r.w > 10) & (r.h > 10)
    return p.select(*KEY, *(F.when(ok, v).alias(k) for k, v in zip("xywh", (r.x + 100, r.y + 50, r.w, r.h), strict=True)))


@query("g31_pan_zoom", with_sql("tb", ", z AS (SELECT *, least(5,greatest(1,x*8)) AS zoom FROM tb) SELECT capture_id, block_id, round(zoom,6) AS zoom, round(greatest(-(zoom-1)*400,least((zoom-1)*400,(y-0.5)*2000)),6) AS pan FROM z"))
def pan_zoom(spark, d):
    zoom = g.clamp(F.col("x") * 8, 1, 5)
    reach = (zoom - 1) * 400
    return blocks(spark, d).select(*KEY, F.round(zoom, 6).alias("zoom"), F.round(F.greatest(-reach, F.least(reach, (F.col("y") - 0.5) * 2000)), 6).alias("pan"))
