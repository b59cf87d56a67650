"""Queries over page images: rasters, their texts and regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import geometry as g
from quire.operators import raster, relations, scoring
from quire.plans.geometry_queries import BOTH, INTER, both
from quire.plans import raster_sql as R
from quire.plans.registry import query
from quire.sources import layouts as L
from quire.sources.layouts import with_sql


def pixels(spark, d):
    return L.pixels(L.rasters(L.table(spark, d, "embeddings")))


def changed(spark, d):
    """A second version of every image: its fourth column lighter, its sixth row darker."""
    p = pixels(spark, d)
    shift = lambda c: F.when(F.col("px") == 3, F.least(F.lit(255), F.col(c) + 40)).when(F.col("py") == 5, F.greatest(F.lit(0), F.col(c) - 12)).otherwise(F.col(c)).cast("long").alias(c)
    return p.select(*raster.SIZE, "px", "py", *(shift(c) for c in "rgb"))


def _boxes(spark, d):
    v = F.col("vec_id")
    return L.table(spark, d, "embeddings").where(F.size("embedding") == 64), v


def texts(spark, d):
    """One text a raster, its place by arithmetic on the id."""
    e, v = _boxes(spark, d)
    return e.select(v.alias("capture_id"), F.lit(0).cast("long").alias("block_id"), ((v % 4) / 8.0).alias("x"), ((v % 5) / 8.0).alias("y"), F.lit(0.5).alias("w"), F.lit(0.25).alias("h"))


def regions(spark, d):
    """One candidate a raster."""
    e, v = _boxes(spark, d)
    return e.select(v.alias("capture_id"), F.lit(0).cast("long").alias("cand_id"), ((v % 3) / 8.0).alias("x"), ((v % 2) / 8.0).alias("y"), F.lit(0.625).alias("w"), F.lit(0.75).alias("h"))


def pixel_boxes(spark, d):
    e, v = _boxes(spark, d)
    return e.select(v.alias("capture_id"), (v % 3).alias("x"), (v % 2).alias("y"), F.lit(5).cast("long").alias("w"), F.lit(4).cast("long").alias("h"))


TXT = ", ids AS (SELECT vec_id AS c FROM embeddings WHERE len(embedding)=64), txt AS (SELECT c AS capture_id, (c%4)/8.0::DOUBLE AS x, (c%5)/8.0::DOUBLE AS y, 0.5::DOUBLE AS w, 0.25::DOUBLE AS h FROM ids), reg AS (SELECT c AS capture_id, (c%3)/8.0::DOUBLE AS x, (c%2)/8.0::DOUBLE AS y, 0.625::DOUBLE AS w, 0.75::DOUBLE AS h FROM ids), pb AS (SELECT c AS capture_id, c%3 AS x, c%2 AS y, 5 AS w, 4 AS h FROM ids), chg AS (SELECT capture_id, px, py, CASE WHEN px=3 THEN least(255,r+40) WHEN py=5 THEN greatest(0,r-12) ELSE r END AS r, CASE WHEN px=3 THEN least(255,g+40) WHEN py=5 THEN greatest(0,g-12) ELSE g END AS g, CASE WHEN px=3 THEN least(255,b+40) WHEN py=5 THEN greatest(0,b-12) ELSE b END AS b FROM pix) "
BG = ", pt AS (SELECT capture_id, gx, gy, sum(r)/4.0::DOUBLE AS r, sum(g)/4.0::DOUBLE AS g, sum(b)/4.0::DOUBLE AS b FROM pix, (VALUES (0),(1),(2),(3)) a(gx), (VALUES (0),(1),(2),(3)) c(gy) WHERE px BETWEEN 2+2*gx//3 AND 3+2*gx//3 AND py BETWEEN 2+2*gy//3 AND 3+2*gy//3 GROUP BY 1,2,3), bn AS (SELECT capture_id, floor((r+g+b)/3.0::DOUBLE/40) AS bin, count(*) AS n, round(sum(r)/count(*),6) AS r, round(sum(g)/count(*),6) AS g, round(sum(b)/count(*),6) AS b FROM pt GROUP BY 1,2), bg AS (SELECT capture_id, r, g, b FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY n DESC, bin) AS rn FROM bn) WHERE rn=1) "
CELLS = BG + ", cl AS (SELECT p.capture_id, px AS gx, py AS gy, CASE WHEN (px+0.5)/8>=t.x AND (px+0.5)/8<t.x+t.w AND 1-(py+0.5)/8>=t.y AND 1-(py+0.5)/8<t.y+t.h THEN 'text' WHEN round(abs(p.r-bg.r)+abs(p.g-bg.g)+abs(p.b-bg.b),6)<=60 THEN 'background' ELSE 'content' END AS cell FROM pix p JOIN txt t USING (capture_id) JOIN bg USING (capture_id)) "
VAR = "(sum({c}*{c})::DOUBLE/count(*)-(sum({c})::DOUBLE/count(*))*(sum({c})::DOUBLE/count(*)))"
VARS = "+".join(VAR.format(c=c) for c in "rgb")


@query("r1_background", with_sql("pix", TXT + BG + "SELECT * FROM bg"))
def background(spark, d):
    return raster.background(pixels(spark, d))


@query("r2_mask_box", with_sql("pix", "SELECT capture_id, min(px)/8.0::DOUBLE AS x, 1-(max(py)+1)/8.0::DOUBLE AS y, (max(px)+1-min(px))/8.0::DOUBLE AS w, (max(py)+1-min(py))/8.0::DOUBLE AS h FROM pix WHERE r>140 GROUP BY 1"))
def mask_box(spark, d):
    return raster.mask_box(pixels(spark, d).where("r > 140"))


def cells(spark, d):
    return raster.content_map(pixels(spark, d), texts(spark, d), grid=8)


@query("r3_content_map", with_sql("pix", TXT + CELLS + "SELECT * FROM cl"))
def content_map(spark, d):
    return cells(spark, d)


@query("r4_content_box", with_sql("pix", TXT + CELLS + "SELECT capture_id, min(gx)/8.0::DOUBLE AS x, 1-(max(gy)+1)/8.0::DOUBLE AS y, (max(gx)+1-min(gx))/8.0::DOUBLE AS w, (max(gy)+1-min(gy))/8.0::DOUBLE AS h FROM cl WHERE cell='content' GROUP BY 1"))
def content_box(spark, d):
    return raster.content_box(cells(spark, d), 8)


SCORES = """, q AS (SELECT capture_id, cell, ((gx+0.5)/8>=x AND (gx+0.5)/8<x+w AND 1-(gy+0.5)/8>=y AND 1-(gy+0.5)/8<y+h) AS ins FROM cl JOIN reg USING (capture_id)),
sc AS (SELECT capture_id, sum(ins::INT)::DOUBLE AS a, sum((ins AND cell='content')::INT)::DOUBLE AS c, sum((ins AND cell='text')::INT)::DOUBLE AS t, sum((cell='content')::INT)::DOUBLE AS wh FROM q GROUP BY 1),
s2 AS (SELECT capture_id, CASE WHEN a>0 THEN c/a ELSE 0 END AS density, CASE WHEN wh>0 THEN c/wh ELSE 0 END AS coverage, CASE WHEN a>0 THEN 1-t/a ELSE 1 END AS te FROM sc) """


@query("r4_content_scores", with_sql("pix", TXT + CELLS + SCORES + "SELECT capture_id, round(density,6) AS density, round(coverage,6) AS coverage, round(te,6) AS text_exclusion FROM s2"))
def content_scores(spark, d):
    s = raster.content_scores(cells(spark, d), regions(spark, d), "cand_id", 8)
    return s.select("capture_id", *(F.round(c, 6).alias(c) for c in ("density", "coverage", "text_exclusion")))


@query("c8_hypothesis_score", with_sql("pix", TXT + CELLS + SCORES + "SELECT capture_id, round(density*0.4+coverage*0.4+te*0.2,6) AS score FROM s2"))
def hypothesis_score(spark, d):
    return raster.content_scores(cells(spark, d), regions(spark, d), "cand_id", 8).select("capture_id", F.round("score", 6).alias("score"))


@query("r5_color_variance", with_sql("pix", f"SELECT capture_id, round(sqrt({VARS}),6) AS variance FROM pix GROUP BY 1"))
def color_variance(spark, d):
    return raster.color_variance(pixels(spark, d))


DEV = "round(sqrt(greatest(0,(sum((r+g+b)*(r+g+b))::DOUBLE/count(*)-(sum(r+g+b)::DOUBLE/count(*))*(sum(r+g+b)::DOUBLE/count(*)))/9)),6)"


@query("r6_strip_deviation", with_sql("pix", f"SELECT capture_id, 'column' AS kind, px AS at, {DEV} AS deviation FROM pix GROUP BY 1,3 UNION ALL SELECT capture_id, 'row', py, {DEV} FROM pix GROUP BY 1,3"))
def strip_deviation(spark, d):
    p = pixels(spark, d)
    named = lambda columns, kind: raster.strips(p, columns).select("capture_id", F.lit(kind).alias("kind"), "at", "deviation")
    return named(True, "column").unionByName(named(False, "row"))


@query("r7_tighten_by_variance", with_sql("pix", R.tighten(DEV)))
def tighten(spark, d):
    return raster.tightened(raster.resized(pixels(spark, d), 32, 32))


@query("r8_auto_crop", with_sql("pix", R.LIGHT + R.auto_crop(24, 24)))
def auto_crop(spark, d):
    light = raster.resized(pixels(spark, d), 24, 24).withColumns({c: F.when((F.col("px") < 4) | (F.col("py") > 19), F.lit(250)).otherwise(F.col(c)).cast("long") for c in "rgb"})
    return raster.auto_cropped(light)


@query("r10_saturation_mask", with_sql("pix", "SELECT capture_id, px, py FROM pix WHERE greatest(r,g,b)>10 AND (greatest(r,g,b)-least(r,g,b))/greatest(r,g,b)::DOUBLE>0.40 AND greatest(r,g,b)/255.0>0.25"))
def saturation_mask(spark, d):
    return raster.saturated(pixels(spark, d)).select("capture_id", "px", "py")


@query("a10_content_regions", "WITH RECURSIVE " + with_sql("pix", TXT + CELLS + R.CONTENT + R.CONTENT_REGIONS + "SELECT * FROM creg")[5:])
def content_regions(spark, d):
    return raster.content_regions(cells(spark, d), 8)


COMP = "WITH RECURSIVE " + with_sql("pix", ", m AS (SELECT capture_id, px, py, py*8+px AS k FROM pix WHERE r>125), r(capture_id, k, root) AS (SELECT capture_id, k, k FROM m UNION SELECT r.capture_id, n.k, r.root FROM r JOIN m o ON o.capture_id=r.capture_id AND o.k=r.k JOIN m n ON n.capture_id=r.capture_id AND abs(n.px-o.px)+abs(n.py-o.py)=1), cc AS (SELECT capture_id, k, min(root) AS root FROM r GROUP BY 1,2) ")[5:]


@query("a11_pixel_components", COMP + "SELECT capture_id, root AS first_pixel, min(k%8) AS x, min(k//8) AS y, max(k%8)-min(k%8)+1 AS w, max(k//8)-min(k//8)+1 AS h, count(*) AS n FROM cc GROUP BY 1,2 HAVING count(*)>=4")
def pixel_components(spark, d):
    return raster.pixel_components(pixels(spark, d).where("r > 125"), 4).select("capture_id", F.array_min("members").alias("first_pixel"), "x", "y", "w", "h", "n")


@query("a12_fragments", "WITH RECURSIVE " + with_sql("pix", TXT + R.FRAGMENTS)[5:])
def fragments(spark, d):
    return scoring.fragments(pixels(spark, d).where("r > 125"), pixel_boxes(spark, d), 3)


@query("r9_component_stats", "WITH RECURSIVE " + with_sql("pix", R.STATS)[5:])
def component_stats(spark, d):
    p = pixels(spark, d)
    return raster.component_stats(raster.pixel_components(p.where("r > 125"), 4), p).drop("members")


@query("r11_anchor_colour", with_sql("pix", TXT + R.anchor_colour(0.5, 0.9, 60, 120) + "SELECT * FROM near"))
def anchor_colour(spark, d):
    return scoring.anchor_colour(changed(spark, d), pixels(spark, d), texts(spark, d), wide=0.9, colour=60, flat=120).select("capture_id", "px", "py")


@query("r12_evidence_mask", with_sql("pix", TXT + R.anchor_colour(0.375, 0.45, 44, 26) + f"SELECT * FROM near UNION {R.SATURATED}"))
def evidence_mask(spark, d):
    narrow = texts(spark, d).withColumn("w", F.lit(0.375))  # wider anchors are skipped
    return scoring.evidence_mask(pixels(spark, d), changed(spark, d), narrow).select("capture_id", "px", "py")


@query("r13_region_variance", with_sql("pix", TXT + f"SELECT capture_id, round(({VARS})/3,6) AS variance FROM pix JOIN pb USING (capture_id) WHERE px>=x AND px<x+w AND py>=y AND py<y+h GROUP BY 1"))
def region_variance(spark, d):
    return raster.region_variance(pixels(spark, d), pixel_boxes(spark, d))


@query("r14_deviation_outside_text", with_sql("pix", TXT + f"SELECT capture_id, {DEV} AS deviation FROM pix JOIN txt USING (capture_id) WHERE NOT (px/8.0>=x AND px/8.0<x+w AND 1-py/8.0>=y AND 1-py/8.0<y+h) GROUP BY 1"))
def deviation_outside_text(spark, d):
    return raster.deviation_outside_text(pixels(spark, d), texts(spark, d))


@query("r15_region_growing", "WITH RECURSIVE " + with_sql("pix", TXT + R.GROWN)[5:])
def region_growing(spark, d):
    seed = regions(spark, d).withColumns({"x": F.col("x") + 0.2, "y": F.col("y") + 0.2, "w": F.lit(0.1), "h": F.lit(0.1)})
    return scoring.grown_regions(seed, texts(spark, d), big(spark, d))


@query("r16_text_mask", with_sql("pix", TXT + "SELECT p.capture_id, px, py FROM pix p JOIN txt USING (capture_id) WHERE px>=greatest(0,floor(x*8-1.5)) AND px<least(8,ceil((x+w)*8+1.5)) AND py>=greatest(0,floor((1-y-h)*8-1.5)) AND py<least(8,ceil((1-y)*8+1.5))"))
def text_mask(spark, d):
    return raster.text_mask(raster.sizes(pixels(spark, d)), texts(spark, d), least=1.5, proportional=0.6).select("capture_id", "px", "py")


@query("r17_dilated_mask", with_sql("pix", TXT + "SELECT DISTINCT capture_id, p.px+dx AS px, p.py+dy AS py FROM pix p, (SELECT unnest(range(-2,3)) AS dx) a, (SELECT unnest(range(-2,3)) AS dy) b WHERE p.r>150 AND dx*dx+dy*dy<=4 AND p.px+dx BETWEEN 0 AND 7 AND p.py+dy BETWEEN 0 AND 7"))
def dilated_mask(spark, d):
    m = pixels(spark, d).where("r > 150")
    return raster.dilated(m, m, 2).select("capture_id", "px", "py")


DIFF = ", df AS (SELECT p.capture_id, p.px, p.py, (abs(p.r-c.r)+abs(p.g-c.g)+abs(p.b-c.b))/3.0::DOUBLE AS diff FROM pix p JOIN chg c USING (capture_id, px, py)) "


@query("r18_validation", with_sql("pix", TXT + DIFF + ", s AS (SELECT capture_id, round(sum((diff<15)::INT)/count(*)::DOUBLE*100,6) AS percent, round(coalesce(sum(CASE WHEN diff<15 THEN diff END)/sum((diff<15)::INT),999),6) AS mean_diff FROM df GROUP BY 1) SELECT *, percent>=70 AND mean_diff<=5 AS accepted FROM s"))
def validation(spark, d):
    return raster.preserved(pixels(spark, d), changed(spark, d))


@query("r19_ring_damage", with_sql("pix", TXT + DIFF + "SELECT pb.capture_id, coalesce(round(sum((diff>20)::INT)/count(diff)::DOUBLE*100,6),0) AS damage FROM pb LEFT JOIN df ON df.capture_id=pb.capture_id AND px>=x-2 AND px<x+w+2 AND py>=y-2 AND py<y+h+2 AND NOT (px>=x AND px<x+w AND py>=y AND py<y+h) AND NOT (px=7) GROUP BY 1"))
def ring_damage(spark, d):
    mask = pixels(spark, d).where("px = 7")
    return raster.ring_damage(pixels(spark, d), changed(spark, d), mask, pixel_boxes(spark, d), margin=2).select("capture_id", "damage")


@query("r20_crop", with_sql("pix", TXT + "SELECT capture_id, px-x AS px, py-y AS py, r, g, b FROM pix JOIN pb USING (capture_id) WHERE px>=x AND px<x+w AND py>=y AND py<y+h"))
def crop(spark, d):
    return raster.cropped(pixels(spark, d), pixel_boxes(spark, d)).drop("width", "height")


@query("r20_resize", with_sql("pix", "SELECT capture_id, nx AS px, ny AS py, r, g, b FROM (SELECT unnest(range(12)) AS nx), (SELECT unnest(range(12)) AS ny), pix WHERE px=nx*8//12 AND py=ny*8//12"))
def resize(spark, d):
    return raster.resized(pixels(spark, d), 12, 12).drop("width", "height")


@query("r20_composite", with_sql("pix", TXT + "SELECT p.capture_id, p.px, p.py, CASE WHEN p.px>=x AND p.px<x+w AND p.py>=y AND p.py<y+h THEN c.r ELSE p.r END AS r, CASE WHEN p.px>=x AND p.px<x+w AND p.py>=y AND p.py<y+h THEN c.g ELSE p.g END AS g, CASE WHEN p.px>=x AND p.px<x+w AND p.py>=y AND p.py<y+h THEN c.b ELSE p.b END AS b FROM pix p JOIN chg c USING (capture_id, px, py) JOIN pb USING (capture_id)"))
def composite(spark, d):
    b = pixel_boxes(spark, d)
    return raster.composite(pixels(spark, d), raster.cropped(changed(spark, d), b), b).drop("width", "height")


@query("r21_tensor", with_sql("pix", R.TENSOR))
def tensor(spark, d):
    t = raster.tensor(pixels(spark, d), 10).select("capture_id", F.posexplode("data").alias("spot", "v"))
    return t.select("capture_id", F.col("spot").cast("long").alias("spot"), F.round(F.col("v").cast("double"), 6).alias("v"))


@query("r22_ring_fill", with_sql("pix", "SELECT capture_id, px, py, CASE WHEN px BETWEEN 2 AND 5 AND py BETWEEN 3 AND 4 THEN fr ELSE r END AS r, CASE WHEN px BETWEEN 2 AND 5 AND py BETWEEN 3 AND 4 THEN fg ELSE g END AS g, CASE WHEN px BETWEEN 2 AND 5 AND py BETWEEN 3 AND 4 THEN fb ELSE b END AS b FROM pix JOIN (SELECT capture_id, (sum(r)//count(*))::BIGINT AS fr, (sum(g)//count(*))::BIGINT AS fg, (sum(b)//count(*))::BIGINT AS fb FROM pix WHERE NOT (px BETWEEN 2 AND 5 AND py BETWEEN 3 AND 4) GROUP BY 1) USING (capture_id)"))
def ring_fill(spark, d):
    p = pixels(spark, d)
    return raster.ring_fill(p, p.where("px BETWEEN 2 AND 5 AND py BETWEEN 3 AND 4")).drop("width", "height")


@query("r23_white_pixels", with_sql("pix", "SELECT capture_id, sum((r>128)::INT)::BIGINT AS white FROM pix GROUP BY 1"))
def white_pixels(spark, d):
    return pixels(spark, d).groupBy("capture_id").agg(F.count_if(F.col("r") > 128).alias("white"))


# ---- classification and scoring


def big(spark, d):
    return raster.resized(pixels(spark, d), 32, 32)


@query("c1_overlay_class", with_sql("pix", TXT + R.OVERLAY + R.CLASSES))
def overlay_class(spark, d):
    return scoring.classified_overlays(regions(spark, d).withColumnRenamed("cand_id", "fig_idx"), texts(spark, d), big(spark, d)).select("capture_id", "block_id", "class")


@query("c2_c3_overlay_evidence", with_sql("pix", TXT + R.OVERLAY + "SELECT capture_id, round(above,6) AS above, round(below,6) AS below, round(coherence,6) AS coherence FROM vt JOIN ch USING (capture_id)"))
def overlay_evidence(spark, d):
    met = relations.pairs(regions(spark, d).withColumnRenamed("cand_id", "fig_idx"), texts(spark, d), ["fig_idx"], ["block_id"])
    p = big(spark, d)
    return scoring.overlay_evidence(met, p, raster.background(p)).select("capture_id", *(F.round(c, 6).alias(c) for c in ("above", "below", "coherence")))


EVIDENCE = f", both_ AS ({BOTH}), ev AS (SELECT capture_id, block_id, round({INTER}/(bw*bh),9) AS ins, (capture_id%11)/10.0::DOUBLE AS ab, (block_id*3%11)/10.0::DOUBLE AS be, (capture_id*7%11)/10.0::DOUBLE AS co, round(least((ay+ah-(by_+bh))/ah,(by_-ay)/ah,(bx-ax)/aw,(ax+aw-(bx+bw))/aw),9) AS near, CASE least((ay+ah-(by_+bh))/ah,(by_-ay)/ah,(bx-ax)/aw,(ax+aw-(bx+bw))/aw) WHEN (ay+ah-(by_+bh))/ah THEN 'top' WHEN (by_-ay)/ah THEN 'bottom' ELSE 'side' END AS edge FROM both_), cls AS (SELECT capture_id, block_id, CASE WHEN ins<=0.3 THEN 'pageText' WHEN ab>=0.5 AND be>=0.5 THEN 'overlay' WHEN near<0.2 AND co>0.4 AND CASE edge WHEN 'bottom' THEN ab WHEN 'top' THEN be ELSE greatest(ab,be) END>=0.5 THEN 'edgeOverlay' WHEN ab<0.3 AND be<0.3 AND co<0.3 THEN 'pageText' WHEN co>0.4 OR ab>=0.3 OR be>=0.3 THEN 'uncertain' ELSE 'pageText' END AS class FROM ev) "


def combined(spark, d):
    a, b = g.rect("a"), g.rect("b")
    near = g.edge_proximity(a, b)
    tenth = lambda v: (v % 11) / 10.0
    c = scoring.overlay_class(F.round(g.share_inside(b, a), 9), tenth(F.col("capture_id")), tenth(F.col("block_id") * 3), tenth(F.col("capture_id") * 7), F.round(near["near"], 9), near["edge"])
    return both(spark, d).select("capture_id", "block_id", c.alias("class"))


@query("c4_combine_evidence", with_sql("fig tb", EVIDENCE + "SELECT * FROM cls"))
def combine_evidence(spark, d):
    return combined(spark, d)


@query("c5_for_trimming", with_sql("fig tb", EVIDENCE + "SELECT * FROM cls WHERE class='pageText'"))
def for_trimming(spark, d):
    return scoring.for_trimming(combined(spark, d))


@query("c6_first_overlay_figure", with_sql("fig tb", EVIDENCE + ", two AS (SELECT capture_id, (block_id+1)//2 AS block_id, block_id%2 AS fig_idx, class FROM cls WHERE class IN ('overlay','edgeOverlay')) SELECT capture_id, block_id, fig_idx, class FROM (SELECT *, row_number() OVER (PARTITION BY capture_id, block_id ORDER BY fig_idx) AS rn FROM two) WHERE rn=1"))
def first_overlay_figure(spark, d):
    two = combined(spark, d).select("capture_id", F.floor((F.col("block_id") + 1) / 2).alias("block_id"), (F.col("block_id") % 2).alias("fig_idx"), "class")
    return relations.first_overlay_figure(two)


def found_hypotheses(spark, d):
    c = cells(spark, d)
    content = raster.content_regions(c, 8)
    subjects = texts(spark, d).withColumnsRenamed({"block_id": "subj_id"})
    return scoring.hypotheses(regions(spark, d), c, content, texts(spark, d), subjects, 8)


HYP = "WITH RECURSIVE " + with_sql("pix", TXT + CELLS + R.CONTENT + R.CONTENT_REGIONS + R.HYPOTHESES)[5:]


@query("c7_hypotheses", HYP + "SELECT capture_id, 0::BIGINT AS cand_id, strategy, x, y, w, h, score FROM hy")
def hypotheses(spark, d):
    return found_hypotheses(spark, d).drop("ordinal")


@query("c7_best_hypothesis", HYP + "SELECT capture_id, 0::BIGINT AS cand_id, strategy, x, y, w, h, score FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY score DESC, ordinal) AS rn FROM hy) WHERE rn=1")
def best_hypothesis(spark, d):
    return scoring.best_hypothesis(found_hypotheses(spark, d))


SIGNALS = ", sg AS (SELECT capture_id, block_id, (xi%100)/100.0::DOUBLE AS cp, (yi%100)/100.0::DOUBLE AS un, (wi%100)/100.0::DOUBLE AS sb, (hi%40)::DOUBLE*1.5 AS bc, (xi%12)/100.0::DOUBLE AS ra, (yi%11)/10.0::DOUBLE AS ap, (wi%11)/10.0::DOUBLE AS tc, block_id%2=0 AS mg, (xi%9)/10.0::DOUBLE AS fr, (yi%5)/10.0::DOUBLE AS cg, (wi%7)/10.0::DOUBLE AS vr, xi%7 AS ar FROM tb), dl AS (SELECT *, least(1,greatest(0,fr))*0.45+least(1,greatest(0,cg)/0.20)*0.30+least(1,greatest(0,vr)/0.35)*0.25 AS delta FROM sg), cf AS (SELECT *, 0+least(1,greatest(0,(cp-0.2)/(0.6-0.2)))*0.16+least(1,greatest(0,(un-0.45)/(0.85-0.45)))*0.08+least(1,greatest(0,(sb-0.18)/(0.45-0.18)))*0.08+least(1,greatest(0,bc/40))*0.06+CASE WHEN ra<=0.05 THEN 1 ELSE greatest(0,1-(ra-0.05)/0.05) END*0.07+ap*0.24+tc*0.16+delta*0.10+CASE WHEN mg THEN 1 ELSE 0 END*0.05 AS conf, tc*0.55+delta*0.30+ap*0.15 AS cpl FROM dl) "


def signals(spark, d):
    from quire.plans.geometry_queries import blocks

    b = blocks(spark, d)
    m = lambda c, n, by: (F.col(c) % n) / by
    b = b.select("capture_id", "block_id", m("xi", 100, 100.0).alias("compactness"), m("yi", 100, 100.0).alias("uniformity"), m("wi", 100, 100.0).alias("shape_balance"), ((F.col("hi") % 40).cast("double") * 1.5).alias("boundary_contrast"), m("xi", 12, 100.0).alias("relative_area"), m("yi", 11, 10.0).alias("anchor_proximity"), m("wi", 11, 10.0).alias("text_coverage"), (F.col("block_id") % 2 == 0).alias("merged"), m("xi", 9, 10.0).alias("fr"), m("yi", 5, 10.0).alias("cg"), m("wi", 7, 10.0).alias("vr"), (F.col("xi") % 7).alias("area_ratio"), "wi", "hi", "xi")
    b = b.withColumn("delta", scoring.delta_score(F.col("fr"), F.col("cg"), F.col("vr")))
    b = b.withColumn("confidence", scoring.blob_confidence({c: F.col(c) for c in b.columns}))
    return b.withColumn("coupling", scoring.coupling(F.col("text_coverage"), F.col("delta"), F.col("anchor_proximity")))


@query("c9_blob_confidence", with_sql("tb", SIGNALS + "SELECT capture_id, block_id, round(conf,6) AS confidence FROM cf"))
def blob_confidence(spark, d):
    return signals(spark, d).select("capture_id", "block_id", F.round("confidence", 6).alias("confidence"))


@query("c10_delta_score", with_sql("tb", SIGNALS + "SELECT capture_id, block_id, round(delta,6) AS delta FROM dl"))
def delta_score(spark, d):
    return signals(spark, d).select("capture_id", "block_id", F.round("delta", 6).alias("delta"))


@query("c11_reject_reason", with_sql("tb", SIGNALS + "SELECT capture_id, block_id, CASE WHEN ra>0.05 THEN 'relative area' WHEN ar>3 AND round(cpl,9)<0.25 THEN 'weak text coupling' WHEN round(conf,9)<0.5 THEN 'confidence' END AS reject_reason FROM cf"))
def reject_reason(spark, d):
    r = scoring.reject_reason(F.col("relative_area"), F.col("area_ratio"), F.round("coupling", 9), F.round("confidence", 9))
    return signals(spark, d).select("capture_id", "block_id", r.alias("reject_reason"))


@query("c12_dilation_radius", with_sql("tb", SIGNALS + ", st AS (SELECT cf.*, wi::DOUBLE AS w, hi::DOUBLE AS h, (tc>=0.8 AND ap>=0.85 AND cp>=0.55 AND sb>=0.22) AS strong FROM cf JOIN tb USING (capture_id, block_id)) SELECT capture_id, block_id, least(28,greatest(3,round(greatest(greatest(w,h)*0.1,h*0.45)+CASE WHEN strong THEN greatest(greatest(w,h)*0.16,h*0.65) ELSE 0 END+CASE WHEN strong AND delta>=0.35 THEN h*0.25 ELSE 0 END)))::INT AS radius FROM st"))
def dilation_radius(spark, d):
    c = F.col
    r = scoring.dilation_radius(c("wi").cast("double"), c("hi").cast("double"), c("hi").cast("double"), c("text_coverage"), c("anchor_proximity"), c("compactness"), c("shape_balance"), c("delta"))
    return signals(spark, d).select("capture_id", "block_id", r.alias("radius"))


@query("c13_small_blobs", with_sql("tb", SIGNALS + "SELECT capture_id, block_id FROM dl JOIN tb USING (capture_id, block_id) WHERE wi>=120 OR round(delta,9)>=0.45"))
def small_blobs(spark, d):
    return scoring.worth_a_look(signals(spark, d).withColumns({"n": F.col("wi"), "delta": F.round("delta", 9)})).select("capture_id", "block_id")


@query("c15_crop_sanity", with_sql("tb", "SELECT capture_id, block_id, round(wi*hi/(400.0*40),9) AS retained, CASE WHEN wi*hi/(400.0*40)<0.15 THEN 400 ELSE wi END::BIGINT AS w, CASE WHEN wi*hi/(400.0*40)<0.15 THEN 40 ELSE hi END::BIGINT AS h FROM tb"))
def crop_sanity(spark, d):
    from quire.plans.geometry_queries import blocks

    kept = F.col("wi") * F.col("hi") / (400.0 * 40)
    ok = scoring.crop_sane(kept)
    return blocks(spark, d).select("capture_id", "block_id", F.round(kept, 9).alias("retained"), F.when(ok, F.col("wi")).otherwise(400).cast("long").alias("w"), F.when(ok, F.col("hi")).otherwise(40).cast("long").alias("h"))


@query("s7_instance_regions", with_sql("pix", TXT + """, ib AS (SELECT capture_id, inst, min(px)/8.0::DOUBLE AS x, 1-(max(py)+1)/8.0::DOUBLE AS y, (max(px)+1-min(px))/8.0::DOUBLE AS w, (max(py)+1-min(py))/8.0::DOUBLE AS h FROM (SELECT *, (px//4)*2+py//4 AS inst FROM pix WHERE r>140) GROUP BY 1,2)
SELECT ib.capture_id, inst AS instance, ib.x, ib.y, ib.w, ib.h FROM ib JOIN txt USING (capture_id) WHERE ib.w*ib.h>=0.03 AND round(greatest(0,least(ib.x+ib.w,txt.x+txt.w)-greatest(ib.x,txt.x))*greatest(0,least(ib.y+ib.h,txt.y+txt.h)-greatest(ib.y,txt.y))/(ib.w*ib.h),9)<0.4"""))
def instance_regions(spark, d):
    """Bright pixels of each quarter of an image as one instance."""
    from quire.operators import screens

    quarter = F.floor(F.col("px") / 4) * 2 + F.floor(F.col("py") / 4)
    return screens.instance_regions(pixels(spark, d).where("r > 140").withColumn("instance", quarter), texts(spark, d))


# ---- images of a page's size, on which samples are taken at strides


def sheets(spark, d):
    return L.sheets(L.table(spark, d, "embeddings"))


def sheet_texts(spark, d):
    c = F.col("capture_id")
    ids = L.table(spark, d, "embeddings").where(F.size("embedding") == 64).select((F.col("vec_id") / 50).cast("long").alias("capture_id")).distinct()
    return ids.select("capture_id", F.lit(0).cast("long").alias("block_id"), ((c % 4) / 8.0).alias("x"), ((c % 5) / 8.0).alias("y"), F.lit(0.5).alias("w"), F.lit(0.25).alias("h"))


@query("r1_background_page", with_sql("sheet", R.SHEET_BG + " SELECT * FROM bg"))
def background_page(spark, d):
    return raster.background(sheets(spark, d))


@query("r3_content_map_page", with_sql("sheet", R.SHEET_CELLS + "SELECT * FROM cl"))
def content_map_page(spark, d):
    return raster.content_map(sheets(spark, d), sheet_texts(spark, d))


@query("r5_color_variance_page", with_sql("sheet", f"SELECT capture_id, round(sqrt({VARS}),6) AS variance FROM sheet WHERE px%6=0 AND py%3=0 GROUP BY 1"))
def color_variance_page(spark, d):
    return raster.color_variance(sheets(spark, d))


@query("r6_strip_deviation_page", with_sql("sheet", f"SELECT capture_id, 'column' AS kind, px AS at, {DEV} AS deviation FROM sheet WHERE py%10=0 GROUP BY 1,3 UNION ALL SELECT capture_id, 'row', py, {DEV} FROM sheet WHERE px%21=0 GROUP BY 1,3"))
def strip_deviation_page(spark, d):
    p = sheets(spark, d)
    named = lambda columns, kind: raster.strips(p, columns).select("capture_id", F.lit(kind).alias("kind"), "at", "deviation")
    return named(True, "column").unionByName(named(False, "row"))


@query("r8_auto_crop_page", with_sql("sheet", R.auto_crop(640, 320, "sheet")))
def auto_crop_page(spark, d):
    return raster.auto_cropped(sheets(spark, d))


@query("r14_deviation_outside_text_page", with_sql("sheet", R.SHEET_TEXT + f" SELECT capture_id, {DEV} AS deviation FROM sheet JOIN txt USING (capture_id) WHERE px%3=0 AND NOT (px/640.0>=x AND px/640.0<x+w AND 1-py/320.0>=y AND 1-py/320.0<y+h) GROUP BY 1"))
def deviation_outside_text_page(spark, d):
    return raster.deviation_outside_text(sheets(spark, d), sheet_texts(spark, d))
