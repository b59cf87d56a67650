"""Queries over pages of text blocks and figures: reading order, gaps, groups, merges, relations, sources, texts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import geometry as g
from quire.functions.text import prefix
from quire.operators import captures, reading, regions, relations, screens
from quire.plans import fold_sql
from quire.plans.geometry_queries import BOTH, KEY, OX, REL, blocks, figures, one_figure
from quire.plans.registry import query
from quire.sources import layouts as L
from quire.sources.layouts import with_sql

# ---- reading order and gaps

ORDER_SQL = """, o1 AS (SELECT *, y+h/2 AS mid FROM {t}),
o2 AS (SELECT *, round(abs(mid-lag(mid) OVER dn)-0.5*greatest(h, lag(h) OVER dn),9) AS step FROM o1 WINDOW dn AS (PARTITION BY capture_id ORDER BY mid DESC, block_id)),
o3 AS (SELECT *, sum(CASE WHEN coalesce(step,0)>0 THEN 1 ELSE 0 END) OVER (PARTITION BY capture_id ORDER BY mid DESC, block_id) AS band FROM o2),
o4 AS (SELECT *, lag(x+w) OVER (PARTITION BY capture_id, band ORDER BY x, block_id) AS pe FROM o3),
o5 AS (SELECT capture_id, band, round(x-pe,9) AS gap, round((pe+x)/2,9) AS centre, row_number() OVER (PARTITION BY capture_id, band ORDER BY round(x-pe,9) DESC NULLS LAST, x, round((pe+x)/2,9) DESC) AS rn FROM o4 WHERE pe IS NOT NULL),
o6 AS (SELECT capture_id, count(*) AS n, round(sum(centre::DECIMAL(18,9))::DOUBLE/count(*),9) AS boundary, min(centre) AS lo, max(centre) AS hi FROM o5 WHERE rn=1 AND gap>0.05 GROUP BY capture_id),
o7 AS (SELECT capture_id, boundary FROM o6 WHERE n>=2 AND round(greatest(hi-boundary, boundary-lo),9)<0.15),
o8 AS (SELECT o4.*, boundary, CASE WHEN boundary IS NULL THEN 0 WHEN round(x,9)<boundary AND round(x+w,9)>boundary THEN 0 WHEN round(x+w/2,9)<boundary THEN 1 ELSE 2 END AS part FROM o4 LEFT JOIN o7 USING (capture_id)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY part, CASE WHEN boundary IS NULL THEN band END, CASE WHEN boundary IS NULL THEN x END, CASE WHEN boundary IS NOT NULL THEN -mid END, block_id)-1 AS reading_pos FROM o8) """


def doc_blocks(spark, d):
    return L.document_blocks(L.table(spark, d, "documents"))


@query("a1_reading_order", with_sql("tb", ORDER_SQL.format(t="tb") + "SELECT capture_id, block_id, reading_pos FROM ordered"))
def reading_order(spark, d):
    return reading.reading_order(blocks(spark, d)).select(*KEY, "reading_pos")


@query("a1_reading_order_columns", with_sql("db", ORDER_SQL.format(t="db") + "SELECT capture_id, block_id, reading_pos FROM ordered"))
def reading_order_columns(spark, d):
    return reading.reading_order(doc_blocks(spark, d)).select(*KEY, "reading_pos")


@query("t1_full_text", with_sql("db", ORDER_SQL.format(t="db") + "SELECT capture_id, string_agg(text, chr(10) ORDER BY reading_pos) AS full_text, count(*) AS blocks FROM ordered GROUP BY capture_id"))
def full_text(spark, d):
    return reading.joined_text(reading.reading_order(doc_blocks(spark, d)), ["capture_id"], "reading_pos")


FORMATTED = """, fl AS (SELECT *, min(x) OVER (PARTITION BY capture_id, part) AS edge, lag(y) OVER w AS py, lag(h) OVER w AS ph, lag(part) OVER w AS pp FROM ordered WINDOW w AS (PARTITION BY capture_id ORDER BY reading_pos)),
pc AS (SELECT capture_id, reading_pos, CASE WHEN pp IS NULL THEN '' WHEN pp<>part OR round(py-y-h,9)>round(1.5::DOUBLE*greatest(h,ph),9) THEN chr(10)||chr(10) ELSE chr(10) END||repeat('  ', floor(round((x-edge)/0.02::DOUBLE,6)+0.5)::INT)||text AS piece FROM fl)
SELECT capture_id, string_agg(piece, '' ORDER BY reading_pos) AS formatted_text, count(*) AS blocks FROM pc GROUP BY 1"""


@query("t10_formatted_text", with_sql("db", ORDER_SQL.format(t="db") + FORMATTED))
def formatted_text(spark, d):
    return reading.formatted_text(doc_blocks(spark, d))


@query("t2_word_count", with_sql("db", "SELECT capture_id, sum(len(list_filter(string_split(text, ' '), lambda w: w<>'')))::BIGINT AS words FROM db GROUP BY capture_id"))
def word_count(spark, d):
    return doc_blocks(spark, d).groupBy("capture_id").agg(F.sum(F.size(reading.words(F.col("text")))).alias("words"))


@query("t3_label_prefix", with_sql("db", "SELECT capture_id, block_id, left_grapheme(text||'é👨‍👩‍👧', 40) AS label40, left_grapheme(text||'🇳🇱', 30) AS label30 FROM db"))
def label_prefix(spark, d):
    """The texts with a combined letter, a joined emoji or a flag behind them, cut at 40 and 30 characters."""
    cut = lambda mark, n: prefix(F.concat("text", F.lit(mark)), n).alias(f"label{n}")
    return doc_blocks(spark, d).select(*KEY, cut("é👨‍👩‍👧", 40), cut("🇳🇱", 30))


@query("t4_figure_label", "SELECT o_orderkey AS capture_id, 'Figure ' || row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS label FROM orders")
def figure_label(spark, d):
    return screens.figure_labels(L.table(spark, d, "orders"), "o_custkey", "o_orderkey").select(F.col("o_orderkey").alias("capture_id"), "label")


@query("s5_line_words", with_sql("db", ", w AS (SELECT *, list_filter(string_split(text,' '), lambda v: v<>'') AS ws FROM db), u AS (SELECT capture_id, block_id, text, x, y, w, h, unnest(ws) AS word, generate_subscripts(ws,1)::BIGINT-1 AS word_no FROM w) SELECT capture_id, block_id, word_no, word, round(x+w*(instr(text,word)-1)/length(text)+1e-9,6) AS x, y, round(w*length(word)/length(text)+1e-9,6) AS w, h FROM u"))
def line_words(spark, d):
    return reading.line_words(doc_blocks(spark, d))


MERGED_SQL = """, i AS (SELECT capture_id, round(y,9) AS low, round(y+h,9) AS high FROM tb), m1 AS (SELECT *, max(high) OVER (PARTITION BY capture_id ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
m2 AS (SELECT *, sum(CASE WHEN reach IS NULL OR low>reach THEN 1 ELSE 0 END) OVER (PARTITION BY capture_id ORDER BY low, high) AS part FROM m1),
m AS (SELECT capture_id, min(low) AS low, max(high) AS high FROM m2 GROUP BY capture_id, part) """


@query("a2_merged_intervals", with_sql("tb", MERGED_SQL + "SELECT * FROM m"))
def merged_intervals(spark, d):
    spans = blocks(spark, d).select("capture_id", F.round("y", 9).alias("low"), F.round(F.col("y") + F.col("h"), 9).alias("high"))
    return reading.merged_intervals(spans, ["capture_id"])


@query("a2_text_gaps", with_sql("fig tb", MERGED_SQL + """, n AS (SELECT *, lead(low) OVER (PARTITION BY capture_id ORDER BY low) AS nx, row_number() OVER (PARTITION BY capture_id ORDER BY low) AS rn FROM m)
SELECT capture_id, 0.0::DOUBLE AS y, low AS h FROM n WHERE rn=1 AND low>0.05 UNION ALL SELECT capture_id, high, round(coalesce(nx,1)-high,9) FROM n WHERE round(coalesce(nx,1)-high,9)>=0.05
UNION ALL SELECT capture_id, 0.0, 1.0 FROM fig WHERE capture_id NOT IN (SELECT capture_id FROM tb)"""))
def text_gaps(spark, d):
    return reading.text_gaps(figures(spark, d).select("capture_id"), blocks(spark, d))


# ---- grouping and merging


def named_blocks(spark, d):
    return blocks(spark, d).withColumn("text", F.concat(F.lit("b"), F.col("block_id").cast("string")))


GROUP_SQL = """, hh AS (SELECT capture_id, sum(hi)::DOUBLE/count(*)/1000 AS mh FROM tb GROUP BY 1), e AS (SELECT a.capture_id, a.block_id AS p, b.block_id AS q FROM tb a JOIN tb b USING (capture_id) JOIN hh USING (capture_id)
 WHERE a.yi-b.yi-b.hi>=0 AND (a.yi-b.yi-b.hi)/1000.0::DOUBLE<=round(1.5*mh,9) AND round(greatest(0,least(a.xi+a.wi,b.xi+b.wi)-greatest(a.xi,b.xi))/least(a.wi,b.wi)::DOUBLE,9)>=0.3),
ee AS (SELECT capture_id, p, q FROM e UNION SELECT capture_id, q, p FROM e) """
RECURSIVE = lambda tail: "WITH RECURSIVE " + with_sql("tb", GROUP_SQL + ", r(capture_id, block_id, g) AS (SELECT capture_id, block_id, block_id FROM tb UNION SELECT r.capture_id, ee.q, r.g FROM r JOIN ee ON ee.capture_id=r.capture_id AND ee.p=r.block_id), grp AS (SELECT capture_id, block_id, min(g) AS group_id FROM r GROUP BY 1,2) " + tail)[5:]


@query("a3_text_groups", RECURSIVE("SELECT * FROM grp"))
def text_groups(spark, d):
    return regions.text_groups(blocks(spark, d)).select(*KEY, "group_id")


@query("a3_group_items", RECURSIVE("SELECT capture_id, group_id, min(x) AS x, round(1-max(y+h),6) AS y, round(max(x+w)-min(x),6) AS w, round(max(y+h)-min(y),6) AS h, substr(string_agg('b'||block_id, ' ' ORDER BY -(y+h/2), block_id),1,40) AS label, count(*)::INT AS blocks FROM grp JOIN tb USING (capture_id, block_id) GROUP BY 1,2"))
def group_items(spark, d):
    return regions.group_items(regions.text_groups(named_blocks(spark, d)))


def candidates(spark, d):
    b = blocks(spark, d)
    source = F.when(F.col("class_id") == 1, "saliency").otherwise("ocrGap")
    return b.select("capture_id", F.col("block_id").alias("cand_id"), "x", "y", "w", (F.col("h") * 6).alias("h"), source.alias("source"), F.round("confidence", 6).alias("confidence"), "class_id")


CAND_SQL = ", cand AS (SELECT capture_id, block_id AS cand_id, x, y, w, h*6 AS h, CASE WHEN class_id=1 THEN 'saliency' ELSE 'ocrGap' END AS source, round(confidence,6) AS confidence, class_id FROM tb) "


@query("a4_merge_overlapping", fold_sql.merged(CAND_SQL, fold_sql.LIKE))
def merge_overlapping(spark, d):
    return regions.merged(candidates(spark, d), regions.like_enough())


@query("a5_merge_side_by_side", fold_sql.merged(CAND_SQL, fold_sql.BESIDE))
def merge_side_by_side(spark, d):
    return regions.merged(candidates(spark, d), regions.side_by_side())


SHARED = "(CASE WHEN least({a}.x+{a}.w,{b}.x+{b}.w)>greatest({a}.x,{b}.x) AND least({a}.y+{a}.h,{b}.y+{b}.h)>greatest({a}.y,{b}.y) THEN (least({a}.x+{a}.w,{b}.x+{b}.w)-greatest({a}.x,{b}.x))*(least({a}.y+{a}.h,{b}.y+{b}.h)-greatest({a}.y,{b}.y)) ELSE 0 END)"
S_KD = SHARED.format(a="k", b="d")
FOLD = "list_reduce(list_prepend({start}, list_transform(rows, lambda v: [v])), lambda acc, nx: CASE WHEN {hit} THEN acc ELSE list_concat(acc, nx) END)"


@query("a6_without_dominated", with_sql("fig tb", CAND_SQL + ", allc AS (SELECT capture_id, 0 AS late, -1 AS cand_id, x, y, w, h FROM fig UNION ALL SELECT capture_id, 1, cand_id, x, y, w, h FROM cand), g AS (SELECT capture_id, list({'late': late, 'cand_id': cand_id, 'x': x, 'y': y, 'w': w, 'h': h} ORDER BY late, cand_id) AS rows FROM allc GROUP BY 1), z AS (SELECT capture_id, " + FOLD.format(start="rows[1:0]", hit="nx[1].late=1 AND len(list_filter(acc, lambda k: round(" + S_KD.replace("d.", "nx[1].") + "/(nx[1].w*nx[1].h),9)>0.5))>0") + " AS kept FROM g), u AS (SELECT capture_id, unnest(kept) AS d FROM z) SELECT capture_id, d.late AS late, d.cand_id AS cand_id, d.x AS x, d.y AS y, d.w AS w, d.h AS h FROM u"))
def without_dominated(spark, d):
    return regions.without_dominated(one_figure(spark, d, "cand_id").withColumn("cand_id", F.lit(-1).cast("long")), candidates(spark, d))


IOU_KD = f"{S_KD}/(k.w*k.h+d.w*d.h-{S_KD})".replace("d.", "nx[1].")


@query("a7_class_aware_nms", with_sql("tb", CAND_SQL + ", g AS (SELECT capture_id, list({'confidence': confidence, 'det_id': cand_id, 'class_id': class_id, 'x': x, 'y': y, 'w': w, 'h': h} ORDER BY confidence DESC, cand_id) AS rows FROM cand GROUP BY 1), z AS (SELECT capture_id, " + FOLD.format(start="rows[1:0]", hit=f"len(list_filter(acc, lambda k: k.class_id=nx[1].class_id AND round({IOU_KD},9)>0.2))>0") + " AS kept FROM g), u AS (SELECT capture_id, unnest(kept) AS d FROM z) SELECT capture_id, d.det_id AS det_id, d.class_id AS class_id, d.confidence AS confidence FROM u"))
def class_aware_nms(spark, d):
    return regions.suppressed(candidates(spark, d).withColumnRenamed("cand_id", "det_id"), 0.2).select("capture_id", "det_id", "class_id", "confidence")


@query("a8_trim_text", fold_sql.TRIMMED)
def trim_text(spark, d):
    return regions.trimmed(one_figure(spark, d, "cand_id"), blocks(spark, d))


@query("a9_best_cut", fold_sql.CUTS)
def best_cut(spark, d):
    return regions.best_cuts(one_figure(spark, d, "cand_id"), blocks(spark, d))


# ---- relations between tables


@query("a13_nearest_anchor", with_sql("fig tb", f", both_ AS ({BOTH}), dd AS (SELECT capture_id, block_id, round(sqrt(power(greatest(0,-{OX}),2)+power(greatest(0,-(least(ay+ah,by_+bh)-greatest(ay,by_))),2)),9) AS distance, bh FROM both_), r AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY distance, block_id) AS rn FROM dd WHERE distance<=round(4*bh,9)) SELECT capture_id, block_id, distance FROM r WHERE rn=1"))
def nearest_anchor(spark, d):
    return relations.nearest_anchor(one_figure(spark, d, "blob_id"), blocks(spark, d)).select("capture_id", "block_id", "distance")


@query("a14_best_candidate", with_sql("fig tb", CAND_SQL + f", m AS (SELECT f.capture_id, c.cand_id, c.source, c.confidence, row_number() OVER (PARTITION BY f.capture_id ORDER BY c.confidence DESC, c.cand_id) AS rn FROM fig f JOIN cand c USING (capture_id) WHERE {SHARED.format(a='f', b='c')}>0) SELECT capture_id, cand_id, source, confidence FROM m WHERE rn=1"))
def best_candidate(spark, d):
    return relations.best_of(candidates(spark, d), one_figure(spark, d, "merged_id")).select("capture_id", "cand_id", "source", "confidence")


@query("a15_covered_subjects", with_sql("fig tb", f"SELECT t.capture_id, t.block_id AS subj_id, coalesce(bool_or(round({SHARED.format(a='f', b='t')}/(t.w*t.h),9)>0.2), false) AS covered FROM tb t LEFT JOIN fig f USING (capture_id) GROUP BY 1,2"))
def covered_subjects(spark, d):
    return relations.held_share(blocks(spark, d).withColumnRenamed("block_id", "subj_id"), figures(spark, d)).select("capture_id", "subj_id", "covered")


@query("a16_text_gap_bounds", with_sql("fig tb", ", r AS (SELECT f.capture_id, any_value(f.x) AS x, any_value(f.w) AS w, min(CASE WHEN round(least(f.x+f.w,t.x+t.w)-greatest(f.x,t.x)-f.w*0.2,9)>0 AND round(t.y-f.y-f.h/2,9)>0 THEN t.y END) AS top, max(CASE WHEN round(least(f.x+f.w,t.x+t.w)-greatest(f.x,t.x)-f.w*0.2,9)>0 AND round(t.y+t.h-f.y-f.h/2,9)<0 THEN t.y+t.h END) AS fl FROM fig f JOIN tb t USING (capture_id) GROUP BY 1) SELECT capture_id, x, round(greatest(0,coalesce(fl,0)),9) AS y, w, round(least(1,coalesce(top,1))-greatest(0,coalesce(fl,0)),9) AS h FROM r WHERE round(least(1,coalesce(top,1))-greatest(0,coalesce(fl,0)),9)>0.05"))
def text_gap_bounds(spark, d):
    return relations.text_gap_bounds(one_figure(spark, d, "cand_id"), blocks(spark, d)).select("capture_id", "x", "y", "w", "h")


@query("c14_evidence_boost", with_sql("fig tb", CAND_SQL + f", s AS (SELECT c.capture_id, c.cand_id, bool_or(round({SHARED.format(a='f', b='c')}/(f.w*f.h),9)>0.2) AS hs FROM cand c LEFT JOIN fig f USING (capture_id) GROUP BY 1,2) SELECT capture_id, cand_id, round(confidence+CASE WHEN coalesce(hs,false) THEN 0.3 ELSE 0 END,6) AS confidence, CASE WHEN coalesce(hs,false) THEN 'salient,hasSubject' ELSE 'salient' END AS evidence FROM cand JOIN s USING (capture_id, cand_id)"))
def evidence_boost(spark, d):
    out = relations.boosted(candidates(spark, d).withColumn("evidence", F.array(F.lit("salient"))), one_figure(spark, d, "subj_id"))
    return out.select("capture_id", "cand_id", F.round("confidence", 6).alias("confidence"), F.array_join("evidence", ",").alias("evidence"))


SUBJECTS = ", sub AS (SELECT * FROM tb WHERE class_id=1), oth AS (SELECT * FROM tb WHERE class_id=0) "
G15 = f"""{SUBJECTS}, hull AS (SELECT f.capture_id, min(s.x) AS x1, min(s.y) AS y1, max(s.x+s.w) AS x2, max(s.y+s.h) AS y2 FROM fig f JOIN sub s USING (capture_id) WHERE round({SHARED.format(a='f', b='s')}/(s.w*s.h),9)>0.2 GROUP BY 1),
un AS (SELECT f.capture_id, f.x AS ox, f.y AS oy, f.w AS ow, f.h AS oh, least(f.x,x1) AS ux, least(f.y,y1) AS uy, greatest(f.x+f.w,x1+(x2-x1))-least(f.x,x1) AS uw, greatest(f.y+f.h,y1+(y2-y1))-least(f.y,y1) AS uh FROM fig f JOIN hull USING (capture_id)),
gr AS (SELECT capture_id, ox, oy, ow, oh, greatest(0,ux) AS ax, greatest(0,uy) AS ay, least(1-greatest(0,ux),uw) AS aw, least(1-greatest(0,uy),uh) AS ah FROM un),
bo AS (SELECT gr.capture_id, ax, ay, aw, ah, t.x AS bx, t.y AS by_, t.w AS bw, t.h AS bh FROM gr JOIN oth t USING (capture_id)), rl AS (SELECT capture_id, {REL} AS relation FROM bo),
bl AS (SELECT capture_id, bool_or(relation='adjacentAbove') AS st, bool_or(relation='adjacentBelow') AS sb, bool_or(relation='adjacentLeft') AS sl, bool_or(relation='adjacentRight') AS sr FROM rl GROUP BY 1),
co AS (SELECT gr.capture_id, CASE WHEN sb THEN greatest(ay,oy-oh*0.30) ELSE ay END AS ly, CASE WHEN st THEN least(ay+ah,oy+oh+oh*0.30) ELSE ay+ah END AS hy, CASE WHEN sl THEN greatest(ax,ox-ow*0.30) ELSE ax END AS lx, CASE WHEN sr THEN least(ax+aw,ox+ow+ow*0.30) ELSE ax+aw END AS hx FROM gr LEFT JOIN bl USING (capture_id))
SELECT f.capture_id, round(coalesce(lx,f.x),6) AS x, round(coalesce(ly,f.y),6) AS y, round(coalesce(hx-lx,f.w),6) AS w, round(coalesce(hy-ly,f.h),6) AS h FROM fig f LEFT JOIN co USING (capture_id)"""


def _pull(t: str, relation: str, stop: str, box: str) -> str:
    """One side of a promoted subject pulled back to the nearest text there."""
    return f"(WITH bo AS (SELECT f.capture_id, f.x AS ax, f.y AS ay, f.w AS aw, f.h AS ah, t.x AS bx, t.y AS by_, t.w AS bw, t.h AS bh FROM {t} f JOIN tb t USING (capture_id)), st AS (SELECT capture_id, {stop} AS s FROM bo WHERE {REL}='{relation}' GROUP BY 1) SELECT f.capture_id, {box} FROM {t} f LEFT JOIN st USING (capture_id))"


G16 = (
    ", p0 AS (SELECT capture_id, greatest(0,x-w*0.2) AS x, greatest(0,y-h*0.2) AS y, least(1,x+w+w*0.2)-greatest(0,x-w*0.2) AS w, least(1,y+h+h*0.2)-greatest(0,y-h*0.2) AS h FROM fig), p1 AS "
    + _pull("p0", "adjacentRight", "min(bx)", "x, y, CASE WHEN s IS NULL THEN w ELSE s-x END AS w, h") + ", p2 AS "
    + _pull("p1", "adjacentLeft", "max(bx+bw)", "CASE WHEN s IS NULL THEN x ELSE s END AS x, y, CASE WHEN s IS NULL THEN w ELSE x+w-s END AS w, h") + ", p3 AS "
    + _pull("p2", "adjacentAbove", "min(by_)", "x, y, w, CASE WHEN s IS NULL THEN h ELSE s-y END AS h") + ", p4 AS "
    + _pull("p3", "adjacentBelow", "max(by_+bh)", "x, CASE WHEN s IS NULL THEN y ELSE s END AS y, w, CASE WHEN s IS NULL THEN h ELSE y+h-s END AS h")
    + " SELECT capture_id, round(x,6) AS x, round(y,6) AS y, round(w,6) AS w, round(h,6) AS h FROM p4"
)


@query("g15_expand_to_subjects", with_sql("fig tb", G15))
def expand_to_subjects(spark, d):
    subjects = blocks(spark, d).where("class_id = 1").withColumnRenamed("block_id", "subj_id")
    return relations.with_subjects(one_figure(spark, d, "fig_idx"), subjects, blocks(spark, d).where("class_id = 0")).select("capture_id", *(F.round(k, 6).alias(k) for k in "xywh"))


@query("g16_promoted_subjects", with_sql("fig tb", G16))
def promoted_subjects(spark, d):
    return relations.promoted(one_figure(spark, d, "subj_id"), blocks(spark, d)).select("capture_id", *(F.round(k, 6).alias(k) for k in "xywh"))


@query("g32_flow_layout", fold_sql.FLOW)
def flow_layout(spark, d):
    """Words of all lines of each document wrapped greedily into lines of 600 units, eight units a character."""
    words = reading.line_words(doc_blocks(spark, d))
    order = Window.partitionBy("capture_id").orderBy("block_id", "word_no")
    words = words.withColumn("word_no", (F.row_number().over(order) - 1).cast("long"))
    return captures.flow_lines(words, "word", "word_no", 600.0, 8.0, 4.0)


# ---- sources: windows and observations


def windows(spark, d):
    c = L.table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("window_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("app_name"), (F.col("c_custkey") % 200).cast("double").alias("w"), (F.col("c_custkey") * 7 % 150).cast("double").alias("h"))


WIN = "(SELECT c_custkey AS window_id, c_name AS title, c_mktsegment AS app_name, (c_custkey%200)::DOUBLE AS w, (c_custkey*7%150)::DOUBLE AS h FROM customer)"


@query("s1_available_windows", f"SELECT window_id, title, app_name, w, h FROM {WIN} WHERE title<>'' AND app_name IS NOT NULL AND w>50 AND h>50")
def available_windows(spark, d):
    return screens.available(windows(spark, d))


@query("s2_find_window", f"SELECT window_id, title, w*2 AS width, h*2 AS height FROM {WIN} WHERE window_id=42")
def find_window(spark, d):
    return screens.find_window(windows(spark, d), 42).select("window_id", "title", F.col("width"), F.col("height"))


@query("s13_window_search", f"SELECT window_id, title, app_name FROM {WIN} WHERE contains(lower(title),'0000004') OR contains(lower(app_name),'0000004')")
def window_search(spark, d):
    return screens.search(windows(spark, d), "0000004").select("window_id", "title", "app_name")


@query("t6_contains_folded", f"SELECT window_id, contains(lower(app_name),'machin') AS found FROM {WIN}")
def contains_folded(spark, d):
    return windows(spark, d).select("window_id", screens.contains_folded(F.col("app_name"), "MACHIN").alias("found"))


@query("s3_region_screen", with_sql("fig", ", s(screen_id, sx, sy, sw, sh) AS (VALUES (0,0.0::DOUBLE,0.0::DOUBLE,400.0::DOUBLE,800.0::DOUBLE),(1,400.0,0.0,400.0,600.0)), r AS (SELECT capture_id, xi::DOUBLE AS x, yi::DOUBLE AS y, wi::DOUBLE AS w, hi::DOUBLE AS h FROM fig), j AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY (x+w/2>=sx AND x+w/2<sx+sw AND y+h/2>=sy AND y+h/2<sy+sh) DESC, screen_id) AS rn FROM r, s), f AS (SELECT capture_id, screen_id, greatest(x-sx,0) AS x1, greatest(sh-(y-sy)-h,0) AS y1, least(x-sx+w,sw) AS x2, least(sh-(y-sy),sh) AS y2 FROM j WHERE rn=1) SELECT capture_id, screen_id::BIGINT AS screen_id, CASE WHEN x2>x1 AND y2>y1 THEN x1 END AS x, CASE WHEN x2>x1 AND y2>y1 THEN y1 END AS y, CASE WHEN x2>x1 AND y2>y1 THEN x2-x1 END AS w, CASE WHEN x2>x1 AND y2>y1 THEN y2-y1 END AS h FROM f"))
def region_screen(spark, d):
    r = figures(spark, d).select("capture_id", *(F.col(f"{k}i").cast("double").alias(k) for k in "xywh"))
    return screens.on_screen(r, [(0, 0.0, 0.0, 400.0, 800.0), (1, 400.0, 0.0, 400.0, 600.0)])


@query("s4_top_candidate", with_sql("tb", ", r AS (SELECT capture_id, (block_id+1)//2 AS observation, block_id, round(confidence,6) AS confidence, row_number() OVER (PARTITION BY capture_id, (block_id+1)//2 ORDER BY round(confidence,6) DESC, block_id) AS rn FROM tb) SELECT capture_id, observation, block_id, confidence FROM r WHERE rn=1"))
def top_candidate(spark, d):
    b = blocks(spark, d).select("capture_id", F.floor((F.col("block_id") + 1) / 2).alias("observation"), "block_id", F.round("confidence", 6).alias("confidence"))
    return screens.top_candidates(b, ["capture_id", "observation"], "confidence", "block_id")


@query("s6_salient_regions", with_sql("tb", "SELECT capture_id, block_id, round(confidence,6) AS confidence FROM tb WHERE round(confidence,6)>=0.7"))
def salient_regions(spark, d):
    return blocks(spark, d).select(*KEY, F.round("confidence", 6).alias("confidence")).where("confidence >= 0.7")


@query("s8_layout_figures", with_sql("tb", CAND_SQL + "SELECT capture_id, cand_id, CASE class_id WHEN 0 THEN 'figure' ELSE 'table' END AS kind FROM cand WHERE round(confidence-0.5,6)>=0.15"))
def layout_figures(spark, d):
    kept = screens.layout_figures(candidates(spark, d).withColumn("confidence", F.round(F.col("confidence") - 0.5, 6)).withColumn("class_name", F.when(F.col("class_id") == 0, "figure").otherwise("table")))
    return kept.select("capture_id", "cand_id", F.col("class_name").alias("kind"))
