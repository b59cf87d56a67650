"""Queries of the detector as one job, over packed pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import detection
from quire.plans import raster_sql as R
from quire.plans.image_queries import SHEET_IDS, _captures, sheets
from quire.plans.raster_queries import VARS, sheet_texts
from quire.plans.registry import query
from quire.sources.layouts import with_sql


def candidates(spark, d):
    """Two candidates a page, apart from each other; on every third page both are too thin."""
    c, i = F.col("capture_id"), F.col("cand_id")
    b = _captures(spark, d).select("capture_id", F.explode(F.expr("sequence(0L, 1L)")).alias("cand_id"))
    thin = c % 3 == 0
    return b.select("capture_id", "cand_id", F.lit("saliency").alias("source"), (0.5 + i / 10).alias("confidence"), (0.06 + i * 0.5).alias("x"), (0.125 + (c % 4) * 0.03125).alias("y"), F.when(thin, 0.0625).otherwise(0.375).alias("w"), F.lit(0.5).alias("h"))


def texts(spark, d):
    """One small text a page."""
    return sheet_texts(spark, d).withColumns({"w": F.lit(0.125), "h": F.lit(0.0625)})


def subjects(spark, d):
    """A subject on every fifth page."""
    return _captures(spark, d).where("capture_id % 5 = 0").select("capture_id", F.lit(0).cast("long").alias("subj_id"), F.lit(0.1).alias("x"), F.lit(0.2).alias("y"), F.lit(0.2).alias("w"), F.lit(0.2).alias("h"))


@query("r3_content_map_packed", with_sql("sheet", R.SHEET_CELLS + "SELECT * FROM cl"))
def content_map(spark, d):
    return detection.content_map(sheets(spark, d), sheet_texts(spark, d))


INSIDE = "px>=floor(round(c.x*640,6)) AND px<ceil(round((c.x+c.w)*640,6)) AND py>=floor(round((1-c.y-c.h)*320,6)) AND py<ceil(round((1-c.y)*320,6))"


def _judged(cands: str) -> str:
    return f"""SELECT c.capture_id, c.cand_id, c.x, c.y, c.w, c.h FROM {cands} c JOIN txt t USING (capture_id) JOIN sheet s USING (capture_id)
WHERE c.w/greatest(c.h,0.001)>=0.15 AND round(greatest(0,least(c.x+c.w,t.x+t.w)-greatest(c.x,t.x))*greatest(0,least(c.y+c.h,t.y+t.h)-greatest(c.y,t.y))/(c.w*c.h),9)<=0.10 AND {INSIDE}
AND (px-floor(round(c.x*640,6)))::BIGINT%greatest(1,(ceil(round((c.x+c.w)*640,6))-floor(round(c.x*640,6)))::BIGINT//100)=0 AND (py-floor(round((1-c.y-c.h)*320,6)))::BIGINT%greatest(1,(ceil(round((1-c.y)*320,6))-floor(round((1-c.y-c.h)*320,6)))::BIGINT//100)=0
GROUP BY ALL HAVING round(sqrt({VARS}),6)>=20"""


#: Candidates and, on pages where none is left, connected content of the page by runs of cells; of both those that ``_judged`` keeps.
FALLBACK = "WITH RECURSIVE " + with_sql("sheet", R.SHEET_CELLS.replace("0.5::DOUBLE AS w, 0.25::DOUBLE AS h FROM sheet", "0.125::DOUBLE AS w, 0.0625::DOUBLE AS h FROM sheet") + f""", {SHEET_IDS},
cand AS (SELECT capture_id, i AS cand_id, 0.06+i*0.5::DOUBLE AS x, 0.125+(capture_id%4)*0.03125::DOUBLE AS y, CASE WHEN capture_id%3=0 THEN 0.0625 ELSE 0.375 END::DOUBLE AS w, 0.5::DOUBLE AS h FROM ids, (SELECT unnest(range(2)) AS i)),
main AS MATERIALIZED ({_judged('cand')}),
cm AS MATERIALIZED (SELECT capture_id, gx, gy, gy*50+gx AS k FROM cl WHERE cell='content' AND capture_id NOT IN (SELECT capture_id FROM main)),
ru AS MATERIALIZED (SELECT capture_id, gy, min(gx) AS x1, max(gx) AS x2, min(k) AS id FROM (SELECT *, gx-row_number() OVER (PARTITION BY capture_id, gy ORDER BY gx) AS isl FROM cm) GROUP BY capture_id, gy, isl),
ad AS MATERIALIZED (SELECT a.capture_id, a.id AS p, b.id AS q FROM ru a JOIN ru b ON a.capture_id=b.capture_id AND abs(a.gy-b.gy)=1 AND a.x1<=b.x2 AND b.x1<=a.x2),
rr(capture_id, id, root) AS (SELECT capture_id, id, id FROM ru UNION SELECT rr.capture_id, ad.q, rr.root FROM rr JOIN ad ON ad.capture_id=rr.capture_id AND ad.p=rr.id WHERE rr.root<ad.q),
lab AS (SELECT ru.*, root FROM ru JOIN (SELECT capture_id, id, min(root) AS root FROM rr GROUP BY 1,2) USING (capture_id, id)),
rg AS (SELECT capture_id, row_number() OVER (PARTITION BY capture_id ORDER BY root)-1 AS cand_id, round(min(x1)/50.0::DOUBLE,6) AS x, round(1-(max(gy)+1)/50.0::DOUBLE,6) AS y, round((max(x2)-min(x1)+1)/50.0::DOUBLE,6) AS w, round((max(gy)-min(gy)+1)/50.0::DOUBLE,6) AS h FROM lab GROUP BY capture_id, root),
big AS (SELECT * FROM rg WHERE round(w*h,9)>=0.03), second AS ({_judged('big')}) """)[5:]


@query("c16_fallback_pass", FALLBACK + "SELECT capture_id, cand_id, round(x,6) AS x, round(y,6) AS y, round(w,6) AS w, round(h,6) AS h, false AS fallback FROM main UNION ALL SELECT *, true FROM second")
def fallback_pass(spark, d):
    """Boxes of both ways, before they are cut to what they show."""
    images, t, s = sheets(spark, d), texts(spark, d), subjects(spark, d)
    return detection.with_fallback(detection.extracted(candidates(spark, d), images, t, s, refine=False), images, t, s, refine=False)


def job(spark, d, **how):
    return detection.detected(sheets(spark, d), candidates(spark, d), texts(spark, d), subjects(spark, d), **how)


@query("d1_detected_figures")
def detected_figures(spark, d):
    return job(spark, d)[0]


#: No text is large enough to trim a candidate, and no two candidates are near enough to merge.
COUNTS = """, fr AS (SELECT count(*)::BIGINT AS n FROM cand c JOIN txt t USING (capture_id) WHERE round(greatest(0,least(c.x+c.w,t.x+t.w)-greatest(c.x,t.x))*greatest(0,least(c.y+c.h,t.y+t.h)-greatest(c.y,t.y))/(c.w*c.h),9)<0.4)
SELECT 'candidates' AS pass, count(*)::BIGINT AS n FROM cand UNION ALL SELECT 'text_free', n FROM fr UNION ALL SELECT 'trimmed', n FROM fr UNION ALL SELECT 'merged', n FROM fr UNION ALL SELECT 'extracted', count(*) FROM main UNION ALL SELECT 'figures', (SELECT count(*) FROM main)+(SELECT count(*) FROM second)"""


@query("k5_pass_counts", FALLBACK + COUNTS)
def pass_counts(spark, d):
    """How many rows each pass of the detector gave, observed while it ran."""
    counts = job(spark, d)[1]
    return spark.createDataFrame(sorted(counts.items()), "pass string, n long")
