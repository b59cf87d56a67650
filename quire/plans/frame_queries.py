"""Queries over scrolling captures."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import frames
from quire.plans.registry import query
from quire.sources import layouts as L
from quire.sources.layouts import with_sql

#: Frames of scrolling captures, and for every pair of neighbours the largest overlap by counting the rows that agree at each offset.
STITCH = with_sql("sheet", """, ln AS (SELECT capture_id, py, string_agg(r, ',' ORDER BY px) AS row FROM sheet GROUP BY 1, 2),
fr AS (SELECT capture_id, k AS frame, py - k*(40+capture_id%4*20) AS py, row FROM ln, (SELECT unnest(range(6)) AS k) WHERE k <= ceil(200.0/(40+capture_id%4*20)) AND py BETWEEN k*(40+capture_id%4*20) AND k*(40+capture_id%4*20)+119),
ht AS (SELECT capture_id, frame, count(*) AS height FROM fr GROUP BY 1, 2),
vt AS (SELECT g.capture_id, g.frame, f.py-g.py AS off, count(*) AS n FROM fr f JOIN fr g ON f.capture_id=g.capture_id AND g.frame=f.frame+1 AND f.row=g.row AND f.py>=g.py GROUP BY 1, 2, 3),
ov AS (SELECT vt.capture_id, vt.frame, max(n) AS overlap FROM vt JOIN ht p ON p.capture_id=vt.capture_id AND p.frame=vt.frame-1 JOIN ht q ON q.capture_id=vt.capture_id AND q.frame=vt.frame WHERE n=p.height-off AND n<=q.height AND n>=8 GROUP BY 1, 2),
al AS (SELECT ht.capture_id, ht.frame, height, coalesce(overlap, 0)::BIGINT AS overlap FROM ht LEFT JOIN ov USING (capture_id, frame)),
tp AS (SELECT *, sum(down) OVER (PARTITION BY capture_id ORDER BY frame) AS top FROM (SELECT *, coalesce(lag(height) OVER (PARTITION BY capture_id ORDER BY frame), 0)-overlap AS down FROM al)) """)


def scrolled(spark, d):
    return L.scrolled(L.sheet_rows(L.table(spark, d, "embeddings")))


@query("s9_frame_overlaps", STITCH + "SELECT * FROM al")
def frame_overlaps(spark, d):
    return frames.overlaps(scrolled(spark, d))


@query("s9_stitched_frames", STITCH + "SELECT capture_id, (top+py)::BIGINT AS py, frame, md5(row) AS row FROM fr JOIN tp USING (capture_id, frame) WHERE py>=overlap")
def stitched_frames(spark, d):
    found = frames.stitched(scrolled(spark, d))
    return found.withColumn("row", F.md5(F.array_join("row", ",").cast("binary")))
