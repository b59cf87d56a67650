"""DuckDB SQL of the raster operators that repeat, grow or weigh evidence; tables as in ``raster_queries`` (8 x 8 pixels).

``big`` is the image at 32 x 32, nearest pixel, as in the queries.
"""

from __future__ import annotations

BIG = ", big AS MATERIALIZED (SELECT capture_id, nx AS px, ny AS py, r, g, b FROM pix, (SELECT unnest(range(32)) AS nx), (SELECT unnest(range(32)) AS ny) WHERE px=nx//4 AND py=ny//4)"
BIG_BG = ", pt2 AS (SELECT capture_id, gx, gy, sum(r)/64.0::DOUBLE AS r, sum(g)/64.0::DOUBLE AS g, sum(b)/64.0::DOUBLE AS b FROM big, (VALUES (0),(1),(2),(3)) a(gx), (VALUES (0),(1),(2),(3)) c(gy) WHERE px BETWEEN 8+8*gx//3 AND 15+8*gx//3 AND py BETWEEN 8+8*gy//3 AND 15+8*gy//3 GROUP BY 1,2,3), bn2 AS (SELECT capture_id, floor((r+g+b)/3.0::DOUBLE/40) AS bin, count(*) AS n, round(sum(r)/count(*),6) AS r, round(sum(g)/count(*),6) AS g, round(sum(b)/count(*),6) AS b FROM pt2 GROUP BY 1,2), bg2 AS (SELECT capture_id, r, g, b FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY n DESC, bin) AS rn FROM bn2) WHERE rn=1)"


def tighten(dev: str) -> str:
    ends = lambda at, n: f"d{n} AS (SELECT capture_id, {at} AS pos, {dev} AS deviation FROM big GROUP BY 1,2), m{n} AS (SELECT capture_id, list_sort(list(deviation))[count(*)//2+1] AS med FROM d{n} GROUP BY 1), e{n} AS (SELECT capture_id, min(pos) AS {n}1, max(pos) AS {n}2 FROM d{n} JOIN m{n} USING (capture_id) WHERE deviation>=greatest(med*1.5, 15.0) GROUP BY 1)"
    low = lambda n: f"greatest(0, {n}1-greatest(4, ({n}2-{n}1)//20))"
    span = lambda n: f"least(32-{low(n)}, {n}2-{n}1+2*greatest(4, ({n}2-{n}1)//20))"
    use = "coalesce(x1<x2 AND y1<y2 AND (w<32*0.85 OR h<32*0.85) AND w>10 AND h>10, false)"
    pick = lambda c, whole: f"CASE WHEN {use} THEN {c} ELSE {whole} END::BIGINT AS {c}"
    return f"{BIG}, {ends('px', 'x')}, {ends('py', 'y')}, c AS (SELECT s.capture_id, x1, x2, y1, y2, {low('x')} AS x, {low('y')} AS y, {span('x')} AS w, {span('y')} AS h FROM (SELECT DISTINCT capture_id FROM big) s LEFT JOIN ex USING (capture_id) LEFT JOIN ey USING (capture_id)) SELECT capture_id, {pick('x', 0)}, {pick('y', 0)}, {pick('w', 32)}, {pick('h', 32)} FROM c"


LIGHT = ", li AS (SELECT capture_id, nx AS px, ny AS py, " + ", ".join(f"CASE WHEN nx<4 OR ny>19 THEN 250 ELSE {c} END AS {c}" for c in "rgb") + " FROM pix, (SELECT unnest(range(24)) AS nx), (SELECT unnest(range(24)) AS ny) WHERE px=nx//3 AND py=ny//3)"


def auto_crop(width: int, height: int, table: str = "li") -> str:
    """The crop of ``table``, images of one size no side of which is more than twice the other."""
    every = lambda n, k: max(1, n // k)  # noqa: E731  the stride for about k samples
    mean = lambda on: f"round(sum(CASE WHEN {on} THEN r+g+b END)/count(CASE WHEN {on} THEN 1 END)/3.0::DOUBLE,6)"
    edges = [mean(f"py=0 AND px%{every(width, 20)}=0"), mean(f"py={height - 1} AND px%{every(width, 20)}=0"), mean(f"px=0 AND py%{every(height, 20)}=0"), mean(f"px={width - 1} AND py%{every(height, 20)}=0")]
    ends = lambda at, along, size, n: f"h{n} AS (SELECT capture_id, {at} AS pos, sum((abs((r+g+b)/3.0::DOUBLE-bg)>20)::INT)/count(*)::DOUBLE>=0.05 AS has FROM {table} JOIN bgs USING (capture_id) WHERE bg>200 AND {along}%{every(size, 40)}=0 GROUP BY 1,2), e{n} AS (SELECT capture_id, coalesce(min(CASE WHEN has THEN pos END),0) AS {n}1, coalesce(max(CASE WHEN has THEN pos END),max(pos)) AS {n}2 FROM h{n} GROUP BY 1)"
    pad = max(2, min(width, height) // 50)
    low = lambda n: f"greatest(0, {n}1-CASE WHEN {n}1>=4 THEN 0 ELSE {pad} END)"
    size = lambda n, most: f"(least({most - 1}, {n}2+CASE WHEN {most - 1}-{n}2>=4 THEN 0 ELSE {pad} END)-{low(n)}+1)"
    use = f"coalesce(bg>200 AND x1<x2 AND y1<y2 AND (w<{width - 4} OR h<{height - 4}) AND w>4 AND h>4, false)"
    pick = lambda c, whole: f"CASE WHEN {use} THEN {c} ELSE {whole} END::BIGINT AS {c}"
    return f", bgs AS (SELECT capture_id, greatest({', '.join(edges)}) AS bg FROM {table} GROUP BY 1), {ends('px', 'py', height, 'x')}, {ends('py', 'px', width, 'y')}, c AS (SELECT bgs.capture_id, bg, x1, x2, y1, y2, {low('x')} AS x, {low('y')} AS y, {size('x', width)} AS w, {size('y', height)} AS h FROM bgs LEFT JOIN ex USING (capture_id) LEFT JOIN ey USING (capture_id)) SELECT capture_id, {pick('x', 0)}, {pick('y', 0)}, {pick('w', width)}, {pick('h', height)} FROM c"


#: Background and content map of pages of 640 x 320 pixels, with a text a page.
SHEET_BG = ", pt AS (SELECT capture_id, gx, gy, sum(r)/64.0::DOUBLE AS r, sum(g)/64.0::DOUBLE AS g, sum(b)/64.0::DOUBLE AS b FROM sheet, (VALUES (0),(1),(2),(3)) a(gx), (VALUES (0),(1),(2),(3)) c(gy) WHERE px BETWEEN 10+204*gx AND 17+204*gx AND py BETWEEN 10+292*gy//3 AND 17+292*gy//3 GROUP BY 1,2,3), bn AS (SELECT capture_id, floor((r+g+b)/3.0::DOUBLE/40) AS bin, count(*) AS n, round(sum(r)/count(*),6) AS r, round(sum(g)/count(*),6) AS g, round(sum(b)/count(*),6) AS b FROM pt GROUP BY 1,2), bg AS (SELECT capture_id, r, g, b FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY n DESC, bin) AS rn FROM bn) WHERE rn=1)"
SHEET_TEXT = ", txt AS (SELECT DISTINCT capture_id, (capture_id%4)/8.0::DOUBLE AS x, (capture_id%5)/8.0::DOUBLE AS y, 0.5::DOUBLE AS w, 0.25::DOUBLE AS h FROM sheet)"
SHEET_CELLS = SHEET_BG + SHEET_TEXT + ", cl AS (SELECT p.capture_id, gx, gy, CASE WHEN (gx+0.5)/50>=t.x AND (gx+0.5)/50<t.x+t.w AND 1-(gy+0.5)/50>=t.y AND 1-(gy+0.5)/50<t.y+t.h THEN 'text' WHEN round(abs(p.r-bg.r)+abs(p.g-bg.g)+abs(p.b-bg.b),6)<=60 THEN 'background' ELSE 'content' END AS cell FROM (SELECT unnest(range(50)) AS gx), (SELECT unnest(range(50)) AS gy), sheet p JOIN txt t USING (capture_id) JOIN bg USING (capture_id) WHERE px=(2*gx+1)*64//10 AND py=(2*gy+1)*32//10) "


def components(mask: str, key: str = "k") -> str:
    """``cc(capture_id, k, root)``: four-connected components of ``mask``, a table of capture_id, px, py."""
    return f", m AS (SELECT capture_id, px, py, py*8+px AS k FROM ({mask})), r(capture_id, k, root) AS (SELECT capture_id, k, k FROM m UNION SELECT r.capture_id, n.k, r.root FROM r JOIN m o ON o.capture_id=r.capture_id AND o.k=r.k JOIN m n ON n.capture_id=r.capture_id AND abs(n.px-o.px)+abs(n.py-o.py)=1), cc AS (SELECT capture_id, k, min(root) AS root FROM r GROUP BY 1,2), nr AS (SELECT capture_id, root, dense_rank() OVER (PARTITION BY capture_id ORDER BY root)-1 AS nth FROM (SELECT DISTINCT capture_id, root FROM cc)) "


BOX = "min(k%8) AS x, min(k//8) AS y, max(k%8)-min(k%8)+1 AS w, max(k//8)-min(k//8)+1 AS h, count(*) AS n"
CONTENT = components("SELECT capture_id, gx AS px, gy AS py FROM cl WHERE cell='content'")
CONTENT_REGIONS = f", creg AS (SELECT capture_id, nth AS region_id, round(x/8.0::DOUBLE,6) AS x, round(1-(y+h)/8.0::DOUBLE,6) AS y, round(w/8.0::DOUBLE,6) AS w, round(h/8.0::DOUBLE,6) AS h, n AS cells FROM (SELECT capture_id, nth, {BOX} FROM cc JOIN nr USING (capture_id, root) GROUP BY 1,2)) "
FRAGMENTS = components("SELECT pix.capture_id, px, py FROM pix JOIN pb USING (capture_id) WHERE r>125 AND px>=x AND px<x+w AND py>=y AND py<y+h") + f", q AS (SELECT capture_id, root, {BOX} FROM cc GROUP BY 1,2 HAVING count(*)>=3), s AS (SELECT *, round(n/(w*h)::DOUBLE,6) AS compactness FROM q), a AS (SELECT capture_id, count(*) AS fragments FROM s GROUP BY 1), l AS (SELECT capture_id, n, compactness FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY n DESC, compactness DESC) AS rn FROM s) WHERE rn=1) SELECT pb.capture_id, coalesce(fragments,0)::BIGINT AS fragments, coalesce(n,0)::BIGINT AS largest, coalesce(compactness,0.0::DOUBLE) AS compactness FROM pb LEFT JOIN a USING (capture_id) LEFT JOIN l USING (capture_id)"
_V = "(sum({c}*{c})::DOUBLE/count(*)-(sum({c})::DOUBLE/count(*))*(sum({c})::DOUBLE/count(*)))"
STATS = (
    components("SELECT capture_id, px, py FROM pix WHERE r>125")
    + f", q AS (SELECT capture_id, root, {BOX} FROM cc GROUP BY 1,2 HAVING count(*)>=4), mp AS (SELECT cc.capture_id, root, px, py, r, g, b FROM cc JOIN pix ON pix.capture_id=cc.capture_id AND px=k%8 AND py=k//8), un AS (SELECT capture_id, root, round(1/(1+({_V.format(c='r')}+{_V.format(c='g')}+{_V.format(c='b')})/3/2000),6) AS uniformity FROM mp GROUP BY 1,2),"
    " ed AS (SELECT mp.capture_id, mp.root, round(sum(abs(mp.r-o.r)+abs(mp.g-o.g)+abs(mp.b-o.b))/count(*)::DOUBLE/3.0::DOUBLE,6) AS bc FROM mp JOIN pix o ON o.capture_id=mp.capture_id AND abs(o.px-mp.px)+abs(o.py-mp.py)=1 LEFT JOIN cc own ON own.capture_id=mp.capture_id AND own.root=mp.root AND own.k=o.py*8+o.px WHERE own.k IS NULL GROUP BY 1,2)"
    " SELECT q.capture_id, nth AS blob_id, x, y, w, h, n, round(n/(w*h)::DOUBLE,6) AS compactness, round(least(w,h)/greatest(w,h)::DOUBLE,6) AS shape_balance, uniformity, coalesce(bc,0.0::DOUBLE) AS boundary_contrast FROM q JOIN nr USING (capture_id, root) JOIN un USING (capture_id, root) LEFT JOIN ed USING (capture_id, root)"
)


def anchor_colour(width: float, wide: float, colour: float, flat: float) -> str:
    """Pixels near a text in the colour of its ring, of texts ``width`` wide, as a table ``near``."""
    within = lambda m: f"px>=floor(ax-{m}) AND px<ceil(ax+aw+{m}) AND py>=floor(ay-{m}) AND py<ceil(ay+ah+{m})"
    return f""", an AS (SELECT capture_id, round(x*8,6) AS ax, round((1-y-h)*8,6) AS ay, round(greatest(1.0,{width}*8),6) AS aw, round(greatest(1.0,h*8),6) AS ah FROM txt), ok AS (SELECT * FROM an WHERE aw/8<={wide} AND greatest(aw,ah)/greatest(1.0,least(aw,ah))<=4.5),
rg AS (SELECT capture_id, sum(r)/count(*)::DOUBLE AS fr, sum(g)/count(*)::DOUBLE AS fg, sum(b)/count(*)::DOUBLE AS fb FROM chg JOIN ok USING (capture_id) WHERE {within('3.0::DOUBLE')} AND NOT (px>=ax AND px<ax+aw AND py>=ay AND py<ay+ah) GROUP BY 1),
ev AS (SELECT a.capture_id, a.px, a.py FROM chg a JOIN chg b ON a.capture_id=b.capture_id AND abs(a.px-b.px)<=1 AND abs(a.py-b.py)<=1 GROUP BY 1,2,3 HAVING greatest(max(b.r)-min(b.r), max(b.g)-min(b.g), max(b.b)-min(b.b))<={flat}),
near AS (SELECT DISTINCT p.capture_id, p.px, p.py FROM pix p JOIN ok USING (capture_id) JOIN rg USING (capture_id) JOIN ev ON ev.capture_id=p.capture_id AND ev.px=p.px AND ev.py=p.py WHERE {within('ah*1.75').replace('px', 'p.px').replace('py', 'p.py')} AND round(sqrt((r-fr)*(r-fr)+(g-fg)*(g-fg)+(b-fb)*(b-fb)),9)<={colour}) """


SATURATED = "SELECT capture_id, px, py FROM pix WHERE greatest(r,g,b)>10 AND (greatest(r,g,b)-least(r,g,b))/greatest(r,g,b)::DOUBLE>0.40 AND greatest(r,g,b)/255.0>0.25"

TENSOR = ", gr AS (SELECT vec_id AS capture_id, unnest(range(300)) AS spot FROM embeddings WHERE len(embedding)=64) SELECT gr.capture_id, spot, round((coalesce(CASE spot//100 WHEN 0 THEN r WHEN 1 THEN g ELSE b END, 114)/255.0::DOUBLE)::FLOAT::DOUBLE, 6) AS v FROM gr LEFT JOIN pix ON pix.capture_id=gr.capture_id AND px=spot%10 AND py=spot%100//10"

GROWN = (
    BIG + BIG_BG
    + """, sd AS (SELECT capture_id, x+0.2::DOUBLE AS x, y+0.2::DOUBLE AS y, 0.1::DOUBLE AS w, 0.1::DOUBLE AS h FROM reg),
pn AS MATERIALIZED (SELECT big.capture_id, px, py, abs(big.r-bg2.r)+abs(big.g-bg2.g)+abs(big.b-bg2.b)<=60 AS blank, px/32.0::DOUBLE>=x AND px/32.0::DOUBLE<x+w AND 1-py/32.0::DOUBLE>=y AND 1-py/32.0::DOUBLE<y+h AS on_text FROM big JOIN bg2 USING (capture_id) JOIN txt USING (capture_id)),
s(capture_id, side, t, u, l, r, c) AS (SELECT capture_id, 0, greatest(0,least(31,trunc((1-(y+h))*32)))::INT, greatest(0,least(32,trunc((1-y)*32)))::INT, greatest(0,least(31,trunc(x*32)))::INT, greatest(0,least(32,trunc((x+w)*32)))::INT, 0 FROM sd UNION ALL
 SELECT capture_id, CASE WHEN go THEN side ELSE side+1 END, CASE WHEN go AND side=0 THEN t-1 ELSE t END, CASE WHEN go AND side=1 THEN u+1 ELSE u END, CASE WHEN go AND side=2 THEN l-1 ELSE l END, CASE WHEN go AND side=3 THEN r+1 ELSE r END, CASE WHEN go AND empty THEN 1 ELSE 0 END
 FROM (SELECT capture_id, side, t, u, l, r, empty, coalesce(room AND NOT text AND NOT (empty AND c=1), false) AS go FROM (
  SELECT s.capture_id, side, t, u, l, r, c, CASE side WHEN 0 THEN t>=1 WHEN 1 THEN u<32 WHEN 2 THEN l>=1 ELSE r<32 END AS room,
   coalesce(bool_or(on_text) FILTER ((CASE WHEN side<2 THEN px-l ELSE py-t END)%greatest(1,(CASE WHEN side<2 THEN r-l ELSE u-t END)//10)=0), false) AS text, coalesce(avg(blank::INT) FILTER ((CASE WHEN side<2 THEN px-l ELSE py-t END)%greatest(1,(CASE WHEN side<2 THEN r-l ELSE u-t END)//20)=0)>=0.60::DOUBLE, false) AS empty
  FROM s LEFT JOIN pn p ON p.capture_id=s.capture_id AND CASE WHEN side<2 THEN p.py=CASE side WHEN 0 THEN t-1 ELSE least(31,u) END AND p.px>=l AND p.px<r ELSE p.px=CASE side WHEN 2 THEN l-1 ELSE least(31,r) END AND p.py>=t AND p.py<u END
  WHERE side<4 GROUP BY s.capture_id, side, t, u, l, r, c)))
SELECT capture_id, 0::BIGINT AS cand_id, round(l/32.0::DOUBLE,6) AS x, round(1-u/32.0::DOUBLE,6) AS y, round((r-l)/32.0::DOUBLE,6) AS w, round((u-t)/32.0::DOUBLE,6) AS h FROM s WHERE side=4"""
)

#: Share of columns with unbroken picture above and below each text, and of picture pixels under it.
OVERLAY = (
    BIG + BIG_BG
    + """, pr AS (SELECT reg.capture_id, reg.x AS ax, reg.y AS ay, reg.w AS aw, reg.h AS ah, txt.x AS bx, txt.y AS by_, txt.w AS bw, txt.h AS bh FROM reg JOIN txt USING (capture_id)),
tp AS (SELECT capture_id, floor(round(greatest(0.0,bx*32),6))::BIGINT AS x1, floor(round(least(31.0,(bx+bw)*32),6))::BIGINT AS x2, floor(round(greatest(0.0,(1-(by_+bh))*32),6))::BIGINT AS y1, floor(round(least(31.0,(1-by_)*32),6))::BIGINT AS y2 FROM pr),
tc AS (SELECT *, greatest(3, (y2-y1)//2) AS reach, greatest(20, (y2-y1)*3) AS pad, greatest(3, least(20, (x2-x1)//30+1)) AS cnt FROM tp), ts AS (SELECT *, greatest(1, (x2-x1)//cnt) AS step FROM tc),
ta AS (SELECT *, list_filter(list_transform(range(cnt), lambda i: x1+step//2+step*i), lambda v: v<=x2) AS cs FROM ts), tl AS (SELECT *, unnest(CASE WHEN len(cs)>0 THEN cs ELSE [(x1+x2)//2] END) AS cx FROM ta),
pc AS (SELECT big.capture_id, px, py, round(abs(big.r-CASE WHEN (bg2.r+bg2.g+bg2.b)/3.0<180 THEN 250 ELSE bg2.r END)+abs(big.g-CASE WHEN (bg2.r+bg2.g+bg2.b)/3.0<180 THEN 250 ELSE bg2.g END)+abs(big.b-CASE WHEN (bg2.r+bg2.g+bg2.b)/3.0<180 THEN 250 ELSE bg2.b END),6)>50 AS pict FROM big JOIN bg2 USING (capture_id)),
ru AS (SELECT tl.capture_id, cx, y1, y2, reach, greatest(0,y1-pad) AS top, least(31,y2+pad) AS low, max(CASE WHEN py<y1 AND py>=greatest(0,y1-pad) AND NOT pict THEN py END) AS su, min(CASE WHEN py>y2 AND py<=least(31,y2+pad) AND NOT pict THEN py END) AS sdn FROM tl JOIN pc ON pc.capture_id=tl.capture_id AND pc.px=tl.cx GROUP BY ALL),
vt AS (SELECT capture_id, sum((y1-1-coalesce(su,top-1)>=reach)::INT)/count(*)::DOUBLE AS above, sum((coalesce(sdn,low+1)-y2-1>=reach)::INT)/count(*)::DOUBLE AS below FROM ru GROUP BY 1),
ch AS (SELECT tp.capture_id, sum(pict::INT)/count(*)::DOUBLE AS coherence FROM tp JOIN pc ON pc.capture_id=tp.capture_id AND px BETWEEN x1 AND x2 AND py BETWEEN y1 AND y2 AND (px-x1)%greatest(1,(x2-x1+1)//15)=0 AND (py-y1)%greatest(1,(y2-y1+1)//5)=0 GROUP BY 1) """
)
CLASSES = """, ne AS (SELECT *, [(ay+ah-by_-bh)/ah, (by_-ay)/ah, (bx-ax)/aw, (ax+aw-bx-bw)/aw] AS d FROM pr), cz AS (SELECT capture_id, above, below, coherence, round(CASE WHEN least(ax+aw,bx+bw)>greatest(ax,bx) AND least(ay+ah,by_+bh)>greatest(ay,by_) THEN (least(ax+aw,bx+bw)-greatest(ax,bx))*(least(ay+ah,by_+bh)-greatest(ay,by_)) ELSE 0 END/(bw*bh),9) AS ins, round(list_min(d),9) AS near, list_position(d, list_min(d)) AS edge FROM ne LEFT JOIN vt USING (capture_id) LEFT JOIN ch USING (capture_id))
SELECT capture_id, 0::BIGINT AS block_id, CASE WHEN ins<=0.3 THEN 'pageText' WHEN above IS NULL THEN 'uncertain' WHEN above>=0.5 AND below>=0.5 THEN 'overlay' WHEN near<0.2 AND coherence>0.4 AND CASE edge WHEN 2 THEN above WHEN 1 THEN below ELSE greatest(above,below) END>=0.5 THEN 'edgeOverlay' WHEN above<0.3 AND below<0.3 AND coherence<0.3 THEN 'pageText' WHEN coherence>0.4 OR above>=0.3 OR below>=0.3 THEN 'uncertain' ELSE 'pageText' END AS class FROM cz"""

_S = "(least(c.x+c.w,d.x+d.w)-greatest(c.x,d.x))*(least(c.y+c.h,d.y+d.h)-greatest(c.y,d.y))"
_MEET = "least(c.x+c.w,d.x+d.w)-greatest(c.x,d.x)>0 AND least(c.y+c.h,d.y+d.h)-greatest(c.y,d.y)>0"
#: Hypotheses of each candidate's bounds with their scores; a table ``hy`` with the strategies' order.
HYPOTHESES = f""", bt AS (SELECT * FROM (SELECT c.capture_id, c.x AS ax, c.y AS ay, c.w AS aw, c.h AS ah, d.x AS bx, d.y AS by_, d.w AS bw, d.h AS bh, round({_S},9) AS s, row_number() OVER (PARTITION BY c.capture_id ORDER BY round({_S},9) DESC, d.region_id) AS rn FROM reg c JOIN creg d USING (capture_id) WHERE {_MEET}) WHERE rn=1),
wd AS (SELECT *, greatest(0.0,ax-aw*0.3) AS wx, greatest(0.0,ay-ah*0.3) AS wy, least(1.0,greatest(0.0,ax-aw*0.3)+least(1.0,aw*1.6)) AS wx2, least(1.0,greatest(0.0,ay-ah*0.3)+least(1.0,ah*1.6)) AS wy2, round(s/(bw*bh),9)<0.5 AS clip FROM bt),
h0 AS (SELECT capture_id, CASE WHEN clip THEN greatest(bx,wx) ELSE bx END AS x, CASE WHEN clip THEN greatest(by_,wy) ELSE by_ END AS y, CASE WHEN clip THEN least(bx+bw,wx+(wx2-wx))-greatest(bx,wx) ELSE bw END AS w, CASE WHEN clip THEN least(by_+bh,wy+(wy2-wy))-greatest(by_,wy) ELSE bh END AS h FROM wd
 UNION ALL SELECT reg.capture_id, q.x, q.y, q.w, q.h FROM reg JOIN (SELECT capture_id, min(gx)/8.0::DOUBLE AS x, 1-(max(gy)+1)/8.0::DOUBLE AS y, (max(gx)+1-min(gx))/8.0::DOUBLE AS w, (max(gy)+1-min(gy))/8.0::DOUBLE AS h FROM cl WHERE cell='content' GROUP BY 1) q USING (capture_id) WHERE reg.capture_id NOT IN (SELECT capture_id FROM bt)),
hu AS (SELECT c.capture_id, min(d.x) AS x, min(d.y) AS y, max(d.x+d.w)-min(d.x) AS w, max(d.y+d.h)-min(d.y) AS h, any_value(c.w*c.h) AS area FROM reg c JOIN txt d USING (capture_id) WHERE {_MEET} AND round({_S}/(d.w*d.h),9)>0.10 GROUP BY 1),
hb AS (SELECT * FROM (SELECT c.capture_id, d.x AS bx, d.y AS by_, d.w AS bw, d.h AS bh, row_number() OVER (PARTITION BY c.capture_id ORDER BY round(d.w*d.h,9) DESC, d.region_id) AS rn FROM hu c JOIN creg d USING (capture_id) WHERE {_MEET}) WHERE rn=1),
h2 AS (SELECT capture_id, area, CASE WHEN bx IS NULL THEN x ELSE least(x,bx) END AS x, CASE WHEN bx IS NULL THEN y ELSE least(y,by_) END AS y, CASE WHEN bx IS NULL THEN w ELSE greatest(x+w,bx+bw)-least(x,bx) END AS w, CASE WHEN bx IS NULL THEN h ELSE greatest(y+h,by_+bh)-least(y,by_) END AS h FROM hu LEFT JOIN hb USING (capture_id)),
rm AS (SELECT c.capture_id, any_value(c.x) AS x, any_value(c.w) AS w, greatest(0.0,coalesce(max(CASE WHEN round(least(c.x+c.w,d.x+d.w)-greatest(c.x,d.x)-c.w*0.2,9)>0 AND round(d.y+d.h-(c.y+c.h/2),9)<0 THEN d.y+d.h END),0.0)) AS lo, least(1.0,coalesce(min(CASE WHEN round(least(c.x+c.w,d.x+d.w)-greatest(c.x,d.x)-c.w*0.2,9)>0 AND round(d.y-(c.y+c.h/2),9)>0 THEN d.y END),1.0)) AS hi FROM reg c JOIN txt d USING (capture_id) GROUP BY 1),
al AS (SELECT capture_id, 0 AS ordinal, 'contentFit' AS strategy, x, y, w, h FROM h0 UNION ALL SELECT capture_id, 1, 'saliencyAnchored', x, y, w, h FROM reg UNION ALL SELECT capture_id, 2, 'subjectAnchored', x, y, w, h FROM h2 UNION ALL SELECT capture_id, 3, 'textGap', x, round(lo,9), w, round(hi-lo,9) FROM rm WHERE round(hi-lo,9)>0.05),
qs AS (SELECT capture_id, ordinal, cell, (gx+0.5)/8>=x AND (gx+0.5)/8<x+w AND 1-(gy+0.5)/8>=y AND 1-(gy+0.5)/8<y+h AS ins FROM cl JOIN al USING (capture_id)),
sm AS (SELECT capture_id, ordinal, sum(ins::INT)::DOUBLE AS a, sum((ins AND cell='content')::INT)::DOUBLE AS c, sum((ins AND cell='text')::INT)::DOUBLE AS t, sum((cell='content')::INT)::DOUBLE AS wh FROM qs GROUP BY 1,2),
hy AS (SELECT al.capture_id, ordinal, strategy, al.x, al.y, al.w, al.h, round(((CASE WHEN a>0 THEN c/a ELSE 0 END)*0.4::DOUBLE+(CASE WHEN wh>0 THEN c/wh ELSE 0 END)*0.4::DOUBLE+(1-CASE WHEN a>0 THEN t/a ELSE 0 END)*0.2::DOUBLE)*CASE WHEN strategy='subjectAnchored' AND al.w*al.h/greatest(area,0.001)>1.2 THEN least(1.0,1.2/(al.w*al.h/greatest(area,0.001))) ELSE 1.0 END,6) AS score FROM al JOIN sm USING (capture_id, ordinal) LEFT JOIN h2 USING (capture_id)) """
