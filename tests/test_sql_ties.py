"""The queries' SQL where numbers meet a threshold exactly or rows are equal."""

import duckdb
import pytest

from quire.plans.page_queries import MERGED_SQL, ORDER_SQL
from quire.plans.raster_queries import CELLS, EVIDENCE, TXT
from quire.sources.layouts import with_sql

#: Two pixels of this image are 60 from its background, but for the last digits of doubles.
GREYS = [146, 114, 155, 117, 114, 127, 127, 130, 131, 153, 92, 136, 133, 111, 127, 133, 118, 154, 131, 131, 135, 132, 131, 123, 134, 121, 132, 135, 95, 104, 137, 121, 165, 132, 148, 128, 119, 129, 113, 124, 154, 117, 140, 133, 138, 136, 125, 107, 107, 155, 118, 123, 131, 159, 179, 125, 118, 121, 105, 123, 127, 131, 124, 130]


@pytest.fixture
def con():
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.1/{t}.parquet'")
    return con


def test_equal_intervals_are_one_step(con):
    assert con.execute(with_sql("tb", MERGED_SQL + "SELECT count(*) FROM (SELECT *, lead(low) OVER (PARTITION BY capture_id ORDER BY low) AS nx FROM m) WHERE high>=nx")).fetchone() == (0,)


def test_cells_at_the_threshold_are_background(con):
    con.execute("CREATE TABLE embeddings AS SELECT 364 AS vec_id, ?::FLOAT[] AS embedding", [[(g + 0.5) / 127.5 - 1 for g in GREYS]])
    assert con.execute(with_sql("pix", TXT + CELLS + "SELECT DISTINCT cell FROM cl WHERE (gx, gy) IN ((3,1),(5,5))")).fetchall() == [("background",)]


def test_first_edge_on_ties(con):
    assert con.execute(with_sql("fig tb", EVIDENCE + "SELECT edge FROM ev WHERE capture_id=56734 AND block_id=4")).fetchall() == [("top",)]


def test_blocks_that_end_at_the_boundary_do_not_cross_it(con, spark):
    from quire.operators import reading
    from quire.sources.layouts import document_blocks

    widths = [900, 230, 400, 336, 364, 400, 400, 400, 400, 400, 400, 340, 166, 310, 400, 114, 400, 170, 400]
    text = "\n".join("a" * ((min(w, 400) - 20) // 2) for w in widths)
    con.execute("CREATE TABLE documents AS SELECT 17353::BIGINT AS doc_id, ? AS text", [text])
    want = con.execute(with_sql("db", ORDER_SQL.format(t="db") + "SELECT block_id FROM ordered ORDER BY reading_pos")).fetchall()
    assert [b for (b,) in want] == [0, *range(1, 19, 2), *range(2, 19, 2)]
    d = document_blocks(spark.createDataFrame([(17353, text)], "doc_id long, text string"))
    assert [r.block_id for r in reading.reading_order(d).orderBy("reading_pos").collect()] == [b for (b,) in want]
