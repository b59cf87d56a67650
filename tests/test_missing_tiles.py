"""Pages that lack some of their tiles: what is there counts, on packed images as in SQL."""

import duckdb
import pytest

from quire.plans import catalog
from test_queries import rows


@pytest.fixture(scope="module")
def some(tmp_path_factory):
    """Two pages, one without its fourth tile, one with 26 tiles."""
    d = str(tmp_path_factory.mktemp("tiles"))
    duckdb.execute(f"COPY (SELECT * FROM '/root/testdata/sf0.01/embeddings.parquet' WHERE vec_id BETWEEN 100 AND 149 AND vec_id<>103 OR vec_id BETWEEN 200 AND 225) TO '{d}/embeddings.parquet'")
    return d


@pytest.mark.parametrize("name", ["c16_fallback_pass", "k5_pass_counts", "o12_preview_elsewhere", "r11_anchor_colour_page", "r13_region_variance_page", "r16_text_mask_page", "r18_r19_validation_page", "r3_content_map_packed"])
def test_matches_sql(spark, some, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{some}/embeddings.parquet'")
    want = con.sql(catalog.oracle_sql()[name]).arrow()
    want = want.read_all() if hasattr(want, "read_all") else want
    assert rows(catalog.queries()[name](spark, some).toArrow()) == rows(want)
