"""What is retouched: of any classes the operator takes two, and the query plans every page."""

import duckdb

from quire.operators import overlays as O
from quire.plans import catalog

DATA = "/root/testdata/sf0.001"
TEXTS = "capture_id long, overlay_id long, kind string, is_excluded boolean, source_text_block_ids array<long>, associated_figure_overlay_id long, classification string"


def test_rebuild_plan_takes_excluded_texts_on_figures(spark):
    classes = ["overlay", "edgeOverlay", "uncertain", "pageText", None]
    texts = [(c, 1, "text", True, [1, 2], 0, cls) for c, cls in enumerate(classes)]
    texts += [(0, 2, "text", False, [3], 0, "overlay"), (0, 3, "text", True, [4], None, "overlay")]
    blocks = spark.createDataFrame([(c, b, 0.1 * b, 0.2 * b, 0.1, 0.1) for c in range(5) for b in range(6)], "capture_id long, block_id long, x double, y double, w double, h double")
    got = O.rebuild_plan(spark.createDataFrame(texts, TEXTS), blocks).collect()
    assert sorted(map(tuple, got)) == [(0, 0, 2, [1, 2], 0.1, 0.2), (1, 0, 2, [1, 2], 0.1, 0.2)]


def test_rebuild_plan_covers_every_page_with_an_excluded_text(spark):
    pages = duckdb.sql(f"SELECT DISTINCT user_id FROM '{DATA}/events.parquet'").fetchall()
    want = {(c, i - 1) for (c,) in pages for i in (1, 3) if (c + i) % 3 == 0}
    got = catalog.queries()["o12_rebuild_plan"](spark, DATA).collect()
    assert {(r.capture_id, r.figure_overlay_id) for r in got} == want and len(got) == len(want)
