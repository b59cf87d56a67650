"""The registered queries of the layout operators, each over the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.plans import detection_queries, frame_queries, geometry_queries, image_queries, page_queries, raster_queries, report_queries, state_queries  # noqa: F401
from quire.plans.registry import ORACLES, QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
