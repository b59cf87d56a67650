"""Capture sources: windows, screens, recognized candidates and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import geometry as g
from quire.operators import relations

# Classes of a layout model.
FIGURE_CLASSES = ["figure", "table"]


def available(windows: DataFrame, least: float = 50) -> DataFrame:
    """Windows that can be captured: owned, titled and larger than ``least`` both ways."""
    return windows.where((F.col("title") != "") & F.col("app_name").isNotNull() & (F.col("w") > least) & (F.col("h") > least))


def find_window(windows: DataFrame, window_id: int) -> DataFrame:
    """The window with its pixel size at twice the frame; raises when the rows are asked for and it is not there."""
    hit = windows.where(F.col("window_id") == window_id).dropDuplicates(["window_id"])
    found = hit.agg(F.max(F.struct(*windows.columns)).alias("m"))  # one row, null without a hit
    found = found.select(F.when(F.col("m").isNull(), F.raise_error(F.lit(f"window {window_id} not found")).cast(found.schema["m"].dataType)).otherwise(F.col("m")).alias("m")).select("m.*")
    return found.withColumns({"width": F.col("w") * 2, "height": F.col("h") * 2})


def contains_folded(text: Column, part: str) -> Column:
    return F.contains(F.lower(text), F.lit(part.lower()))


def search(windows: DataFrame, text: str) -> DataFrame:
    """Windows whose title or application holds the text, whatever its case; an empty text finds all."""
    return windows if not text else windows.where(contains_folded(F.col("title"), text) | contains_folded(F.col("app_name"), text))


def on_screen(regions: DataFrame, screens: list[tuple[int, float, float, float, float]]) -> DataFrame:
    """Each region on the screen that holds its centre (else the first): flipped and clipped to it, or null."""
    r = g.rect()
    holds = [F.when(g.contains_point(g.Rect(*s[1:]), r.x + r.w / 2, r.y + r.h / 2), F.lit(i)) for i, s in enumerate(screens)]
    at = F.coalesce(*holds, F.lit(0))
    table = F.array(*(F.struct(F.lit(s[0]).cast("long").alias("screen_id"), *(F.lit(float(v)).alias(k) for k, v in zip(("sx", "sy", "sw", "sh"), s[1:], strict=True))) for s in screens))
    d = regions.withColumn("s", F.get(table, at))
    local = g.Rect(r.x - F.col("s.sx"), r.y - F.col("s.sy"), r.w, r.h)
    return d.select("capture_id", F.col("s.screen_id").alias("screen_id"), *g.flip_on_display(local, F.col("s.sw"), F.col("s.sh")).named())


def top_candidates(df: DataFrame, keys: list[str], confidence: str, tie: str) -> DataFrame:
    """The most confident row of each observation; ties to the smaller id."""
    w = Window.partitionBy(*keys).orderBy(F.desc(confidence), tie)
    return df.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def layout_figures(detections: DataFrame, least: float = 0.15) -> DataFrame:
    """Detections of a figure class with enough confidence."""
    return detections.where((F.col("confidence") >= least) & F.col("class_name").isin(FIGURE_CLASSES))


def instance_regions(masks: DataFrame, texts: DataFrame, least_area: float = 0.03, most_text: float = 0.4) -> DataFrame:
    """Boxes of instance masks given as pixels (capture_id, instance, px, py, width, height), bottom-left.

    Small ones go, and so do those of which texts cover ``most_text`` or more.
    """
    box = masks.groupBy("capture_id", "instance").agg(F.min("px").alias("x1"), F.min("py").alias("y1"), (F.max("px") + 1).alias("x2"), (F.max("py") + 1).alias("y2"), F.first("width").alias("width"), F.first("height").alias("height"))
    w, h = F.col("width"), F.col("height")
    r = g.Rect(F.col("x1") / w, 1 - F.col("y2") / h, (F.col("x2") - F.col("x1")) / w, (F.col("y2") - F.col("y1")) / h)
    large = box.select("capture_id", "instance", *r.named()).where(F.round(F.col("w") * F.col("h"), 9) >= least_area)
    return relations.text_free(large, texts, most_text, "instance").drop("text_overlap")


def figure_labels(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("label", F.concat(F.lit("Figure "), F.row_number().over(Window.partitionBy(key).orderBy(order)).cast("string")))


def status_text(state: Column, width: Column, height: Column, words: Column, figures: Column, message: Column) -> Column:
    """What the status line says in each state of a capture."""
    return (
        F.when(state == "idle", F.lit("No capture"))
        .when(state == "capturing", F.lit("Capturing..."))
        .when(state == "captured", F.format_string("Captured %d×%d", width, height))
        .when(state == "analyzing", F.lit("Analyzing..."))
        .when(state == "analyzed", F.format_string("Analyzed · %d words · %d figures", words, figures))
        .when(state == "error", F.concat(F.lit("Error: "), F.coalesce(message, F.lit(""))))
    )
