"""Readers and writers of the library's files: logs, coverage, catalogs, reports, markdown."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

COVERAGE = "data array<struct<files: array<struct<filename: string, summary: struct<lines: struct<count: bigint, covered: bigint, percent: double>>>>>>"
CATALOG = "map<string, struct<category: string, description: string>>"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place below ``spark.checkpoint.dir``, or on a local master without it in a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(base or 'file://' + tempfile.mkdtemp(prefix='quire-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _run() -> Column:
    """The run of a file: the folder ``run_id=...`` it lies in, else its name."""
    run = F.regexp_extract(F.col("_metadata.file_path"), "run_id=([^/]+)/", 1)
    return F.when(run != "", run).otherwise(F.col("_metadata.file_name")).alias("run_id")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """``run_id, line_no, line``: a run a file, its lines numbered from 0.

    Files are read in splits. A line's place in its split comes from the order in which the split is read, and
    the lines of the splits before it from a running sum over a file's split counts, so a file of any size is
    spread over tasks and no file is ever a row. Lines end at a line feed, a carriage return, or both.
    """
    lines = spark.read.text(path, recursiveFileLookup=True).select(_run(), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    splits = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first"))
    return lines.join(splits, ["file", "block"]).select("run_id", (F.col("at") + F.col("before")).alias("line_no"), "line")


def read_coverage(spark: SparkSession, path: str) -> DataFrame:
    """``run_id, path, covered, count, percent`` of the source files of coverage exports."""
    d = spark.read.schema(COVERAGE).json(path, multiLine=True, recursiveFileLookup=True).select(_run(), F.explode("data").alias("d"))
    f = d.select("run_id", F.explode("d.files").alias("f"))
    return f.select("run_id", F.col("f.filename").alias("path"), F.col("f.summary.lines.covered").alias("covered"), F.col("f.summary.lines.count").alias("count"), F.col("f.summary.lines.percent").alias("percent")).where(F.contains("path", F.lit("/Sources/")))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """``key, category, description`` of a catalog that maps test names."""
    d = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", CATALOG)).alias("key", "v"))
    return d.select("key", "v.category", "v.description")


def write_logs(log: DataFrame, path: str) -> None:
    """``log`` (run_id, line_no, line) as a text file a run, in a folder of its own."""
    log.select("run_id", "line_no", F.col("line").alias("value")).repartition("run_id").sortWithinPartitions("run_id", "line_no").drop("line_no").write.partitionBy("run_id").text(path)


def write_coverage(files: DataFrame, path: str) -> None:
    """``files`` (run_id, path, covered, count) as a coverage export a run, in a folder of its own."""
    lines = F.struct(F.struct("count", "covered", (F.col("covered") * 100.0 / F.col("count")).alias("percent")).alias("lines"))
    runs = files.groupBy("run_id").agg(F.collect_list(F.struct(F.col("path").alias("filename"), lines.alias("summary"))).alias("files"))
    runs.select("run_id", F.to_json(F.struct(F.array(F.struct("files")).alias("data"))).alias("value")).repartition("run_id").write.partitionBy("run_id").text(path)


def write_catalog(entries: DataFrame, path: str) -> None:
    """``entries`` (key, category, description) as one catalog file: a catalog is one map, small by nature."""
    entry = F.struct("key", F.struct("category", "description"))
    entries.agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value")).coalesce(1).write.text(path)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files as rows of bytes, for a decoder of the caller's choice."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def write_dashboard(summary: DataFrame, path: str) -> None:
    """One JSON object a row, keys in alphabetical order."""
    summary.select(F.to_json(F.struct(*sorted(summary.columns))).alias("value")).write.mode("overwrite").text(path)


def append_history(spark: SparkSession, new: DataFrame, path: str, keep: int = 50) -> DataFrame:
    """The stored runs of each series with the new ones, only the last ``keep``; the caller writes them to a new place."""
    from quire.operators.reports import history

    old = spark.read.schema(new.schema).parquet(path)
    return history(old.unionByName(new), keep).drop("back")


def markdown(texts: DataFrame) -> DataFrame:
    """``capture_id, path, content``: one markdown page a capture."""
    name = F.col("capture_id").cast("string")
    content = F.concat(F.lit("# Capture "), name, F.lit("\n\n"), F.col("full_text"), F.lit("\n"))
    return texts.select("capture_id", F.concat(F.lit("capture-"), name, F.lit(".md")).alias("path"), content.alias("content"))


def portable_pixmaps(crops: DataFrame) -> DataFrame:
    """``capture_id, path, content``: the pixels of each crop (capture_id, fig_no, width, height, px, py, r, g, b) as a plain pixmap file."""
    colour = F.concat_ws(" ", "r", "g", "b")
    pixels = F.array_sort(F.collect_list(F.struct("py", "px", colour.alias("c"))))
    d = crops.groupBy("capture_id", "fig_no", "width", "height").agg(F.transform(pixels, lambda p: p["c"]).alias("c"))
    content = F.concat(F.lit("P3\n"), F.concat_ws(" ", "width", "height"), F.lit("\n255\n"), F.array_join("c", "\n"), F.lit("\n"))
    path = F.concat(F.lit("capture-"), F.col("capture_id").cast("string"), F.lit("-figure-"), F.col("fig_no").cast("string"), F.lit(".ppm"))
    return d.select("capture_id", path.alias("path"), content.alias("content"))


def export(texts: DataFrame, path: str, selection: str = "textAndFigures", crops: DataFrame | None = None) -> None:
    """Write markdown pages and figure images (pixmaps of ``crops``) as text, a folder a file; ``selection`` may leave out either."""
    parts = [markdown(texts)] if selection in ("textAndFigures", "textOnly") else []
    parts += [portable_pixmaps(crops)] if selection in ("textAndFigures", "figuresOnly") and crops is not None else []
    for n, part in enumerate(parts):
        part.select(F.col("content").alias("value"), "path").write.mode("append" if n else "overwrite").partitionBy("path").text(path)
