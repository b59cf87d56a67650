"""Reading order, text-free gaps, words and full text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def reading_order(blocks: DataFrame, band_tolerance: float = 0.5, least_gap: float = 0.05, spread: float = 0.15, sections: bool = False) -> DataFrame:
    """``blocks`` with ``reading_pos`` (from 0) within each capture, and with ``sections`` also ``section``.

    Blocks fall into bands of like height on the page. Where at least two bands have a gap wider than
    ``least_gap`` at about the same place, the page has two columns: blocks across the boundary come first,
    then the left and the right column (sections 0, 1 and 2); else bands are read left to right, in one section.
    Ties go to the smaller block id.
    """
    w = Window.partitionBy("capture_id")
    down = w.orderBy(F.desc("mid"), "block_id")
    b = blocks.withColumn("mid", F.col("y") + F.col("h") / 2)
    b = b.withColumn("step", F.abs(F.col("mid") - F.lag("mid").over(down)) - band_tolerance * F.greatest("h", F.lag("h").over(down)))
    b = b.withColumn("band", F.sum((F.coalesce(F.round("step", 9), F.lit(0.0)) > 0).cast("long")).over(down))
    across = Window.partitionBy("capture_id", "band").orderBy("x", "block_id")
    b = b.withColumn("left_end", F.lag(F.col("x") + F.col("w")).over(across))
    b = b.withColumns({"gap": F.round(F.col("x") - F.col("left_end"), 9), "centre": F.round((F.col("left_end") + F.col("x")) / 2, 9)})
    # the widest gap of each band, seen once; all in one pass over a page's rows
    widest = F.row_number().over(Window.partitionBy("capture_id", "band").orderBy(F.desc_nulls_last("gap"), "x", F.desc("centre")))
    b = b.withColumn("centre", F.when((widest == 1) & (F.col("gap") > least_gap), F.col("centre")))
    middle = F.round(F.sum(F.col("centre").cast("decimal(18,9)")).over(w).cast("double") / F.count("centre").over(w), 9)
    b = b.withColumns({"bands": F.count("centre").over(w), "boundary": middle, "low": F.min("centre").over(w), "high": F.max("centre").over(w)})
    columns = (F.col("bands") >= 2) & (F.round(F.greatest(F.col("high") - F.col("boundary"), F.col("boundary") - F.col("low")), 9) < spread)
    b = b.withColumn("boundary", F.when(columns, F.col("boundary")))
    at = lambda v: F.round(v, 9)  # noqa: E731  a block that ends at the boundary does not cross it
    part = F.when(F.col("boundary").isNull(), F.lit(0)).when((at(F.col("x")) < F.col("boundary")) & (at(F.col("x") + F.col("w")) > F.col("boundary")), 0).when(at(F.col("x") + F.col("w") / 2) < F.col("boundary"), 1).otherwise(2)
    plain = F.col("boundary").isNull()
    order = w.orderBy(part, F.when(plain, F.col("band")), F.when(plain, F.col("x")), F.when(~plain, -F.col("mid")), "block_id")
    b = b.withColumns({"reading_pos": (F.row_number().over(order) - 1).cast("long"), "section": part})
    return b.select(*blocks.columns, "reading_pos", *(["section"] if sections else []))


def joined_text(df: DataFrame, keys: list[str], position: str, text: str = "text", separator: str = "\n") -> DataFrame:
    """The texts of each key in the order of a position column, joined by a separator."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(text).alias("t"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: r["t"]), separator).alias("full_text"), F.count("*").alias("blocks"))


def formatted_text(blocks: DataFrame, paragraph: float = 1.5, indent: float = 0.02) -> DataFrame:
    """``capture_id, formatted_text, blocks``: the texts in reading order, with the page's structure kept.

    An empty line stands between two texts where the gap from one down to the next is larger than ``paragraph``
    times the taller of them, and where a column ends, so columns are sections of their own. A text that starts
    to the right of its section's left edge is indented by two spaces for each ``indent`` of the page's width.
    """
    b = reading_order(blocks, sections=True)
    w = Window.partitionBy("capture_id").orderBy("reading_pos")
    left = F.min("x").over(Window.partitionBy("capture_id", "section"))
    gap = F.round(F.lag("y").over(w) - F.col("y") - F.col("h"), 9)
    apart = (F.lag("section").over(w) != F.col("section")) | (gap > F.round(paragraph * F.greatest("h", F.lag("h").over(w)), 9))
    line_end = F.when(F.lag("section").over(w).isNull(), "").when(apart, "\n\n").otherwise("\n")
    steps = F.floor(F.round((F.col("x") - left) / indent, 6) + 0.5).cast("int")
    b = b.withColumn("piece", F.concat(line_end, F.repeat(F.lit("  "), steps), "text"))
    return joined_text(b, ["capture_id"], "reading_pos", "piece", "").withColumnRenamed("full_text", "formatted_text")


def words(line: Column) -> Column:
    """The words of a line, split at single spaces."""
    return F.filter(F.split(line, " ", -1), lambda w: w != "")


def line_words(blocks: DataFrame) -> DataFrame:
    """A row a word, placed by its first occurrence in the line (a repeated word gets the first one's place)."""
    placed = blocks.select("*", F.posexplode(words(F.col("text"))).alias("word_no", "word"))
    at = F.instr(F.col("text"), F.col("word")) - 1
    n = F.char_length("text")
    places = lambda v: F.round(v + 1e-9, 6)  # noqa: E731  half-way values that are a hair off go up too
    return placed.select("capture_id", "block_id", F.col("word_no").cast("long").alias("word_no"), "word", places(F.col("x") + F.col("w") * at / n).alias("x"), "y", places(F.col("w") * F.char_length("word") / n).alias("w"), "h")


def merged_intervals(df: DataFrame, keys: list[str], low: str = "low", high: str = "high") -> DataFrame:
    """Overlapping or touching intervals of each key as one."""
    w = Window.partitionBy(*keys).orderBy(low, high)
    d = df.withColumn("reach", F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    d = d.withColumn("part", F.sum((F.col("reach").isNull() | (F.col(low) > F.col("reach"))).cast("long")).over(w))
    return d.groupBy(*keys, "part").agg(F.min(low).alias(low), F.max(high).alias(high)).drop("part")


def text_gaps(captures: DataFrame, blocks: DataFrame, least: float = 0.05) -> DataFrame:
    """``capture_id, y, h``: the full-width stretches without text, from the bottom up.

    The gap below the first text must be larger than ``least``, those between and above at least as large. A
    capture without text is one gap.
    """
    spans = merged_intervals(blocks.select("capture_id", F.round("y", 9).alias("low"), F.round(F.col("y") + F.col("h"), 9).alias("high")), ["capture_id"])
    w = Window.partitionBy("capture_id").orderBy("low")
    spans = spans.withColumns({"next": F.lead("low").over(w), "nth": F.row_number().over(w)})
    size = lambda a, b: F.round(b - a, 9)
    first = spans.where((F.col("nth") == 1) & (size(F.lit(0.0), F.col("low")) > least)).select("capture_id", F.lit(0.0).alias("y"), F.col("low").alias("h"))
    end = F.coalesce("next", F.lit(1.0))
    later = spans.where(size(F.col("high"), end) >= least).select("capture_id", F.col("high").alias("y"), size(F.col("high"), end).alias("h"))
    bare = captures.join(blocks, "capture_id", "left_anti").select("capture_id", F.lit(0.0).alias("y"), F.lit(1.0).alias("h"))
    return first.unionByName(later).unionByName(bare)
