"""Scrolling captures: frames that overlap are laid end to end as one long image.

``rows``: capture_id, frame, py (from the top of the frame), row (the pixels of that row, any comparable type).
Image rows are the unit that moves, so no task ever holds a frame, and a capture may have any number of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PRIME, BASES = (1 << 31) - 1, (1_000_003, 48_271)  # products of two residues fit a long


def _power(base: int, n: Column, bits: int = 20) -> Column:
    """``base`` ** ``n`` modulo ``PRIME`` for n < 2**bits."""
    steps = F.array(*(F.struct(F.lit(1 << k).cast("long").alias("bit"), F.lit(pow(base, 1 << k, PRIME)).cast("long").alias("f")) for k in range(bits)))
    return F.aggregate(steps, F.lit(1).cast("long"), lambda acc, s: F.when(n.bitwiseAND(s["bit"]) > 0, F.pmod(acc * s["f"], F.lit(PRIME))).otherwise(acc))


def overlaps(rows: DataFrame, least: int = 8) -> DataFrame:
    """``capture_id, frame, height, overlap``: how many of a frame's first rows are the last rows of the frame before.

    The overlap is the largest of at least ``least`` rows that agree pixel by pixel, 0 if there is none and for
    the first frame. Every frame has polynomial hashes of all its beginnings and ends, from one running sum
    each: the end that starts at row d has the hash of an equal beginning times the base to the d. Beginnings
    and ends of one length meet in an equi join, a row each, so frames of repeated or empty rows cost no more
    than others; the winner's rows are then compared themselves.
    """
    key = ["capture_id", "frame"]
    run = Window.partitionBy(*key).orderBy("py").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*key)
    d = rows.select(*key, F.col("py").cast("long").alias("py"), *(F.pmod(F.xxhash64("row", F.lit(k)), F.lit(PRIME)).alias(f"h{k}") for k in range(len(BASES))))
    for k, base in enumerate(BASES):
        power = _power(base, F.col("py"))
        d = d.withColumns({f"p{k}": power, f"t{k}": F.pmod(F.col(f"h{k}") * power, F.lit(PRIME))})
    sums = {f"{n}{k}": F.sum(f"t{k}").over(w) for k in range(len(BASES)) for n, w in (("s", run), ("all", whole))}
    d = d.withColumns({"height": F.count("*").over(whole), **sums})
    frames = d.where("py = 0").select(*key, "height")
    before = Window.partitionBy("capture_id").orderBy("frame")
    pairs = frames.withColumn("next", F.lead("frame").over(before)).where("next IS NOT NULL").select(*key, "next")
    ends = d.join(pairs, key).select("capture_id", F.col("next").alias("frame"), (F.col("height") - F.col("py")).alias("overlap"), *(F.col(f"p{k}").alias(f"shift{k}") for k in range(len(BASES))), *(F.pmod(F.col(f"all{k}") - F.col(f"s{k}") + F.col(f"t{k}"), F.lit(PRIME)).alias(f"end{k}") for k in range(len(BASES))))
    starts = d.select(*key, (F.col("py") + 1).alias("overlap"), *(F.pmod(F.col(f"s{k}"), F.lit(PRIME)).alias(f"start{k}") for k in range(len(BASES))))
    same = F.lit(True)
    for k in range(len(BASES)):
        same = same & (F.pmod(F.col(f"start{k}") * F.col(f"shift{k}"), F.lit(PRIME)) == F.col(f"end{k}"))
    best = starts.join(ends, [*key, "overlap"]).where(same & (F.col("overlap") >= least)).groupBy(*key).agg(F.max("overlap").alias("overlap"))
    heights = frames.withColumn("before", F.lag("frame").over(before)).withColumn("above", F.lag("height").over(before))
    best = best.join(heights.select(*key, "before", "above"), key)
    mine = rows.join(best, key).where("py < overlap").select(*key, "overlap", F.col("py").cast("long").alias("at"), F.col("row").alias("mine"))
    theirs = best.select("capture_id", "frame", F.col("before"), (F.col("above") - F.col("overlap")).alias("from"))
    theirs = rows.withColumnRenamed("frame", "before").join(theirs, ["capture_id", "before"]).where("py >= `from`").select(*key, (F.col("py") - F.col("from")).cast("long").alias("at"), F.col("row").alias("theirs"))
    agree = mine.join(theirs, [*key, "at"]).groupBy(*key, "overlap").agg(F.count_if(F.col("mine") == F.col("theirs")).alias("n")).where("n = overlap")
    return frames.join(agree.select(*key, "overlap"), key, "left").withColumn("overlap", F.coalesce("overlap", F.lit(0)).cast("long"))


def placed(found: DataFrame) -> DataFrame:
    """``capture_id, frame, top, bottom, fresh``: where each frame of ``overlaps`` lies; rows from ``fresh`` on are new."""
    w = Window.partitionBy("capture_id").orderBy("frame")
    up_to = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = found.withColumn("down", F.coalesce(F.lag("height").over(w), F.lit(0)) - F.col("overlap"))
    d = d.withColumn("top", F.sum("down").over(up_to)).withColumn("bottom", F.col("top") + F.col("height"))
    done = F.coalesce(F.max("bottom").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d.select("capture_id", "frame", "top", "bottom", F.greatest(F.lit(0), done - F.col("top")).alias("fresh"))


def stitched(rows: DataFrame, least: int = 8) -> DataFrame:
    """``capture_id, py, frame, row``: the long image of each capture, row by row, and the frame that a row is from.

    Rows that a frame shares with those before it come once; a frame that repeats the one before adds nothing;
    a frame without an overlap follows below the last row. A capture that was stopped gives what its frames
    hold. Frame numbers need not be dense. Null rows equal each other in the hashes but verify nothing, so an
    overlap never rests on them.
    """
    at = placed(overlaps(rows, least))
    d = rows.join(at, ["capture_id", "frame"]).where("py >= fresh")
    return d.select("capture_id", (F.col("top") + F.col("py")).cast("long").alias("py"), "frame", "row")
