"""States of captures and overlays, folded from events: the same functions on a table and on a stream.

Both are plain aggregations, so Structured Streaming keeps one small state row a key, whatever the order in
which events arrive; ``sink`` writes them in update mode.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

# The state in which each operation leaves a capture.
STATES = {"select": "capturing", "add": "captured", "move": "analyzing", "resize": "analyzing", "toggle": "analyzed", "delete": "error"}


def capture_states(events: DataFrame) -> DataFrame:
    """``capture_id, state, seq``: the state after the last event of each capture; unknown operations are idle."""
    named = F.create_map(*(F.lit(x) for kv in STATES.items() for x in kv))[F.col("op")]
    last = events.groupBy("capture_id").agg(F.max(F.struct("seq", F.coalesce(named, F.lit("idle")).alias("state"))).alias("m"))
    return last.select("capture_id", F.col("m.state").alias("state"), F.col("m.seq").alias("seq"))


def overlay_states(events: DataFrame) -> DataFrame:
    """``capture_id, overlay_id, is_excluded, edits, last_seq``."""
    toggles = F.count_if(F.col("op") == "toggle")
    return events.groupBy("capture_id", "overlay_id").agg((toggles % 2 == 1).alias("is_excluded"), F.count("*").alias("edits"), F.max("seq").alias("last_seq"))


def edits_by_window(events: DataFrame, late: str = "10 minutes", every: str = "1 hour") -> DataFrame:
    """Edits by operation and time window; events later than ``late`` behind the newest are left out of a stream."""
    seen = events.withWatermark("ts", late) if events.isStreaming else events
    return seen.groupBy(F.window("ts", every).alias("w"), "op").agg(F.count("*").alias("edits")).select(F.col("w.start").alias("from_ts"), "op", "edits")


def progress(frames: DataFrame) -> DataFrame:
    """How far each scrolling capture is: null while the total is unknown or zero."""
    return frames.groupBy("capture_id").agg(F.max("frame").alias("frames"), F.max("estimated_total").alias("total")).withColumn("ratio", F.when(F.col("total") > 0, F.col("frames") / F.when(F.col("total") > 0, F.col("total"))))


def sink(states: DataFrame, name: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Run a stream into an in-memory table until what is there now is through."""
    return states.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
