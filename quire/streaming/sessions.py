"""Edit sessions: the overlays and the state of each capture, kept by key while events come in.

Clamped moves depend on their order, so no aggregation can fold them. ``replayed`` folds a table of events;
``edited`` does the same on a stream with ``transformWithState``: a head and one entry an overlay are kept for
each capture, and an event-time timer moves a capture that stays busy for too long to error. Both apply
``Page``, one event at a time in the order of ``seq``.

``events``: capture_id, overlay_id, seq, op, ts, dx, dy, x, y, w, h. Operations: place (puts an overlay at
x, y, w, h, top-left), move and resize (by dx, dy, clamped to the page), select, add, toggle, delete (of the
overlay that is selected). An event with a ``seq`` that is not above the last one of its capture was seen
before and changes nothing, so a source may repeat events.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from quire.operators.captures import per_capture
from quire.streaming.folds import STATES

BUSY = ("capturing", "analyzing")
FIELDS = ["overlay_id", "op", "ts", "dx", "dy", "x", "y", "w", "h"]
ROW = "overlay_id long, x double, y double, w double, h double, is_excluded boolean, is_deleted boolean, is_selected boolean, state string, seq long, edits long"
HEAD = "state string, selected long, seq long, edits long, ms long"
ENTRY = "x double, y double, w double, h double, is_excluded boolean, is_deleted boolean"


@dataclass
class Page:
    """One capture: its state, the overlay that is selected, and its overlays as [x, y, w, h, excluded, deleted]."""

    state: str = "idle"
    selected: int | None = None
    seq: int | None = None
    edits: int = 0
    ms: int = 0
    overlays: dict[int, list] = field(default_factory=dict)

    def apply(self, seq: int, overlay_id: int, op: str, ms: int, dx: float, dy: float, *box: float) -> bool:
        """Apply an event; whether it was new."""
        if self.seq is not None and seq <= self.seq:
            return False
        self.seq, self.edits, self.ms = seq, self.edits + 1, max(self.ms, ms)
        self.state = STATES.get(op, self.state if op == "place" else "idle")
        o = self.overlays.get(overlay_id)
        if op == "place":
            self.overlays[overlay_id] = [*box, False, False]
        elif op in ("select", "add"):
            self.selected = overlay_id
        elif op == "delete":
            if self.selected in self.overlays:
                self.overlays[self.selected][5] = True
            self.selected = None
        elif o and not o[5]:
            if op == "toggle":
                o[4] = not o[4]
            elif op in ("move", "resize"):
                x, y, w, h = (v + d for v, d in zip(o[:4], (dx, dy, 0.0, 0.0) if op == "move" else (0.0, 0.0, dx, dy)))
                size = lambda v: max(0.01, min(1.0, v))
                o[:4] = max(0.0, min(1 - w, x)), max(0.0, min(1 - h, y)), size(w), size(h)
        return True

    def stuck(self, now_ms: int, after_ms: int) -> bool:
        return self.state in BUSY and self.ms + after_ms <= now_ms

    def rows(self) -> list[tuple]:
        """A row for the capture itself (no overlay), and one for each overlay."""
        tail = (self.state, self.seq, self.edits)
        out = [(None, None, None, None, None, None, None, None, *tail)]
        for i, (x, y, w, h, excluded, deleted) in sorted(self.overlays.items()):
            out.append((i, *(round(v, 6) for v in (x, y, w, h)), excluded, deleted, i == self.selected, *tail))
        return out


def replayed(events: DataFrame, stuck_after: str = "30 minutes", now: str | None = None) -> DataFrame:
    """``capture_id`` and ``ROW``: each capture and its overlays after all events of a table.

    With ``now`` (a timestamp), captures that were still busy ``stuck_after`` before it are in error. The events
    of one capture pass through one task together: an edit session is made by hand.
    """
    after = int(pd.Timedelta(stuck_after).total_seconds() * 1000)
    limit = int(pd.Timestamp(now, tz="UTC").timestamp() * 1000) if now else None

    def kernel(rows: list[dict]) -> list[tuple]:
        page = Page()
        for r in rows:
            page.apply(r["seq"], r["overlay_id"], r["op"], r["ms"], *(r[k] for k in FIELDS[3:]))
        if limit is not None and page.stuck(limit, after):
            page.state = "error"
        return page.rows()

    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return per_capture(events.withColumn("ms", ms), ["seq"], ["overlay_id", "op", "ms", *FIELDS[3:]], kernel, ROW)


class Session(StatefulProcessor):
    """A capture's page as keyed state, with a timer while it is busy."""

    def __init__(self, after_ms: int):
        self.after_ms = after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", HEAD)
        self.entries = handle.getMapState("overlays", "overlay_id long", ENTRY)

    def _page(self) -> Page:
        page = Page(*self.head.get()) if self.head.exists() else Page()
        page.overlays = {k[0]: list(v) for k, v in self.entries.iterator()}
        return page

    def _keep(self, page: Page) -> None:
        self.head.update((page.state, page.selected, page.seq, page.edits, page.ms))
        for i, o in page.overlays.items():
            self.entries.updateValue((i,), tuple(o))

    def _frame(self, key: tuple, page: Page) -> pd.DataFrame:
        names = [f.split()[0] for f in ROW.split(", ")]
        out = pd.DataFrame(page.rows(), columns=names).astype({"overlay_id": "Int64", "seq": "Int64"})
        out.insert(0, "capture_id", key[0])
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        page, seen = self._page(), pd.concat(list(rows)).sort_values("seq")
        seen["ms"] = seen["ts"].astype("datetime64[ms]").astype("int64")
        new = [page.apply(int(r.seq), int(r.overlay_id), r.op, int(r.ms), *(getattr(r, k) for k in FIELDS[3:])) for r in seen.itertuples()]
        if any(new):
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            if page.state in BUSY:
                # not before the watermark of now, or the timer could not be set
                self.handle.registerTimer(max(page.ms + self.after_ms, timerValues.getCurrentWatermarkInMs() + 1))
            self._keep(page)
            yield self._frame(key, page)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        page = self._page()
        if page.state in BUSY:
            page.state = "error"
            self._keep(page)
            yield self._frame(key, page)

    def close(self) -> None:
        pass


def edited(events: DataFrame, stuck_after: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """The rows of ``replayed`` for each capture whenever events of it arrive or its timer runs out (update mode).

    The last rows of a capture are its state: those with the most ``edits``, in error before busy. Events
    of a capture have to arrive in order from batch to batch; inside a batch they are put in order. Needs the
    RocksDB state store.
    """
    after = int(pd.Timedelta(stuck_after).total_seconds() * 1000)
    seen = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return seen.groupBy("capture_id").transformWithStateInPandas(Session(after), f"capture_id long, {ROW}", "Update", "EventTime")


def latest(updates: DataFrame) -> DataFrame:
    """Of all rows that a stream of ``edited`` has written, the last of each capture and overlay."""
    w = Window.partitionBy("capture_id", "overlay_id").orderBy(F.desc("edits"), F.desc(F.col("state") == "error"))
    return updates.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


class Changes(StatefulProcessor):
    """The last stamp of a report; a row for every poll whose stamp is another."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "stamp long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        polls = pd.concat(list(rows)).sort_values(["ts", "seq"])
        before = polls["stamp"].shift(1)
        if self.last.exists():
            before = before.fillna(self.last.get()[0])
        self.last.update((int(polls["stamp"].iloc[-1]),))
        new = polls[polls["stamp"] != before]
        if len(new):
            yield pd.DataFrame({"report": key[0], "seq": new["seq"].to_numpy(), "stamp": new["stamp"].to_numpy()})

    def close(self) -> None:
        pass


def changed_reports(polls: DataFrame) -> DataFrame:
    """``report, seq, stamp``: of polls (report, seq, stamp, ts) those whose stamp is unlike the one before.

    A stamp that comes back after another is a change again. On a stream the last stamp of each report is
    kept; polls have to arrive in the order of their time from batch to batch.
    """
    if polls.isStreaming:
        return polls.groupBy("report").transformWithStateInPandas(Changes(), "report long, seq long, stamp long", "Append", "None")
    before = F.lag("stamp").over(Window.partitionBy("report").orderBy("ts", "seq"))
    return polls.withColumn("before", before).where("before IS NULL OR stamp <> before").select("report", "seq", "stamp")
