"""Codes of vectors from small codebooks, with VA-file filtering (operator 12).

A vector's components become integers and are cut into equal consecutive parts; each part position has a
codebook of ``ENTRIES`` integer vectors, learnt by rounds of assignment and integer means over all vectors,
and a vector's code names the nearest entry of each part.

The nearest entry is found as in a VA-file: the entries' coordinates are cut into 2**``BITS`` cells each,
and only the cells are kept. For each part that asks, lookup tables hold the least and the greatest squared
distance to every cell of every coordinate; their sums bound the distance to each entry from below and above.
Only entries whose lower bound is not above the least upper bound are refined with exact integer distances,
so the result is that of a full search.

A round is one pass over the written integer vectors: tasks give sums of parts by entry, Spark adds them, and
only the codebooks (parts x entries x positions) pass the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import Scratch, slices

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
BITS = 3
LARGEST = 1 << 25  # of an integer component, so that no squared distance leaves 64 bits


class CellFilter:
    """The VA-file of one codebook: ``entries`` (entry x position) as cells, with the entries to refine on."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        low, cells = entries.min(axis=0), 1 << bits
        width = -(-(entries.max(axis=0) - low + 1) // cells)
        cell = (entries - low) // width
        self.first = low + np.arange(cells)[:, None] * width  # cell x position
        self.last = self.first + width - 1
        self.entries, self.at = entries, (cell * entries.shape[1] + np.arange(entries.shape[1])).ravel()

    def bounds(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distances of parts (part x position) to all entries."""
        below, above = self.first - asked[:, None, :], asked[:, None, :] - self.last
        least = np.maximum(np.maximum(below, above), 0)
        most = np.maximum(np.abs(below), np.abs(above))  # of the two ends; one of them is the farthest point
        shape = (len(asked), *self.entries.shape)
        return tuple((t * t).reshape(len(asked), -1).take(self.at, axis=1).reshape(shape).sum(axis=2) for t in (least, most))

    def nearest(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each part, the lowest of equally near ones, and the squared distance."""
        lower, upper = self.bounds(asked)
        row, entry = np.nonzero(lower <= upper.min(axis=1, keepdims=True))
        gap = asked[row] - self.entries[entry]
        exact = np.full(lower.shape, np.iinfo(np.int64).max)
        exact[row, entry] = (gap * gap).sum(axis=1)
        best = exact.argmin(axis=1)
        return best, exact[np.arange(len(best)), best]


def _parts(batch: pa.RecordBatch, at: int, dim: int) -> np.ndarray:
    """Vectors of a batch as part x row x position."""
    return batch.column(at).flatten().to_numpy().reshape(-1, PARTS, dim // PARTS).transpose(1, 0, 2)


def _sums(books: list[np.ndarray], dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = [CellFilter(b) for b in books]
        count, total = np.zeros((PARTS, len(books[0])), np.int64), np.zeros((PARTS, *books[0].shape), np.int64)
        for batch in slices(batches, 2048):
            for p, (asked, f) in enumerate(zip(_parts(batch, 0, dim), filters, strict=True)):
                best, _ = f.nearest(asked)
                count[p] += np.bincount(best, minlength=count.shape[1])
                np.add.at(total[p], best, asked)
        p, e = np.nonzero(count)
        cols = [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, ["part", "entry", "n", "total"])

    return run


def _codes(books: list[np.ndarray], dim: int, kept: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = [CellFilter(b) for b in books]
        for batch in slices(batches, 2048):
            best, gap = zip(*(f.nearest(a) for a, f in zip(_parts(batch, kept, dim), filters, strict=True)), strict=True)
            code = [x.tobytes().hex() for x in np.stack(best, axis=1).astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(code, pa.string()), pa.array(sum(gap), pa.int64())], [*batch.schema.names[:kept], "code", "error"])

    return run


def _usable(v: Column) -> Column:
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & (F.size(v) % PARTS == 0) & ~odd


def _integers(v: Column) -> Column:
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    too_large = F.exists(whole, lambda x: (x >= LARGEST) | (x <= -LARGEST))
    return F.when(too_large, F.raise_error(F.lit(f"a component of {LARGEST // SCALE} or more has no exact code"))).otherwise(whole)


def compress(vectors: DataFrame, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """The code of every vector: ``vec_id, code, error, label_error, codebooks_sha256``.

    Each component x becomes floor(4096 * x). Codebooks start as the parts of the 16 rows with the smallest ids
    (all, if fewer; null ids last, rows of one id in the order of their integers); a round assigns every part
    to its nearest entry (ties to the lower index) and replaces each entry by the floor of its parts' means;
    entries without parts stay. ``code`` has two hexadecimal digits for each part's entry after the last round,
    ``error`` is the sum of the squared distances, ``label_error`` its sum over the rows of an equal label
    (nulls together), ``codebooks_sha256`` the hash of the final entries' decimal components, joined by commas,
    by part, entry and position.

    Rows whose vector is null or holds null or non-finite components take no part; nor do vectors of another
    length than that of the smallest kept id, or of a length that is 0 or no multiple of 8. A component of
    8,192 or more is an error, as distances would leave 64 bits. Repeated rows count each. Other columns,
    whatever their names, are not read. A table without a usable vector gives no rows.
    """
    scratch = Scratch(vectors.sparkSession, "codes")
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")).where(_usable(F.col("v")))
    base = scratch.write(base.withColumn("v", _integers(F.col("v"))), "whole")
    order = [F.col("vec_id").asc_nulls_last(), "v"]
    first = base.orderBy(*order).limit(1).collect()
    dim = len(first[0].v) if first else PARTS
    base = base.where(F.size("v") == dim)
    start = np.array([r.v for r in base.orderBy(*order).limit(ENTRIES).collect()], np.int64).reshape(-1, PARTS, dim // PARTS)
    books = [start[:, p] for p in range(PARTS)]
    for _ in range(rounds if first else 0):
        sums = base.select("v").mapInArrow(_sums(books, dim), "part int, entry int, n long, total array<long>")
        sums = sums.select("part", "entry", "n", F.posexplode("total").alias("at", "x")).groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        new = [b.copy() for b in books]
        for r in sums.collect():  # parts x entries x positions at most; a local iterator runs a job for each partition
            new[r.part][r.entry, r.at] = r.x // r.n
        if all((a == b).all() for a, b in zip(new, books, strict=True)):
            break  # further rounds would change nothing
        books = new
    named = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    if not first:
        books = [np.zeros((1, 1), np.int64)] * PARTS
    label = base.schema["label"].dataType.simpleString()
    coded = scratch.write(base.select("vec_id", "label", "v").mapInArrow(_codes(books, dim, 2), f"vec_id long, label {label}, code string, error long"), "coded")
    scratch.keep_only("coded")
    # the rows of one label may be a large part of all: they are dealt over eight keys
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(7))))
    x, y = coded.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(8)).cast("int")).alias("x"), sums.alias("y")
    out = x.join(y, F.col("x.label").eqNullSafe(F.col("y.label")) & (F.col("x.part") == F.col("y.part")))
    return out.select("x.vec_id", "x.code", "x.error", "y.label_error", F.lit(named).alias("codebooks_sha256"))
