"""Work on one capture at a time: small Python helpers over the rows of a page, spread by Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.pandas.types import to_arrow_schema


#: Results are handed on when they are this many, however many captures an Arrow batch has.
ROWS = 50_000


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def per_capture(df: DataFrame, order: list[str], columns: list[str], kernel: Callable[[list[dict]], list[tuple]], schema: str, key: str = "capture_id") -> DataFrame:
    """``kernel(rows)`` for the rows of each capture, sorted by ``order``; it returns tuples for ``schema``.

    A capture is one page, so its rows fit in a task; many captures go through one Arrow batch. The key is put
    before the tuples. Far faster than a Python call for each small group.
    """
    fields = list(dict.fromkeys([*order, *columns]))
    grouped = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("rows"))
    out = StructType([df.schema[key], *StructType.fromDDL(schema).fields])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, k in enumerate(batch.column(0).to_pylist()):  # the rows of one capture at a time become Python objects
                rows += [(k, *found) for found in kernel(batch.column(1)[i].as_py())]
                if len(rows) >= ROWS:
                    yield _batch(rows, arrow)
                    rows = []
            yield _batch(rows, arrow)

    return grouped.mapInArrow(run, out)


def per_capture_arrays(df: DataFrame, order: list[str], columns: list[str], kernel: Callable[[dict[str, np.ndarray]], list[tuple]], schema: str, key: str = "capture_id") -> DataFrame:
    """As ``per_capture`` for numbers without nulls: ``kernel`` gets an array a column, so no row becomes a Python object."""
    fields = list(dict.fromkeys([*order, *columns]))
    grouped = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("rows"))
    out = StructType([df.schema[key], *StructType.fromDDL(schema).fields])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, rows = batch.column(1), []
            whole = {f: np.asarray(lists.values.field(i)) for i, f in enumerate(fields)}
            for k, a, b in zip(batch.column(0).to_pylist(), np.asarray(lists.offsets), np.asarray(lists.offsets)[1:]):
                rows += [(k, *found) for found in kernel({f: v[a:b] for f, v in whole.items()})]
                if len(rows) >= ROWS:
                    yield _batch(rows, arrow)
                    rows = []
            yield _batch(rows, arrow)

    return grouped.mapInArrow(run, out)


def per_capture_values(df: DataFrame, order: str, columns: list[str], kernel: Callable[[dict[str, np.ndarray]], np.ndarray], name: str, schema: str, extra: Callable[[Column], dict[str, Column]] | None = None, key: str = "capture_id") -> DataFrame:
    """``df`` with a column ``name`` that ``kernel`` gives for the rows of each capture, sorted by ``order``.

    The kernel gets an array a column and, as one number each, what ``extra`` computes from the capture's rows.
    Rows go in and out as they are, so nothing is joined back.
    """
    fields = [order, *(c for c in df.columns if c not in (key, order))]
    grouped = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("rows"))
    more = extra(F.col("rows")) if extra else {}
    grouped = grouped.select(key, "rows", *(c.alias(n) for n, c in more.items()))
    out = grouped.select(key, "rows").withColumn("values", F.array().cast(f"array<{schema}>")).schema
    value_type, singles = to_arrow_schema(out).field("values").type.value_type, list(more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, found = batch.column(1), []
            whole = {f: np.asarray(lists.values.field(fields.index(f))) for f in columns}
            single = {n: batch.column(2 + i).to_pylist() for i, n in enumerate(singles)}
            ends = np.asarray(lists.offsets)
            for i, (a, b) in enumerate(zip(ends, ends[1:])):
                found.append(kernel({f: v[a:b] for f, v in whole.items()} | {n: v[i] for n, v in single.items()}))
            values = pa.array(np.concatenate(found) if found else [], value_type)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.ListArray.from_arrays(lists.offsets, values)], [key, "rows", "values"])

    rows = grouped.mapInArrow(run, out).select(key, F.explode(F.arrays_zip("rows", "values")).alias("r"))
    return rows.select(*(F.col(key) if c == key else F.col(f"r.rows.{c}") for c in df.columns), F.col("r.values").alias(name))


class Sets:
    """Disjoint sets of 0..n-1 with path halving; the root is the smallest member."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, a: int) -> int:
        while self.parent[a] != a:
            self.parent[a] = self.parent[self.parent[a]]
            a = self.parent[a]
        return a

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)


def flow_lines(words: DataFrame, text: str, order: str, width: float, unit: float, gap: float) -> DataFrame:
    """Words set in lines: a word that would pass ``width`` starts the next line unless it is the first of its line."""

    def kernel(c: dict[str, np.ndarray]) -> list[tuple]:
        x, line, out = 0.0, 0, []
        for at, n in zip(c["at"].tolist(), c["n"].tolist()):
            size = unit * n
            if x > 0 and x + size > width:
                x, line = 0.0, line + 1
            out.append((at, line, x))
            x += size + gap
        return out

    sized = words.select("capture_id", F.col(order).cast("long").alias("at"), F.char_length(text).alias("n"))  # the texts themselves stay behind
    return per_capture_arrays(sized, ["at", "n"], [], kernel, f"{order} long, line_no long, x double")
