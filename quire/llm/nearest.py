"""Nearest neighbours by collision counting (operator 1).

The vectors lie in blocks of bounded size, spread by hash. In every block each of ``projections`` random
lines has one sorted array of its vectors' projections. A query opens a window around its own projection
in each array; virtual rehashing fits all windows to the search radius, so the arrays are never rebuilt.
Collisions are counted on whichever side of the windows holds less. A vector whose collisions exceed the
threshold is verified with its exact cosine. The radius shrinks to that of the k-th verified neighbour, and
all that collide often enough there are verified; no number of candidates ends a query.

Blocks are searched in waves that double: one block, then two, four and so on. What a query found in earlier
waves bounds its radius in the next, so half of all blocks are searched with at most the radius of the k-th
neighbour in the other half, and windows shrink as the table grows. Queries meet blocks of vectors in blocks
of their own, so a task holds one block of each. A block returns at most k rows a query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.shared import Scratch

WIDTH, FEW = 1.4, 256


class CollisionIndex:
    """Sorted projections of one block of unit vectors."""

    def __init__(self, unit: np.ndarray, projections: int, miss: float = 2.0, seed: int = 11):
        self.lines = np.random.default_rng(seed).standard_normal((projections, unit.shape[1]))
        self.shift = (np.arange(projections) * (4 * np.linalg.norm(self.lines, axis=1).max() + 4))[:, None]
        p = self.lines @ unit.T
        order = np.argsort(p, axis=1, kind="stable")
        self.flat = (np.take_along_axis(p, order, 1) + self.shift).ravel()
        self.order = order.ravel().astype(np.min_scalar_type(len(unit)))  # narrow, as windows are copied
        self.n = unit.shape[0]
        chance = math.erf(WIDTH / math.sqrt(2))  # of a collision on one line at exactly the radius
        self.threshold = projections * chance - miss * math.sqrt(projections * chance * (1 - chance))

    def collisions(self, at: np.ndarray, radius: float) -> np.ndarray:
        """On how many lines each row is in the window around the query's projections ``at``.

        The smaller side is counted: what the windows hold, or what lies outside them.
        """
        reach = WIDTH * radius
        low, high = np.searchsorted(self.flat, at - reach), np.searchsorted(self.flat, at + reach, "right")
        wide = 2 * int((high - low).sum()) > len(self.flat)
        if wide:
            ends = np.arange(len(at) + 1) * self.n
            low, high = np.concatenate((ends[:-1], high)), np.concatenate((low, ends[1:]))
        counts = np.bincount(np.concatenate([self.order[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)]), minlength=self.n)
        return len(at) - counts if wide else counts

    def search(self, query: np.ndarray, verify, k: int, bound: float | None = None) -> tuple[np.ndarray, np.ndarray, bool]:
        """Rows verified, their cosines (by ``verify(rows)``), and whether more rows could be asked for.

        With the cosine ``bound`` every row is verified that collides often enough at its radius. Without one
        the radius shrinks: a few rows bound it, those of them that collide most often bound it further, and
        the rows that collide often enough at the radius of the k-th verified one are verified.
        """
        at, done = self.lines @ query + self.shift[:, 0], np.zeros(self.n, bool)
        rows, cos = np.empty(0, np.int64), np.empty(0)
        few = max(FEW, 2 * k)
        new = np.arange(min(few, self.n)) if bound is None else rows
        for first in (True, False) if bound is None else (False,):
            if len(new):
                done[new] = True
                rows, cos = np.concatenate((rows, new)), np.concatenate((cos, verify(new)))
            near = bound if bound is not None else np.partition(cos, len(cos) - k)[len(cos) - k] if len(rows) >= k else -1.0
            radius = math.sqrt(max(0.0, 2 - 2 * near)) + 1e-9
            counts = self.collisions(at, radius)
            new = np.flatnonzero(((counts >= self.threshold) | (radius >= 2)) & ~done)  # no two unit vectors are farther apart than 2
            if first and len(new) > few:
                new = new[np.argpartition(counts[new], len(new) - few)[len(new) - few :]]
        rows, cos = np.concatenate((rows, new)), np.concatenate((cos, verify(new)))
        return rows, cos, bound is None


def _search_block(k: int, projections: int):
    def run(table: pa.Table) -> pa.Table:
        ids, side, bounds = table["id"].to_numpy(), table["side"].to_numpy(), table["bound"].to_pylist()
        vectors = np.array(table["vector"].combine_chunks().flatten(), np.float64).reshape(len(ids), -1)
        scale = np.linalg.norm(vectors, axis=1)
        index_rows = np.flatnonzero(side == 0)
        data, norms, data_ids = vectors[index_rows], scale[index_rows], ids[index_rows]
        out = [], [], []
        if len(data):
            index = CollisionIndex(data / norms[:, None], projections)
            for i in np.flatnonzero(side == 1):
                q, own = vectors[i], ids[i]

                def verify(rows, q=q, n=scale[i]):
                    return np.clip((data[rows] * q).sum(axis=1) / (norms[rows] * n), -1.0, 1.0)

                # rows of the query's own id, and repeats of an id, may stand among the found: go on until k others are in
                want = k + 1
                while True:
                    rows, cos, more = index.search(q / scale[i], verify, want, bounds[i])
                    rank = np.lexsort((data_ids[rows], -cos))
                    rank = rank[data_ids[rows[rank]] != own]
                    _, first = np.unique(data_ids[rows[rank]], return_index=True)
                    rank = rank[np.sort(first)[:k]]
                    if len(rank) == k or not more or len(rows) == len(data):
                        break
                    want = min(2 * want + len(rows), len(data))
                out[0].append(np.full(len(rank), own))
                out[1].append(data_ids[rows[rank]])
                out[2].append(cos[rank])
        cols = [np.concatenate(x) if x else np.empty(0) for x in out]
        return pa.table({"query_id": cols[0].astype(np.int64), "vec_id": cols[1].astype(np.int64), "score": cols[2].astype(np.float64)})

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, projections: int = 128, block: int = 8192, query_block: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row of ``queries`` its k nearest rows of ``vectors`` by cosine.

    Score is the cosine of the vectors as given, in double precision; ties go to the smaller id; with fewer
    than k candidates all are returned. Rows with a null id or a vector that is null, empty, zero or holds
    null or non-finite parts take no part on either side. A vector meets only those of its own length. Rows
    that repeat an id stand for one item: an item's score is that of its nearest vector, and it is never its
    own neighbour. Empty tables give no rows. Other columns are not read. ``block`` and ``query_block`` bound
    what a task holds: every vector is sent once for each query block, every query once for each block.
    """
    scratch = Scratch(vectors.sparkSession, "nearest")

    def usable(df: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        df = df.select(F.col(id_col).cast("long").alias("id"), v.alias("vector")).where("id IS NOT NULL AND vector IS NOT NULL")
        df = df.where("size(vector) > 0 AND NOT exists(vector, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity')) AND exists(vector, x -> x <> 0)")
        return df.distinct()

    data, asked = usable(vectors), usable(queries)
    blocks, query_blocks = max(1, math.ceil(data.count() / block)), max(1, math.ceil(asked.count() / query_block))
    h = F.xxhash64("id", "vector")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    data = data.withColumn("block", F.pmod(h, F.lit(blocks)).cast("int"))
    asked = asked.withColumn("query_block", F.pmod(h, F.lit(query_blocks)).cast("int"))
    best, first = None, 0
    while first < blocks:
        end = min(2 * first + 1, blocks)
        every = lambda a, b: F.explode(F.sequence(F.lit(a), F.lit(b - 1)))
        left = data.where(f"block >= {first} AND block < {end}").select("id", "vector", F.lit(0).alias("side"), "block", every(0, query_blocks).alias("query_block"), F.lit(None).cast("double").alias("bound"))
        bounded = asked.withColumn("bound", F.lit(None).cast("double"))
        if best is not None:
            kth = best.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("bound"))
            bounded = asked.join(kth, "id", "left")
        right = bounded.select("id", "vector", F.lit(1).alias("side"), every(first, end).alias("block"), "query_block", "bound")
        met = left.unionByName(right).withColumn("length", F.size("vector"))
        found = met.groupBy("length", "block", "query_block").applyInArrow(_search_block(k, projections), "query_id long, vec_id long, score double")
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        best = scratch.write(ranked, f"best-{end}")
        if first:
            scratch.drop(f"best-{first}")
        first = end
    return best


def brute_force(ids: list[int], vectors: list[list[float]], query_ids: list[int], k: int = 5) -> Iterator[tuple[int, int, int, float]]:
    """The exact answer on a small list, for tests and for measuring recall."""
    x = np.asarray(vectors, np.float64)
    n = np.linalg.norm(x, axis=1)
    at = {v: i for i, v in enumerate(ids)}
    for q in query_ids:
        cos = np.clip((x * x[at[q]]).sum(axis=1) / (n * n[at[q]]), -1.0, 1.0)
        order = [i for i in np.lexsort((np.asarray(ids), -cos)) if ids[i] != q][:k]
        yield from ((q, r, ids[i], float(cos[i])) for r, i in enumerate(order, 1))
