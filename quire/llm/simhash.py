"""Near-duplicate documents by SimHash and BK-trees (operator 11).

A text's fingerprint has a bit set where more than half of its shingles' 64-bit hashes have it set. Documents
with equal fingerprints are one class. Two fingerprints that differ in at most ``radius`` bits agree on at
least one of ``radius`` + 1 parts of the bits, so every class goes to one shard for each part, and linked
classes meet in a shard. Shards of more than ``SHARD`` fingerprints are split by the same argument on the bits
that are still free, until about ten are left: no shard holds more than 2**10 fingerprints, and a fingerprint
is in at most 243 shards at radius 2, whatever the data.

Each shard has a BK-tree: a node's children are keyed by their Hamming distance to it. A search at distance d
from a node follows only the edges from d - radius to d + radius. The trees of a task are built and searched
together, level by level in arrays. They travel to the searches of their shard by shuffle and not through the
driver, where fingerprints of all documents would have to meet. A shard returns its links as stars, not as
pairs; stars are joined by distributed union-find.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.shared import Scratch, components, in_slots, slices, slots_of, words_in_parts

WORDS, SEED = 3, 42
SHARD, ROOM = 256, 10  # fingerprints above which a shard is split; free bits below which it is not
VISITS = 1 << 21  # searched tree nodes that a task holds at once, at most


def fingerprint(text: bytes | None, k: int = WORDS) -> int:
    """The fingerprint of a text as an unsigned number; 0 without words. Texts of any length pass in parts."""
    ones, n, last = np.zeros(64, np.int64), 0, []
    for words in words_in_parts((text or b"").lower()):
        words = last + words
        for at in range(0, len(words) - k + 1, 1 << 16):
            window = words[at : at + (1 << 16) + k - 1]
            joined = map(b" ".join, zip(*(window[i:] for i in range(k))))
            h = np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(SEED)), np.uint64, len(window) - k + 1)
            ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            n += len(h)
        last = words[max(0, len(words) - k + 1) :]
    if not n:  # all words there are, if any
        return _majority_of_one(last)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _majority_of_one(words: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(words), SEED) if words else 0


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        marks = np.fromiter(map(fingerprint, batch.column(1).to_pylist()), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks.view(np.int64))], ["doc_id", "mark"])


class BKTrees:
    """BK-trees of several shards in arrays. ``codes`` are distinct inside a shard and stand shard by shard."""

    def __init__(self, codes: np.ndarray, shard: np.ndarray):
        self.codes = codes
        starts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
        self.root = np.repeat(starts, np.diff(np.append(starts, len(codes))))
        above, keys, children = self.root.copy(), [], []
        live = np.flatnonzero(above != np.arange(len(codes)))
        while len(live):
            key = above[live] * 65 + np.bitwise_count(codes[live] ^ codes[above[live]])
            edges, first = np.unique(key, return_index=True)  # the first code on an edge becomes the child there
            keys.append(edges)
            children.append(live[first])
            above[live] = live[first][np.searchsorted(edges, key)]
            live = live[above[live] != live]
        keys, children = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (keys, children))
        order = np.argsort(keys, kind="stable")
        self.keys, self.children = keys[order], children[order]

    def within(self, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of places of codes of one shard that differ in at most ``radius`` bits, each pair once."""
        ask, node, found = np.arange(len(self.codes)), self.root, []
        while len(ask):
            d = np.bitwise_count(self.codes[ask] ^ self.codes[node]).astype(np.int64)
            hit = (d <= radius) & (ask < node)
            found.append((ask[hit], node[hit]))
            lo = np.searchsorted(self.keys, node * 65 + np.maximum(d - radius, 0))
            many = np.searchsorted(self.keys, node * 65 + np.minimum(d + radius, 64), "right") - lo
            step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            ask, node = np.repeat(ask, many), self.children[np.repeat(lo, many) + step]
        a, b = zip(*found, strict=True)
        return np.concatenate(a), np.concatenate(b)


def stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` places the smallest place that it reaches over the pairs."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _links(radius: int):
    """Rows (shard, mark), sorted, as a stream to links (a, b); the last shard of a batch waits for the next."""

    def of(shard: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
        low = stars(len(codes), *BKTrees(codes, shard).within(radius))
        linked = np.flatnonzero(low != np.arange(len(codes)))
        return pa.RecordBatch.from_arrays([pa.array(codes[x].view(np.int64)) for x in (low[linked], linked)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, codes = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            shard = np.append(shard, batch.column(0).to_numpy())
            codes = np.append(codes, batch.column(1).to_numpy().view(np.uint64))
            starts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else np.empty(0, np.int64)
            if len(starts) < 2:
                continue
            work = np.cumsum(np.diff(starts) ** 2)  # of every shard but the last
            while len(work):
                n = max(1, int(np.searchsorted(work, VISITS, "right")))
                yield of(shard[starts[0] : starts[n]], codes[starts[0] : starts[n]])
                starts, work = starts[n:], work[n:] - work[n - 1]
            shard, codes = shard[starts[0] :], codes[starts[0] :]
        if len(shard):
            yield of(shard, codes)

    return run


def bit_splits(radius: int) -> list[tuple[int, int, bool]]:
    """How shards are split: rows (mask, finer mask, last) of bits on which a shard's fingerprints agree, from no bits on.

    A mask's free bits are cut into ``radius`` + 1 runs, and each finer mask has one of them more; the last
    ones leave too few bits free for a large shard.
    """
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    out, todo = [], [0]
    while todo:
        mask = todo.pop()
        free = [b for b in range(64) if not mask >> b & 1]
        for run in np.array_split(free, radius + 1):
            finer, last = mask | sum(1 << int(b) for b in run), len(free) - len(run) <= max(ROOM, radius)
            out.append((signed(mask), signed(finer), last))
            todo += [] if last else [finer]
    return out


def _choose(shared, large, split: bool):
    """Rows (mark, mask, last, hash) of shards that hold two or more, either those to be split or the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last, h = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy()
            yield batch.filter(pa.array(in_slots(shared.value, h) & ((in_slots(large.value, h) & ~last) == split)))

    return run


def tree_links(spark: SparkSession, scratch: Scratch, marks: DataFrame, radius: int) -> DataFrame:
    """``a, b``: links between the distinct fingerprints of ``marks(mark)`` that join all within ``radius`` of each other.

    Shard sizes are counted before anything is gathered. Bitmaps of the shards that hold two or more, and of
    those to be split, are broadcast (2 MB each). A shard that shares its bit with one to be split is split
    too, and one that shares its bit with a shard of two passes alone; neither changes a link.
    """
    kind = "mark long, mask long, last boolean, hash long"
    splits = F.broadcast(spark.createDataFrame(bit_splits(radius), "mask long, finer long, last boolean"))  # 363 rows at radius 2
    first = F.array(*(F.struct(F.lit(f).alias("mask"), F.lit(last).alias("last")) for m, f, last in bit_splits(radius) if m == 0))
    rows, found = marks.select("mark", F.inline(first)), None
    level, more = 0, True
    while more:
        rows = rows.withColumn("hash", F.xxhash64("mask", F.col("mark").bitwiseAND(F.col("mask"))))
        sizes = scratch.write(rows.groupBy("hash").agg(F.count("*").alias("n"), F.first("last").alias("last")).where("n > 1"), f"sizes-{level}")
        large = sizes.where(~F.col("last") & (F.col("n") > SHARD)).select("hash")
        shared, wide = (spark.sparkContext.broadcast(slots_of(x)) for x in (sizes.select("hash"), large))
        dealt = rows.mapInArrow(_choose(shared, wide, False), kind).select("hash", "mark").repartition("hash").sortWithinPartitions("hash", "mark")
        links = scratch.write(dealt.mapInArrow(_links(radius), "a long, b long"), f"links-{level}")
        found = links if found is None else found.union(links)
        more = not large.isEmpty()
        if more:
            split = scratch.write(rows.mapInArrow(_choose(shared, wide, True), kind).select("mark", "mask"), f"split-{level}")
            rows = split.join(splits, "mask").select("mark", F.col("finer").alias("mask"), "last")
        level += 1
    return found


def near_copies(docs: DataFrame, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Component of every document: ``doc_id, fingerprint, component_id, kept``.

    Fingerprints of 3-word shingles, repeats included (A-Z lower-cased, words split at ASCII white space), are
    linked where they differ in at most ``radius`` bits; ``component_id`` is the smallest id reachable over
    links, ``kept`` marks the rows whose id that is. Texts with fewer than three words have the whole sequence
    as their one shingle; null, empty and blank texts have the fingerprint zero and are linked like any other.
    Rows that repeat an id are judged by their own text each. Rows with a null id link nothing and are kept;
    their component is that of the rows with their fingerprint, or null. Other columns, whatever their names,
    are not read. Texts are read whole. An empty table gives no rows.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "simhash")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    marks = scratch.write(base.mapInArrow(_fingerprints, "doc_id long, mark long"), "marks")
    classes = scratch.write(marks.where("doc_id IS NOT NULL").groupBy("mark").agg(F.min("doc_id").alias("rep")), "classes")
    comp = components(scratch, tree_links(spark, scratch, classes.select("mark"), radius))
    member = comp.select(F.col("node").alias("mark"), "component").union(comp.select("component", "component").distinct())
    member = scratch.write(member.join(classes, "mark"), "member")
    least = member.groupBy("component").agg(F.min("rep").alias("least"))
    named = member.join(least, "component").select("mark", "least")
    named = scratch.write(classes.join(named, "mark", "left").select("mark", F.coalesce("least", "rep").alias("component_id")), "named")
    scratch.keep_only("marks", "named")
    # copies of one text may be a large part of all rows: they are dealt over eight keys
    part = F.pmod(F.xxhash64("doc_id"), F.lit(8)).cast("int")
    eight = named.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(7))))
    out = marks.withColumn("part", part).join(eight, ["mark", "part"], "left")
    out = out.select("doc_id", F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"), "component_id")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
