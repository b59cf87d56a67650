"""Near-duplicate documents by b-bit MinHash (operator 3).

A document's set holds its distinct k-word shingles as 64-bit hashes. Documents with equal sets are one
class, named by a hash of the set. Each class has 256 minima; four bits of each are packed into a 128-byte
signature, and 24 bands of four whole minima give the buckets in which candidates meet (a pair at similarity
0.8 misses all 24 with probability 3e-6). Candidates pass in two rounds, so that a bucket of near copies
never becomes all its pairs:

1. every member is paired with the smallest member of its bucket and with its neighbour in order;
   pairs whose collision-corrected estimate from bit counts is too low go; the rest are confirmed on the
   full sets, and confirmed links are joined into components;
2. only in buckets that still hold several components, the pairs across components are estimated and
   confirmed (``shared.across``): as rows in buckets of up to 64, block against piece in wider ones. Before
   that, buckets of more than 64 are exchanged for buckets of rare shingles (``shared.narrowed``), which
   loses no link and keeps texts apart that only have a template in common. Pairs inside a component need no
   second look, as the result is the component.

The work so follows the pairs that share a bucket, not the clusters that buckets chain together. The
estimate's cut is 4.5 standard deviations below the threshold, so it only spares exact checks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import Scratch, across, components, first_pairs, in_slots, met, narrowed, slices, slots_of

MINIMA, BITS, BANDS, ROWS = 256, 4, 24, 4
FEW, LEFT, RIGHT = 64, 256, 512
_SALT = np.random.default_rng(20).integers(0, 2**31, (MINIMA, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ODD = np.random.default_rng(21).integers(0, 2**62, 64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def word_shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; A-Z lower-cased, words split at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    k = min(k, len(h))
    s = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        s = (s ^ h[i : len(h) - k + 1 + i]) * _ODD[i]
        s ^= s >> np.uint64(32)
    s.sort()
    return s[np.concatenate(([True], s[1:] != s[:-1]))]


def set_key(shingles: np.ndarray) -> int:
    """The 64-bit name of a set that is not empty."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - 2**63


def minima(shingles: np.ndarray) -> np.ndarray:
    """256 minima of a set under multiplicative orders of its 32-bit hashes; long sets in pieces."""
    x = (shingles >> np.uint64(20)).astype(np.uint32)
    return np.min([(x[i : i + 8192] * _SALT).min(axis=1) for i in range(0, len(x), 8192)], axis=0)


def pack(m: np.ndarray) -> bytes:
    """The low four bits of each minimum, two to a byte."""
    low = (m & np.uint32(15)).astype(np.uint8)
    return (low[0::2] | (low[1::2] << np.uint8(4))).tobytes()


_NIBBLE = np.array([(a & 15 == 0) + (a >> 4 == 0) for a in range(256)], np.uint8)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of packed signatures (uint8 rows): the share of equal four-bit minima less chance collisions."""
    equal = _NIBBLE[a ^ b].sum(axis=-1, dtype=np.int32) / MINIMA
    return (equal - 2.0**-BITS) / (1 - 2.0**-BITS)


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union of two sets (sorted, distinct)."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate((x, y))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def _signatures(text_col: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = {"n": [], "key": [], "bands": [], "sig": []}
            for text in batch.column(text_col).to_pylist():
                s = word_shingles(text, k)
                out["n"].append(len(s))
                out["key"].append(set_key(s) if len(s) else None)
                if not len(s):
                    out["bands"].append(None)
                    out["sig"].append(None)
                    continue
                m = minima(s)
                bands = m[: BANDS * ROWS].reshape(BANDS, ROWS)
                out["bands"].append([xxhash.xxh3_64_intdigest(x.tobytes(), seed=j) - 2**63 for j, x in enumerate(bands)])
                out["sig"].append(pack(m))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:text_col], pa.array(out["n"], pa.int64()), pa.array(out["key"], pa.int64()), pa.array(out["bands"], pa.list_(pa.int64())), pa.array(out["sig"], pa.binary())],
                [*batch.schema.names[:text_col], "n", "key", "bands", "sig"],
            )

    return run


def _sets(k: int, slots):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            batch = batch.filter(pa.array(in_slots(slots.value, batch.column(2).to_numpy())))
            sets = [s for t in batch.column(1).to_pylist() if len(s := word_shingles(t, k))]
            yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "shingles"])

    return run


def _unpacked(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(1)]


def _close(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sa, sb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, MINIMA * BITS // 8) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(estimate(sa, sb) >= threshold)) for c in batch.columns[:2]], ["a", "b"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                keep.append(alike(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    return run


def _across(cut: float, percent: int):
    """Confirmed links between components in one block pair of a bucket: rows of side 0 against rows of side 1.

    A pair whose ends a link has joined meanwhile is skipped, so the links of a block form a forest.
    """

    def run(table: pa.Table) -> pa.Table:
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint8).reshape(table.num_rows, -1)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for chunk in table["shingles"].chunks for x in chunk]
        ids, comp, side = table["id"].to_numpy(), table["comp"].to_numpy().copy(), table["side"].to_numpy()
        right, links = np.flatnonzero(side == 1), []
        for i in np.flatnonzero(side == 0):
            r = right[comp[right] != comp[i]]
            e = estimate(sig[i], sig[r])
            r = r[np.argsort(-e, kind="stable")[: int((e >= cut).sum())]]
            for j in r:
                if comp[i] != comp[j] and alike(sets[i], sets[j], percent):
                    comp[comp == comp[j]] = comp[i]
                    links.append((ids[i], ids[j]))
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Component of every document: ``doc_id, n_shingles, component_id, kept, text_hash``.

    Documents are linked where 100 * intersection >= percent * union of their k-word shingle sets;
    ``component_id`` is the smallest id reachable over links, ``kept`` marks the rows whose id that is.
    Null, empty and blank texts have an empty set (n_shingles 0) and are linked with nothing; texts with
    fewer than k words have the whole sequence as their one shingle. Rows that repeat an id are judged by
    their own text each (``text_hash``, Spark's xxhash64 of it, tells them apart). Rows with a null id link
    nothing and are kept; their component is that of the rows with their set, or null. Sets and shingles are
    named by 64-bit hashes. Other columns, whatever their names, are not read. Texts are read whole. An
    empty table gives no rows.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "near")
    p = percent / 100 + (1 - percent / 100) * 2.0**-BITS
    cut = percent / 100 - 4.5 * (p * (1 - p) / MINIMA) ** 0.5
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    sigs = scratch.write(base.mapInArrow(_signatures(2, k), "doc_id long, text_hash long, n long, key long, bands array<long>, sig binary"), "sigs")
    classes = sigs.where("key IS NOT NULL AND doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("rep"))
    classes = scratch.write(classes, "classes")  # every set and the smallest id that has it
    heads = sigs.where("key IS NOT NULL").join(classes.select("key", F.col("rep").alias("doc_id")), ["key", "doc_id"]).dropDuplicates(["key"])
    heads = scratch.write(heads.select(F.col("key").alias("id"), "doc_id", "bands", "sig"), "heads")
    meeting = scratch.write(met(heads.select("id", F.explode("bands").alias("band"))), "met")
    scratch.sweep()
    heads = scratch.write(heads.select("id", "doc_id", "sig").join(meeting.select("id").distinct(), "id", "left_semi"), "signed")
    scratch.drop("heads")
    slots = spark.sparkContext.broadcast(slots_of(heads.select(F.xxhash64("doc_id").alias("hash"))))
    wanted = base.where("doc_id IS NOT NULL").select("doc_id", "text", F.xxhash64("doc_id").alias("h")).mapInArrow(_sets(k, slots), "id long, shingles binary")
    wanted = wanted.join(heads.select("id"), "id", "left_semi").groupBy("id").agg(F.first("shingles").alias("shingles"))
    sets = scratch.write(wanted, "sets")
    scratch.sweep()

    def confirmed(pairs: DataFrame) -> DataFrame:
        left, right = (sets.select(F.col("id").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
        return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(_confirm(percent), "a long, b long")

    def likely(pairs: DataFrame) -> DataFrame:
        left, right = (heads.select(F.col("id").alias(x), F.col("sig").alias(f"s{x}")) for x in "ab")
        return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(_close(cut), "a long, b long")

    tested = scratch.write(first_pairs(meeting), "pairs-1")
    links = scratch.write(confirmed(likely(tested)), "links-1")
    comp = components(scratch, links, "cc-1")
    narrow, least = narrowed(scratch, meeting, comp, sets.select("id", "shingles"), _unpacked, percent, FEW)
    pairs, blocks = across(narrow, comp, FEW, LEFT, RIGHT, least, scratch)
    more = confirmed(likely(pairs.join(tested, ["a", "b"], "left_anti")))
    wide = blocks.join(heads.select("id", "sig"), "id").join(sets, "id").groupBy("band", "block", "piece").applyInArrow(_across(cut, percent), "a long, b long")
    # the first components as stars, and what joins them
    stars = comp.select(F.col("component").alias("a"), F.col("node").alias("b"))
    links = scratch.write(stars.union(more).union(wide), "links-2")
    comp = components(scratch, links, "cc-2")
    member = comp.select(F.col("node").alias("key"), "component").union(comp.select("component", "component").distinct())
    member = scratch.write(member.join(classes, "key"), "member")
    # written, so that Spark can split the join where a component is very large
    first = scratch.write(member.groupBy("component").agg(F.min("rep").alias("least")), "first")
    least = member.join(first, "component").select("key", "least")
    named = scratch.write(classes.join(least, "key", "left").select("key", F.coalesce("least", "rep").alias("component_id")), "named")
    scratch.keep_only("sigs", "named")
    scratch.sweep()
    row = sigs.select("doc_id", "text_hash", "n", "key")
    out = row.where("key IS NOT NULL").join(named, "key", "left")
    out = out.unionByName(row.where("key IS NULL"), allowMissingColumns=True)  # texts without words meet nothing
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "text_hash")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
