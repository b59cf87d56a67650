"""Intermediate tables in the cluster's shared folder, and connected components on them.

Lineage is cut with Parquet tables below ``spark.checkpoint.dir`` (the folder that the driver and all
executors share), so a lost executor costs a re-read, not a failed job. Where the setting is unset and the
session is local, a temporary folder is used; on a cluster an unset folder is an error.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.sources.files import shared_path

HUB = 256  # neighbours from which on the rows of a node are dealt over eight keys
LEVELS = (8, 64, 512, 4096, 32768)
_BAND = np.random.default_rng(61).integers(0, 2**62, 2).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, bound as a lambda variable so that it is computed once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


class Scratch:
    """A folder of its own below the shared folder for one operator call."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = shared_path(spark, name)

    def write(self, df: DataFrame, table: str, **options) -> DataFrame:
        """Write ``df`` as Parquet and return it as read back; its lineage starts at these files."""
        df.write.options(**{"compression": "zstd", **options}).parquet(f"{self.base}/{table}")
        return self.read(table, df.schema)

    def sweep(self) -> None:
        """Let Spark's cleaner free the shuffle files of what is written by now, after a step that shuffled much."""
        gc.collect()
        self.spark._jvm.System.gc()

    def read(self, table: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.base}/{table}")

    def drop(self, *tables: str) -> None:
        """Delete tables that nothing reads any more."""
        for table in tables:
            path, fs = self._at(f"{self.base}/{table}")
            fs.delete(path, True)

    def keep_only(self, *tables: str) -> None:
        """Delete all other tables of this call."""
        path, fs = self._at(self.base)
        self.drop(*{f.getPath().getName() for f in fs.listStatus(path)}.difference(tables))

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows``, so that a task holds few texts as Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def words_in_parts(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text, split at ASCII white space, in lists of about ``size`` bytes each; no word is cut."""
    open_word = b""
    for at in range(0, len(text), size):
        part = open_word + text[at : at + size]
        words = part.split()
        open_word = words.pop() if at + size < len(text) and not part[-1:].isspace() else b""
        yield words


def slot_words(hashes: DataFrame, name: str, log2: int = 24) -> DataFrame:
    """``word, bits``: the bitmap of ``slots_of`` for the column ``name`` as a table of at most 2**19 rows, see ``kept_slots``."""
    slot = F.pmod(name, F.lit(1 << log2))
    words = hashes.select(F.shiftright(slot, 5).alias("word"), F.expr(f"shiftleft(1L, cast(pmod({name}, {1 << log2}) AS int) & 31)").alias("bit"))
    return words.groupBy("word").agg(F.bit_or("bit").alias("bits"))


def kept_slots(rows: DataFrame, words: DataFrame, name: str, anyway: Column | None = None, log2: int = 24) -> DataFrame:
    """The ``rows`` whose slot is set in ``slot_words``, or that stay ``anyway``; the bitmap is broadcast, 2**19 rows of two numbers at most."""
    word, bit = F.shiftright(F.pmod(name, F.lit(1 << log2)), 5), F.expr(f"shiftright(bits, cast(pmod({name}, {1 << log2}) AS int) & 31) & 1 = 1")
    found = rows.withColumn("word", word).join(F.broadcast(words), "word", "inner" if anyway is None else "left")
    return found.where(bit if anyway is None else bit | anyway).drop("word", "bits")


def slots_of(hashes: DataFrame, log2: int = 24) -> bytearray:
    """A bitmap of 2**``log2`` bits with the slot of every ``hash`` of a table set: 2 MB, however many rows.

    A row whose slot is not set is not among them, so it can be left out before a shuffle; a row whose slot
    is set still has to be joined. Test it with ``in_slots`` in a task.
    """
    slot = F.pmod("hash", F.lit(1 << log2))
    words = hashes.select(F.shiftright(slot, 5).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(hash, {1 << log2}) AS int) & 31)").alias("bit"))
    got = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # 2**19 rows of two numbers at most
    out = np.zeros(1 << (log2 - 5), "<u4")
    out[got["word"].to_numpy()] = got["bits"].to_numpy().astype("<u4")
    return bytearray(out.tobytes())


def in_slots(slots: bytearray, hashes: np.ndarray) -> np.ndarray:
    """Which of the signed 64-bit ``hashes`` have their slot set."""
    bits = np.frombuffer(slots, np.uint8)
    slot = hashes & (len(bits) * 8 - 1)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (band, id), sorted, as a stream: see ``met``. What passes from batch to batch is the last row's run."""
    names = ["band", "id", "low", "before", "nth"]
    band, low, last, nth = None, 0, 0, 0  # the run that is under way: its band, first id, latest id and its number
    for batch in batches:
        b, i = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(b):
            continue
        before_b, before_i = np.append(b[0] if band is None else band, b[:-1]), np.append(i[0] if band is None else last, i[:-1])
        new = b != before_b
        new[0] |= band is None
        fresh = new | (i != before_i)  # repeated rows go
        b, i, before_i, new = b[fresh], i[fresh], before_i[fresh], new[fresh]
        if not len(b):
            continue
        start = np.maximum.accumulate(np.where(new, np.arange(len(b)), -1))
        lows = np.where(start < 0, low, i[start])
        nths = np.where(start < 0, nth + 1 + np.arange(len(b)), np.arange(len(b)) - start)
        show = ~new | np.append(~new[1:], False)  # the first of a run only if a second follows
        cols = [b[show], i[show], lows[show], np.where(new, 0, before_i)[show], nths[show]]
        first = new[show]
        if not new[0] and nth == 0:  # the first row of the run under way was held back
            cols = [np.append(x, y) for x, y in zip((band, last, low, 0, 0), cols, strict=True)]
            first = np.append(True, first)
        band, low, last, nth = b[-1], lows[-1], i[-1], nths[-1]
        arrays = [pa.array(x, pa.int64(), mask=first if n == "before" else None) for n, x in zip(names, cols, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names)


def met(banded: DataFrame) -> DataFrame:
    """``band, id, low, before, nth``: the rows of ``banded(band, id)`` in bands that hold at least two ids.

    ``low`` is the smallest id of the band, ``before`` the next smaller one (null for ``low``), ``nth`` the
    id's number from 0. Bands are sorted by Spark and pass as a stream, so a band of any size needs no room.
    """
    dealt = banded.select("band", "id").repartition("band").sortWithinPartitions("band", "id")
    return dealt.mapInArrow(_meeting, "band long, id long, low long, before long, nth long")


def meeting_rows(banded: DataFrame) -> DataFrame:
    """What ``met`` gives, with SQL functions, for ``banded(band, id)`` without repeated rows.

    Bands of one id go before the rest is sorted; only their smallest and largest id are looked at for that.
    """
    dealt = banded.select("band", "id").repartition("band")
    held = dealt.groupBy("band").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("band", "low")
    rows, order = dealt.join(held.hint("shuffle_hash"), "band"), Window.partitionBy("band").orderBy("id")
    return rows.select("band", "id", "low", F.lag("id").over(order).alias("before"), (F.row_number().over(order) - 1).cast("long").alias("nth"))


def first_pairs(met: DataFrame) -> DataFrame:
    """``a, b``: each id with the smallest of its band and with the next smaller one; linear in the rows of ``met``."""
    star = met.where("id <> low").select(F.col("low").alias("a"), F.col("id").alias("b"))
    chain = met.where("before <> low").select(F.col("before").alias("a"), F.col("id").alias("b"))
    return star.union(chain).distinct()


def _rarest_first(unpack: Callable[[pa.RecordBatch], list[np.ndarray]], slots, percent: int):
    """Rows of sets to ``band, id``: each set's shingles that are not among the frequent ones, then those, as many as can start a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            bands, size = [np.empty(0, np.int64)], []
            for s in unpack(batch):
                s = s.view(np.int64)
                frequent = in_slots(slots.value, s)
                head = len(s) + percent * len(s) // -100 + 1
                bands.append(np.concatenate((s[~frequent], s[frequent]))[:head])
                size.append(len(bands[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(bands)), pa.array(np.repeat(batch.column(0).to_numpy(), size))], ["band", "id"])

    return run


def _counted(unpack: Callable[[pa.RecordBatch], list[np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            h, n = np.unique(np.concatenate([np.empty(0, np.uint64), *unpack(batch)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["hash", "n"])

    return run


def narrowed(scratch: Scratch, meeting: DataFrame, comp: DataFrame, sets: DataFrame, unpack: Callable[[pa.RecordBatch], list[np.ndarray]], percent: int, few: int) -> tuple[DataFrame, int]:
    """``meeting`` with bands of more than ``few`` ids in several components replaced by bands of rare shingles.

    Texts that share a template meet in the same bands without being alike. A set of n shingles that is alike
    another at ``percent`` shares at least ceil(n * percent / 100) of its shingles, so under any one order of
    all shingles the first that both have is among the first n - ceil(n * percent / 100) + 1 of each. The order
    puts shingles last that more than ``few`` components in such bands have, as one set of each shows (told by a
    bitmap of 2 MB; a shingle that only shares a bit with one comes later too, which changes no result). So ids that could be alike
    still meet, and what a template shares brings nobody together while it is less than that share.

    ``sets``: a row a set, ``id`` first; ``unpack`` gives the sets of a batch. Also returns how many ids a band
    needs for ``across`` to look at it.
    """
    wide = meeting.where(F.col("nth") == few).select("band")
    member = meeting.select("band", "id").join(wide, "band", "left_semi").join(comp.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    member = scratch.write(member, "wide")
    several = member.groupBy("band").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("band")
    several = scratch.write(several, "several")
    if several.isEmpty():
        return meeting.join(wide, "band", "left_anti"), 4
    crowd = scratch.write(member.join(several, "band", "left_semi").select("id", "component").distinct(), "crowd")
    held = scratch.write(sets.join(crowd, "id", "left_semi").select(sets.columns), "held")
    heads = crowd.groupBy("component").agg(F.min("id").alias("id"))
    counts = held.join(heads, "id", "left_semi").select(sets.columns).mapInArrow(_counted(unpack), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    slots = scratch.spark.sparkContext.broadcast(slots_of(counts.where(F.col("n") > few).select("hash")))
    rare = met(held.mapInArrow(_rarest_first(unpack, slots, percent), "band long, id long"))
    return scratch.write(meeting.join(wide, "band", "left_anti").union(rare), "narrow"), 2


def levels_of(counts: DataFrame, marks: tuple[int, ...], log2: int = 24) -> list[bytearray]:
    """A bitmap as of ``slots_of`` for each of ``marks``: the slots of hashes of ``counts(hash, n)`` with n above the mark."""
    slot, bit = F.pmod("hash", F.lit(1 << log2)), F.expr(f"shiftleft(1L, cast(pmod(hash, {1 << log2}) AS int) & 31)")
    over = [F.bit_or(F.when(F.col("n") > m, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"m{m}") for m in marks]
    words = counts.where(F.col("n") > marks[0]).select(F.shiftright(slot, 5).alias("word"), bit.alias("bit"), "n")
    got = words.groupBy("word").agg(*over).toArrow()  # 2**19 rows of a few numbers at most
    out = np.zeros((len(marks), 1 << (log2 - 5)), "<u4")
    for row, m in zip(out, marks, strict=True):
        row[got["word"].to_numpy()] = got[f"m{m}"].to_numpy().astype("<u4")
    return [bytearray(row.tobytes()) for row in out]


def _rarest_inside(unpack: Callable[[pa.RecordBatch], list[np.ndarray]], levels, percent: int):
    """Rows of sets, with ``bands`` last, to ``band, id``: every band crossed with each of the shingles that can start a link, rarest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out, size = [np.empty(0, np.uint64)], []
            for s, bands in zip(unpack(batch), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                level = sum((in_slots(x, s.view(np.int64)).astype(np.int8) for x in levels.value), np.zeros(len(s), np.int8))
                head = s[np.argsort(level, kind="stable")][: len(s) + percent * len(s) // -100 + 1]
                keys = (head ^ (head >> np.uint64(31))) * _BAND[0] + np.array(bands, np.int64).view(np.uint64)[:, None] * _BAND[1]
                out.append((keys ^ (keys >> np.uint64(29))).ravel())
                size.append(keys.size)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), size))], ["band", "id"])

    return run


def crowded_bands(scratch: Scratch, meeting: DataFrame, comp: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """``band, id, component`` of bands of more than ``most`` ids, and the bands with more than ``most`` outside their largest component."""
    wide = meeting.where(F.col("nth") == most).select("band")
    member = meeting.select("band", "id").join(wide, "band", "left_semi").join(comp.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    member = scratch.write(member, "wide")
    parts = member.groupBy("band", "component").agg(F.count("*").alias("n")).groupBy("band").agg((F.sum("n") - F.max("n")).alias("outside"))
    return member, scratch.write(parts.where(F.col("outside") > most).select("band"), "crowded")


def exchanged(scratch: Scratch, meeting: DataFrame, comp: DataFrame, sets: DataFrame, unpack: Callable[[pa.RecordBatch], list[np.ndarray]], percent: int, most: int) -> tuple[DataFrame, DataFrame | None]:
    """``meeting`` without its crowded bands, and what stands for these: bands of one crowded band and one rare shingle.

    A band is crowded where more than ``most`` ids are outside its largest component, as texts of one template
    are. Its ids now meet only if they share one of their first n - ceil(n * percent / 100) + 1 shingles too, in an
    order that puts frequent ones last (see ``narrowed``), so no link is lost and no ids meet that did not meet
    before. The order follows the power of eight of a shingle's count over the components in crowded bands, told
    by bitmaps of 2 MB. Bands that are not crowded stay: comparing them is linear in their ids. The second table
    is to be compared from bands of two ids on; it is None where no band is crowded.

    ``sets``: a row a set, ``id`` first; ``unpack`` gives the sets of a batch and may meet one more column, the last.
    """
    member, crowded = crowded_bands(scratch, meeting, comp, most)
    if crowded.isEmpty():
        return meeting, None
    crowd = scratch.write(member.join(crowded, "band", "left_semi").groupBy("id", "component").agg(F.collect_list("band").alias("bands")), "crowd")
    held = scratch.write(sets.join(crowd.select("id", "bands"), "id"), "held")
    heads = crowd.groupBy("component").agg(F.min("id").alias("id"))
    counts = held.join(heads, "id", "left_semi").select(held.columns).mapInArrow(_counted(unpack), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    levels = scratch.spark.sparkContext.broadcast(levels_of(counts, LEVELS))
    rare = scratch.write(met(held.mapInArrow(_rarest_inside(unpack, levels, percent), "band long, id long")), "rare")
    return meeting.join(crowded, "band", "left_anti"), rare


def across(met: DataFrame, comp: DataFrame, few: int, left: int, right: int, least: int = 4, scratch: Scratch | None = None, name: str = "across") -> tuple[DataFrame, DataFrame]:
    """All pairs of ids that meet in a band and are in different components of ``comp(node, component)``, in two forms.

    Bands of at most ``few`` ids give rows ``a, b``: less than ``few`` / 2 for each row of ``met``. Of wider
    bands, the ids outside the band's largest component, in blocks of about ``left``, meet all ids of the
    band, in pieces of about ``right``: rows ``id, comp, band, block, piece, side`` (0: block, 1: piece), to be
    grouped by band, block and piece. Bands of less than ``least`` ids are left out: ``first_pairs`` has all
    pairs of up to three.

    With ``scratch`` the ids and their components are written there as table ``name``, so that the join of
    ``met`` with ``comp`` is made once and not for every form.
    """
    wide = met.where(F.col("nth") == least - 1).select("band")
    member = met.select("band", "id").join(wide, "band", "left_semi").join(comp.select(F.col("node").alias("id"), "component"), "id", "left")
    member = member.select("band", "id", F.coalesce("component", "id").alias("comp"))
    member = scratch.write(member, name) if scratch else member
    parts = member.groupBy("band", "comp").agg(F.count("*").alias("n"))
    parts = parts.groupBy("band").agg(F.sum("n").alias("n"), F.count("*").alias("comps"), F.max(F.struct("n", "comp")).alias("top")).where("comps > 1")
    small = member.join(parts.where(F.col("n") <= few).select("band"), "band")
    x, y = (small.select("band", F.col("id").alias(i), F.col("comp").alias(f"c{i}")) for i in "ab")
    pairs = x.join(y, "band").where("ca <> cb AND a < b").select("a", "b").distinct()
    large = parts.where(F.col("n") > few).select("band", F.col("top.comp").alias("main"), F.ceil((F.col("n") - F.col("top.n")) / left).cast("int").alias("blocks"), F.ceil(F.col("n") / right).cast("int").alias("pieces"))
    member, h = member.join(large, "band"), F.xxhash64("id")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = ["id", "comp", "band", "block", "piece"]
    own = member.where("comp <> main").withColumn("block", F.pmod(h, F.col("blocks")).cast("int")).withColumn("piece", every("pieces"))
    others = member.withColumn("piece", F.pmod(h, F.col("pieces")).cast("int")).withColumn("block", every("blocks"))
    return pairs, own.select(*cols, F.lit(0).alias("side")).union(others.select(*cols, F.lit(1).alias("side")))


def components(scratch: Scratch, edges: DataFrame, name: str = "cc") -> DataFrame:
    """Distributed union-find: ``edges(a, b)`` to ``(node, component)``, component the smallest node reachable.

    Alternating large-star and small-star steps (Kiveris et al., 2014) on a written edge table: each step is
    a group-by for the smallest neighbour and a join, so no task ever holds a component, and the number of
    rounds grows with the logarithm of the largest component. Rows with a null end or a = b are no edges;
    repeated edges count once. Nodes that are their own component (roots, and nodes in no edge) have no row.
    """
    both = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    e = scratch.write(both.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), f"{name}-0")
    before, k = None, 0
    while True:
        known = e.groupBy("u").agg(F.count("*").alias("n"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("hash"))
        *size, most = known.agg(F.coalesce(F.sum("n"), F.lit(0)), F.sum("hash"), F.max("n")).first()
        if size == before or size[0] == 0:
            scratch.sweep()
            return e.select(F.col("v").alias("node"), F.col("u").alias("component"))
        before = size
        # large star: every neighbour that is larger than the node moves to the node's smallest neighbour
        half = e.select(F.col("v").alias("n"), F.col("u").alias("m")).union(e.select("u", "v"))
        least = half.groupBy("n").agg(F.min("m").alias("least")).select("n", F.least("n", "least").alias("least"))
        larger, key = e.select(F.col("u").alias("n"), F.col("v").alias("m")), ["n"]
        if most > HUB:  # the rows of a root that many nodes know are dealt over eight keys
            hubs = F.broadcast(e.groupBy("u").agg(F.count("*").alias("k")).where(F.col("k") > HUB).select(F.col("u").alias("n"), F.lit(True).alias("hub")))
            larger = larger.join(hubs, "n", "left").withColumn("part", F.when(F.col("hub"), F.pmod(F.xxhash64("m"), F.lit(8)).cast("int")).otherwise(0)).drop("hub")
            least = least.join(hubs, "n", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.when(F.col("hub"), 7).otherwise(0)))).drop("hub")
            key = ["n", "part"]
        large = larger.join(least, key).select(F.col("m").alias("v"), F.col("least").alias("u")).distinct()
        # small star: a node and its smaller neighbours move to the smallest of these
        root = large.groupBy("v").agg(F.min("u").alias("root"))
        moved = large.join(root, "v").where("u <> root").select(F.col("u").alias("v"), F.col("root").alias("u"))
        k += 1
        new = scratch.write(moved.union(root.select("v", F.col("root").alias("u"))).distinct(), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        e = new
