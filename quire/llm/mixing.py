"""Mixing sources to target weights by Pfair scheduling, in SQL functions (operator 9).

Each source's documents are dealt, in a hashed order, into blocks of ``block_rows``. One block is sent in
each slot. With a share of w of the slots, block i of a source (from 1) is released at slot floor((i-1)/w)
and due by slot ceil(i/w); of the released blocks the one with the earliest deadline goes first, so at any
slot every source is less than one block away from its share. Weights are taken as they are written, as
ratios of integers, so the pattern repeats exactly after as many slots as these integers add up to: the
pattern is one fold over one period, whatever the size of the corpus, and no rounding adds up. When a source
has no block left, the rest go on with their weights relative to each other: a phase of its own.

Nothing is dropped or repeated; a document's position is its block's slot and its place in the block.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LONGEST, CHUNK = 1 << 17, 256
REST = "\0rest"  # the group of all sources without a target weight


def whole_weights(weights: dict[str, float]) -> dict[str, int]:
    """The positive weights as the smallest integers in the same proportion, each as it is written in decimals."""
    exact = {s: Fraction(str(w)) for s, w in weights.items() if w > 0}
    scale = math.lcm(*(w.denominator for w in exact.values()))
    whole = {s: int(w * scale) for s, w in exact.items()}
    shared = math.gcd(*whole.values())
    whole = {s: w // shared for s, w in whole.items()}
    if sum(whole.values()) > LONGEST:
        raise ValueError(f"as integers the weights add up to {sum(whole.values())}, more than {LONGEST}: give them with fewer digits")
    return whole


def dealt(docs: DataFrame, block_rows: int, bucket_rows: int, group: Column, key_cols: list[str]) -> DataFrame:
    """``row, source, block, place``: every row of ``docs``, its block (from 1) of its group and its place in that.

    A group's rows get their numbers without meeting in one task: rows are counted by group and hash bucket
    (about ``bucket_rows`` each), a running sum over these counts gives each bucket its first number.
    """
    spread = docs.select(group.alias("source"), F.xxhash64(*key_cols).alias("h"), F.struct("*").alias("row"))
    buckets = max(1, -(-docs.count() // bucket_rows))
    spread = spread.withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(buckets)))
    counts = spread.groupBy("source", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("source", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("source", "bucket").orderBy("h", *(F.col(f"row.`{c}`") for c in key_cols))
    rows = spread.withColumn("nth", F.row_number().over(inside)).join(counts, ["source", "bucket"])
    number = F.col("first") + F.col("nth") - 1
    return rows.select("row", "source", (F.floor(number / block_rows) + 1).alias("block"), (number % block_rows).alias("place"))


def phases(blocks: DataFrame, weights: dict[str, int]) -> DataFrame:
    """``source, begin, upto, per, total, slot0, pattern``: what each source sends in each phase, from ``blocks(source, n)``.

    A phase ends when the first of its sources has sent all its blocks. In it a source sends its blocks from
    ``begin`` (exclusive) to ``upto``, ``per`` of them in each period of ``total`` slots, at the slots
    ``pattern`` of that period, counted from ``slot0``. One row a source and phase; the fold runs on one row
    that lists the groups: one for each weight, and one for all sources without a weight.
    """
    given = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)) if weights else F.create_map().cast("map<string,int>")
    blocks = blocks.select("source", F.col("n").cast("long").alias("n"), F.coalesce(given[F.col("source")], F.lit(0)).cast("long").alias("w"))
    listed = blocks.agg(F.array_sort(F.collect_list(F.struct("source", "n", "w"))).alias("s"))
    listed = listed.withColumn("state", F.expr("""
        aggregate(sequence(1, greatest(size(s), 1)),
          named_struct('sent', transform(s, x -> 0L), 'slot', 0L, 'out', cast(array() AS array<struct<source:string,begin:bigint,upto:bigint,per:bigint,slot0:bigint,total:bigint>>)),
          (a, step) -> transform(array(zip_with(s, a.sent, (x, y) -> if(x.n > y, x.w, 0L))), left ->
            transform(array(if(array_max(left) > 0, left, zip_with(s, a.sent, (x, y) -> if(x.n > y, 1L, 0L)))),
              per -> transform(array(named_struct('per', per, 'total', aggregate(per, 0L, (p, q) -> p + q),
                  'rounds', array_min(filter(transform(s, (x, i) -> if(per[i] > 0, (x.n - a.sent[i]) / cast(per[i] AS double), NULL)), r -> r IS NOT NULL)))), c ->
                named_struct(
                  'sent', transform(a.sent, (y, i) -> least(s[i].n, y + coalesce(cast(ceil(c.per[i] * c.rounds - 1e-9) AS bigint), 0L))),
                  'slot', a.slot + coalesce(cast(ceil(c.rounds) AS bigint), 0L) * c.total,
                  'out', concat(a.out, filter(transform(s, (x, i) -> named_struct('source', x.source, 'begin', a.sent[i],
                      'upto', least(x.n, a.sent[i] + coalesce(cast(ceil(c.per[i] * c.rounds - 1e-9) AS bigint), 0L)), 'per', c.per[i], 'slot0', a.slot, 'total', c.total)), o -> o.per > 0)))
              )[0])[0])[0])"""))  # fmt: skip
    rows = listed.select(F.explode("state.out").alias("p")).select("p.*").where("upto > begin")
    by_phase = rows.groupBy("slot0").agg(F.array_sort(F.collect_list(F.struct("source", "per"))).alias("all"), F.first("total").alias("total"))
    # one period: of the released blocks (with i sent, floor(i * total / per) <= t) the earliest deadline ceil((i + 1) * total / per)
    period = by_phase.withColumn("order", F.expr(f"""
        aggregate(sequence(0L, (total - 1) div {CHUNK}), named_struct('sent', transform(all, x -> 0L), 'order', cast(array() AS array<int>)),
          (b, c) -> transform(array(aggregate(sequence(c * {CHUNK}, least(total, (c + 1) * {CHUNK}) - 1), named_struct('sent', b.sent, 'order', cast(array() AS array<int>)),
            (a, t) -> transform(array(array_min(filter(transform(all, (x, i) ->
                if(a.sent[i] * total < (t + 1) * x.per AND a.sent[i] < x.per, struct(((a.sent[i] + 1) * total + x.per - 1) div x.per AS due, i AS i), NULL)), y -> y IS NOT NULL)).i), pick ->
              named_struct('sent', transform(a.sent, (y, i) -> if(i = pick, y + 1, y)), 'order', concat(a.order, array(coalesce(pick, -1)))))[0])), d ->
            named_struct('sent', d.sent, 'order', concat(b.order, d.order)))[0]).order"""))  # fmt: skip
    slots = period.select("slot0", "all", F.posexplode("order").alias("at", "i")).where("i >= 0").withColumn("source", F.expr("all[i].source"))
    slots = slots.groupBy("slot0", "source").agg(F.array_sort(F.collect_list("at")).alias("pattern"))
    return rows.join(slots, ["slot0", "source"]).select("source", "begin", "upto", "per", "total", "slot0", "pattern")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block_rows: int = 64, bucket_rows: int = 4096, source_col: str = "source", key_cols: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """``docs`` with ``mix_block`` (of its source), ``mix_slot`` and ``mix_place``: sort by the last two to read the mixture.

    ``weights`` gives each source its target share (relative numbers, exact as written; as the smallest
    integers in that proportion they may add up to 2**17 at most). While a source lasts it is less than one
    block away from its share at every slot. Sources without a positive weight come as one group when the
    others are through. None: all sources in turn, however many. A null source is the source named by an empty text.
    All rows stay, repeated rows and ids included; rows alike in ``key_cols`` are interchangeable. Columns of
    the three names that ``docs`` already has are replaced. Slots grow but may skip numbers between phases.
    Empty tables give no rows.
    """
    name = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    if weights is None:  # equal shares: block after block of each source in turn, a source that ends is left out
        rows = dealt(docs, block_rows, bucket_rows, name, list(key_cols))
        turns = docs.select(name.alias("source")).distinct()  # a row a source
        turns = turns.withColumn("turn", F.row_number().over(Window.orderBy("source")) - 1).withColumn("turns", F.count("*").over(Window.partitionBy()))
        out = rows.join(turns, "source").withColumn("slot", (F.col("block") - 1) * F.col("turns") + F.col("turn"))
    else:
        whole = whole_weights(weights)
        group = F.when(name.isin(list(whole)), name).otherwise(REST)
        rows = dealt(docs, block_rows, bucket_rows, group, list(key_cols))
        sizes = docs.groupBy(group.alias("source")).agg(F.ceil(F.count("*") / block_rows).alias("n"))
        plan = F.broadcast(phases(sizes, whole).withColumnRenamed("source", "of"))  # at most a row for each weight and phase, patterns of 2**17 slots in all
        here = (F.col("source") == F.col("of")) & (F.col("block") > F.col("begin")) & (F.col("block") <= F.col("upto"))
        at = F.col("block") - F.col("begin") - 1
        out = rows.join(plan, here).withColumn("slot", F.col("slot0") + F.floor(at / F.col("per")) * F.col("total") + F.get("pattern", (at % F.col("per")).cast("int")))
    named = {"mix_block": F.col("block"), "mix_slot": F.col("slot"), "mix_place": F.col("place")}
    return out.select(*(F.col(f"row.`{c}`") for c in docs.columns if c not in named), *(x.cast("long").alias(c) for c, x in named.items()))


def in_order(docs: DataFrame, weights: dict[str, float] | None = None, **options) -> DataFrame:
    """The rows of ``docs``, all columns as they are, sorted into the mixture; options as for ``mix``."""
    row = docs.select(F.struct("*").alias("row"), "source", F.xxhash64("doc_id", "text").alias("key"))
    mixed = mix(row, weights, key_cols=("key",), **options)
    return mixed.orderBy("mix_slot", "mix_place").select("row.*")
