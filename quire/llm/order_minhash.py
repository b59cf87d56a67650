"""Order MinHash fingerprints of documents in SQL functions (operator 6).

A text's k-mers are pairs of neighbouring words; a run without spaces of more than 16 characters counts as
the overlapping stretches of up to 16 that begin at each of its characters (in runs of up to 31, not at some
in the middle), so an edit changes only the k-mers near it. A
k-mer is numbered by its occurrence in the text, so repeats stay apart, and hashed with that number. The
hashes lie on a circle, in which each of ``SLOTS`` starting points is an order of its own: the two k-mers
that are minimal in that order are put in the order of the text, and their hashes make the slot's tuple.
Two texts agree in a slot when they share both minimal k-mers in the same order, so likeness falls with
edits and with moved parts. The fingerprint is four hexadecimal digits for each slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.shared import let

SLOTS, PLACE = 64, 28  # PLACE: bits for a k-mer's place in the text
_KEY = (1 << 35) - 1


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text, empty if it has no word; null counts as empty. Equal texts have equal ones.

    Arrays are bound as lambda variables, so that each is made once. ``s`` has hash and place of all k-mers in
    one number each, sorted: repeats stand together in text order, and a k-mer's occurrence number is found by
    doubling steps back. ``h`` has them hashed with that number and sorted again; of each slot that holds any,
    the first stands for the slot and the empty ones before it.
    """
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?:(?<!\S)|(?<=\S{16})|(?=\S{17}))(?=(\S{1,16}))"), F.lit(1))
    key = lambda x: F.shiftright(x, PLACE)
    place = lambda x: x.bitwiseAND(F.lit((1 << PLACE) - 1))
    slot = lambda x: F.shiftright(x, PLACE + 29).cast("int")  # noqa: E731  the key's 6 highest bits
    join = lambda hashed, at: F.shiftleft(hashed.bitwiseAND(F.lit(_KEY)), PLACE).bitwiseOR(at)

    def pairs(w: Column) -> Column:
        return F.sort_array(F.transform(w, lambda t, i: join(F.xxhash64(t, F.coalesce(F.get(w, i + 1), F.lit(""))), i.cast("long"))))

    def numbered(s: Column) -> Column:
        steps = F.transform(F.sequence(F.ceil(F.log2(F.size(s) + 1)).cast("int"), F.lit(0)), lambda p: F.call_function("shiftleft", F.lit(1), p))

        def one(x: Column, i: Column, steps: Column) -> Column:
            same = lambda at: F.coalesce(key(F.get(s, at)) == key(x), F.lit(False))
            count = F.aggregate(steps, F.lit(0), lambda n, step: F.when((i - n - step >= 0) & same(F.greatest(i - n - step, F.lit(0))), n + step).otherwise(n))
            return F.when((i == 0) | ~same(F.greatest(i - 1, F.lit(0))), x).otherwise(join(F.xxhash64(key(x), count), place(x)))

        return F.sort_array(let(steps, lambda p: F.transform(s, lambda x, i: one(x, i, p))))

    def slots(h: Column) -> Column:
        heads = F.filter(F.transform(h, lambda x, i: F.when((i == 0) | (slot(F.get(h, F.greatest(i - 1, F.lit(0)))) != slot(x)), i)), lambda i: i.isNotNull())

        def entry(i: Column) -> Column:
            pair = lambda a, b: F.when(place(a) <= place(b), F.xxhash64(key(a), key(b))).otherwise(F.xxhash64(key(b), key(a)))
            return F.right(F.concat(F.lit("000"), F.lower(F.hex(pair(F.get(h, i), F.get(h, (i + 1) % F.size(h))).bitwiseAND(F.lit(0xFFFF))))), F.lit(4))

        def spread(f: Column) -> Column:
            many = lambda i, k: slot(F.get(h, i)) - F.when(k == 0, -1).otherwise(slot(F.get(h, F.get(f, F.greatest(k - 1, F.lit(0))))))
            last = SLOTS - 1 - slot(F.get(h, F.element_at(f, -1)))
            body = F.array_join(F.transform(f, lambda i, k: F.repeat(entry(i), many(i, k))), "")
            return F.concat(body, F.repeat(entry(F.get(f, F.lit(0))), last))

        return let(heads, spread)

    full = let(words, lambda w: let(pairs(w), lambda s: let(numbered(s), slots)))
    return F.when(F.coalesce(text, F.lit("")).rlike(r"\S"), full).otherwise(F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """The share of slots in which two fingerprints agree; 1 for equal ones, 0 where just one is empty."""
    at = lambda f, i: F.substr(f, i * 4 + 1, F.lit(4))
    same = F.aggregate(F.sequence(F.lit(0), F.lit(SLOTS - 1)), F.lit(0), lambda n, i: n + (at(a, i) == at(b, i)).cast("int"))
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(same / F.lit(float(SLOTS)))


def with_next(docs: DataFrame, blocks: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, mark, next_text, next_mark``: every document with the next in descending order of the id.

    After the last comes the first; null ids come last, rows of one id in the order of a hash of their text.
    Ids are cut at about ``blocks`` quantiles (that many numbers pass the driver), each range is sorted by
    itself, and the first document of each range also goes to the range before it.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.withColumn("rank", F.coalesce("doc_id", F.lit(-(2**63)))).withColumn("h", F.xxhash64("text"))
    cuts = sorted({int(q) for q in base.where("doc_id IS NOT NULL").stat.approxQuantile("doc_id", [i / blocks for i in range(1, blocks)], 1 / (4 * blocks))}) if blocks > 1 else []
    if cuts:
        bounds = F.array(*(F.lit(c).cast("long") for c in cuts))
        steps = F.array(*(F.lit(1 << p) for p in range(len(cuts).bit_length() - 1, -1, -1)))
        inside = lambda at: (at <= len(cuts)) & F.coalesce(F.get(bounds, F.least(at, F.lit(len(cuts))) - 1) <= F.col("rank"), F.lit(False))
        base = base.withColumn("block", F.aggregate(steps, F.lit(0), lambda p, s: F.when(inside(p + s), p + s).otherwise(p)))
    else:
        base = base.withColumn("block", F.lit(0))
    tops = base.groupBy("block").agg(F.max(F.struct("rank", F.bitwise_not(F.hash("h")).alias("o"), "h")).alias("top"))  # a row a block
    w = Window.orderBy("block")  # over at most ``blocks`` rows
    tops = tops.select(F.col("top.rank").alias("rank"), F.col("top.h").alias("h"), F.lead("block").over(w).alias("to"), F.min("block").over(w).alias("least"))
    # the first document of all goes behind the last range, as the next of the last document
    tops = tops.select("rank", "h", F.coalesce("to", "least").alias("to"), F.col("to").isNull().cast("int").alias("lap"))
    guests = base.join(F.broadcast(tops), ["rank", "h"]).dropDuplicates(["rank", "h"])
    cols = ["doc_id", "text", "mark", "rank", "h"]
    guests = guests.withColumn("mark", fingerprint(F.col("text"))).select(*cols, F.col("to").alias("block"), "lap", F.lit(True).alias("guest"))
    own = base.withColumn("mark", fingerprint(F.col("text"))).select(*cols, "block", F.lit(0).alias("lap"), F.lit(False).alias("guest"))
    order = Window.partitionBy("block").orderBy("lap", F.desc("rank"), F.hash("h"), F.desc("h"), "guest")
    both = own.unionByName(guests).withColumn("next", F.lead(F.struct("text", "mark")).over(order))
    return both.where("NOT guest").select("doc_id", "text", "mark", F.col("next.text").alias("next_text"), F.col("next.mark").alias("next_mark"))


def edited_likeness(docs: DataFrame, blocks: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, and how like they are.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. The
    edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document, see ``with_next``; a single document is its own next. Null texts count as empty, and empty texts
    are alike. One row per input row; other columns are not read.
    """
    d = with_next(docs, blocks, id_col, text_col).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substr("next_text", F.lit(1), half))
    d = d.withColumn("edited", edited).withColumn("edited_mark", fingerprint(F.col("edited")))
    return d.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.col("mark").alias("fingerprint"), F.col("edited_mark").alias("edited_fingerprint"),
        likeness(F.col("mark"), F.col("edited_mark")).alias("near_edited"), likeness(F.col("mark"), F.col("next_mark")).alias("near_next"),
    )
