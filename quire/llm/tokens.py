"""Token ids of whole texts, and their binary form (operator 7).

``Encoder`` runs the tokenizers library in the tasks. A byte-level vocabulary first cuts a text into pieces
(letters, digits, marks, white space, each with the space before it) and then encodes each piece by itself,
so the ids of a text are those of its pieces in order. The pieces are cut here in numpy, over many texts at
once, with the library's own answer for the class of every character; the ids of a piece come from the
library, and a bounded memory of pieces spares asking for them again.

``write_tokens`` stores one row per document in ascending id order as Parquet: ids as a list column with
dictionary encoding, counts and document ids with delta encoding, row groups of a set size and page
indexes, so that a reader of counts or of a range of documents reads those pages alone.
"""

from __future__ import annotations

import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

REMEMBERED, PIECE = 1_000_000, 32
LETTER, DIGIT, MARK, BLANK, UNKNOWN = 0, 1, 2, 3, 255
_FACTORS = np.random.default_rng(41).integers(0, 2**63, (2, PIECE)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_WIDE = np.uint64(64)


def _ragged(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places ``first[i], first[i] + 1, ...``, ``count[i]`` of them, for all i in order."""
    upto = np.cumsum(count)
    return np.arange(upto[-1] if len(upto) else 0) + np.repeat(first - (upto - count), count)


class Encoder:
    """Ids of texts by the tokenizer file at ``path``, as the library's ``encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocab.values()) + 1, bool)  # tokens that begin with a space
        for token, i in vocab.items():
            self.opens[i] = token.startswith("Ġ")
        self.line = vocab["Ċ"]
        self.classes = np.full(0x110000, UNKNOWN, np.uint8)
        # the memory: names of the pieces, ``key`` ascending, and where in ``ids`` those of a piece lie
        self.key, self.check = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.first, self.count = np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)

    def _keep(self, at: np.ndarray) -> None:
        self.key, self.check, count = self.key[at], self.check[at], self.count[at]
        self.ids = self.ids[_ragged(self.first[at], count)]
        self.first, self.count = np.cumsum(count) - count, count

    def _class_of(self, c: int) -> int:
        cuts = lambda s: len(self.tokenizer.pre_tokenizer.pre_tokenize_str(s))
        c = chr(c)
        return LETTER if cuts("a" + c) == 1 else DIGIT if cuts("1" + c) == 1 else MARK if cuts("!" + c) == 1 else BLANK

    def _classes(self, c: np.ndarray) -> np.ndarray:
        found = self.classes[c]
        if (found == UNKNOWN).any():
            for x in np.unique(c[found == UNKNOWN]).tolist():
                self.classes[x] = self._class_of(x)
            found = self.classes[c]
        return found

    def _cuts(self, c: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Ascending places in the code points ``c`` at which pieces begin; texts end (and begin) at ``ends``."""
        kind, n = self._classes(c), len(c)
        fresh = np.zeros(n + 1, bool)  # the first place of each text
        fresh[0] = fresh[ends] = True
        begin = fresh[:n].copy()
        begin[1:] |= kind[1:] != kind[:-1]
        blank = kind == BLANK
        # of a run of white space that something follows, the last character is cut off; a space joins what follows
        last = np.flatnonzero(blank[:-1] & ~blank[1:] & ~fresh[1:n])
        begin[last] = True
        begin[last[c[last] == 32] + 1] = False
        # a mark ' that begins a piece, with s, t, m, d, re, ve or ll behind it, is a piece with those letters
        quote = np.flatnonzero((c == 39) & begin)
        if len(quote):
            behind = np.append(np.where(fresh[:n], 0, c), [0, 0])  # no letter of the next text counts
            a, b = behind[quote + 1], behind[quote + 2]
            one = np.isin(a, [ord(x) for x in "stmd"])
            two = (a == ord("r")) & (b == ord("e")) | (a == ord("v")) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
            begin[quote[one | two] + 1] = False
            stop = np.concatenate((quote[one] + 2, quote[two] + 3))
            stop = stop[stop < n]
            begin[stop[kind[stop] == LETTER]] = True  # the letters that are left are a piece of their own
        return np.flatnonzero(begin)

    def _encode_each(self, pieces: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _encode_new(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids of distinct pieces: many in one call where a space or a line break is sure to part them."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        spaced, bare, odd = [], [], []
        for i, p in enumerate(pieces):
            rest = p[1:] if p[0] == " " else p
            (odd if not rest or rest[0].isspace() or "\n" in p or " " in rest else spaced if p[0] == " " else bare).append(i)
        for group, lead in ((spaced, ""), (bare, "\n")):
            for at in range(0, len(group), 1000):
                part = group[at : at + 1000]
                ids = np.array(self.tokenizer.encode_batch_fast([lead + lead.join([pieces[i] for i in part])], add_special_tokens=False)[0].ids, np.uint32)
                begin = np.flatnonzero(ids == self.line) + 1 if lead else np.flatnonzero(self.opens[ids])
                if len(begin) != len(part):  # never with a vocabulary of the kind described above
                    odd.extend(part)
                    continue
                stop = np.append(begin[1:] - len(lead), len(ids))
                for i, a, b in zip(part, begin.tolist(), stop.tolist()):
                    out[i] = ids[a:b]
        for i, ids in zip(odd, self._encode_each([pieces[i] for i in odd]), strict=True):
            out[i] = ids
        return out  # type: ignore[return-value]

    def _learn(self, key: np.ndarray, check: np.ndarray, pieces: list[str]) -> None:
        found = self._encode_new(pieces)
        count = np.array([len(x) for x in found], np.int64)
        first = len(self.ids) + np.cumsum(count) - count
        self.ids = np.concatenate((self.ids, *found))
        at = np.searchsorted(self.key, key)
        self.key, self.check = np.insert(self.key, at, key), np.insert(self.check, at, check)
        self.first, self.count = np.insert(self.first, at, first), np.insert(self.count, at, count)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and the place in it at which each text ends."""
        # in texts with strings of special tokens the library finds these before it cuts pieces
        whole = [i for i, t in enumerate(texts) if t and any(s in t for s in self.special)]
        plain = [t or "" for t in texts]
        found = self._encode_each([plain[i] for i in whole])
        for i in whole:
            plain[i] = ""
        ids, ends = self._encode_plain(plain)
        if not whole:
            return ids, ends
        parts = np.split(ids, ends[:-1])
        for i, x in zip(whole, found, strict=True):
            parts[i] = x
        return np.concatenate(parts), np.cumsum([len(p) for p in parts])

    def _encode_plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "".join(texts)
        if not joined:
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        ends = np.cumsum([len(t) for t in texts])
        c = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        at = self._cuts(c, ends)
        size = np.diff(at, append=len(c))
        # two independent sums name a piece of up to PIECE characters; longer ones are encoded where they stand
        pos = np.minimum(np.arange(len(c)) - np.repeat(at, size), PIECE - 1)
        wide = c.astype(np.uint64) + np.uint64(1)
        key = np.add.reduceat(wide * _FACTORS[0][pos], at) * _WIDE + size.astype(np.uint64)
        check = np.add.reduceat(wide * _FACTORS[1][pos], at)
        long = np.flatnonzero(size > PIECE)
        key[long] = 0  # no short piece has this key: its lowest six bits hold a length
        one, where, inverse = np.unique(key, return_index=True, return_inverse=True)
        known = self._places(one, check[where])
        if len(self.key) > REMEMBERED:  # what these texts use is likely to come again
            self._keep(np.unique(known[known >= 0]))
            known = self._places(one, check[where])
        new = np.flatnonzero((known < 0) & (one != 0))
        if len(new):
            spots = where[new]
            self._learn(one[new], check[spots], [joined[a : a + n] for a, n in zip(at[spots].tolist(), size[spots].tolist())])
            known = self._places(one, check[where])
        if (check != check[where][inverse]).any() or (known[one != 0] < 0).any():  # two pieces with one key: once in 2**58 pairs
            parts = self._encode_each(texts)
            return np.concatenate(parts), np.cumsum([len(p) for p in parts])
        place = known[inverse]
        count = np.where(place >= 0, self.count[place], 0)
        first = np.where(place >= 0, self.first[place], 0)
        store = self.ids
        if len(long):
            extra = self._encode_each([joined[a : a + n] for a, n in zip(at[long].tolist(), size[long].tolist())])
            count[long] = [len(x) for x in extra]
            first[long] = len(store) + np.cumsum(count[long]) - count[long]
            store = np.concatenate((store, *extra))
        return store[_ragged(first, count)], np.append(0, np.cumsum(count))[np.searchsorted(at, ends)]

    def _places(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Where ascending keys stand in the memory, -1 for those that do not."""
        if not len(self.key):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((self.key[at] == key) & (self.check[at] == check), at, -1)


def encoder(path: str) -> Encoder:
    """One encoder for each file in a Python worker, kept from task to task."""
    kept = sys.modules.setdefault("_quire_encoders", types.ModuleType("_quire_encoders")).__dict__
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def encoded(batches: Iterator[pa.RecordBatch], column: int, path: str, end_id: int, chars: int = 1_000_000) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with the ids of the texts in ``column``, ``end_id`` behind each, and where each text's ids end.

    A slice has about ``chars`` bytes of text. A longer text is encoded in parts, cut before a single space
    between characters that are none, which is always between two pieces.
    """
    enc = encoder(path)
    for batch in batches:
        size = np.asarray(pc.binary_length(batch.column(column)).fill_null(0))
        starts = np.flatnonzero(np.diff(np.cumsum(size) // chars, prepend=-1))
        for a, b in zip(starts, np.append(starts[1:], batch.num_rows), strict=True):
            rows = batch.slice(a, b - a)
            parts = [list(_parts(t or "", chars, enc.special)) for t in rows.column(column).to_pylist()]
            found = [enc.encode(group) for group in _groups([p for ps in parts for p in ps], chars)]
            ids, sizes = np.concatenate([i for i, _ in found]), np.concatenate([np.diff(e, prepend=0) for _, e in found])
            ends = np.cumsum(sizes)[np.cumsum([len(ps) for ps in parts]) - 1]
            yield rows, np.insert(ids, ends, np.uint32(end_id)), ends + np.arange(1, len(ends) + 1)


def _groups(texts: list[str], chars: int) -> Iterator[list[str]]:
    """The texts in runs of about ``chars`` characters, so that few are held as arrays at once."""
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= chars:
            yield group
            group, size = [], 0
    if group:
        yield group


def _parts(text: str, chars: int, special: list[str]) -> Iterator[str]:
    """The text in parts of at most ``chars``, where it has places to cut."""
    at = 0
    while len(text) - at > chars and not any(s in text for s in special):
        cut = text.rfind(" ", at + 1, at + chars)
        while cut > at and (text[cut - 1].isspace() or text[cut + 1].isspace()):
            cut = text.rfind(" ", at + 1, cut)
        if cut <= at:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, files: int, row_group_mb: int = 16, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``doc_id, n_tokens, before, ids`` (with ``end_id`` at the end) under ``path``, in ascending order over all files.

    ``before`` counts the ids of the documents before it in the same file.

    Documents go to ``files`` ranges of ids before they are encoded; nulls in the id sort first, null texts
    have the end id alone, repeated ids and rows all stay, ordered by text. Other columns, whatever their
    names, are not read. Texts are read whole, however long.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # the text's hash parts the rows of an id that repeats very often
    ranged = picked.withColumn("h", F.xxhash64("text")).repartitionByRange(files, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0  # a task writes one file
        for rows, ids, ends in encoded(batches, 1, tokenizer, end_id):
            offsets = np.append(0, ends)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.view(np.int32)))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(offsets).astype(np.int64)), pa.array(before + offsets[:-1].astype(np.int64)), lists], ["doc_id", "n_tokens", "before", "ids"])
            before += len(ids)

    options = {
        "compression": "zstd", "parquet.block.size": row_group_mb << 20, "parquet.page.size": 1 << 18, "parquet.page.row.count.limit": 2000, "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary": "true", "parquet.enable.dictionary#doc_id": "false", "parquet.enable.dictionary#n_tokens": "false", "parquet.enable.dictionary#before": "false",
    }
    ranged.mapInArrow(run, "doc_id long, n_tokens long, before long, ids array<int>").write.options(**options).parquet(path)


def token_counts(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, n_tokens`` of a written token table; the ids are not read."""
    return spark.read.parquet(path).select("doc_id", "n_tokens")


def token_spans(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of a written token table.

    ``start`` counts the ids of all documents before it: those of the files before, summed from the counts
    alone, and those before it in its file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            values, ends = np.asarray(lists.values).astype("<u4", copy=False), np.asarray(lists.offsets)
            crc = [zlib.crc32(values[a:b]) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64())], ["file", "before", "doc_id", "n_tokens", "ids_crc32"])

    number = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long").alias("file")
    rows = spark.read.parquet(path).select(number, "before", "doc_id", "ids").mapInArrow(run, "file long, before long, doc_id long, n_tokens long, ids_crc32 long")
    files = spark.read.parquet(path).select(number, "n_tokens").groupBy("file").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = files.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    return rows.join(F.broadcast(files), "file").select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
