"""Cost-balanced packing of token sequences (operator 5).

Each task packs its documents in blocks of about ``block_tokens`` tokens as they come: no shuffle, and no
more than a block is held. Of a document's ids every full window of ``capacity`` is a sequence of its own.
The rests are assigned in descending length to the sequence of least cost, linear plus quadratic in the
piece's length (attention looks inside one piece only), among those with room for it; a rest that fits
nowhere is cut at the largest room. The block has as few sequences as can hold its rests, so its padding is
below one sequence.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.tokens import encoded


def pack_rests(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces ``(item, start in item, length, sequence, offset)`` for items shorter than ``capacity``, and the number of sequences."""
    count = -(-int(lengths.sum()) // capacity)
    room, cost, pieces = np.full(count, capacity), np.zeros(count), []
    for item in np.argsort(-lengths, kind="stable").tolist():
        start, left = 0, int(lengths[item])
        while left:
            fits = np.flatnonzero(room >= left)
            s = int(fits[np.argmin(cost[fits])]) if len(fits) else int(np.argmax(room))
            n = min(left, int(room[s]))
            pieces.append((item, start, n, s, capacity - int(room[s])))
            room[s] -= n
            cost[s] += linear * n + quadratic * n * n
            start, left = start + n, left - n
    return pieces, count


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, block_tokens: int = 1 << 20, linear: float = 1.0, quadratic: float = 1 / 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document's ids are its text's (null: empty) with ``end_id`` behind; each id lies in exactly one piece,
    and the pieces of a sequence fill it without a gap from 0. A null id stays null, a repeated id or row is
    packed each time. ``sequence_id`` is unique over the result: the partition's number and a count in it.
    Documents are read whole, however long; other columns, whatever their names, are not read.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def packed(block: list[tuple[int | None, bytes]], first: int) -> tuple[pa.RecordBatch, int]:
        rows, rests = [], []
        for doc, ids in block:
            n = len(ids) // 4
            for at in range(0, n - n % capacity, capacity):
                rows.append((doc, at, capacity, zlib.crc32(ids[4 * at : 4 * (at + capacity)]), n, first, 0))
                first += 1
            if n % capacity:
                rests.append((doc, ids, n, n - n % capacity))
        pieces, used = pack_rests(np.array([n - at for *_, n, at in rests], np.int64), capacity, linear, quadratic)
        for item, start, length, sequence, offset in pieces:
            doc, ids, n, at = rests[item]
            rows.append((doc, at + start, length, zlib.crc32(ids[4 * (at + start) : 4 * (at + start + length)]), n, first + sequence, offset))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names), first + used

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence, block, size = TaskContext.get().partitionId() << 40, [], 0
        for rows, ids, ends in encoded(batches, 1, tokenizer, end_id):
            for doc, found in zip(rows.column(0).to_pylist(), np.split(ids.astype("<u4", copy=False), ends[:-1]), strict=True):
                block.append((doc, found.tobytes()))
                size += len(found)
                if size >= block_tokens:
                    out, sequence = packed(block, sequence)
                    yield out
                    block, size = [], 0
        if block:
            yield packed(block, sequence)[0]

    return picked.mapInArrow(run, ", ".join(f"{n} long" for n in names))
