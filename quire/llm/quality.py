"""Quality classifier with supervised subword embeddings (operator 2).

Every word and every character 3- and 4-gram of a document (whole text, case kept, n-grams inside words
with the space at either side) is hashed to one of 2**17 learned vectors of 16 numbers. A document is the
mean of its vectors, a softmax layer gives the two classes. Vectors and layer are trained by plain
stochastic gradient descent in numpy, in one task, over at most ``sample`` labelled documents. Since the
output is linear in the mean, the trained model folds into one number per bucket, and scoring is a lookup
and a mean: a map over the documents without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import slices

BUCKETS_LOG2, DIM = 17, 16
_MUL = np.random.default_rng(31).integers(0, 2**31, 64, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
PIECE = 1 << 20


@dataclass
class QualityModel:
    """Folded model: the score of a document is sigmoid(bias + mean of weights over its features)."""

    weights: np.ndarray
    bias: float


def features(text: str | None) -> Iterator[np.ndarray]:
    """Bucket numbers of all features of a text, in pieces of about a million characters (cut at white space)."""
    text, at = text or "", 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        if end < len(text) and (cut := text.rfind(" ", at + 1, end)) > 0:
            end = cut
        yield _features(text[at:end])
        at = end


def _features(text: str) -> np.ndarray:
    c = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    space = (c <= 32) | (c == 160) | (c == 0x3000)
    c = np.where(space, np.uint32(32), c)
    out, shift = [], np.uint32(32 - BUCKETS_LOG2)
    a, b, d = c[:-2] * _MUL[0], c[1:-1] * _MUL[1], c[2:] * _MUL[2]
    out.append((a + b + d)[~space[1:-1]])
    if len(c) > 3:
        out.append((a[:-1] + b[:-1] * np.uint32(7) + d[:-1] * np.uint32(11) + c[3:] * _MUL[3])[~(space[1:-2] | space[2:-1])])
    start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    if len(start):
        first = np.zeros(len(c), np.int64)
        first[start] = start
        pos = np.arange(len(c)) - np.maximum.accumulate(first)
        h = np.where(space, np.uint32(0), c * _MUL[pos & 63])
        out.append(np.add.reduceat(h, start, dtype=np.uint32) ^ np.uint32(0x5BD1E995))
    h = np.concatenate(out) * np.uint32(0x9E3779B1)
    return ((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77)) >> shift


def train(texts: list[str | None], labels: np.ndarray, epochs: int = 6, rate: float = 0.4, seed: int = 7) -> QualityModel:
    """Stochastic gradient descent over the documents in a seeded order, with a falling rate."""
    rng = np.random.default_rng(seed)
    vectors = ((rng.random((1 << BUCKETS_LOG2, DIM), np.float32) - np.float32(0.5)) * np.float32(2 / DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    bags = []
    for t in texts:
        n = np.zeros(0, np.uint32)
        for part in features(t):
            n = np.concatenate((n, part))
        ids, counts = np.unique(n, return_counts=True)
        bags.append((ids, (counts / max(1, counts.sum())).astype(np.float32)))
    steps, done = epochs * len(bags), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            lr = np.float32(rate * (1 - done / steps))
            done += 1
            ids, w = bags[i]
            hidden = w @ vectors[ids]
            z = hidden @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = layer @ p
            layer -= lr * np.outer(hidden, p)
            bias -= lr * np.float32(0.1) * p
            vectors[ids] -= (lr * min(1, len(ids) / 8)) * (w * np.float32(len(ids)) ** np.float32(0.5))[:, None] * back[None, :]
    return QualityModel((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def score_texts(texts: list[str | None], model: QualityModel) -> np.ndarray:
    out = np.empty(len(texts))
    for i, t in enumerate(texts):
        total, n = 0.0, 0
        for part in features(t):
            total += float(model.weights[part].sum(dtype=np.float64))
            n += len(part)
        out[i] = total / max(1, n)
    return 1 / (1 + np.exp(-np.clip(out + model.bias, -40, 40)))


def held_out(id_col: str = "doc_id", folds: int = 5, fold: int = 0) -> Column:
    """Whether crc32 of the id as text, modulo ``folds``, is ``fold``."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = 4000) -> QualityModel:
    """Fit on at most ``sample`` labelled documents outside the held-out fold, chosen by a hash of the id.

    Labels with a null id or quality are not used; repeated labels of an id count as their mean, 0.5 as 1;
    of repeated documents the least text is used. Without any usable row every score is 0.5. Labels that
    are all alike give that label's side of 0.5 for every document.
    """
    chosen = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out())
    chosen = chosen.groupBy("doc_id").agg(F.when(F.avg("quality") >= 0.5, 1).otherwise(0).alias("label"))
    rows = F.broadcast(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))  # at most ``sample`` rows of 12 bytes
    rows = docs.select("doc_id", "text").join(rows, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        m = train([None if t is None else str(t) for t in pdf["text"]], pdf["label"].to_numpy().astype(int))
        return pd.DataFrame({"weights": [m.weights.tobytes()], "bias": [m.bias]})

    got = rows.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(run, "weights binary, bias double").collect()
    if not got:
        return QualityModel(np.zeros(1 << BUCKETS_LOG2, np.float32), 0.0)
    return QualityModel(np.frombuffer(got[0]["weights"], np.float32), got[0]["bias"])


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` ids with ``score`` (0 to 1; higher: label 1 is likelier) and ``predicted`` (1 at ``threshold`` or more).

    One row per input row, repeated ids included. Null, empty and blank texts have no feature and get the
    model's prior. A null id stays null. Texts are read whole; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score_texts(batch.column(1).to_pylist(), shared.value))], ["doc_id", "score"])

    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, that score at ``threshold`` or more; a row is judged where it stands."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(score_texts(batch.column(at).to_pylist(), shared.value) >= threshold))

    return docs.mapInArrow(run, docs.schema)
