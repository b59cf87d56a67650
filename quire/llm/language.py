"""Language identification by multilingual mixture inference (operator 10).

Each language has a smoothed distribution over hashed character 2- and 3-grams. A document is a mixture:
expectation-maximisation estimates the proportion of every language from the document's n-gram counts. A
language joins the document's set only if the log-likelihood that it adds is above a penalty that grows
with the logarithm of the document's length. The prediction is the set's largest language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.quality import held_out
from quire.llm.shared import slices

BUCKETS_LOG2 = 15
LETTER = re.compile(r"\p{L}")
PIECE = 1 << 20


def ngram_counts(text: str | None) -> np.ndarray:
    """Counts of the hashed 2- and 3-grams of a text's lower-cased letters; all else counts as one space."""
    text, counts = text or "", np.zeros(1 << BUCKETS_LOG2, np.int64)
    for at in range(0, len(text), PIECE):
        c = np.frombuffer(f" {text[at : at + PIECE].lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.where(((c >= 97) & (c <= 122)) | (c >= 192) | (c == 170) | (c == 181) | (c == 186), c, np.uint32(32))
        gap = c == 32
        pair = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA77)
        two = pair[~(gap[:-1] & gap[1:])]
        three = (pair[:-1] * np.uint32(0xC2B2AE3D) + c[2:] * np.uint32(0x27D4EB2F))[~gap[1:-1]]
        h = np.concatenate((two, three))
        h = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BUCKETS_LOG2)
        counts += np.bincount(h, minlength=1 << BUCKETS_LOG2)
    return counts


def mixture(p: np.ndarray, c: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Expectation-maximisation: proportions of the columns of ``p`` for counts ``c``, and the log-likelihood."""
    w, n = np.full(p.shape[1], 1 / p.shape[1]), c.sum()
    for _ in range(rounds):
        w = w * ((c / (p @ w)) @ p) / n
    return w, float(c @ np.log(p @ w))


def detect(text: str | None, languages: list[str], p: np.ndarray, penalty: float) -> tuple[str, float, list[str]]:
    """Prediction, its proportion, and the language set in falling proportion."""
    if not text or not LETTER.search(text) or not languages:
        return "und", 0.0, []
    counts = ngram_counts(text)
    at = np.flatnonzero(counts)
    if not len(at):
        return "und", 0.0, []
    p, c = p[at], counts[at].astype(float)
    w, _ = mixture(p, c, 8)
    order = list(np.argsort(-w, kind="stable"))
    chosen, best = order[:1], float(c @ np.log(p[:, order[0]]))
    share = np.array([1.0])
    for i in order[1:]:
        trial, ll = mixture(p[:, [*chosen, i]], c, 20)
        if ll - best > penalty * np.log1p(c.sum()):  # the penalty alone decides; a language that fails stops no other
            chosen, best, share = [*chosen, i], ll, trial
    top = int(np.argmax(share))
    ranked = [languages[chosen[i]] for i in np.argsort(-share, kind="stable")]
    return languages[chosen[top]], float(min(1.0, max(0.0, w[chosen[top]] if len(chosen) == 1 else share[top]))), ranked


def fit_languages(docs: DataFrame, per_language: int = 1000, smoothing: float = 0.2, parts: int = 64) -> tuple[list[str], np.ndarray]:
    """Languages in order and their n-gram distributions (buckets x languages), from at most ``per_language``
    documents a language outside the held-out fold, chosen by a hash of the id. Null and blank languages and
    null texts are not learned from. The counts add up in Spark; the driver gets buckets x languages numbers."""
    known = docs.where("lang IS NOT NULL AND trim(lang) <> '' AND doc_id IS NOT NULL").where(~held_out(folds=4, fold=2))
    # the smallest hashes of each language: of parts of a language first, so that no task sorts a whole one
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("h", "doc_id"))
    chosen = known.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).withColumn("part", F.pmod(F.xxhash64("h"), F.lit(parts)))
    for by in (("lang", "part"), ("lang",)):
        chosen = chosen.withColumn("rank", rank(*by)).where(F.col("rank") <= per_language)
    chosen = chosen.select("doc_id", "lang").distinct()
    rows = docs.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"])  # per_language rows of 12 bytes a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[lang] = total.get(lang, 0) + ngram_counts(text)
        for lang, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["lang", "bucket", "n"])

    sums = rows.select("lang", "text").mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = sums.groupBy("lang").agg(F.collect_list("bucket").alias("bucket"), F.collect_list("n").alias("n")).orderBy("lang").collect()
    table = np.full((1 << BUCKETS_LOG2, len(got)), smoothing)
    for j, r in enumerate(got):
        table[r["bucket"], j] += r["n"]
    return [r["lang"] for r in got], (table / table.sum(axis=0)).astype(np.float64)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], penalty: float = 4.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, langs``: prediction, its proportion, and the document's language set.

    One row per input row, repeated ids included. ``und`` with score 0 and an empty set if the text is null
    or has no letter, or if no language was learned. Texts are read whole; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, p = shared.value
        for batch in batches:
            got = [detect(t, languages, p, penalty) for part in slices(iter([batch])) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.list_(pa.string()))],
                ["doc_id", "lang_pred", "score", "langs"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, langs array<string>")
