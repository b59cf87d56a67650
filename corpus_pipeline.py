"""From raw documents to packed training sequences: quality, line dedup, near dedup, mixing, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read again
as the next stage's documents; all but the last return the columns of ``documents``. Each stage judges what
its predecessor kept. ``run`` does that in the cluster's shared folder.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import line_dedup, mixing, near_dedup, packing, quality
from quire.llm.queries import MIX_WEIGHTS, tokenizer_path
from quire.llm.shared import Scratch


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more; the model learns from ``labels`` on these documents.

    A row is judged where it stands, so null ids, repeated rows and columns of any name pass through; null
    and empty texts get the model's prior.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_quality(docs, quality.fit_quality(docs, labels))


def fuzzy_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that stand elsewhere before; documents of which nothing is left go.

    ``n_chars`` follows the text; rows that agree in id and text, null and blank texts stay, see
    ``line_dedup.dedup_lines``. Columns of any name pass through.
    """
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")))
    lined = line_dedup.dedup_lines(docs.select("doc_id", "text", rest.alias("rest"))).where("lines_kept > 0 OR lines = 0")
    count = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return lined.select(*(F.col(c) if c in ("doc_id", "text") else count.alias(c) if c == "n_chars" else F.col(f"rest.`{c}`") for c in docs.columns))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five words to a shingle, similarity 0.8 or more.

    The row with the smallest id stays. Rows that repeat an id are judged by their own texts; of rows that
    agree in id and text one stays. Rows without an id all stay, and so do empty and null texts.
    """
    gone = near_dedup.near_duplicates(docs).where("NOT kept").select("doc_id", "text_hash").distinct()
    row = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"))
    row = row.withColumn("apart", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()))
    kept = row.join(gone, ["doc_id", "text_hash"], "left_anti").dropDuplicates(["doc_id", "text_hash", "apart"])
    return kept.select("row.*")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in an order in which every source keeps to its target share for as long as it lasts.

    All rows stay, see ``mixing.mix``. The files and the rows in them are in the mixture's order.
    """
    return mixing.in_order(docs, MIX_WEIGHTS).select(docs.columns)


def cost_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the token sequences, packed among neighbours in the mixture and numbered in its order.

    The order is that of the files that the stage before wrote, and of the rows in them; documents that were
    not read from files are packed as they come. Null texts are their end id alone; every row is packed,
    repeated ones too, see ``packing.pack``.
    """
    try:
        rows = docs.select("doc_id", "text", F.struct("_metadata.file_name", "_metadata.row_index").alias("place"))
    except AnalysisException:  # no files, no places
        return packing.pack(docs, tokenizer_path())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, "place").sortWithinPartitions("place")
    return packing.pack(rows, tokenizer_path())


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", fuzzy_line_dedup),
    ("minhash near dedup", minhash_near_dedup),
    ("source mixing", source_mixing),
    ("packing", cost_packing),
]

#: SQL can express neither the trained classifier nor MinHash and tokenization.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for ``documents`` under ``sf_dir``."""
    scratch, docs = Scratch(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
