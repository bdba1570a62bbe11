"""Training-corpus pipeline: documents -> packed token windows.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame.  Every stage works on all rows its predecessor kept; its
result is written as Parquet and read again as the next one's ``docs``.  All
but the last return the columns of ``documents``.  Rows with a null doc_id or
null text pass the filters (they have nothing to be judged by) and are packed
as an empty document; rows that repeat a doc_id are one document and stay or
go together; empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm import decontam, linededup, neardup, packing, toxicity
from tallyfold.llm.registry import documents, scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows that score below 0.5; learned from ``labels``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.keep_clean(docs, toxicity.train(docs, labels))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every row; repeated multi-line chunks leave the text, and
    ``n_chars`` follows it."""
    return linededup.dedup(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least doc_id of each near-duplicate class."""
    classes = neardup.near_duplicates(docs, scratch(spark, "pipeline-classes"))
    gone = classes.where("doc_id != class_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows that hold no benchmark item."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents in windows of 1024 ids."""
    return packing.pack_documents(docs, scratch(spark, "pipeline-tokens"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

# The toxicity, near-duplicate and packing stages have no SQL form; the first
# four stages are tested against brute-force versions in tests/llm, packing by
# an exact round trip.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    folder, docs = scratch(spark, "pipeline"), documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.mode("overwrite").parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
