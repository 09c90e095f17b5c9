"""A corpus pipeline of five stages: quality, recurring lines, near-duplicates, benchmark passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkgraph.llm import decontam, linetemplates, neardup, packing, quality
from linkgraph.llm.common import table
from linkgraph.storage import work_dir


def as_row(docs: DataFrame) -> DataFrame:
    """row, with the columns of docs under their own names, beside the id and the text: what a stage adds clashes with
    none of them."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != "text"]).alias("row"), "doc_id", "text")


def unpacked(rows: DataFrame, like: DataFrame, **changed: F.Column) -> DataFrame:
    """The columns of like from what as_row() made, but for changed ones."""
    changed["text"] = F.col("text")
    return rows.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in like.columns])


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose probability of the top grade is low (junk, toxic ones)."""
    model = quality.train(docs.select("doc_id", "text"), quality.grades_of(table(spark, sf_dir, "labels")))
    return unpacked(quality.select(quality.score(as_row(docs), model)), docs)


def without_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines of recurring templates out of the texts; n_chars follows, and texts left without a word go."""
    cleaned = linetemplates.drop_recurring_lines(as_row(docs))
    lost = F.col("n_dropped") > 0
    kept = cleaned.where(~lost | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    n_chars = F.when(lost, F.length("text").cast("bigint")).otherwise(F.col("row.n_chars"))
    return unpacked(kept, docs, n_chars=n_chars)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group linked by 5-word shingles at 0.8."""
    return neardup.drop_near_duplicates(docs).select(docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a window of a benchmark item."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of the documents."""
    return packing.pack(docs, "byte_bpe_50k.tiktoken")


STAGES = [
    ("quality", good_documents),
    ("line dedup", without_recurring_lines),
    ("near-duplicates", one_of_near_duplicates),
    ("decontamination", without_benchmark),
    ("packing", packed),
]
#: The classifier and the packing order are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = work_dir(spark, "corpus")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = f"{folder}/{i}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
