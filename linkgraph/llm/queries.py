"""The queries of the corpus operators, as __spark_entry__ registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ann, decontam, importance, language, linetemplates, neardup, oracles, packing, quality, repeats, sharding, toolcalls, warc
from .common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, quality.grades_of(table(spark, sf_dir, "labels")))
    return quality.score(docs, model).select("doc_id", "expected_grade", "p_top", (F.col("p_top") >= quality.MIN_P_TOP).alias("accepted"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), "byte_bpe_50k.tiktoken"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(warc.round_trip(spark, table(spark, sf_dir, "pages")))


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = toolcalls.from_conversations(table(spark, sf_dir, "conversations"))
    return toolcalls.digest(toolcalls.link(messages, {"answer": toolcalls.ANSWER}))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(sharding.shuffle_into_shards(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.digest(decontam.mark_contamination(docs, table(spark, sf_dir, "benchmark")))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, similarity=0.85)


def op9_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linetemplates.digest(linetemplates.drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(repeats.remove_repeats(table(spark, sf_dir, "documents")))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digest(alignment.align(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", "piece_bpe_32k.model"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return importance.digest(importance.resample(docs, target, n=1, buckets=10_000, percent=10, min_words=20, seed=2024))


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    network = language.train(docs.where(~language.held_out()))
    return language.digest(language.identify(docs.select("doc_id", "text"), network))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_packing": op2_packing,
    "op3_warc": op3_warc,
    "op4_tool_calls": op4_tool_calls,
    "op5_sharding": op5_sharding,
    "op6_decontamination": op6_decontamination,
    "op7_nearest": op7_nearest,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_line_templates": op9_line_templates,
    "op10_repeats": op10_repeats,
    "op11_alignment": op11_alignment,
    "op12_importance": op12_importance,
    "op13_language": op13_language,
}
ORACLES: dict[str, str] = {
    "op3_warc": oracles.OP3,
    "op4_tool_calls": oracles.OP4,
    "op6_decontamination": oracles.OP6,
    "op8_near_duplicates": oracles.OP8,
    "op9_line_templates": oracles.OP9,
    "op10_repeats": oracles.OP10,
    "op12_importance": oracles.OP12,
}
