"""Pairs judged by the places that refer to them: instructions of matched callers that are aligned with each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import ratio


def call_site_scores(pairs: DataFrame, sites_a: DataFrame, sites_b: DataFrame, matches: DataFrame, aligned: DataFrame) -> DataFrame:
    """pairs (a, b) with score: of the aligned places that refer to a, the share whose partner refers to b.

    sites_a and sites_b are (src, at, target): instruction at of caller src refers to target. matches (src,
    dst) are the matched callers, aligned (src, dst, at, partner) the partners of their instructions. A caller
    of a, itself aside, that is not matched, or not with a caller of b, is one place without. No place: 1.
    For fields the sites are the reads or the writes, for classes all that names them, for variables the loads,
    stores and increments of matched methods.
    """
    callers = pairs.join(sites_a.select(F.col("target").alias("a"), "src").distinct(), "a").where("not src <=> a")
    theirs = sites_b.select(F.col("target").alias("b"), F.col("src").alias("dst"), F.lit(True).alias("there")).distinct()
    placed = callers.join(matches.select("src", "dst"), "src", "left").join(theirs, ["b", "dst"], "left")
    lost = placed.where("there is null").select("a", "b", F.lit(0).alias("hit"))
    here = sites_a.select(F.col("target").alias("a"), "src", "at").distinct()
    there = sites_b.select(F.col("target").alias("b"), F.col("src").alias("dst"), F.col("at").alias("partner"), F.lit(1).alias("hit")).distinct()
    met = placed.where("there").join(aligned, ["src", "dst"]).join(here, ["a", "src", "at"]).join(there, ["b", "dst", "partner"], "left").select("a", "b", F.coalesce("hit", F.lit(0)).alias("hit"))
    counted = lost.unionByName(met).groupBy("a", "b").agg(F.sum("hit").alias("hits"), F.count("*").alias("n"))
    score = ratio(F.coalesce("hits", F.lit(0)).cast("double"), F.coalesce("n", F.lit(0)).cast("double"))
    return pairs.join(counted, ["a", "b"], "left").select("a", "b", score.alias("score"))
