"""Weighted scoring of candidate pairs, the accept rule and one-to-one selection."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.similarity import ABSOLUTE, RELATIVE, mismatch_bound, normalised
from ..storage import keep

LEVELS = ("initial", "intermediate", "full", "extra")


@dataclass(frozen=True)
class Scorer:
    """A similarity function: a name, a weight, the levels at which it counts, and its score as a Column."""

    name: str
    weight: float
    score: Callable[[], Column]
    levels: tuple[str, ...] = LEVELS


@dataclass
class Registry:
    scorers: list[Scorer] = field(default_factory=list)

    def add(self, scorer: Scorer) -> None:
        if any(s.name == scorer.name for s in self.scorers):
            raise ValueError(f"a scorer named {scorer.name} is registered")
        self.scorers.append(scorer)

    def at(self, level: str) -> list[Scorer]:
        return [s for s in self.scorers if level in s.levels]

    def maximum(self, level: str) -> float:
        return float(sum(s.weight for s in self.at(level)))


def score_pairs(pairs: DataFrame, scorers: list[Scorer], bound: float | None = None, results: bool = True) -> DataFrame:
    """pairs with raw, the weighted sum of scores, and, where asked for, results, the scores by name.

    With bound, pairs whose missed weight reaches it go; the missed weight only grows, so it is tested
    after each scorer, cheap ones first, and later scorers see fewer pairs."""
    missed = F.lit(0.0)
    out = pairs
    for i, s in enumerate(scorers):
        out = out.withColumn(f"_s{i}", s.score().cast("double"))
        missed = missed + F.lit(float(s.weight)) * (1 - F.col(f"_s{i}"))
        if bound is not None:
            out = out.where(missed < bound)
    raw = sum((F.lit(float(s.weight)) * F.col(f"_s{i}") for i, s in enumerate(scorers)), F.lit(0.0))
    if not results:
        return out.withColumn("raw", raw).drop(*[f"_s{i}" for i in range(len(scorers))])
    by_name = F.array(*[F.struct(F.lit(s.name).alias("name"), F.col(f"_s{i}").alias("score"), F.lit(float(s.weight)).alias("weight")) for i, s in enumerate(scorers)])
    return out.withColumn("raw", raw).withColumn("results", by_name).drop(*[f"_s{i}" for i in range(len(scorers))])


def rank(scored: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """rank from 1 within each source, by raw descending, ties by target."""
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(src).orderBy(F.desc("raw"), dst)))


def accept(scored: DataFrame, maximum: float, absolute: float = ABSOLUTE, relative: float = RELATIVE, src: str = "a", dst: str = "b") -> DataFrame:
    """The best candidate of a source when it reaches absolute and the second stays below (1 - relative) of it.

    Only the two best of a source are looked at, which Spark limits before it shuffles."""
    w = W.partitionBy(src).orderBy(F.desc("raw"), dst)
    two = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 2).withColumn("score", normalised(F.col("raw"), maximum))
    best = two.groupBy(src).agg(
        F.max_by(dst, -F.col("rank")).alias(dst),
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("score"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"),
    )
    return best.where((F.col("score") >= absolute) & (F.col("second").isNull() | (F.col("second") < F.col("score") * (1 - relative))))


def contest_bound(maximum: float, absolute: float = ABSOLUTE, relative: float = RELATIVE) -> float:
    """The raw score below which a candidate can neither be accepted nor keep another from being so."""
    return maximum * (absolute * (1 - relative)) ** 0.5 - 1e-6


def without_conflicts(accepted: DataFrame, dst: str = "b") -> DataFrame:
    """Drops every pair whose target was chosen by more than one source. What was accepted is looked at twice and therefore
    kept, not computed again."""
    accepted = keep(accepted)
    chosen = accepted.groupBy(dst).agg(F.count("*").alias("_n")).where("_n = 1").select(dst)
    return accepted.join(chosen, dst, "left_semi")


def perfect(scored: DataFrame, maximum: float, src: str = "a", dst: str = "b", tolerance: float = 1e-6) -> DataFrame:
    """The best candidate when it reaches the maximum and the second does not; a target chosen once."""
    top = maximum - tolerance
    winners = scored.where(F.col("raw") >= top).groupBy(src).agg(F.count("*").alias("_n"), F.min(dst).alias(dst), F.max("raw").alias("raw")).where("_n = 1").drop("_n")
    return without_conflicts(winners, dst)


def bound(maximum: float) -> float:
    return mismatch_bound(maximum)
