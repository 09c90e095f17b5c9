"""Similarity kernels as Column expressions; scores are in [0, 1]."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Thresholds of the accept rule on normalised scores.
ABSOLUTE, RELATIVE = 0.85, 0.085


def ratio(part: Column, whole: Column) -> Column:
    """part / whole; 1 when both are 0."""
    return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(1.0)).cast("double")


def count_ratio(a: Column, b: Column) -> Column:
    return F.when(a == b, 1.0).otherwise(1 - F.abs(a - b) / F.nullif(F.greatest(a, b), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    return ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def flags(a: Column, b: Column, mask: int, divisor: int) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b).bitwiseAND(F.lit(mask))) / F.lit(float(divisor))


def null_rule(a: Column, b: Column, score: Column) -> Column:
    """Both absent: equal; one absent: different; else score."""
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(score)


def both_or_neither(a: Column, b: Column, score: Column) -> Column:
    """The rule for parts that may have no body: one has and the other has not: 0; neither: 1."""
    return null_rule(a, b, score)


def normalised(raw: Column, maximum: float) -> Column:
    return F.pow(raw / F.lit(maximum), F.lit(2.0))


def raw_score(score: Column, maximum: float) -> Column:
    return F.sqrt(score) * F.lit(maximum)


def mismatch_bound(maximum: float, absolute: float = ABSOLUTE, relative: float = RELATIVE) -> float:
    """A pair that misses at least this much of the maximum can neither win nor contest a win."""
    return maximum - (absolute * (1 - relative)) ** 0.5 * maximum


def greedy_pairs(a: str, b: str, score: Callable[[Column, Column], Column]) -> Column:
    """Sum of the scores of a greedy pairing over the longer length: each item of array a takes the best one of b that
    is left, the first on ties, if it scores above 0. Both empty 1, one empty 0."""

    def take(state: Column, x: Column) -> Column:
        left = state["left"]
        best = F.array_max(F.transform(left, lambda y, i: F.struct(score(x, y).cast("double").alias("s"), (-i).alias("at"))))
        hit = F.coalesce(best["s"] > 0, F.lit(False))
        rest = F.when(hit, F.filter(left, lambda y, i: i != -best["at"])).otherwise(left)
        return F.struct(rest.alias("left"), (state["total"] + F.when(hit, best["s"]).otherwise(0.0)).alias("total"))

    total = F.aggregate(a, F.struct(F.col(b).alias("left"), F.lit(0.0).alias("total")), take, lambda state: state["total"])
    return ratio(total, F.greatest(F.size(a), F.size(b)).cast("double"))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length of two strings of symbols; both empty 1, one empty 0."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / F.nullif(longer, F.lit(0)))


def _costs(a: list[str], b: list[str]) -> np.ndarray:
    """0 for equal items, 1 for items of one kind (text before ':') that differ, 2 else."""
    kinds = lambda items: np.array([x.split(":", 1)[0] for x in items], dtype=object)
    x, y = np.array(a, dtype=object), np.array(b, dtype=object)
    return np.where(x[:, None] == y[None, :], 0, np.where(kinds(a)[:, None] == kinds(b)[None, :], 1, 2)).astype(np.int64)


def edit_costs(costs: np.ndarray) -> np.ndarray:
    """Table of least costs of turning prefixes of a into prefixes of b, from the costs of replacing items of a (rows) by
    those of b; a gap costs 2."""
    return edit_tables(costs[None])[0]


def edit_tables(costs: np.ndarray) -> np.ndarray:
    """edit_costs() of many pairs of equal sizes (pair, item of a, item of b) at once."""
    pairs, n, m = costs.shape
    table = np.zeros((pairs, n + 1, m + 1), np.int64)
    table[:, 0], table[:, :, 0] = 2 * np.arange(m + 1), 2 * np.arange(n + 1)
    if n and m:
        steps = 2 * np.arange(m + 1)
        for i in range(1, n + 1):
            row = table[:, i - 1] + 2
            row[:, 1:] = np.minimum(row[:, 1:], table[:, i - 1, :-1] + costs[:, i - 1])
            # gaps along the row: the least of row[j'] + 2 * (j - j') over all j' up to j
            table[:, i] = np.minimum.accumulate(row - steps, axis=1) + steps
    return table


def weighted_similarity(a: list[str], b: list[str]) -> float:
    if not a or not b:
        return float(not a and not b)
    return 1 - float(edit_costs(_costs(a, b))[-1, -1]) / (2 * max(len(a), len(b)))


def partners(costs: np.ndarray) -> list[int]:
    """For each item of a (rows of costs) the place of its partner in b or -1. From the end, the neighbouring cell with the
    least cost is taken: the diagonal on ties, then the item of a is skipped only if that is strictly cheaper.
    A diagonal over items of different kinds is no partnership."""
    return all_partners(costs[None])[0].tolist()


def all_partners(costs: np.ndarray) -> np.ndarray:
    """partners() of many pairs of equal sizes (pair, item of a, item of b) at once."""
    table, (pairs, n, m) = edit_tables(costs), costs.shape
    out, open_ = np.full((pairs, n), -1, np.int32), np.arange(pairs)
    i, j = np.full(pairs, n), np.full(pairs, m)
    while len(open_ := open_[(i[open_] > 0) & (j[open_] > 0)]):
        x, y = i[open_], j[open_]
        diagonal, up, left = table[open_, x - 1, y - 1], table[open_, x - 1, y], table[open_, x, y - 1]
        both = (diagonal <= up) & (diagonal <= left)
        skip = ~both & (up < left)
        met = both & (table[open_, x, y] - diagonal < 2)
        out[open_[met], x[met] - 1] = y[met] - 1
        i[open_] -= both | skip
        j[open_] -= both | ~skip
    return out


def align(a: list[str], b: list[str]) -> list[int]:
    return partners(_costs(a, b)) if a and b else [-1] * len(a)


@F.pandas_udf(T.DoubleType())
def weighted_edit_similarity(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Edit similarity of two arrays of items 'kind:detail'."""
    for a, b in pairs:
        yield pd.Series([None if x is None or y is None else weighted_similarity(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def alignment(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([None if x is None or y is None else align(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype=object)
