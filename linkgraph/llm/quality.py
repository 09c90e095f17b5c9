"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight per hashed text feature is shared by all grades; ordered thresholds cut the score:
P(grade > k) = sigmoid(score - threshold_k). Expected grade and the probability of the top grades
come from the same score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import forget, stored
from .common import with_columns_from

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Words whose hash a task remembers at once.
CACHE_WORDS = 200_000
#: A document is accepted when its probability of the top grade reaches this.
MIN_P_TOP = 0.75
#: Characters of a stem.
PREFIX = 5
UPPER, LETTER, DIGIT, SYMBOL = (np.zeros(256, bool) for _ in range(4))
UPPER[65:91] = True
LETTER[97:123] = LETTER[65:91] = LETTER[128:] = True
DIGIT[48:58] = True
SYMBOL[[c for c in b"!#$%&*+/<=>?@\\^_`{|}~"]] = True


def featurizer(dims: int) -> Callable[[str | None], np.ndarray]:
    """A function from a text to the sorted distinct indices of its features: its words, their stems (first
    PREFIX characters), and bins of its length, word variety and shares of capitals, digits and symbols."""
    cache: dict[bytes, int] = {}

    def features(text: str | None) -> np.ndarray:
        raw = (text or "").encode("utf-8", "surrogatepass")
        words = WORD.findall(raw.lower())
        distinct = set(words)
        stems = {b"\1" + w.decode("utf-8", "replace")[:PREFIX].encode() for w in distinct if len(w) > PREFIX}
        found = []
        for w in chain(distinct, stems):
            at = cache.get(w)
            if at is None:
                if len(cache) > CACHE_WORDS:
                    cache.clear()
                at = cache[w] = zlib.crc32(w) % dims
            found.append(at)
        counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        letters, n = max(1, counts[LETTER].sum()), max(1, len(raw))
        shape = {
            "length": int(np.log2(n)),
            "variety": int(10 * len(distinct) / max(1, len(words))),
            "upper": int(10 * counts[UPPER].sum() / letters),
            "digit": int(20 * min(0.5, counts[DIGIT].sum() / n)),
            "symbol": int(40 * min(0.25, counts[SYMBOL].sum() / n)),
        }
        found.extend(zlib.crc32(f"\0{k}={v}".encode()) % dims for k, v in shape.items())
        return np.unique(np.array(found, np.int64))

    return features


@dataclass
class OrdinalModel:
    """weights: one per hashed feature; thresholds: ascending, one fewer than the grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    @property
    def dims(self) -> int:
        return len(self.weights)

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for k = 0 .. K-2, one row per score."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds[None, :], -40, 40)))


def likelihood_gradient(model: OrdinalModel, index: np.ndarray, owner: np.ndarray, grades: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the mean negative log likelihood, by weights and by thresholds; owner has the row of each feature in index."""
    n, k = len(grades), len(model.thresholds)
    k_above, k_below = np.maximum(grades - 1, 0), np.minimum(grades, k - 1)
    tails = model.tails(np.bincount(owner, weights=model.weights[index], minlength=n))
    above = np.where(grades == 0, 1.0, tails[np.arange(n), k_above])
    below = np.where(grades == k, 0.0, tails[np.arange(n), k_below])
    p = np.maximum(above - below, 1e-9)
    by_weight = np.bincount(index, weights=((above + below - 1) / n)[owner], minlength=model.dims)
    by_threshold = (np.bincount(k_above, weights=above * (1 - above) / p, minlength=k) - np.bincount(k_below, weights=below * (1 - below) / p, minlength=k)) / n
    return by_weight, by_threshold


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, dims: int, rounds: int = 250, l1: float = 3e-4) -> OrdinalModel:
    """Maximum likelihood with an L1 penalty on the weights, by accelerated proximal gradient steps.

    Each feature's step comes from a diagonal bound of the curvature: half the sum of the row lengths
    in which it occurs.
    """
    weights, thresholds = np.zeros(dims), np.arange(n_grades - 1, dtype=float) - (n_grades - 2) / 2
    if not len(rows):
        return OrdinalModel(weights, np.full(n_grades - 1, -40.0))  # no evidence against any row
    lengths = np.array([len(r) for r in rows])
    n, index, owner = len(rows), np.concatenate(rows), np.repeat(np.arange(len(rows)), lengths)
    step = 2 * n / np.maximum(1, np.bincount(index, weights=lengths[owner] + 1.0, minlength=dims))
    ahead, ahead_t, momentum = weights, thresholds, 1.0
    for _ in range(rounds):
        grad, grad_t = likelihood_gradient(OrdinalModel(ahead, ahead_t), index, owner, grades)
        moved = ahead - step * grad
        moved = np.sign(moved) * np.maximum(0, np.abs(moved) - step * l1)
        moved_t = np.maximum.accumulate(ahead_t - np.clip(grad_t, -1, 1) + np.arange(n_grades - 1) * 1e-9)
        if ((ahead - moved) * (moved - weights)).sum() > 0:
            momentum = 1.0  # the last steps overshot
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = moved + (momentum - 1) / after * (moved - weights)
        ahead_t = np.maximum.accumulate(moved_t + (momentum - 1) / after * (moved_t - thresholds))
        weights, thresholds, momentum = moved, moved_t, after
    return OrdinalModel(weights, thresholds)


def train(docs: DataFrame, ratings: DataFrame, grade: str = "grade", n_grades: int = 3, key: str = "doc_id", text: str = "text", dims: int = 1 << 18, max_rows: int = 8192, max_features: int = 1 << 24) -> OrdinalModel:
    """Fit on at most max_rows rated documents, those with the smallest hash of their key, and of these on as many, in
    that order, as have at most max_features features together.

    Both bounds do not depend on the size of docs; features, not texts, come to the driver. Of rows that share a key, the
    one whose text has the smallest hash is rated. Ratings that are null or outside 0 .. n_grades-1, or without a
    document, are left out; a document rated twice counts twice. Without any rating the model accepts everything.
    """
    order = ["_hash", "_key", "_grade"]
    rated = ratings.select(F.xxhash64(key).alias("_hash"), F.col(key).alias("_key"), F.col(grade).cast("int").alias("_grade")).where(f"_grade between 0 and {n_grades - 1}")
    sample = rated.orderBy(*order).limit(max_rows).groupBy(*order).agg(F.count("*").alias("_times"))
    body = F.col(text)
    joined = docs.select(F.col(key).alias("_key"), body.alias("_text")).join(F.broadcast(sample), "_key")
    one_each = joined.groupBy(*order, "_times").agg(F.min_by(F.struct("_text"), F.struct(F.xxhash64("_text"), "_text")).alias("_one")).select(*order, "_times", F.col("_one._text").alias("_text"))

    def work():
        features = featurizer(dims)
        return lambda texts: [[features(t).tolist() for t in texts]]

    made, path = stored(with_columns_from(one_each, "_text", "features array<int>", work).select(*order, "_times", "features"), "rated")
    sizes = made.select(*order, (F.size("features") * F.col("_times")).alias("n")).orderBy(*order).toArrow().to_pylist()  # at most max_rows rows
    total, last = 0, None
    for row in sizes:
        total += row["n"]
        if total > max_features:
            break
        last = (row["_hash"], row["_key"], row["_grade"])
    if len(sizes) and total > max_features:
        made = made.where(F.struct(*order) <= F.struct(*[F.lit(v) for v in last]) if last else F.lit(False))
    rows = made.orderBy("_key", "_grade").toArrow()
    forget(docs.sparkSession, path)
    features = rows.column("features").combine_chunks()
    flat, ends = features.flatten().to_numpy().astype(np.int64), features.offsets.to_numpy() if len(rows) else np.zeros(1, int)
    times, grades = (rows.column(c).to_numpy().astype(int).tolist() for c in ("_times", "_grade"))
    lists = [flat[a - ends[0] : b - ends[0]] for a, b, n in zip(ends[:-1], ends[1:], times, strict=True) for _ in range(n)]
    return fit_ordinal(lists, np.repeat(np.array(grades, int), times), n_grades, dims)


def score(docs: DataFrame, model: OrdinalModel, text: str = "text") -> DataFrame:
    """docs with expected_grade and p_top, the probability of the highest grade.

    Whole texts count; null and empty texts get the score of a text without words. Columns of docs
    named like an added one are replaced. The weights are broadcast: dims numbers, whatever the input.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))

    def work():
        weights, thresholds = shared.value
        model, features = OrdinalModel(weights, thresholds), featurizer(len(weights))

        def run(texts):
            tails = model.tails(np.array([weights[features(t)].sum(dtype=float) for t in texts]))
            return [tails.sum(axis=1).tolist(), tails[:, -1].tolist()]

        return run

    return with_columns_from(docs, text, "expected_grade double, p_top double", work)


def grades_of(labels: DataFrame) -> DataFrame:
    """Grades from the labels table: 0 junk, 1 readable but toxic, 2 clean; null where a label is missing."""
    return labels.select("doc_id", F.expr("case when quality is null or toxic is null then null when quality = 0 then 0 when toxic = 1 then 1 else 2 end").alias("grade"))


def select(scored: DataFrame, min_p_top: float = MIN_P_TOP) -> DataFrame:
    return scored.where(F.col("p_top") >= min_p_top)
