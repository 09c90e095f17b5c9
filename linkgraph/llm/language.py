"""Language identification by a byte convolutional network.

Texts are cut into windows of a fixed number of bytes. Filters of several widths slide over a window; each
keeps its highest response (max pooling), and a softmax over the pooled responses gives the probabilities of
the languages. Every byte of a text is in a window, and the windows of a text vote by their probabilities. The
network is trained in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import without_leftovers
from .common import chunks, with_columns_from

#: Bytes of a window, and windows that go through the network together.
WINDOW, BATCH = 128, 64
WIDTHS, FILTERS = (2, 3, 4), 16
#: A-Z as a-z; digits, symbols and control characters as a blank.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


@dataclass
class ByteNetwork:
    """filters: for each width an array (width, 256, FILTERS), the response of each filter to each byte at each place;
    bias: one per filter; out: (filters, languages) and out_bias."""

    langs: list[str]
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def responses(self, windows: np.ndarray) -> Iterator[np.ndarray]:
        """For each width, the response at each place, of each window, of each filter."""
        across = np.ascontiguousarray(windows.T).astype(np.intp)
        for filters in self.filters:
            places = len(across) - len(filters) + 1
            response = filters[0].take(across[:places], axis=0)
            for k in range(1, len(filters)):
                response += filters[k].take(across[k : k + places], axis=0)
            yield response

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Highest response of each filter in each window, and where it starts."""
        best, where = [], []
        for response in self.responses(windows):
            at = response.argmax(axis=0)
            where.append(at)
            best.append(np.take_along_axis(response, at[None], axis=0)[0])
        return np.concatenate(best, axis=1) + self.bias, np.concatenate(where, axis=1)

    def highest(self, windows: np.ndarray) -> np.ndarray:
        """pooled(), without the places: the later half of the places is folded onto the earlier one until one is left."""
        best = []
        for response in self.responses(windows):
            places = len(response)
            while places > 1:
                half = (places + 1) // 2
                np.maximum(response[: places - half], response[half:places], out=response[: places - half])
                places = half
            best.append(response[0])
        return np.concatenate(best, axis=1) + self.bias

    def softmax(self, pooled: np.ndarray) -> np.ndarray:
        scores = np.maximum(pooled, 0) @ self.out + self.out_bias
        scores = np.exp(scores - scores.max(axis=1, keepdims=True))
        return scores / scores.sum(axis=1, keepdims=True)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        return np.concatenate([self.softmax(self.highest(windows[i : i + BATCH])) for i in range(0, len(windows), BATCH)] or [np.zeros((0, len(self.langs)))])


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded windows of all texts, the text of each window, and its bytes. Windows overlap by the widest filter less one,
    so that no place of a filter is lost; the last one is filled up with blanks."""
    step = WINDOW - max(WIDTHS) + 1
    size = np.array([len(t) for t in texts], np.int64)
    count = np.maximum(1, -(-(size - max(WIDTHS) + 1) // step))
    owner = np.repeat(np.arange(len(texts)), count)
    within = (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * step
    data = FOLD[np.frombuffer(b"".join(texts) + b" " * WINDOW, np.uint8)]
    start = (np.cumsum(size) - size)[owner] + within
    windows = data[np.minimum(start[:, None] + np.arange(WINDOW), len(data) - 1)]
    length = np.minimum(WINDOW, size[owner] - within)
    windows[np.arange(WINDOW) >= length[:, None]] = 32
    return windows, owner, length


def fit(windows: np.ndarray, labels: np.ndarray, langs: list[str], epochs: int = 6, rate: float = 0.02, seed: int = 7) -> ByteNetwork:
    """Cross entropy by Adam over shuffled batches. Only the place of a filter's highest response has a gradient."""
    rng = np.random.default_rng(seed)
    n_filters = FILTERS * len(WIDTHS)
    net = ByteNetwork(langs, [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS], np.zeros(n_filters, np.float32), rng.normal(0, 0.3, (n_filters, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32))
    params = [*net.filters, net.bias, net.out, net.out_bias]
    mean, square, steps = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for i in range(0, len(order), BATCH):
            rows = order[i : i + BATCH]
            for at, (p, g) in enumerate(zip(params, gradients(net, windows[rows], labels[rows]), strict=True)):
                mean[at] += 0.1 * (g - mean[at])
                square[at] += 0.001 * (g * g - square[at])
                m, v = mean[at] / (1 - 0.9 ** (steps + 1)), square[at] / (1 - 0.999 ** (steps + 1))
                p -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
            steps += 1
    return net


def gradients(net: ByteNetwork, windows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
    """Of the mean cross entropy, in the order filters, bias, out, out_bias."""
    pooled, where = net.pooled(windows)
    n, active = len(windows), np.maximum(pooled, 0)
    error = net.softmax(pooled)
    error[np.arange(n), labels] -= 1
    error /= n
    back = (error @ net.out.T) * (pooled > 0)
    found = []
    for i, filters in enumerate(net.filters):
        own = slice(i * FILTERS, (i + 1) * FILTERS)
        grad = np.zeros(filters.shape)
        for k in range(len(filters)):
            byte = np.take_along_axis(windows, where[:, own] + k, axis=1).astype(np.int64)
            grad[k] = np.bincount((byte * FILTERS + np.arange(FILTERS)).ravel(), weights=back[:, own].ravel(), minlength=256 * FILTERS).reshape(256, FILTERS)
        found.append(grad)
    return [*found, back.sum(axis=0), active.T @ error, error.sum(axis=0)]


def train(docs: DataFrame, text: str = "text", lang: str = "lang", max_rows: int = 2048, windows_a_row: int = 8, max_langs: int = 256) -> ByteNetwork | None:
    """Fits on the rows with a language and a text, at most max_rows of them, shared out evenly over the languages (the
    max_langs most common ones): of each language those with the smallest hash of their text, with up to windows_a_row
    windows spread over the whole text. Windows, not texts, come to the driver. None without such rows.

    A language's share of hash values that gives a little more than its rows is taken from its count, so that few rows
    are ordered; equal texts are hashed alike, so of those the ordering keeps as many as still fit.
    """
    known = docs.select(F.col(lang).alias("lang"), F.col(text).cast("string").alias("_text")).where("lang is not null and _text is not null and _text <> ''")
    with without_leftovers(docs.sparkSession):
        counts = [tuple(r) for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()]
        if not counts:
            return None
        rows = max(1, max_rows // len(counts))
        span = [(name, int(min(1.0, (1.5 * rows + 100) / n) * (1 << 62)), i) for i, (name, n) in enumerate(sorted(counts))]
        spans = docs.sparkSession.createDataFrame(span, "lang string, span bigint, label int")
        hashed = known.join(F.broadcast(spans), "lang").withColumn("hash", F.xxhash64("_text").bitwiseAND((1 << 62) - 1)).where("hash <= span")
        first = hashed.withColumn("at", F.row_number().over(W.partitionBy("label").orderBy("hash", "_text"))).where(F.col("at") <= rows)
        found = first.select("label", "hash", "_text").mapInArrow(lambda batches: _spread(batches, windows_a_row), "label int, hash bigint, at int, window binary").orderBy("label", "hash", "at", "window").toArrow()
    windows = np.frombuffer(b"".join(found.column("window").to_pylist()), np.uint8).reshape(-1, WINDOW)
    return fit(windows, found.column("label").to_numpy().astype(np.int64), [name for name, _, _ in span])


def _spread(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "_text"):
        windows, owner, _ = windows_of(batch.column(2).cast(pa.binary()).to_pylist())
        count = np.bincount(owner, minlength=batch.num_rows)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        n = count[owner]
        picked = np.flatnonzero((within * most) // n != ((within - 1) * most) // n) if len(n) else within
        labels, hashes = (batch.column(i).to_numpy()[owner[picked]] for i in range(2))
        yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(hashes), pa.array(within[picked].astype(np.int32)), pa.array([w.tobytes() for w in windows[picked]], pa.binary())], names=["label", "hash", "at", "window"])


def identify(docs: DataFrame, net: ByteNetwork | None, text: str = "text") -> DataFrame:
    """docs with lang_pred and score, the mean probability of that language over the bytes of the whole text.

    Null texts, texts without a letter, and all texts where nothing was learned are `und` with score 0. Ties go to the
    first language in order. Columns of docs named like an added one are replaced; repeated rows are handled each on
    its own. The network (some 40,000 numbers) is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def work():
        network = shared.value

        def run(texts):
            raw = [t.encode() if t and any(map(str.isalpha, t)) else None for t in texts]
            lettered = [i for i, t in enumerate(raw) if t is not None] if network else []
            langs, scores = ["und"] * len(texts), [0.0] * len(texts)
            if lettered:
                windows, owner, length = windows_of([raw[i] for i in lettered])
                votes = np.zeros((len(lettered), len(network.langs)))
                for i in range(0, len(windows), BATCH):
                    found = network.softmax(network.highest(windows[i : i + BATCH])) * length[i : i + BATCH, None]
                    np.add.at(votes, owner[i : i + BATCH], found)
                votes /= votes.sum(axis=1, keepdims=True)
                for i, best, value in zip(lettered, votes.argmax(axis=1).tolist(), votes.max(axis=1).tolist(), strict=True):
                    langs[i], scores[i] = network.langs[best], min(1.0, value)
            return [langs, scores]

        return run

    return with_columns_from(docs, text, "lang_pred string, score double", work)


def held_out(key: str = "doc_id") -> Column:
    """The third of the rows that a network may not learn from; null keys belong to it."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def digest(identified: DataFrame) -> DataFrame:
    return identified.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
