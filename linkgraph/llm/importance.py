"""Importance resampling towards a target distribution, over hashed n-grams.

The texts of a batch are joined with a separator that no word holds, one pass of a regular expression finds
all words of the batch, and a binary search in the documents' offsets says whose each word is, so n-grams that
reach over a separator are masked before they are counted. The logarithm of how much likelier a bucket is in
the target than in the corpus is its gain; a document's weight is the sum of the gains of its n-grams, and the
weights with Gumbel noise, ordered, are a sample without replacement.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..storage import stored, without_leftovers
from .common import chunks

#: Bytes of words; joined texts are lower-cased (A-Z) before.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SEPARATOR = b"\0"
#: Words that are in memory at once, whatever the length of a text.
WORDS = 1 << 18
ADDED = "n_words bigint, n_features bigint, weight bigint"


def features(texts: list[bytes | None], n: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For blocks of words of the joined texts: the document of each word, and document and bucket of each n-gram of
    1 to n words that lies within one document. A bucket is the crc32 of the words, joined by blanks, modulo buckets."""
    blob = SEPARATOR.join([t or b"" for t in texts]).lower()
    offsets = np.cumsum([0] + [len(t or b"") + len(SEPARATOR) for t in texts[:-1]])
    found = WORD.finditer(blob)
    tail, tail_owner = [], np.zeros(0, np.int64)
    while block := list(islice(found, WORDS)):
        words = tail + [m.group() for m in block]
        new = np.searchsorted(offsets, np.fromiter((m.start() for m in block), np.int64, len(block)), side="right") - 1
        owner = np.concatenate([tail_owner, new])
        owners, hashes = [], []
        crc: list[int] = []
        for size in range(1, n + 1):
            if size > len(words):
                break
            if size == 1:
                crc = list(map(zlib.crc32, words))
            else:  # crc of the first size - 1 words, carried on over a blank and the next word
                crc = [zlib.crc32(w, zlib.crc32(b" ", c)) for w, c in zip(words[size - 1 :], crc)]
            first, last = owner[: len(crc)], owner[size - 1 :]
            counted = (first == last) & (np.arange(size - 1, len(words)) >= len(tail))  # those before were counted with the last block
            owners.append(first[counted])
            hashes.append(np.array(crc, np.int64)[counted] % buckets)
        yield new, np.concatenate(owners), np.concatenate(hashes)
        keep = min(n - 1, len(words))
        tail, tail_owner = (words[-keep:], owner[-keep:]) if keep else ([], owner[:0])


def bucket_counts(docs: DataFrame, text: str = "text", n: int = 2, buckets: int = 10_000) -> np.ndarray:
    """How many n-grams of docs fall into each bucket. A task gives at most one row per bucket, and so does the sum, so
    what reaches the driver is bounded by buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in chunks(batches, "_text"):
            for _, _, hashes in features(batch.column(0).cast(pa.binary()).to_pylist(), n, buckets):
                total += np.bincount(hashes, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    with without_leftovers(docs.sparkSession):
        rows = docs.select(F.col(text).cast("string").alias("_text")).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(buckets, np.int64)
    counts[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return counts


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares of each bucket, rounded down."""
    S, T_, buckets = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((t + 1) * (S + buckets) / ((s + 1) * (T_ + buckets)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, text: str = "text", n: int = 2) -> DataFrame:
    """docs with n_words, n_features and weight. Null and empty texts have none of them. Columns of docs named like an
    added one are replaced; repeated rows are weighed each on its own."""
    buckets = len(gains)
    shared = docs.sparkSession.sparkContext.broadcast(gains)  # as many numbers as there are buckets
    new = T.StructType.fromDDL(ADDED)
    names = [c for c in docs.columns if c not in new.names]
    kept = docs.select(*[docs[f"`{c}`"].alias(f"k{i}") for i, c in enumerate(names)], docs[f"`{text}`"].cast("string").alias("_text"))
    schema = T.StructType([*kept.schema.fields[:-1], *new.fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.astype(float)
        for batch in chunks(batches, "_text"):
            n_docs, at = batch.num_rows, batch.num_columns - 1
            sums = np.zeros((3, n_docs))
            for words, owner, hashes in features(batch.column(at).cast(pa.binary()).to_pylist(), n, buckets):
                sums += [np.bincount(words, minlength=n_docs), np.bincount(owner, minlength=n_docs), np.bincount(owner, weights=of[hashes], minlength=n_docs)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], *map(pa.array, sums.astype(np.int64))], schema=arrow)

    made = kept.mapInArrow(run, schema)
    return made.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)], *new.names)


def noise(key: str, seed: int) -> F.Column:
    """Thousandths of standard Gumbel noise, rounded down, from the first 32 bits of the SHA-256 of seed and key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("bigint")


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", keep: tuple[str, ...] = ("doc_id",), n: int = 2, buckets: int = 10_000, percent: int = 10, min_words: int = 20, seed: int = 2024) -> DataFrame:
    """The columns of docs in keep with ADDED, score and rank: of the N rows with at least min_words words, the
    floor(percent * N / 100) with the highest scores are drawn and ranked 1, 2, 3, ..., ties to the smaller key; rank is
    null for all others.

    Counts cover all rows and whole texts of both tables. A null key counts as an empty string in the noise and comes
    last among ties; rows that share key and score are ranked in any order. The order is a range partitioned sort, whose
    partitions are numbered from their sizes, so no rows meet in one task; weights are stored before, as the sort samples
    its input. Without rows the result is empty. Only columns in keep go through the sort (the text if it is one of them); one that is named like an added one is left out.
    """
    spark = docs.sparkSession
    gains = gains_of(bucket_counts(docs, text, n, buckets), bucket_counts(target, target_text, n, buckets))
    added = (*T.StructType.fromDDL(ADDED).names, "score", "rank")
    names = [c for c in keep if c not in added]
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in names]).alias("row"), F.coalesce(docs[f"`{key}`"].cast("string"), F.lit("")).alias("_key"), docs[f"`{key}`"].alias("_order"), docs[f"`{text}`"].alias("_text"))
    weighed = weigh(packed, gains, "_text", n).select("row", "_key", "_order", *T.StructType.fromDDL(ADDED).names)
    scored = stored(weighed, "weighed")[0].withColumn("score", F.col("weight") + noise("_key", seed)).withColumn("_in", F.col("n_words") >= min_words)
    ordered = scored.orderBy(F.desc("_in"), F.desc("score"), F.asc_nulls_last("_order")).withColumn("_at", F.monotonically_increasing_id())
    placed, _ = stored(ordered, "scored")
    part, within = F.shiftrightunsigned("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = sorted(tuple(r) for r in placed.where("_in").groupBy(part.cast("int").alias("part")).count().collect())  # one row a partition
    drawn = percent * sum(size for _, size in sizes) // 100
    before = np.cumsum([0] + [size for _, size in sizes]).tolist()
    starts = spark.createDataFrame([(p, b) for (p, _), b in zip(sizes, before)], "_part int, _before bigint")
    rank = F.col("_before") + within + 1
    joined = placed.withColumn("_part", part.cast("int")).join(F.broadcast(starts), "_part", "left")
    return joined.select(*[F.col(f"row.`{c}`") for c in names], *T.StructType.fromDDL(ADDED).names, "score", F.when(F.col("_in") & (rank <= drawn), rank).alias("rank"))


def digest(sampled: DataFrame) -> DataFrame:
    return sampled.select("doc_id", "n_features", "weight", "score", "rank")
