"""Nearest neighbours by cosine through an inverted multi-index.

Both halves of the normalised vectors are quantised apart, so K centroids a half make K * K cells. A
query takes cells in the order of the summed distance of their two centroids, from a heap, until they
hold a given share of all vectors, and reranks what is in them by the exact cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import without_leftovers, work_dir
from .common import cut, n_partitions
from .warc import file_system

ENTRY = "entry bigint, embedding array<double>, ids array<bigint>"


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(vec_id, embedding as doubles) of the vectors that take part, repeated rows once."""
    numbers = F.col(f"`{column}`").cast("array<double>")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col(f"`{key}`").alias("vec_id"), numbers.alias("embedding")).where("vec_id is not null and embedding is not null").where(finite).where(some)
    return rows.withColumn("entry", F.xxhash64("embedding")).dropDuplicates(["entry", "vec_id", "embedding"])


def scaled(matrix: np.ndarray) -> np.ndarray:
    """Rows times powers of two, such that squares of tiny and huge numbers stay in the range of doubles; it changes
    no cosine, as it changes no digit."""
    return np.ldexp(matrix, -np.frexp(np.abs(matrix).max(axis=1, initial=0.0))[1][:, None])


def normalised(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def centroids_for(n: int) -> int:
    """Centroids of each half for an index of n entries: cells grow with the root of n, so that they neither fill up
    nor become more than a driver can count."""
    return int(min(1024, max(64, 4 * n**0.25)))


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x**2).sum(axis=1)[:, None] - 2 * x @ centroids.T + (centroids**2).sum(axis=1)[None, :]


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    centroids = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = squared(x, centroids).argmin(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centroids))[:, None]
        centroids = np.where(n > 0, sums / np.maximum(n, 1), centroids)
    return centroids


def cells_in_order(a: np.ndarray, b: np.ndarray, counts: np.ndarray, wanted: int) -> list[int]:
    """Cells (i * len(b) + j) by ascending a[i] + b[j] until they hold wanted vectors; empty cells are passed.

    The heap holds the next pairs only: one more on either side of a pair that was taken."""
    by_a, by_b, k = np.argsort(a, kind="stable"), np.argsort(b, kind="stable"), len(b)
    da, db = a[by_a].tolist(), b[by_b].tolist()
    heap, seen, out, held = [(da[0] + db[0], 0, 0)], {(0, 0)}, [], 0
    while heap and held < wanted:
        _, i, j = heappop(heap)
        cell = int(by_a[i]) * k + int(by_b[j])
        if counts[cell]:
            out.append(cell)
            held += counts[cell]
        for ni, nj in ((i + 1, j), (i, j + 1)):
            if ni < len(da) and nj < len(db) and (ni, nj) not in seen:
                seen.add((ni, nj))
                heappush(heap, (da[ni] + db[nj], ni, nj))
    return out


def best_of_cells(queries: np.ndarray, visits: list[np.ndarray], matrix: np.ndarray, cells: np.ndarray, lead: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
    """(query, row of matrix, cosine) of each query's k nearest rows in the cells it visits; rows are sorted by
    cell; equal cosines go by lead, the smallest id of a row.

    Block products find who can be among the k; the cosines of these are then summed pair by pair, the
    same way whatever the blocks."""
    norms = np.linalg.norm(matrix, axis=1)
    lengths = np.linalg.norm(queries, axis=1)
    asked: dict[int, list[int]] = {}
    for q, visited in enumerate(visits):
        for cell in visited.tolist():
            asked.setdefault(cell, []).append(q)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for cell, qs in asked.items():
        lo, hi = np.searchsorted(cells, [cell, cell + 1])
        if lo == hi:
            continue
        score = queries[qs] @ matrix[lo:hi].T / (lengths[qs][:, None] * norms[lo:hi][None, :])
        if hi - lo > k:
            limit = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
            at, row = np.nonzero(score >= limit - 1e-9)
        else:
            at, row = np.indices(score.shape).reshape(2, -1)
        found.append((np.array(qs)[at], row + lo, score[at, row]))
    if not found:
        return
    q, row, score = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((-score, q))
    q, row, score = q[order], row[order], score[order]
    first = np.searchsorted(q, q, "left")
    least = np.full(len(queries), -np.inf)
    least[q[np.arange(len(q)) - first == k - 1]] = score[np.arange(len(q)) - first == k - 1]
    near = score >= least[q] - 1e-9
    q, row = q[near], row[near]
    score = np.einsum("ij,ij->i", queries[q], matrix[row]) / (lengths[q] * norms[row])
    order = np.lexsort((lead[row], -score, q))
    q, row, score = q[order], row[order], score[order]
    first = np.searchsorted(q, q, "left")
    keep = np.arange(len(q)) - first < k
    yield from zip(q[keep].tolist(), row[keep].tolist(), score[keep].tolist(), strict=True)


def nearest(vectors: DataFrame, queries: F.Column | None = None, key: str = "vec_id", column: str = "embedding", k: int = 5, centroids: int | None = None, share: float | None = None, sample: int = 16384, shard_rows: int = 8192) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): each query's k nearest others among all vectors, by cosine.

    queries is a condition on vec_id (default: divisible by 50). Vectors that are null or zero or hold
    null or non-finite numbers take no part, nor do rows without an id or of another length than most.
    Rows that share the query's id are its own. Ties go to the smaller id; fewer candidates give fewer rows.

    Equal vectors are one index entry with their k + 1 smallest ids, which are all that a result can show,
    so a vector that a third of the rows hold is no hot cell. Centroids are fitted on at most sample
    entries, those with the smallest hash; every entry is indexed. Index shards have about shard_rows
    entries; a cell with more is spread over several shards. The share of vectors that a query visits sets the
    recall; by default it visits n ** 0.9 of n, which is what isotropic vectors of 64 dimensions need for 0.9
    (they have no near neighbours to speak of); clustered ones need less. Each half has centroids centroids, by default more the more entries there are.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, key, column)
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("embedding") == sizes["d"])
    half, same = (sizes["d"] + 1) // 2, W.partitionBy("entry", "embedding").orderBy("vec_id")
    few = rows.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1)
    entries = cut(few.groupBy("entry", "embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))

    fitted = normalised(_matrix(entries.orderBy("entry").limit(sample).select("embedding").toArrow().column(0).combine_chunks()))
    centroids = centroids or centroids_for(entries.count())
    books = [k_means(fitted[:, :half], centroids), k_means(fitted[:, half:], centroids) if sizes["d"] > 1 else np.zeros((1, 0))]
    shared = spark.sparkContext.broadcast(books)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = normalised(_matrix(batch.column(1)))
            cell = squared(unit[:, :half], first).argmin(axis=1) * len(second) + squared(unit[:, half:], second).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], names=[*batch.schema.names, "cell"])

    placed = cut(entries.mapInArrow(place, f"{ENTRY}, cell int"))
    per_cell = placed.groupBy("cell").count().collect()  # at most centroids squared rows
    counts = np.zeros(len(books[0]) * len(books[1]), np.int64)
    for r in per_cell:
        counts[r["cell"]] = r["count"]
    total = int(counts.sum())
    shards = max(1, -(-total // shard_rows))
    spread = spark.createDataFrame([(r["cell"], -(-r["count"] // shard_rows)) for r in per_cell], "cell int, parts int")
    folder = f"{work_dir(spark, 'multi-index')}/entries"
    part = F.pmod(F.col("entry"), F.col("parts")).cast("int")
    sharded = placed.join(F.broadcast(spread), "cell").withColumn("shard", F.pmod(F.xxhash64("cell", part), F.lit(shards)).cast("int"))
    with without_leftovers(spark):
        sharded.repartition(shards, "shard").sortWithinPartitions("shard", "cell").write.partitionBy("shard").parquet(folder)
    where = {}
    for s in spread.select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p")).select("cell", F.pmod(F.xxhash64("cell", "p"), F.lit(shards)).cast("int").alias("shard")).distinct().collect():
        where.setdefault(s["cell"], []).append(s["shard"])
    routes = spark.sparkContext.broadcast((counts, where))

    asked = rows.where(F.col("vec_id") % 50 == 0 if queries is None else queries).select("vec_id", "entry", "embedding")
    wanted = int(np.ceil(total**0.9 if share is None else share * total))

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (first, second), (counts, where) = shared.value, routes.value
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = normalised(_matrix(batch.column(1)))
            a, b = squared(unit[:, :half], first), squared(unit[:, half:], second)
            made = []
            for i, (entry, vector) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                by_shard: dict[int, list[int]] = {}
                for cell in cells_in_order(a[i], b[i], counts, wanted):
                    for shard in where[cell]:
                        by_shard.setdefault(shard, []).append(cell)
                made.extend({"shard": s, "entry": entry, "embedding": vector, "cells": cells} for s, cells in by_shard.items())
                if len(made) > 2000:
                    yield pa.RecordBatch.from_pylist(made, schema=_ROUTED)
                    made = []
            if made:
                yield pa.RecordBatch.from_pylist(made, schema=_ROUTED)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = file_system(folder)
        shard, index = None, None
        for batch in batches:
            number = batch.column(0).to_numpy()
            for s in np.unique(number):
                if s != shard:
                    shard, index = s, _load(files, f"{path}/shard={s}")
                mine = batch.filter(pa.array(number == s))
                matrix, cells, ids = index
                lead = np.array([x[0] for x in ids])
                out = []
                for at in range(0, mine.num_rows, 1024):
                    block = mine.slice(at, 1024)
                    names, visits = block.column(1).to_pylist(), [np.array(c) for c in block.column(3).to_pylist()]
                    for q, row, score in best_of_cells(_matrix(block.column(2)), visits, matrix, cells, lead, k + 1):
                        out.extend((names[q], vec_id, score) for vec_id in ids[row])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)] if out else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], names=["entry", "vec_id", "score"])

    # by number: what the traversal costs does not show in the bytes of the queries
    spread_out = asked.select("entry", "embedding").repartition(2 * n_partitions(spark), "entry").dropDuplicates(["entry"])
    routed = spread_out.mapInArrow(traverse, "shard int, entry bigint, embedding array<double>, cells array<int>")
    hits = routed.repartition(2 * shards, "shard", F.pmod(F.col("entry"), F.lit(4))).sortWithinPartitions("shard").mapInArrow(search, "entry bigint, vec_id bigint, score double")
    best = W.partitionBy("entry").orderBy(F.desc("score"), "vec_id")
    top = hits.distinct().withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n")
    pairs = asked.select(F.col("vec_id").alias("query_id"), "entry").distinct().join(top, "entry").where("query_id <> vec_id")
    order = W.partitionBy("query_id", "entry").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


_ROUTED = pa.schema([("shard", pa.int32()), ("entry", pa.int64()), ("embedding", pa.list_(pa.float64())), ("cells", pa.list_(pa.int32()))])


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return scaled(flat.reshape(len(column), -1))


def _load(files: fs.FileSystem, path: str) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """Vectors, cells and ids of one index shard, sorted by cell."""
    found = [f.path for f in files.get_file_info(fs.FileSelector(path)) if f.path.endswith(".parquet")]
    table = pa.concat_tables([pq.ParquetFile(files.open_input_file(f)).read(["cell", "embedding", "ids"]) for f in sorted(found)]).sort_by("cell").combine_chunks()
    return _matrix(table.column("embedding").chunk(0)), table.column("cell").to_numpy(), table.column("ids").to_pylist()
