"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Texts are lower-cased (A-Z only) and split into words; patterns are windows of consecutive words of
the benchmark texts. Over the word sequence of a document the search looks at the block of the last
two words of a possible window: a shift table says how far the window can move on without missing a
pattern, a zero shift leads to the bucket of patterns that end in this block, and these are compared
word by word.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored, without_leftovers, work_dir
from .common import with_columns_from
from .warc import file_system

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
ADDED = "n_words bigint, hit_spans array<struct<start:bigint,end:bigint>>, hit_items array<string>"


def words_of(text: str | None) -> list[bytes]:
    """bytes.lower() changes A-Z alone; the pattern keeps digits, letters and everything beyond ASCII."""
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


class WuManber:
    """Patterns of one length m, given as starts in a sequence of word ids with the item each is from; the id 0 stands
    for any word that no pattern has.

    Tables are a dictionary of shifts and flat arrays: equal patterns are one, found by the block of its
    last two words (m = 1: the word), with the items that hold it next to each other."""

    def __init__(self, flat: np.ndarray, starts: np.ndarray, owners: np.ndarray, m: int, words: int):
        self.m, self.block, self.words = m, min(2, m), words + 1
        self.default = m - self.block + 1
        rows = flat[starts[:, None] + np.arange(m)]
        order = np.lexsort([*rows.T[::-1], self._keys(rows, m)])  # by last block, then by the words
        rows, self.owners = rows[order], array("q", owners[order].tolist())
        new = np.append(True, (rows[1:] != rows[:-1]).any(axis=1))
        first = np.flatnonzero(new)
        self.ends = array("q", np.append(first, len(rows)).tolist())
        self.starts = array("q", starts[order][first].tolist())
        last = self._keys(rows[first], m)
        self.keys = array("q", last.tolist())
        ends = range(self.block, m + 1)
        keys = np.concatenate([self._keys(rows[first], end) for end in ends])
        steps = np.repeat([m - end for end in ends], len(first))
        order = np.lexsort((steps, keys))
        keys, steps = keys[order], steps[order]
        least = np.append(True, keys[1:] != keys[:-1])
        self.shift = dict(zip(keys[least].tolist(), steps[least].tolist(), strict=True))

    def _keys(self, rows: np.ndarray, end: int) -> np.ndarray:
        return rows[:, end - 1] if self.block == 1 else rows[:, end - 2] * self.words + rows[:, end - 1]

    def search(self, ids: list[int], flat: list[int]) -> Iterator[tuple[int, array]]:
        """Start of each occurrence and the numbers of the items that hold the pattern."""
        m, n, shift, default, words = self.m, len(ids), self.shift, self.default, self.words
        factor = 0 if self.block == 1 else words
        at = m - 1
        while at < n:
            last = ids[at]
            if not last:
                at += m
                continue
            key = ids[at - 1] * factor + last
            step = shift.get(key, default)
            if step:
                at += step
                continue
            start, one = at - m + 1, bisect_left(self.keys, key)
            while one < len(self.keys) and self.keys[one] == key:
                o = self.starts[one]
                if ids[start] == flat[o] and ids[start : at + 1] == flat[o : o + m]:
                    yield start, self.owners[self.ends[one] : self.ends[one + 1]]
                    break
                one += 1
            at += 1


class Patterns:
    """Search tables for some benchmark items: one pass for each pattern length."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names, self.flat = [], []
        starts: dict[int, list[np.ndarray]] = {}
        owners: dict[int, list[np.ndarray]] = {}
        for item, words in items:
            m = min(window, len(words))
            count = len(words) - m + 1
            starts.setdefault(m, []).append(len(self.flat) + np.arange(count))
            owners.setdefault(m, []).append(np.full(count, len(self.names)))
            self.names.append(item)
            self.flat.extend(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words)
        flat = np.array(self.flat, np.int64)
        self.passes = [WuManber(flat, np.concatenate(starts[m]), np.concatenate(owners[m]), m, len(self.vocabulary)) for m in sorted(starts)]

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        ids = [self.vocabulary.get(w, 0) for w in words]
        spans, items = [], set()
        for one in self.passes:
            for start, owners in one.search(ids, self.flat):
                spans.append((start, start + one.m))
                items.update(owners)
        return spans, {self.names[i] for i in items}


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def write_blocks(benchmark: DataFrame, item: str, text: str, block_words: int) -> tuple[str, int]:
    """The benchmark in the shared folder, dealt by item into blocks of about block_words words; the folder and the
    number of blocks."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).where("item is not null and text is not null")
    n_words = F.size(F.regexp_extract_all("text", F.lit(r"[0-9A-Za-z\x{80}-\x{10ffff}]+"), 0))
    total = items.agg(F.coalesce(F.sum(n_words), F.lit(0))).first()[0]
    n = max(1, -(-total // block_words))
    path = work_dir(spark, "benchmark")
    with without_leftovers(spark):
        block = F.pmod(F.xxhash64("item"), F.lit(n)).cast("int")
        items.withColumn("block", block).repartition(min(n, 1000), "block").write.partitionBy("block").parquet(path)
    return path, n


#: The tables of the block that a worker used last: they are built once a worker, and there is never a second one.
_TABLES: dict[tuple, Patterns] = {}


def tables_of(path: str, block: int, window: int) -> Patterns:
    if (path, block, window) not in _TABLES:
        _TABLES.clear()
        files, folder = file_system(f"{path}/block={block}")
        found = files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        items = []
        for file in sorted(f.path for f in found if f.path.endswith(".parquet")):
            for batch in pq.ParquetFile(files.open_input_file(file)).iter_batches(columns=["item", "text"]):
                items += [(i, words) for i, t in zip(*[c.to_pylist() for c in batch.columns], strict=True) if (words := words_of(t))]
        _TABLES[path, block, window] = Patterns(items, window)
    return _TABLES[path, block, window]


def mark_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, block_words: int = 500_000) -> DataFrame:
    """docs with n_words, hit_spans (merged, half-open word ranges) and hit_items (sorted as strings).

    The benchmark is dealt into blocks of about block_words words (or one longer item); a task reads one
    block from the shared folder and searches its documents for it, so nothing of the benchmark goes
    through the driver and a task's tables do not grow with it. One block needs no shuffle; of several,
    each has tasks of its own, and the hits meet by document. Null or empty texts have no words and no
    hits. Benchmark rows without an id or without words are left out; rows that share an id are one item.
    Repeated document rows are handled each on its own. Columns of docs named like an added one are replaced.
    """
    path, blocks = write_blocks(benchmark, item_id, item_text, block_words)
    if blocks == 1:
        return with_columns_from(docs, text, ADDED, searcher(path, 0, window))
    names = [c for c in docs.columns if c not in ("n_words", "hit_spans", "hit_items")]
    numbered, _ = stored(docs.select(F.struct(*[docs[f"`{c}`"] for c in names]).alias("_row"), docs[f"`{text}`"].alias("_text"), F.monotonically_increasing_id().alias("_number")), "numbered")
    first, others = with_columns_from(numbered, "_text", ADDED, searcher(path, 0, window)), None
    for block in range(1, blocks):
        found = with_columns_from(numbered.select("_number", "_text"), "_text", ADDED, searcher(path, block, window)).where(F.size("hit_spans") > 0)
        others = found if others is None else others.unionByName(found)
    more = others.groupBy("_number").agg(F.flatten(F.collect_list("hit_spans")).alias("_spans"), F.flatten(F.collect_list("hit_items")).alias("_items"))
    none = lambda c: F.coalesce(c, F.array())
    both = first.join(more, "_number", "left").withColumns({"_spans": none("_spans"), "_items": none("_items")})
    return _joined(both).select("_row.*", "n_words", "hit_spans", "hit_items")


def searcher(path: str, block: int, window: int):
    """Looks for the items of one block of the benchmark."""

    def build():
        patterns = tables_of(path, block, window)

        def work(texts):
            n, spans, items = [], [], []
            for t in texts:
                words = words_of(t)
                hit, owners = patterns.find(words)
                n.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in merged(hit)])
                items.append(sorted(owners))
            return [n, spans, items]

        return work

    return build


def _joined(df: DataFrame) -> DataFrame:
    """Spans and items of earlier blocks and of this one, together."""
    ordered = F.array_sort(F.concat("_spans", "hit_spans"))
    open_end = "aggregate(s, cast(array() as array<struct<start:bigint,end:bigint>>), (acc, x) -> if(size(acc) > 0 and x.start <= element_at(acc, -1).end, concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'end', greatest(x.end, element_at(acc, -1).end)))), concat(acc, array(x))))"
    return df.withColumn("s", ordered).withColumn("hit_spans", F.expr(open_end)).withColumn("hit_items", F.array_sort(F.array_distinct(F.concat("_items", "hit_items")))).drop("s", "_spans", "_items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_share: float = 0.0, **options) -> DataFrame:
    """The rows of docs of whose words more than min_share are hit go; columns stay as they were."""
    text = options.get("text", "text")
    cols = [f"`{c}`" for c in docs.columns]
    packed = docs.select(F.struct(*cols).alias("_row"), F.col(text).alias("_text"))
    marked = mark_contamination(packed, benchmark, **{**options, "text": "_text"})
    hit = F.aggregate("hit_spans", F.lit(0).cast("bigint"), lambda acc, x: acc + x["end"] - x["start"])
    return marked.where((hit == 0) | (hit <= F.lit(min_share) * F.col("n_words"))).select("_row.*")


def digest(marked: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    hit = F.aggregate("hit_spans", F.lit(0).cast("bigint"), lambda acc, x: acc + x["end"] - x["start"])
    return marked.select(
        F.col(doc_id),
        "n_words",
        hit.alias("n_hit"),
        F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )
