"""Exact removal of long strings that a document with a smaller id has too.

Minimiser anchors with context hashes, not a suffix order: one anchor, the smallest 24-gram hash, for
each run of 50-byte windows (anchors.py). Spark's sort, which spills to disk, brings equal anchors
together with the hash of the text around them; equal surroundings settle all windows of a run at
once, and only runs whose anchor meets different surroundings are looked at window by window. Both
steps take the keys in passes, so that the disk holds the rows of one pass only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import ODD, WIDTH, Prefixes, gram_hashes, mix, runs
from ..storage import forget, stored
from .common import chunks, n_partitions, text_key

#: Bytes of text whose anchors are found at once, so that the arrays stay in the processor's cache.
BLOCK = 1 << 18
#: Longer texts are cut into pieces that overlap by a window, so that a task's memory is bounded.
PIECE = 1 << 22
#: Rows that a task combines before they are shuffled.
COMBINE = 1 << 19
#: Sorted rows that a task settles at once.
PORTION = 200_000
#: A key with so many different surroundings among these is spread over tasks.
HOT = 64
TAG = 24  # bits of the text's key beside the document id
LAST = np.int64((1 << 63) - 1)
#: Sizes: start and length of a range share a long.
LENGTH_BITS = 24
ROWS = "key bigint, part bigint, id bigint, place bigint"
FOUND = "id bigint, tag bigint, dup boolean, at bigint"
#: The two low bits of a key: what is known of its rows already.
REPEATS, LOOK = np.int64(1), np.int64(2)
#: The place of rows that stand for a spread key where its other rows are.
NOWHERE = np.int64(-1)
SPREAD = np.int64(0x1E3779B97F4A7C15)


def _pieces(ids, tags, texts) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of texts with id, tag and offset of each."""
    block, meta, size = [], [], 0
    for id_, tag, text in zip(ids, tags, texts, strict=True):
        data = text.encode("utf-8", "surrogatepass") if text else b""
        for at in range(0, max(1, len(data) - WIDTH + 1), PIECE):
            block.append(data[at : at + PIECE + WIDTH - 1])
            meta.append((LAST if id_ is None else id_, tag, at))
            size += len(block[-1])
            if size >= BLOCK:
                yield block, *np.array(meta, np.int64).T
                block, meta, size = [], [], 0
    if block:
        yield block, *np.array(meta, np.int64).T


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _first_of_equals(key: np.ndarray, part: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (key, part, id), and in it for each row the place of the first with its key and part. Most keys are
    there once, so only the others are sorted by part and id too."""
    order = np.argsort(key)
    new = np.append(_changes(key[order]), True)
    several = np.flatnonzero(~(new[:-1] & new[1:]))
    if len(several):
        mine = order[several]
        order[several] = mine[np.lexsort((ids[mine], part[mine], key[mine]))]
    new = _changes(key[order], part[order])
    return order, np.flatnonzero(new)[np.cumsum(new) - 1]


def combined(key: np.ndarray, part: np.ndarray, ids: np.ndarray, place: np.ndarray, more: np.ndarray) -> pa.RecordBatch:
    """Rows to shuffle for those of one chunk of text; more is the number of further windows of a row.

    Of equal strings only those of the smallest document stand for all. The others repeat it, whatever
    else there is: neighbouring ones of a text become one row, under a key that spreads them. A key with
    many different surroundings is spread too: its rows will be looked at by window, and two rows that
    are nowhere stand for them under the key itself.
    """
    order, lead = _first_of_equals(key, part, ids)
    key, part, ids, place, more = (x[order] for x in (key, part, ids, place, more))
    repeats = ids > ids[lead]
    kept = ~repeats
    out = []
    k, p, d = key[kept], part[kept], ids[kept]
    if len(k):
        start = np.flatnonzero(_changes(k))
        n = np.diff(np.append(start, len(k)))
        lo, hi = np.minimum.reduceat(d, start), np.maximum.reduceat(d, start)
        hot = (n >= HOT) & (lo < hi)
        spread = np.repeat(hot, n)
        salted = (mix((k ^ p).view(np.uint64)).view(np.int64) & ~(REPEATS | LOOK)) | LOOK
        out.append((np.where(spread, salted, k), p, d, place[kept]))
        for which, low_byte in ((lo, 0xFE), (hi, 0xFF)):  # no row has these as the number of its windows
            out.append((k[start][hot], np.full(hot.sum(), low_byte), which[hot], np.full(hot.sum(), NOWHERE)))
    if repeats.any():
        d, at, m = ids[repeats], place[repeats], more[repeats]
        by_text = np.lexsort((at >> TAG, at & ((1 << TAG) - 1), d))
        d, at, m = d[by_text], at[by_text], m[by_text]
        tag, first = at & ((1 << TAG) - 1), at >> TAG
        end = first + m + 1
        new = _changes(d, tag)
        new[1:] |= first[1:] > end[:-1]
        start = np.flatnonzero(new)
        span = np.maximum.reduceat(end, start) - first[start] - 1
        out.append(((first[start] * SPREAD ^ d[start]) & ~LOOK | REPEATS, span, d[start], at[start]))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], names=["key", "part", "id", "place"])


def anchor_rows(passes: int, number: int):
    """(key, part, id, place) of each run of the pass: 48 bits of the gram's hash; 56 bits of the context's hash and
    the number of windows less one; the document; the first window with the tag."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for part_ in chunks([batch], "text"):
                for texts, ids, tags, offsets in _pieces(*[c.to_pylist() for c in part_.columns]):
                    text, gram, context, first, last = runs(texts, passes=passes, number=number)
                    if not len(text):
                        continue
                    more = last - first
                    key = (gram << np.uint64(16)).view(np.int64)
                    part = ((context << np.uint64(8)) | more.astype(np.uint64)).view(np.int64)
                    held.append((key, part, ids[text], ((first + offsets[text]) << TAG) | tags[text], more))
                    n += len(text)
                    if n >= COMBINE:
                        yield combined(*[np.concatenate(c) for c in zip(*held, strict=True)])
                        held, n = [], 0
        if n:
            yield combined(*[np.concatenate(c) for c in zip(*held, strict=True)])

    return run


def window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, part, id, place) of each window in the ranges to look at: two hashes of its bytes, 126 bits in all."""
    held, n = [], 0
    for batch in chunks(batches, "text"):
        for id_, tag, text, look in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            data = text.encode("utf-8", "surrogatepass")
            packed = np.unique(np.array(look, np.int64))
            start, size = packed >> LENGTH_BITS, packed & ((1 << LENGTH_BITS) - 1)
            groups = np.flatnonzero(_changes(start // BLOCK)).tolist()
            for lo, hi in zip(groups, [*groups[1:], len(start)], strict=True):
                count = size[lo:hi]
                windows = np.repeat(start[lo:hi] - (np.cumsum(count) - count), count) + np.arange(count.sum())
                low = int(windows[0])
                body = data[low : int(windows[-1]) + WIDTH]
                at = windows - low
                key = (Prefixes(body).hashes(at, at + WIDTH) & ~np.uint64(3)).view(np.int64)
                grams = gram_hashes(body)
                part = mix(grams[at] * ODD[2] ^ grams[at + WIDTH - 24]).view(np.int64)
                held.append((key, part, np.full(len(at), LAST if id_ is None else id_, np.int64), (windows << TAG) | tag, np.zeros(len(at), np.int64)))
                n += len(at)
                if n >= COMBINE:
                    yield combined(*[np.concatenate(c) for c in zip(*held, strict=True)])
                    held, n = [], 0
    if n:
        yield combined(*[np.concatenate(c) for c in zip(*held, strict=True)])


def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, part and id, all of one key in one task: runs that repeat a smaller document's (dup), and
    runs whose anchor also meets other surroundings in another document (to be looked at by window).

    A key that goes on over several pieces counts as one with other surroundings: looking more closely
    than needed changes nothing, and so no key is held whole."""
    before: tuple = (None, None, None)
    for (key, part, ids, place), began, goes_on in _portions(batches):
        new = _changes(key, part)
        start = np.flatnonzero(new)
        least = ids[start]
        if began and before[:2] == (key[0], part[0]):
            least[0] = before[2]
        lead = np.repeat(least, np.diff(np.append(start, len(key))))
        before = (key[-1], part[-1], lead[-1])
        known = (key & REPEATS) == REPEATS
        dup = known | (ids > lead)
        first = np.flatnonzero(_changes(key))
        n = np.diff(np.append(first, len(key)))
        others = (np.add.reduceat(new.astype(np.int64), first) > 1) & (np.minimum.reduceat(ids, first) < np.maximum.reduceat(ids, first))
        others[0] |= began
        others[-1] |= goes_on
        look = ~dup & (np.repeat(others, n) | ((key & LOOK) == LOOK))
        out = (dup | look) & (place != NOWHERE)
        more = np.where(known, part, part & 255)
        yield _found(ids[out], place[out], dup[out], np.where(dup, more + WIDTH, more + 1)[out])


def settled_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As settled, for single windows: those that a smaller document has too."""
    before: tuple = (None, None, None)
    for (key, part, ids, place), began, _ in _portions(batches):
        start = np.flatnonzero(_changes(key, part))
        least = ids[start]
        if began and before[:2] == (key[0], part[0]):
            least[0] = before[2]
        lead = np.repeat(least, np.diff(np.append(start, len(key))))
        before = (key[-1], part[-1], lead[-1])
        known = (key & REPEATS) == REPEATS
        dup = (known | (ids > lead)) & (place != NOWHERE)
        yield _found(ids[dup], place[dup], np.ones(int(dup.sum()), bool), np.where(known, part + WIDTH, WIDTH)[dup])


def _found(ids, place, dup, length) -> pa.RecordBatch:
    at = ((place >> TAG) << LENGTH_BITS) | length
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(place & ((1 << TAG) - 1)), pa.array(dup), pa.array(at)], names=["id", "tag", "dup", "at"])


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], bool, bool]]:
    """Columns of about so many sorted rows, cut between keys where there are several, and whether the first key
    began before and the last one goes on."""
    held, n, began = [], 0, False
    for batch in batches:
        held.append([c.to_numpy() for c in batch.columns])
        n += batch.num_rows
        if n < PORTION:
            continue
        cols = [np.concatenate(c) for c in zip(*held, strict=True)]
        end = int(np.searchsorted(cols[0], cols[0][-1], "left"))
        goes_on = not end
        end = end or n
        yield [c[:end] for c in cols], began, goes_on
        held, n, began = ([], 0, True) if goes_on else ([[c[end:] for c in cols]], n - end, False)
    if n:
        cols = [np.concatenate(c) for c in zip(*held, strict=True)]
        yield cols, began, False


def removed_ranges(source: DataFrame, passes: int = 2) -> tuple[DataFrame, str]:
    """(id, tag, ranges): for each text that repeats something, the packed byte ranges to remove; and the folder
    that holds them.

    source: id, tag, text. Each of the passes takes the anchors of its share of the hashes and then, since
    equal windows have equal anchors, the windows to look at that come from these."""
    spark = source.sparkSession
    parts = 4 * n_partitions(spark)

    def by_key(rows: DataFrame, settle, name: str) -> tuple[DataFrame, str]:
        ordered = rows.repartition(parts, "key").sortWithinPartitions("key", "part", "id")
        return stored(ordered.mapInArrow(settle, FOUND), name)

    found, paths = None, []

    def add(rows: DataFrame, path: str) -> None:
        nonlocal found
        dups = rows.where("dup")
        found = dups if found is None else found.unionByName(dups)
        paths.append(path)

    runs_ = []
    for number in range(passes):
        one, path = by_key(source.mapInArrow(anchor_rows(passes, number), ROWS), settled, "runs")
        add(one, path)
        runs_.append(one.where("not dup").withColumn("pass", F.lit(number)))
    looked = runs_[0]
    for one in runs_[1:]:
        looked = looked.unionByName(one)
    names = [f"look{number}" for number in range(passes)]
    looked = looked.groupBy(F.col("id").alias("join_id"), "tag").agg(*[F.collect_list(F.when(F.col("pass") == number, F.col("at"))).alias(name) for number, name in enumerate(names)])
    nullable = source.withColumn("join_id", F.coalesce("id", F.lit(int(LAST))))
    asked, asked_path = stored(nullable.join(looked, ["join_id", "tag"]).select("id", "tag", "text", *names), "looked-at")
    for name in names:
        add(*by_key(asked.where(F.size(name) > 0).select("id", "tag", "text", name).mapInArrow(window_rows, ROWS), settled_windows, "windows"))
    forget(spark, asked_path)
    ranges, path = stored(found.groupBy("id", "tag").agg(F.collect_list("at").alias("ranges")), "ranges")
    forget(spark, *paths)
    return ranges, path


def merge(ranges: list[int]) -> list[tuple[int, int]]:
    if not ranges:
        return []
    packed = np.sort(np.array(ranges, np.int64))
    start, end = packed >> LENGTH_BITS, (packed >> LENGTH_BITS) + (packed & ((1 << LENGTH_BITS) - 1))
    reach = np.maximum.accumulate(end)
    new = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
    return list(zip(start[new].tolist(), reach[np.concatenate([new[1:] - 1, [len(reach) - 1]])].tolist(), strict=True))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, removed_spans, kept) per row of docs: kept is what is left of the text as
    UTF-8 bytes, removed_spans are the maximal removed byte ranges.

    A byte goes when a 50-byte string that covers it also starts in a document with a smaller key; null
    keys count as larger than all others and equal to each other, rows with one key do not act on each
    other. Null texts have no bytes. Strings are judged on the input. Equal rows get equal results. Other
    columns of docs, whatever their names, are not used. Strings count as equal when two independent
    hashes are, of 104 bits together for a run of windows and of 126 for a single one.
    """
    source = docs.select(F.col(f"`{key}`").alias("id"), F.shiftrightunsigned(text_key(F.col(f"`{text}`")), 64 - TAG).alias("tag"), F.col(f"`{text}`").alias("text"))
    found = removed_ranges(source)[0].select(F.col("id").alias("join_id"), F.col("tag").alias("join_tag"), "ranges")
    joined = source.join(found, (F.coalesce(source["id"], F.lit(int(LAST))) == found["join_id"]) & (source["tag"] == found["join_tag"]), "left")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            rows = []
            for id_, value, ranges in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                data = value.encode("utf-8", "surrogatepass") if value else b""
                spans = merge(ranges or [])
                left, at = [], 0
                for start, end in spans:
                    left.append(data[at:start])
                    at = end
                left.append(data[at:])
                kept = b"".join(left)
                rows.append((id_, len(data), len(data) - len(kept), [{"start": a, "end": b} for a, b in spans], kept))
            cols = list(zip(*rows, strict=True))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=[key, "n_bytes", "n_removed", "removed_spans", "kept"])

    return joined.select("id", "text", "ranges").mapInArrow(apply, f"`{key}` bigint, n_bytes bigint, n_removed bigint, removed_spans array<struct<start:bigint,end:bigint>>, kept binary")


def digest(cleaned: DataFrame) -> DataFrame:
    return cleaned.select("doc_id", "n_bytes", "n_removed", F.size("removed_spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
