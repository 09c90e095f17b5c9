"""Cross-tokenizer alignment by inverted pair bitmaps.

Two tokenizers cut the same bytes; where both end a token, a group ends, and every token of one in a group
is linked with every token of the other. The documents are dealt into blocks. A block holds, for each pair
of ids linked in it, a compressed bitmap of the documents that hold the pair and bitmaps of the bits of its
multiplicities there (planes). Blocks hold different documents, so the OR of a pair's bitmaps is their
concatenation, and its document count is the sum of their popcounts; link counts are popcounts of planes,
weighted by their bits. The counts return to the blocks, where the postings are walked once to give every
document its scores.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..storage import stored
from .common import chunks
from .vocabularies import LONG, byte_level_encoder, byte_level_tokens, piece_model

#: A block of postings is closed at this many UTF-8 bytes of text (or one longer text) or this many documents.
BLOCK_BYTES, BLOCK_DOCS = 8 << 20, 1 << 16
#: Pairs of a block are dealt into segments of this many.
SEGMENT = 1 << 15
#: Pieces of text whose alignment a worker remembers, by number and by characters.
MAX_PIECES, MAX_CHARS = 150_000, 8 << 20
#: Groups with more links than this are counted by distinct ids, not link by link.
SMALL_GROUP = 256
DOCUMENT = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
POSTING = "kind int, block bigint, part int, plane int, a array<int>, b array<int>, n array<int>, bits binary"
CUT = re.compile(r"(?<=\S) (?=\S)")
#: White space but blanks and line breaks, and such pairs of these: a text with one of them is cut by CUT.
UNEVEN = [*(chr(c) for c in range(0x10000) if chr(c).isspace() and chr(c) not in " \n"), "  ", " \n", "\n "]


def pieces_of(text: str) -> list[str]:
    """The text cut at single blanks between other characters. No token of either vocabulary reaches over such a
    blank but as its first byte, so tokens and groups of the pieces, each with a blank before it, are those of the text."""
    if text[:1].isspace() or text[-1:].isspace() or any(u in text for u in UNEVEN):
        return CUT.split(text)
    return text.split(" ")


class _Numbers(dict):
    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self.new.append(piece)
        n = self[piece] = len(self)
        return n


class Pieces:
    """What is aligned inside each piece of text that a worker has met, by its number."""

    def __init__(self, a_name: str, b_name: str):
        self.a_tokens = byte_level_tokens(a_name)
        self.encode_a = byte_level_encoder(a_name, self.a_tokens)
        self.model, self.b_tokens = piece_model(b_name)
        if any(b" " in t.lstrip(b" ") for t in self.b_tokens):
            raise ValueError(f"{b_name} has pieces that go on behind a blank")
        self.a_written, self.b_written = ([np.array([f"{i}{mark}" for i in range(len(tokens))], object) for mark in marks] for tokens, marks in ((self.a_tokens, ",|"), (self.b_tokens, ",;")))
        self.a_lengths, self.b_lengths = (np.array([len(t) for t in tokens]) for tokens in (self.a_tokens, self.b_tokens))
        self.clear()

    def clear(self) -> None:
        self.index, self.chars = _Numbers(), 0
        self.texts: list[str | None] = []  # groups of each piece, each with a semicolon; None where it does not give its own bytes
        self.stats = np.zeros((4, 0), np.int64)  # n_a, n_b, n_groups, n_links
        self.first, self.pair, self.times = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def numbers(self, text: str) -> list[int]:
        return list(map(self.index.__getitem__, pieces_of(text)))

    def full(self) -> bool:
        return len(self.index) > MAX_PIECES or self.chars > MAX_CHARS

    def learn(self) -> None:
        """Aligns the pieces that numbers() has met since the last call."""
        new, self.index.new = self.index.new, []
        if not new:
            return
        self.chars += sum(map(len, new))
        stats, texts, owner, pair, times = self.align(new)
        self.stats = np.concatenate([self.stats, stats], axis=1)
        self.texts += texts
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.bincount(owner, minlength=len(new)))])
        self.pair, self.times = np.concatenate([self.pair, pair]), np.concatenate([self.times, times])

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all pieces on both sides, how many each piece has, and whether it gives its own bytes on both (no ids
        where it does not). Pieces of at most LONG characters go to the byte-level encoder together."""
        raw = [f" {p}".encode() for p in pieces]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        lists_b = self.model.encode(pieces)
        n_b, flat_b = np.fromiter(map(len, lists_b), np.int64, len(raw)), np.fromiter(chain.from_iterable(lists_b), np.int64)
        lists_a: list[list[int]] = []
        at = 0
        while at < len(pieces):
            to, chars = at + 1, len(pieces[at])
            while to < len(pieces) and chars + len(pieces[to]) < LONG // 2:
                chars += 1 + len(pieces[to])
                to += 1
            lists_a.append(self.encode_a(f" {' '.join(pieces[at:to])}"))
            at = to
        flat_a = np.fromiter(chain.from_iterable(lists_a), np.int64)
        whole = b"".join(raw)
        if b"".join([self.a_tokens[i] for i in flat_a.tolist()]) != whole:
            raise ValueError("a byte-level vocabulary must give every text back")
        n_a = np.diff(np.searchsorted(np.cumsum(self.a_lengths[flat_a]), np.append(0, np.cumsum(size)), side="right"))
        owner_b = np.repeat(np.arange(len(raw)), n_b)
        sound = np.bincount(owner_b, weights=self.b_lengths[flat_b], minlength=len(raw)).astype(np.int64) == size
        if not sound.all() or b"".join([self.b_tokens[i] for i in flat_b.tolist()]) != whole:
            sound &= np.array([b"".join([self.b_tokens[i] for i in ids]) == own for ids, own in zip(lists_b, raw, strict=True)], bool)
            flat_a, flat_b = flat_a[np.repeat(sound, n_a)], flat_b[sound[owner_b]]
            n_a, n_b = n_a * sound, n_b * sound
        return flat_a, flat_b, n_a, n_b, sound

    def align(self, pieces: list[str]) -> tuple:
        """Counts and group texts of the pieces, and (piece, pair, times) sorted by piece."""
        flat_a, flat_b, n_a, n_b, sound = self._encode(pieces)
        ends_a, ends_b = np.cumsum(self.a_lengths[flat_a]), np.cumsum(self.b_lengths[flat_b])
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        size_a, size_b = np.bincount(group_a, minlength=len(common)), np.bincount(group_b, minlength=len(common))
        group_owner = np.repeat(np.arange(len(pieces)), n_a)[np.cumsum(size_a) - 1] if len(common) else np.zeros(0, np.int64)
        n_groups = np.bincount(group_owner, minlength=len(pieces))
        n_links = np.zeros(len(pieces), np.int64)
        np.add.at(n_links, group_owner, size_a * size_b)

        written = np.empty(len(flat_a) + len(flat_b), object)
        end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
        for flat, group, before, end, (comma, last) in ((flat_a, group_a, end_b - size_b, end_a, self.a_written), (flat_b, group_b, end_a, end_b, self.b_written)):
            at = np.arange(len(flat))
            written[at + before[group]] = np.where(at + 1 == end[group], last[flat], comma[flat]) if len(flat) else comma[flat]
        ends = np.cumsum(n_a + n_b).tolist()
        texts = ["".join(written[start:end]) if same else None for start, end, same in zip([0, *ends[:-1]], ends, sound.tolist(), strict=True)]

        width, start_b = len(self.b_tokens), end_b - size_b
        small = (size_a * size_b <= SMALL_GROUP)[group_a] if len(common) else np.zeros(0, bool)
        reach = size_b[group_a][small]
        within = np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach)
        to = np.repeat(start_b[group_a][small], reach) + within
        key = (np.repeat(group_owner[group_a][small], reach) << 32) | (np.repeat(flat_a[small], reach) * width + flat_b[to])
        key, times = np.unique(key, return_counts=True)
        found = [(key >> 32, key & 0xFFFFFFFF, times)]
        start_a = end_a - size_a
        for g in np.flatnonzero(size_a * size_b > SMALL_GROUP).tolist():
            ids_a, times_a = np.unique(flat_a[start_a[g] : start_a[g] + size_a[g]], return_counts=True)
            ids_b, times_b = np.unique(flat_b[start_b[g] : start_b[g] + size_b[g]], return_counts=True)
            found.append((np.full(len(ids_a) * len(ids_b), group_owner[g]), (ids_a[:, None] * width + ids_b).ravel(), np.outer(times_a, times_b).ravel()))
        owner, pair, times = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(owner, kind="stable")
        return np.stack([n_a, n_b, n_groups, n_links]), texts, owner[order], pair[order], times[order]


def varints(values: np.ndarray) -> bytes:
    """Seven bits a byte, the lowest first; the top bit says that more follow. Values below 2 ** 21."""
    size = 1 + (values >= 1 << 7) + (values >= 1 << 14)
    out, at = np.zeros(size.sum(), np.uint8), np.cumsum(size) - size
    for k in range(3):
        has = size > k
        out[at[has] + k] = (values[has] >> 7 * k & 127) | np.where(size[has] > k + 1, 128, 0)
    return out.tobytes()


def from_varints(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8).astype(np.int64)
    last = data < 128
    number = np.cumsum(last) - last
    first = np.append(0, np.flatnonzero(last)[:-1] + 1) if len(data) else np.zeros(0, np.int64)
    shift = 7 * (np.arange(len(data)) - first[number])
    return np.bincount(number, weights=(data & 127) << shift, minlength=0).astype(np.int64) if len(data) else data


def pack_bitmaps(pos: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Bitmaps of documents, one for each distinct pos: those pos, their popcounts, and the set bits of all as gaps.
    pos and docs are sorted by both."""
    new = np.append(True, pos[1:] != pos[:-1]) if len(pos) else np.zeros(0, bool)
    gaps = docs - np.where(new, 0, np.append(0, docs[:-1]))
    first = np.flatnonzero(new)
    return pos[first], np.diff(np.append(first, len(pos))), varints(gaps)


def unpack_bitmaps(n: np.ndarray, bits: bytes) -> np.ndarray:
    """The documents of bitmaps with these popcounts, one after another."""
    gaps = from_varints(bits)
    run = np.cumsum(gaps)
    first = np.cumsum(n) - n
    return run - np.repeat(run[first] - gaps[first], n)


def planes_of(pos: np.ndarray, docs: np.ndarray, times: np.ndarray) -> Iterator[tuple]:
    """(plane, pos, popcounts, bits): plane 0 is which documents hold a pair at all, plane k the bit k - 1 of times - 1."""
    yield 0, *pack_bitmaps(pos, docs)
    more, k = times - 1, 1
    while more.any():
        has = more & 1 == 1
        if has.any():
            yield k, *pack_bitmaps(pos[has], docs[has])
        more, k = more >> 1, k + 1


def weight_of(plane):
    """Links that a bit of this plane stands for (a number or a Column)."""
    return F.when(plane == 0, F.lit(1).cast("bigint")).otherwise(F.expr("shiftleft(1L, plane - 1)")) if not isinstance(plane, int) else (1 << plane - 1 if plane else 1)


class Block:
    """Documents on their way into one block of postings."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.owner_sizes, self.numbers, self.bytes = pieces, [], [], 0

    def add(self, text: str | None) -> None:
        numbers = self.pieces.numbers(text) if text else []
        self.owner_sizes.append(len(numbers))
        self.numbers.append(np.array(numbers, np.int32))
        self.bytes += len(text or "")

    def close(self) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Counts and group texts of the documents, and (pair, document, times) sorted by pair and document."""
        self.pieces.learn()
        p, n_docs = self.pieces, len(self.numbers)
        lists = self.numbers
        unsound = np.array([t is None for t in p.texts], bool)
        texts = ["".join([p.texts[i] for i in numbers.tolist()])[:-1] if not unsound[numbers].any() else "" for numbers in lists]
        flat = np.concatenate(lists).astype(np.int64) if lists else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(n_docs), self.owner_sizes)
        bad = np.bincount(owner[unsound[flat]], minlength=n_docs) > 0
        flat, owner = flat[~bad[owner]], owner[~bad[owner]]
        stats = np.zeros((4, n_docs), np.int64)
        for row, values in zip(stats, p.stats, strict=True):
            np.add.at(row, owner, values[flat])
        key, times = np.unique(flat << 16 | owner, return_counts=True)
        piece, doc = key >> 16, key & 0xFFFF
        reach = (p.first[1:] - p.first[:-1])[piece]
        at = np.repeat(p.first[piece], reach) + np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach)
        key, times = p.pair[at] << 16 | np.repeat(doc, reach), p.times[at] * np.repeat(times, reach)
        order = np.argsort(key, kind="stable")
        key, times = key[order], times[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        times = np.add.reduceat(times, first) if len(first) else times
        return stats, texts, key[first] >> 16, key[first] & 0xFFFF, times


_PIECES: dict[tuple[str, str], Pieces] = {}


def pieces_for(a_name: str, b_name: str) -> Pieces:
    """A worker's pieces; they start anew when they are full."""
    if (a_name, b_name) not in _PIECES:
        _PIECES.clear()
        _PIECES[a_name, b_name] = Pieces(a_name, b_name)
    if _PIECES[a_name, b_name].full():
        _PIECES[a_name, b_name].clear()
    return _PIECES[a_name, b_name]


@dataclass
class Alignment:
    """documents: the columns kept, DOCUMENT, n_best and count_sum (and groups, if asked for).
    pairs: a, b, n_docs, n_links and best (whether n_docs is the highest of a's pairs)."""

    documents: DataFrame
    pairs: DataFrame


def align(docs: DataFrame, a_name: str, b_name: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_groups: bool = False) -> Alignment:
    """Aligns a byte-level vocabulary (.json, ids of blank + text) with a sentencepiece model (ids of text, which it
    puts the blank before itself); the vocabularies are paths, or names of public ones, and are opened in the tasks.

    Every row is a document of its own, also where rows repeat. Null and empty texts, and those whose joined token bytes
    of either side are not blank + text, have no tokens: zeros, and '' for the groups. A count is in how many documents
    a pair of ids is linked; n_best are a document's links whose count is the highest of their first id, ties included,
    count_sum the sum of counts over its links. Columns in keep that are named like an added one are left out; no rows give no rows.
    Memory per task: one block (BLOCK_BYTES of text or one longer text) and MAX_PIECES pieces. Broadcast: at most
    one row per id of the first vocabulary.
    """
    spark = docs.sparkSession
    added = [f.name for f in T.StructType.fromDDL(DOCUMENT)] + ["groups"] * with_groups
    keep = tuple(c for c in keep if c not in (*added, "n_best", "count_sum"))
    source = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("_text"))
    keys = source.schema.fields[:-1]
    schema = T.StructType([*T.StructType.fromDDL(POSTING).fields, *keys, *T.StructType.fromDDL(DOCUMENT).fields, T.StructField("groups", T.StringType())])
    arrow = to_arrow_schema(schema)
    n_keys, width = len(keys), len(T.StructType.fromDDL(POSTING))

    def batch(size: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(size, f.type) for f in arrow], schema=arrow)

    def closed(block: Block, rows: list[pa.RecordBatch], number: int) -> Iterator[pa.RecordBatch]:
        stats, texts, pair, doc, times = block.close()
        n, b_size = len(texts), len(block.pieces.b_tokens)
        kept = pa.Table.from_batches(rows).combine_chunks()
        made = {f"k{i}": kept.column(i).chunk(0).cast(arrow[width + i].type) for i in range(n_keys)}
        made |= dict(zip(("n_a", "n_b", "n_groups", "n_links"), map(pa.array, stats), strict=True))
        made["groups_sha256"] = pa.array([hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts])
        if with_groups:
            made["groups"] = pa.array(texts)
        yield batch(n, kind=pa.array(np.zeros(n, np.int32)), block=pa.array(np.full(n, number)), part=pa.array(np.arange(n, dtype=np.int32)), **made)
        pairs, at = np.unique(pair, return_inverse=True)
        for part in range(-(-len(pairs) // SEGMENT)):
            low, high = np.searchsorted(at, [part * SEGMENT, (part + 1) * SEGMENT])
            own = pairs[part * SEGMENT : (part + 1) * SEGMENT]
            for plane, pos, counts, bits in planes_of(at[low:high] - part * SEGMENT, doc[low:high], times[low:high]):
                lists = {"a": own[pos] // b_size, "b": own[pos] % b_size, "n": counts}
                yield batch(1, kind=pa.array([1], pa.int32()), block=pa.array([number]), part=pa.array([part], pa.int32()), plane=pa.array([plane], pa.int32()), bits=pa.array([bits], pa.binary()), **{k: pa.array([v.astype(np.int32)], pa.list_(pa.int32())).cast(arrow.field(k).type) for k, v in lists.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        block, rows = Block(pieces_for(a_name, b_name)), []
        for one in chunks(batches, "_text"):
            texts, start = one.column(n_keys), 0
            for i in range(one.num_rows):
                block.add(texts[i].as_py())
                if block.bytes >= BLOCK_BYTES or len(block.numbers) >= BLOCK_DOCS:
                    yield from closed(block, [*rows, one.slice(start, i + 1 - start)], number)
                    number, start, rows = number + 1, i + 1, []
                    block = Block(pieces_for(a_name, b_name))
            if start < one.num_rows:
                rows.append(one.slice(start))
        if rows:
            yield from closed(block, rows, number)

    rows, path = stored(source.mapInArrow(run, schema), "pair-postings")
    postings = rows.where("kind = 1")
    planes = postings.select("block", "part", "plane", F.posexplode(F.arrays_zip("a", "b", "n")).alias("pos", "x")).select("block", "part", "plane", "pos", "x.a", "x.b", "x.n")
    counted = planes.groupBy("a", "b").agg(F.sum(F.when(F.col("plane") == 0, F.col("n")).cast("bigint")).alias("n_docs"), F.sum(F.col("n") * weight_of(F.col("plane"))).alias("n_links"))
    counts, _ = stored(counted, "pair-counts")
    highest = counts.groupBy("a").agg(F.max("n_docs").alias("highest"))
    pairs = counts.join(F.broadcast(highest), "a").select("a", "b", "n_docs", "n_links", (F.col("n_docs") == F.col("highest")).alias("best"))

    asked = planes.where("plane = 0").join(pairs, ["a", "b"]).select("block", "part", "pos", "a", "b", "n_docs", F.col("best").cast("int").alias("best"))
    bitmaps = spark.read.schema(rows.schema).parquet(path).where("kind = 1").select("block", "part", "plane", "a", "b", "n", "bits")
    returned = asked.groupBy("block", "part").cogroup(bitmaps.groupBy("block", "part")).applyInArrow(walk, "block bigint, part int, n_best bigint, count_sum bigint")
    scores = returned.groupBy("block", "part").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    kept = [F.col(f"k{i}").alias(c) for i, c in enumerate(keep)]
    documents = rows.where("kind = 0").join(scores, ["block", "part"], "left").select(*kept, *added, zero("n_best"), zero("count_sum"))
    return Alignment(documents, pairs)


def walk(counts: pa.Table, postings: pa.Table) -> pa.Table:
    """One segment: its pairs' counts and its bitmaps give (document, n_best, count_sum) of its links."""
    where = np.lexsort((counts.column("b").to_numpy(), counts.column("a").to_numpy()))
    sums, n_docs, best = {}, counts.column("n_docs").to_numpy()[where], counts.column("best").to_numpy()[where]
    key = counts.column("a").to_numpy()[where].astype(np.int64) << 32 | counts.column("b").to_numpy()[where]
    for row in postings.to_pylist():
        n = np.array(row["n"], np.int64)
        docs, at = unpack_bitmaps(n, row["bits"]), np.repeat(np.searchsorted(key, np.array(row["a"], np.int64) << 32 | np.array(row["b"])), n)
        size = docs.max() + 1
        for name, values in (("n_best", best), ("count_sum", n_docs)):
            total = np.bincount(docs, weights=values[at] * weight_of(row["plane"]), minlength=size)
            old = sums.get(name, np.zeros(0))
            sums[name] = np.pad(old, (0, max(0, size - len(old)))) + np.pad(total, (0, max(0, len(old) - size)))
    held = np.flatnonzero(sums["count_sum"]) if sums else np.zeros(0, np.int64)
    made = {"block": np.full(len(held), postings.column("block")[0].as_py() if sums else 0), "part": held.astype(np.int32)}
    return pa.table(made | {name: values[held].astype(np.int64) for name, values in sums.items()} if sums else made | {"n_best": held, "count_sum": held})


def digest(alignment: Alignment) -> DataFrame:
    return alignment.documents.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
