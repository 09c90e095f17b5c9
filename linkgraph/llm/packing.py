"""Bounded-space online packing of token sequences into windows of one length.

Each partition keeps a fixed number of open windows. A piece goes to the open window that it fills
best; when none has room, a new one is opened while there is a slot, else the fullest is emitted.
What is open at the end of a partition is merged: windows of a bounded number of partitions meet in
one group, are packed again, and so on until one group is left.
"""

from __future__ import annotations

import base64
import json
import os
import re
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import chunks, cut
from .vocabularies import LONG, place

PIECE = "sequence_id bigint, offset bigint, start bigint, length bigint, doc_tokens bigint, token_bytes binary"


def load_encoder(name: str) -> Callable[[list[str]], list[list[int]]]:
    """A function from texts to token ids, for use in the task that calls this. name: a path, or a public vocabulary: a
    .json of tokenizers, or a .tiktoken file of ranks (the same ids, several times as fast), whose added tokens are those of
    the .json beside it. The string of an added token in a text gives its id, and the text on either side is encoded
    apart. Texts with a run of white space beyond LONG characters go to the .json, as the rank encoder gives up on them."""
    path = place(name)
    if not path.endswith(".tiktoken"):
        return _json_encoder(path)
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    json_path = f"{path.removesuffix('.tiktoken')}.json"
    encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=_added_tokens(json_path))
    slow: list[Callable] = []

    def encode(text: str) -> list[int]:
        if not has_long_blank(text):
            return encoding.encode(text, allowed_special="all")
        if not slow:
            slow.append(_json_encoder(json_path))
        return slow[0]([text])[0]

    return lambda texts: [encode(t) for t in texts]


def _json_encoder(path: str) -> Callable[[list[str]], list[list[int]]]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def has_long_blank(text: str) -> bool:
    """Whether a run of white space is longer than LONG."""
    if len(text) <= LONG or len(text) - sum(map(len, text.split())) <= LONG:
        return False
    return any(m.end() - m.start() > LONG for m in re.finditer(r"\s+", text))


def _added_tokens(path: str) -> dict[str, int]:
    """String and id of the tokens that a .json of tokenizers adds to the ranks; none without such a file."""
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as file:
        added = json.load(file)["added_tokens"]
    if any(t[option] for t in added for option in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{path} has added tokens that are more than plain strings")
    return {t["content"]: t["id"] for t in added}


class Packer:
    """Open windows of one partition. A piece is (row, start, doc_tokens, ids)."""

    def __init__(self, size: int, slots: int, min_fragment: int, first_id: int):
        self.size, self.slots, self.min_fragment, self.next_id = size, slots, min_fragment, first_id
        self.room: list[tuple[int, int]] = []  # (room left, window), sorted
        self.content: dict[int, list[tuple]] = {}

    def _take_id(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def add(self, piece: tuple) -> Iterator[tuple[int, list[tuple]]]:
        """Emits the windows that are finished by this piece as (id, pieces)."""
        row, start, total, ids = piece
        while len(ids) >= self.size:
            yield self._take_id(), [(row, start, total, ids[: self.size])]
            start, ids = start + self.size, ids[self.size :]
        while len(ids):
            at = bisect_left(self.room, (len(ids), -1))
            if at < len(self.room):
                room, window = self.room.pop(at)
                self.content[window].append((row, start, total, ids))
                if room > len(ids):
                    insort(self.room, (room - len(ids), window))
                else:
                    yield window, self.content.pop(window)
                return
            if len(self.room) < self.slots:
                window = self._take_id()
                self.content[window] = [(row, start, total, ids)]
                insort(self.room, (self.size - len(ids), window))
                return
            room, window = self.room.pop(0)  # the fullest goes; a cut piece fills it up if that is worth a cut
            if room >= self.min_fragment:
                self.content[window].append((row, start, total, ids[:room]))
                start, ids = start + room, ids[room:]
            yield window, self.content.pop(window)

    def rest(self) -> list[tuple[int, list[tuple]]]:
        out = [(window, self.content[window]) for _, window in self.room]
        self.room, self.content = [], {}
        return out


def pack(docs: DataFrame, encoder_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), size: int = 1024, slots: int = 32, min_fragment: int = 16, end_id: int = 0, fan_in: int = 16) -> DataFrame:
    """One row per piece of a document: the columns in keep, then sequence_id, offset (in the sequence,
    gapless from 0), start (in the document), length, doc_tokens and token_bytes (little-endian unsigned
    32-bit ids).

    A document's ids are those of its text plus end_id; null text counts as empty, so every row has at
    least one id. Each id is in exactly one piece. Memory per task: slots windows of size ids beside one
    batch of texts. Repeated rows are packed each on its own; an empty table gives no rows. The last
    merge cuts freely, so all but one of its windows are full. A column in keep that is named like one
    of a piece is left out; other columns of docs are not used.
    """
    keep = tuple(c for c in keep if c not in T.StructType.fromDDL(PIECE).names)
    named = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    source = docs.select(*named, F.col(text).alias("_text"))
    keys = source.select(*[f"k{i}" for i in range(len(keep))]).schema.fields
    schema = T.StructType([*keys, *T.StructType.fromDDL(PIECE).fields, *T.StructType.fromDDL("closed boolean, origin bigint").fields])
    arrow = to_arrow_schema(schema)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encode, packer = load_encoder(encoder_path), Packer(size, slots, min_fragment, part << 36)
        last = np.array([end_id], "<u4")
        for batch in chunks(batches, "_text"):
            texts = ["" if t is None else t for t in batch.column(batch.schema.get_field_index("_text")).to_pylist()]
            rows = list(zip(*[batch.column(i).to_pylist() for i in range(len(keys))], strict=True)) if keys else [()] * len(texts)
            made = []
            for row, ids in zip(rows, encode(texts), strict=True):
                full = np.concatenate([np.array(ids, "<u4"), last])
                made.extend(packer.add((row, 0, len(full), full)))
            if made:
                yield pa.RecordBatch.from_pylist(list(_rows(made, True, part)), schema=arrow)
        if rest := packer.rest():
            yield pa.RecordBatch.from_pylist(list(_rows(rest, False, part)), schema=arrow)

    def again(level: int, final: bool):
        def merge(group_rows: pa.Table) -> pa.Table:
            rows = sorted(group_rows.to_pylist(), key=lambda r: (r["origin"], r["sequence_id"], r["offset"]))
            group = rows[0]["origin"] // fan_in
            packer, made = Packer(size, 1 if final else slots, 1, (level << 56) + (group << 36)), []
            for r in rows:
                made.extend(packer.add((tuple(r[f.name] for f in keys), r["start"], r["doc_tokens"], np.frombuffer(r["token_bytes"], "<u4"))))
            return pa.Table.from_pylist([*_rows(made, True, group), *_rows(packer.rest(), final, group)], schema=arrow)

        return merge

    packed = cut(source.mapInArrow(first, schema))
    done, open_ = packed.where("closed"), packed.where("not closed")
    parts, level = packed.rdd.getNumPartitions(), 1
    while True:
        final = parts <= fan_in
        merged = open_.groupBy(F.expr(f"origin div {fan_in}").alias("g")).applyInArrow(again(level, final), schema)
        if final:
            done = done.unionByName(merged)
            break
        merged = cut(merged)
        done, open_ = done.unionByName(merged.where("closed")), merged.where("not closed")
        parts, level = -(-parts // fan_in), level + 1
    return done.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *T.StructType.fromDDL(PIECE).names)


def _rows(windows, closed: bool, origin: int) -> Iterator[dict]:
    for window, pieces in windows:
        offset = 0
        for row, start, total, ids in pieces:
            yield {f"k{i}": v for i, v in enumerate(row)} | {"sequence_id": window, "offset": offset, "start": start, "length": len(ids), "doc_tokens": total, "token_bytes": ids.tobytes(), "closed": closed, "origin": origin}
            offset += len(ids)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("token_bytes").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
