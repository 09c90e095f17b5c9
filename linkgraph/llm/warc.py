"""WARC archives with a two-level capture index.

Records are written as one gzip member each. The index sorts reversed-host URL keys into compressed
blocks of lines; each index file ends with a sparse directory (first key and place of each block).
A look-up finds the file by its key range, the block by binary search in the directory, the captures
by binary search in the block, and then reads just the records' byte ranges from the archives.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import work_dir
from .common import chunks, cut, n_partitions

#: Groups of equal payloads are broadcast up to this many (some 40 MB); beyond it pages are joined with a shuffle.
BROADCAST_ROWS = 500_000
#: Files of an index, whose bounds every task has in memory.
MOST_FILES = 100_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "url_key string, page_id bigint, archive string, offset bigint, length bigint"
RECORD = "page_id bigint, url string, record_type string, refers_to bigint, declared_digest string, declared_bytes bigint, payload binary"


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def url_key(url: str | None) -> str:
    """Host labels from the last to the first, then path and query: com,example,www)/path?query. Scheme,
    fragment, user, a leading www and default ports do not count. What is no URL is its own key."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return (url or "").strip()
    if not host:
        return (url or "").strip()
    port_text = f":{port}" if port and (parts.scheme, port) not in (("http", 80), ("https", 443)) else ""
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{port_text}){parts.path or '/'}{query}"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = re.sub(r"[\r\n]", "", url) if url is not None else None
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    head += [f"WARC-Target-URI: {target}"] if target is not None else []
    head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"] if revisit else []
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    number = lambda name: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(name, ""))) else None
    revisit = fields["WARC-Type"] == "revisit"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    return {"page_id": number("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To"), "declared_digest": digest, "declared_bytes": length, "payload": None if revisit else payload}


def with_revisits(pages: DataFrame, min_bytes: int) -> DataFrame:
    """page_id, url, payload, digest, refers_to: of equal payloads of at least min_bytes the largest page_id is
    the response. A payload that pages without an id alone have is a response each time.

    Who revisits whom is found without the payloads. These then meet it by page, or by a broadcast of what
    is known to be small, so that copies of one page never meet; small payloads are not joined at all."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", body.alias("payload"), F.sha1(body).alias("digest"))
    large = F.octet_length("payload") >= min_bytes
    named = rows.where(large).select("page_id", "digest")
    groups = named.groupBy("digest").agg(F.max("page_id").alias("best"), F.count("*").alias("n")).where("n > 1 and best is not null").select("digest", "best")
    groups = cut(groups)
    if groups.count() <= BROADCAST_ROWS:
        found = rows.where(large).join(F.broadcast(groups), "digest", "left")
    else:
        by_page = named.join(groups, "digest").where("not page_id <=> best").distinct().select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "best")
        found = rows.where(large).join(by_page, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left")
    revisits = F.expr("case when page_id <=> best then null else best end")
    columns = ["page_id", "url", "payload", "digest"]
    return found.select(*columns, revisits.alias("refers_to")).unionByName(rows.where(~large).select(*columns, F.lit(None).cast("bigint").alias("refers_to")))


def write_archives(rows: DataFrame, root: str, level: int = 4, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = 256 << 20) -> DataFrame:
    """Writes one gzip member per row to archives under root; returns where each is (CAPTURE).

    A task that runs again writes files of another name, and only those of the task that counted are
    in the result, which is kept in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = file_system(root)
        files.create_dir(folder, recursive=True)
        name, out, size, number = "", None, 0, 0
        for batch in chunks(batches, "payload"):
            made = []
            for page_id, url, payload, digest, refers_to in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if out is None or size >= archive_bytes:
                    if out is not None:
                        out.close()
                    name = f"part-{TaskContext.get().partitionId():05d}-{number}-{uuid.uuid4().hex}.warc.gz"
                    out, size, number = files.open_output_stream(f"{folder}/{name}", compression=None), 0, number + 1
                member = gzip.compress(record_bytes(page_id, url, payload, digest, refers_to, date), level, mtime=0)
                out.write(member)
                made.append({"url_key": url_key(url), "page_id": page_id, "archive": name, "offset": size, "length": len(member)})
                size += len(member)
            if made:
                yield pa.RecordBatch.from_pylist(made, schema=_CAPTURES)
        if out is not None:
            out.close()

    return cut(rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, CAPTURE))


_CAPTURES = pa.schema([("url_key", pa.string()), ("page_id", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def write_index(captures: DataFrame, root: str, files_: int | None = None, block_lines: int = 1000) -> DataFrame:
    """Sorts the captures into index files under root; returns (file, first_key, last_key).

    Range partitions by key and place: captures of a very frequent key go on in the next file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = file_system(root)
        files.create_dir(folder, recursive=True)
        name, out, at, directory, lines, first, last = "", None, 0, [], [], None, None

        def flush():
            nonlocal at, lines
            block = zlib.compress("\n".join(lines).encode("utf-8", "surrogatepass"))
            directory.append([json.loads(lines[0])[0], at, len(block)])
            out.write(block)
            at, lines = at + len(block), []

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if out is None:
                    name, first = f"index-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}", row[0]
                    out = files.open_output_stream(f"{folder}/{name}", compression=None)
                lines.append(json.dumps(row))
                last = row[0]
                if len(lines) >= block_lines:
                    flush()
        if out is not None:
            if lines:
                flush()
            tail = zlib.compress(json.dumps(directory).encode())
            out.write(tail + len(tail).to_bytes(8, "little"))
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "first_key": [first], "last_key": [last]})

    n = min(files_ or n_partitions(captures.sparkSession), MOST_FILES)
    ordered = captures.repartitionByRange(n, "url_key", "archive", "offset").sortWithinPartitions("url_key", "archive", "offset")
    return cut(ordered.mapInArrow(run, "file string, first_key string, last_key string"))


class IndexFile:
    """One index file: its directory, and the block read last."""

    def __init__(self, files: fs.FileSystem, path: str):
        self.source = files.open_input_file(path)
        size = self.source.size()
        tail = int.from_bytes(self.source.read_at(8, size - 8), "little")
        self.directory = json.loads(zlib.decompress(self.source.read_at(tail, size - 8 - tail)))
        self.keys = [d[0] for d in self.directory]
        self.block: tuple[int, list, list] = (-1, [], [])

    def find(self, key: str) -> Iterator[list]:
        at = max(0, bisect_left(self.keys, key) - 1)  # captures of the key may begin in the block before
        while at < len(self.keys) and self.keys[at] <= key:
            if self.block[0] != at:
                _, offset, length = self.directory[at]
                lines = [json.loads(x) for x in zlib.decompress(self.source.read_at(length, offset)).decode("utf-8", "surrogatepass").split("\n")]
                self.block = (at, [x[0] for x in lines], lines)
            _, keys, lines = self.block
            yield from lines[bisect_left(keys, key) : bisect_right(keys, key)]
            at += 1


def look_up(keys: DataFrame, index: DataFrame, root: str) -> DataFrame:
    """The captures of the url_key values of keys. The table of files, of which write_index makes MOST_FILES at most
    whatever the input, is broadcast; keys go to the tasks of the files whose range holds them."""
    bounds = sorted((r["first_key"], r["last_key"], r["file"]) for r in index.collect())
    shared = keys.sparkSession.sparkContext.broadcast(bounds)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lasts = sorted((b[1], b[2], b[0]) for b in shared.value)
        tops = [x[0] for x in lasts]
        for batch in batches:
            out_key, out_file = [], []
            for key in batch.column(0).to_pylist():
                at = bisect_left(tops, key)
                while at < len(lasts) and lasts[at][2] <= key:
                    out_key.append(key)
                    out_file.append(lasts[at][1])
                    at += 1
            yield pa.RecordBatch.from_pydict({"url_key": pa.array(out_key, pa.string()), "file": pa.array(out_file, pa.string())})

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = file_system(root)
        name, index_file = None, None
        made: list[list] = []

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), _CAPTURES.types, strict=True)], schema=_CAPTURES)

        for batch in batches:
            for key, file in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if file != name:
                    name, index_file = file, IndexFile(files, f"{folder}/{file}")
                for capture in index_file.find(key):
                    made.append(capture)
                    if len(made) >= 10_000:  # a key may have any number of captures
                        yield batch_of()
                        made = []
        if made:
            yield batch_of()

    asked = keys.select("url_key").where("url_key is not null").distinct().mapInArrow(spread, "url_key string, file string")
    return asked.repartition(max(1, len(bounds)), "file").sortWithinPartitions("file", "url_key").mapInArrow(search, CAPTURE)


def read_records(captures: DataFrame, root: str, region: int = 16 << 20) -> DataFrame:
    """Reads the byte ranges of the captures, in the order of the archives; payload is null for a revisit."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("declared_digest", pa.string()), ("declared_bytes", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = file_system(root)
        name, source = None, None
        for batch in batches:
            rows, size = [], 0
            for archive, offset, length in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if archive != name:
                    name, source = archive, files.open_input_file(f"{folder}/{archive}")
                data = gzip.decompress(source.read_at(length, offset))
                rows.append(parse_record(data))
                size += len(data)
                if size >= 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    ordered = captures.select("archive", "offset", "length").repartition(F.col("archive"), F.expr(f"offset div {region}")).sortWithinPartitions("archive", "offset")
    return ordered.mapInArrow(run, RECORD)


def archive_pages(spark: SparkSession, pages: DataFrame, min_bytes: int = 1000, root: str | None = None) -> tuple[DataFrame, DataFrame, str]:
    """Writes archives and index of pages (page_id, url, html); returns captures, index files and the folder.

    Null html is an empty payload, null url an empty key; repeated rows are records of their own; other
    columns are not used. Pages without an id keep none."""
    root = root or work_dir(spark, "warc")
    captures = write_archives(with_revisits(pages.select("page_id", "url", "html"), min_bytes), f"{root}/archives")
    return captures, write_index(captures, f"{root}/index"), root


def round_trip(spark: SparkSession, pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """Writes the pages, looks every one up by its URL key and reads its record back."""
    _, index, root = archive_pages(spark, pages, min_bytes)
    keys = pages.select("url").distinct().mapInArrow(_keys, "url_key string")
    return read_records(look_up(keys, index, f"{root}/index"), f"{root}/archives")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"url_key": pa.array([url_key(u) for u in batch.column(0).to_pylist()], pa.string())})


def digest(records: DataFrame) -> DataFrame:
    return records.select(
        "page_id",
        F.coalesce(F.octet_length("payload").cast("bigint"), F.col("declared_bytes")).alias("payload_bytes"),
        F.coalesce(F.sha1("payload"), F.col("declared_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )
