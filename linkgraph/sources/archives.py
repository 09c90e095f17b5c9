"""Archive members as rows, with fingerprints."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "archive string, entry string, content binary"


def read_archives(spark: SparkSession, path: str, suffix: str = ".class") -> DataFrame:
    """(archive, entry, content) of the entries of zip archives under path that end in suffix, in archive order.
    An archive is read by one task and passed on entry by entry."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_buffer())) as archive:
                    for info in archive.infolist():
                        if info.filename.endswith(suffix) and not info.is_dir():
                            yield pa.RecordBatch.from_pydict({"archive": [name], "entry": [info.filename], "content": pa.array([archive.read(info)], pa.binary())})

    return files.mapInArrow(run, ENTRY)


def container(uri: F.Column) -> F.Column:
    """The archive that an entry's URI (scheme jar) lies in; another URI is its own."""
    return F.when(uri.startswith("jar:"), F.regexp_extract(uri, r"(?s)^jar:(.*)!/", 1)).otherwise(uri)


def first_wins(entries: DataFrame, archives: list[str]) -> DataFrame:
    """One row for each entry name: the one of the earliest archive in the list, with all its origins."""
    position = F.array_position(F.array(*[F.lit(a) for a in archives]), F.col("archive"))
    ranked = entries.withColumn("position", position).where("position > 0")
    origins = ranked.groupBy("entry").agg(F.transform(F.array_sort(F.collect_set(F.struct("position", "archive"))), lambda x: x["archive"]).alias("origins"), F.min("position").alias("position"))
    return ranked.join(origins, ["entry", "position"]).select("entry", "archive", "origins", "content")


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(file, size, sha256, sha1) of each file; the name has no line breaks."""
    f = spark.read.format("binaryFile").load(path)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"[\r\n]", "_")
    return f.select(name.alias("file"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.sha1("content").alias("sha1"))


def same_file(a: str, b: str):
    """Two fingerprints (struct columns file, size, sha256) agree where both know a part."""
    equal = [F.coalesce(F.col(f"{a}.{c}") == F.col(f"{b}.{c}"), F.lit(True)) for c in ("file", "size", "sha256")]
    return equal[0] & equal[1] & equal[2]


def locate(wanted: DataFrame, found: DataFrame, folders: list[str]) -> DataFrame:
    """wanted (file, size, sha256) with the path of the first folder that has it; null where none has."""
    order = F.array_position(F.array(*[F.lit(d) for d in folders]), F.col("f.folder"))
    hit = wanted.alias("w").join(found.alias("f"), (F.col("w.file") == F.col("f.file")) & F.coalesce(F.col("w.size") == F.col("f.size"), F.lit(True)) & F.coalesce(F.col("w.sha256") == F.col("f.sha256"), F.lit(True)))
    best = hit.where(order > 0).groupBy("w.file").agg(F.min_by("f.path", order).alias("path"))
    return wanted.join(best, "file", "left")
