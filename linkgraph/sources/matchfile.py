"""Match files: tab-indented text in which a line belongs to the class and member lines above it."""

from __future__ import annotations

import base64
import datetime
from collections.abc import Iterator
from itertools import batched

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MATCH = "kind string, a_class string, b_class string, a_member string, b_member string, a_idx int, b_idx int, side string, unmatchable boolean, line_no bigint"
HEAD = "Matches saved "
#: Rows of a file that are in Python at once.
PARSED_ROWS = 10_000
#: Line words by depth, with their kind, and whether the line says that an entity has no match.
WORDS = {0: {"c": ("class", False), "cu": ("class", True)}, 1: {"m": ("method", False), "f": ("field", False), "mu": ("method", True), "fu": ("field", True)}, 2: {"ma": ("arg", False), "mv": ("var", False), "mau": ("arg", True), "mvu": ("var", True)}}


class FormatError(ValueError):
    """A line that does not fit the grammar."""


def parse(text: str) -> Iterator[dict]:
    """The match lines of a file as rows of MATCH. Header lines are not rows."""
    lines = text.split("\n")
    if not lines or not lines[0].startswith(HEAD):
        raise FormatError("line 1: no match file")
    classes, member, content = None, None, False
    for number, line in enumerate(lines[1:], 2):
        body = line.lstrip("\t")
        depth, parts = len(line) - len(body), body.split("\t")
        known = WORDS.get(depth, {})
        content = content or (depth == 0 and parts[0] in WORDS[0])
        if not body.strip() or not content:
            continue
        if parts[0] not in known or len(parts) != 3:
            raise FormatError(f"line {number}: {body[:40]!r}")
        kind, unmatchable = known[parts[0]]
        row = dict.fromkeys(("a_class", "b_class", "a_member", "b_member", "a_idx", "b_idx", "side")) | {"kind": kind, "unmatchable": unmatchable, "line_no": number}
        if unmatchable and parts[1] not in ("a", "b"):
            raise FormatError(f"line {number}: side {parts[1]!r}")
        ends = {f"{parts[1]}": parts[2]} if unmatchable else {"a": parts[1], "b": parts[2]}
        row["side"] = parts[1] if unmatchable else None
        if depth == 0:
            classes, member = (None if unmatchable else ends), None
            row |= {f"{s}_class": v for s, v in ends.items()}
        else:
            if classes is None or (depth == 2 and member is None):
                raise FormatError(f"line {number}: no line above it belongs to")
            row |= {f"{s}_class": v for s, v in classes.items()}
            if depth == 1:
                member = None if unmatchable else ends
                row |= {f"{s}_member": v for s, v in ends.items()}
            else:
                row |= {f"{s}_member": v for s, v in member.items()} | {f"{s}_idx": int(v) for s, v in ends.items()}
        yield row


INPUT = "section string, file string, size bigint, algorithm string, hash binary, pattern string"
#: Header sections of input files, and the words of patterns for what is not obfuscated.
SECTIONS = ("a", "b", "cp", "cp a", "cp b")
PATTERNS = ("non-obf cls a", "non-obf cls b", "non-obf mem a", "non-obf mem b")


def parse_inputs(text: str) -> Iterator[dict]:
    """The header of a file as rows of INPUT: input files by section, in all three forms (the name; size, SHA256 hash and
    name; size, algorithm, hash and name), and patterns under their word."""
    lines = text.split("\n")
    if not lines or not lines[0].startswith(HEAD):
        raise FormatError("line 1: no match file")
    section = None
    for number, line in enumerate(lines[1:], 2):
        if not line.startswith("\t"):
            return
        row = dict.fromkeys(("section", "file", "size", "algorithm", "hash", "pattern"))
        if line.startswith("\t\t"):
            if section is None:
                raise FormatError(f"line {number}: a file without a section")
            *about, row["file"] = line[2:].split("\t", 3)
            if about:
                row["size"], row["algorithm"] = int(about[0]), about[1] if len(about) == 3 else "SHA256"
                row["hash"] = base64.b64decode(about[-1])
            yield row | {"section": section}
        elif line[1:-1] in SECTIONS and line.endswith(":"):
            section = line[1:-1]
        else:
            word, _, pattern = line[1:].partition("\t")
            if word not in PATTERNS:
                raise FormatError(f"line {number}: {line[:40]!r}")
            yield row | {"section": word, "pattern": pattern}


def read_inputs(spark: SparkSession, path: str) -> DataFrame:
    """INPUT of each match file under path, with file_name."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file_name"), "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file_name", pa.string()), ("section", pa.string()), ("file", pa.string()), ("size", pa.int64()), ("algorithm", pa.string()), ("hash", pa.binary()), ("pattern", pa.string())])
        for batch in batches:
            rows = [{"file_name": name, **row} for name, text in zip(*[c.to_pylist() for c in batch.columns], strict=True) for row in parse_inputs(text)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.mapInArrow(run, f"file_name string, {INPUT}")


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("kind", pa.string()), *[(c, pa.string()) for c in ("a_class", "b_class", "a_member", "b_member")], ("a_idx", pa.int32()), ("b_idx", pa.int32()), ("side", pa.string()), ("unmatchable", pa.bool_()), ("line_no", pa.int64())])
        for batch in batches:
            for text in batch.column(0):
                for rows in batched(parse(text.as_py()), PARSED_ROWS):
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.mapInArrow(run, MATCH)


def known(matches: DataFrame, classes_a: DataFrame, classes_b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose classes (column class_id) exist on their sides, and those that do not."""
    there = lambda s, c: F.col(f"{s}_class").isNull() | F.col(f"{s}_there")
    marked = matches.join(classes_a.select(F.col("class_id").alias("a_class"), F.lit(True).alias("a_there")), "a_class", "left").join(classes_b.select(F.col("class_id").alias("b_class"), F.lit(True).alias("b_there")), "b_class", "left")
    ok = F.coalesce(there("a", "a_there"), F.lit(False)) & F.coalesce(there("b", "b_there"), F.lit(False))
    cols = matches.columns
    return marked.where(ok).select(cols), marked.where(~ok).select(cols)


def lines_of(matches: DataFrame) -> DataFrame:
    """(sort, value): the text lines, children under their parents, A's ids in order."""
    pair = F.when(F.col("unmatchable"), F.col("side"))
    end = lambda what: F.when(F.col("unmatchable"), F.when(F.col("side") == "a", F.col(f"a_{what}")).otherwise(F.col(f"b_{what}"))).otherwise(F.col(f"b_{what}"))
    first = lambda what: F.coalesce(pair, F.col(f"a_{what}").cast("string"))
    u = F.when(F.col("unmatchable"), "u").otherwise("")
    kind = F.col("kind")
    line = (
        F.when(kind == "class", F.concat_ws("\t", F.concat(F.lit("c"), u), first("class"), end("class")))
        .when(kind.isin("method", "field"), F.concat_ws("\t", F.lit(""), F.concat(F.substring(kind, 1, 1), u), first("member"), end("member")))
        .otherwise(F.concat_ws("\t", F.lit(""), F.lit(""), F.concat(F.lit("m"), F.substring(kind, 1, 1), u), first("idx"), end("idx").cast("string")))
    )
    sort = F.struct(F.coalesce("a_class", "b_class").alias("c"), F.when(kind == "class", 0).otherwise(1).alias("d"), F.coalesce("a_member", "b_member", F.lit("")).alias("m"), F.when(kind.isin("arg", "var"), 1).otherwise(0).alias("e"), "kind", F.coalesce("a_idx", "b_idx", F.lit(-1)).alias("i"))
    return matches.select(sort.alias("sort"), line.alias("value"))


def header_lines(inputs: DataFrame | None = None) -> list[str]:
    """Header lines behind the first one, for inputs (INPUT; a project's input files, some tens), which are written in
    the newest form."""
    rows = [] if inputs is None else inputs.collect()
    out = []
    for section in SECTIONS:
        out.append(f"\t{section}:")
        for r in rows:
            if r["section"] == section:
                known = [str(r["size"]), r["algorithm"] or "SHA256", base64.b64encode(r["hash"]).decode()] if r["hash"] is not None else []
                out.append("\t\t" + "\t".join([*known, r["file"]]))
    return out + [f"\t{r['section']}\t{r['pattern']}" for r in rows if r["pattern"] is not None]


def write_matches(matches: DataFrame, path: str, now: datetime.datetime | None = None, inputs: DataFrame | None = None) -> bool:
    """Writes text files into the folder path, which must not exist; False when there is nothing to write.

    A class and what belongs to it stay together, and each file has the header, so every file is a match
    file of its own and no task writes all; in the order of their names they are in the order of A's ids."""
    if matches.isEmpty():
        return False
    stamp = (now or datetime.datetime.now(datetime.UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")
    head = [f"{HEAD}{stamp}, input files:", *header_lines(inputs)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = False
        for batch in batches:
            if batch.num_rows and not begun:
                begun = True
                yield pa.RecordBatch.from_pydict({"value": head})
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string())], names=["value"])

    body = lines_of(matches).select("value", "sort", F.col("sort.c").alias("c"))
    body.repartitionByRange("c").sortWithinPartitions("sort").select("value").mapInArrow(run, "value string").write.mode("errorifexists").text(path)
    return True
