"""Class files as rows: the class, its members, and the strings and references of its constant pool."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytecode import INSTRUCTION, instructions

CLASS = f"origin string, class_id string, access int, super_id string, interfaces array<string>, signature string, strings array<string>, members array<struct<kind:string,position:int,id:string,access:int,signature:string,code_length:int,code:array<{INSTRUCTION}>>>, references array<struct<kind:string,owner:string,id:string>>, error string"
#: Bytes after the tag of each kind of constant.
SIZES = {3: 4, 4: 4, 5: 8, 6: 8, 7: 2, 8: 2, 9: 4, 10: 4, 11: 4, 12: 4, 15: 3, 16: 2, 17: 4, 18: 4, 19: 2, 20: 2}


class ClassFormatError(ValueError):
    """The bytes are no class file."""


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, form: str):
        size = struct.calcsize(">" + form)
        if self.at + size > len(self.data):
            raise ClassFormatError("the file ends too early")
        values = struct.unpack_from(">" + form, self.data, self.at)
        self.at += size
        return values[0] if len(values) == 1 else values

    def skip(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ClassFormatError("the file ends too early")
        self.at += n
        return self.data[self.at - n : self.at]


#: The form and the type of each kind of number.
NUMBERS = {3: (">i", "I"), 4: (">f", "F"), 5: (">q", "J"), 6: (">d", "D")}


def parse_class(data: bytes, skip_code: bool = False) -> dict:
    """The class as a row of CLASS without origin; with skip_code without the instructions of its methods."""
    r = Reader(data)
    if r.take("I") != 0xCAFEBABE:
        raise ClassFormatError("no class file")
    r.take("HH")
    pool: dict[int, tuple[int, object]] = {}
    n, i = r.take("H"), 1
    while i < n:
        tag = r.take("B")
        if tag == 1:
            pool[i] = (1, r.skip(r.take("H")).decode("utf-8", "replace"))
        elif tag in SIZES:
            raw = r.skip(SIZES[tag])
            pool[i] = (tag, struct.unpack(">HH", raw) if tag in (9, 10, 11, 12) else struct.unpack(">H", raw)[0] if tag in (7, 8) else raw)
        else:
            raise ClassFormatError(f"constant of kind {tag}")
        i += 2 if tag in (5, 6) else 1
    text = lambda k: pool[k][1]
    name = lambda k: text(text(k)) if k else None
    id_ = lambda cls: None if cls is None else cls if cls.startswith("[") else f"L{cls};"

    def constant(k: int) -> tuple[str | None, str | None]:
        """Type and text of what an instruction refers to."""
        tag, value = pool[k]
        if tag in NUMBERS:
            return NUMBERS[tag][1], repr(struct.unpack(NUMBERS[tag][0], value)[0])
        if tag == 7:
            return "Ljava/lang/Class;", id_(text(value))
        if tag == 8:
            return "Ljava/lang/String;", text(value)
        if tag in (9, 10, 11):
            member, desc = (text(i) for i in text(value[1]))
            return None, f"{id_(name(value[0]))}.{member}{';;' if tag == 9 else ''}{desc}"
        if tag in (17, 18):
            member, desc = (text(i) for i in text(struct.unpack(">HH", value)[1]))
            return desc, member
        return None, None

    access, this, parent = r.take("HHH")
    interfaces = [id_(name(r.take("H"))) for _ in range(r.take("H"))]

    def attributes() -> dict[str, bytes]:
        out = {}
        for _ in range(r.take("H")):
            key, size = r.take("HI")
            out[text(key)] = r.skip(size)
        return out

    signature = lambda attrs: text(struct.unpack(">H", attrs["Signature"])[0]) if "Signature" in attrs else None
    members = []
    for kind, mark in (("field", ";;"), ("method", "")):
        for position in range(r.take("H")):
            bits, member, desc = r.take("HHH")
            attrs = attributes()
            code = struct.unpack_from(">I", attrs["Code"], 4)[0] if "Code" in attrs else None
            members.append({"kind": kind, "position": position, "id": f"{text(member)}{mark}{text(desc)}", "access": bits, "signature": signature(attrs), "code_length": code, "code": None if code is None or skip_code else list(instructions(attrs["Code"][8 : 8 + code], constant))})
    attrs = attributes()
    references = []
    for tag, value in pool.values():
        if tag in (9, 10, 11):
            member, desc = (text(k) for k in text(value[1]))
            references.append({"kind": "field" if tag == 9 else "method", "owner": id_(name(value[0])), "id": f"{member}{';;' if tag == 9 else ''}{desc}"})
    return {"class_id": id_(name(this)), "access": access, "super_id": id_(name(parent)), "interfaces": interfaces, "signature": signature(attrs), "strings": sorted({text(v) for t, v in pool.values() if t == 8}), "members": members, "references": references}


def decode(entries: DataFrame, skip_code: bool = False) -> DataFrame:
    """One row per archive entry (archive, entry, content). An entry that is no class file, or a damaged one, is a row with
    its error and nothing else but the origin."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(CLASS))

    def one(origin: str, content: bytes) -> dict:
        try:
            return {"origin": origin, **parse_class(content, skip_code), "error": None}
        except (ValueError, KeyError, TypeError, IndexError, struct.error) as problem:  # whatever damaged indices lead to
            return {name: None for name in schema.names} | {"origin": origin, "error": f"{type(problem).__name__}: {problem}"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for origin, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_pylist([one(origin, content)], schema=schema)

    return entries.select("archive", "content").mapInArrow(run, CLASS)


def index(entries: DataFrame, archives: list[str]) -> DataFrame:
    """(class_id, archive, entry): where each class of a class path is, the first archive of the list first. Bodies are
    read only for what load() takes from it."""
    from .archives import first_wins

    return first_wins(entries.withColumn("content", F.lit(None).cast("binary")), archives).select(F.concat(F.lit("L"), F.regexp_replace("entry", r"\.class$", ""), F.lit(";")).alias("class_id"), "archive", "entry")


def load(classes: DataFrame, entries: DataFrame, archives: list[str], most: int = 100) -> DataFrame:
    """classes with all that they refer to, directly or not, from the entries of a class path; what is in no archive is
    created as an unknown class, with its id alone."""
    from ..storage import keep

    where = keep(index(entries, archives))
    found, open_ = keep(classes), keep(missing(classes))
    for _ in range(most):
        wanted = where.join(open_, "class_id", "left_semi")
        fresh = keep(decode(entries.join(wanted.select("archive", "entry"), ["archive", "entry"], "left_semi")))
        if fresh.isEmpty():
            unknown = open_.select("class_id", *[F.lit(None).cast(f.dataType).alias(f.name) for f in classes.schema.fields if f.name != "class_id"]).select(classes.columns)
            return found.unionByName(unknown)
        found = keep(found.unionByName(fresh.select(classes.columns)))
        open_ = keep(missing(found))
    raise RuntimeError(f"classes still refer to others after {most} rounds")


def edges(classes: DataFrame) -> DataFrame:
    """(caller, position, op, kind, owner, id): what instructions refer to: kind is call, read or write."""
    method = classes.select("class_id", F.explode("members").alias("m")).select("class_id", "m.id", F.explode("m.code").alias("i")).where("i.kind in ('field', 'method')")
    kind = F.when(F.col("i.kind") == "method", "call").when(F.col("i.op").isin(178, 180), "read").otherwise("write")
    owner = F.regexp_extract("i.ref", r"(?s)^(.*?;)\.", 1)
    return method.select(F.concat_ws(".", "class_id", "id").alias("caller"), F.col("i.index").alias("position"), F.col("i.op").alias("op"), kind.alias("kind"), owner.alias("owner"), F.expr("substr(i.ref, length(regexp_extract(i.ref, '(?s)^(.*?;)[.]', 1)) + 2)").alias("id"))


def constants(classes: DataFrame) -> DataFrame:
    """(class_id, method, type, value): the strings and numbers that a method's instructions load, each once."""
    method = classes.select("class_id", F.explode("members").alias("m")).select("class_id", F.col("m.id").alias("method"), F.explode("m.code").alias("i"))
    number = F.when(F.col("i.kind") == "int", F.col("i.num").cast("string")).when(F.col("i.op").between(2, 8), (F.col("i.op") - 3).cast("string"))
    loaded = F.when(F.col("i.kind") == "ldc", F.struct(F.col("i.type").alias("type"), F.col("i.ref").alias("value"))).when(number.isNotNull(), F.struct(F.lit("I").alias("type"), number.alias("value")))
    return method.select("class_id", "method", loaded.alias("c")).where("c is not null").select("class_id", "method", "c.type", "c.value").distinct()


def missing(classes: DataFrame) -> DataFrame:
    """Classes that references or parents name and that are not there, as rows (class_id)."""
    named = classes.select(F.explode(F.concat(F.transform("references", lambda x: x["owner"]), F.array("super_id"), F.col("interfaces"))).alias("class_id"))
    return named.where("class_id is not null").distinct().join(classes.select("class_id"), "class_id", "left_anti")
