"""Class files built byte by byte, and generic signatures."""

import struct

import pytest
from pyspark.sql import functions as F

from linkgraph.functions import signatures
from linkgraph.sources import classfiles


def class_file(name="a/B", parent="java/lang/Object", interfaces=("a/I",), text="hello"):
    pool = []

    def add(raw: bytes) -> int:
        pool.append(raw)
        return len(pool)

    utf = lambda s: add(b"\1" + struct.pack(">H", len(s.encode())) + s.encode())
    cls = lambda s: add(b"\7" + struct.pack(">H", utf(s)))
    this, up, faces = cls(name), cls(parent), [cls(i) for i in interfaces]
    add(b"\10" + struct.pack(">H", utf(text)))
    other, pair = cls("a/C"), add(b"\14" + struct.pack(">HH", utf("call"), utf("()V")))
    add(b"\12" + struct.pack(">HH", other, pair))
    field, desc, code = utf("x"), utf("I"), utf("Code")
    method, sig = utf("m"), utf("()V")
    body = struct.pack(">HHI", 1, 1, 3) + b"\0\0\261" + struct.pack(">HH", 0, 0)
    out = struct.pack(">IHHH", 0xCAFEBABE, 0, 61, len(pool) + 1) + b"".join(pool) + struct.pack(">HHH", 0x21, this, up)
    out += struct.pack(">H", len(faces)) + b"".join(struct.pack(">H", f) for f in faces)
    out += struct.pack(">HHHHH", 1, 2, field, desc, 0)
    out += struct.pack(">HHHHHHI", 1, 1, method, sig, 1, code, len(body)) + body + struct.pack(">H", 0)
    return out


def test_class_files(spark):
    entries = spark.createDataFrame([("x.jar", "a/B.class", bytearray(class_file())), ("x.jar", "a/C.class", bytearray(class_file("a/C", "a/B", ())))], "archive string, entry string, content binary")
    got = {r.class_id: r for r in classfiles.decode(entries).collect()}
    b = got["La/B;"]
    assert (b.super_id, b.interfaces, b.strings, b.access) == ("Ljava/lang/Object;", ["La/I;"], ["hello"], 0x21)
    assert [(m.kind, m.id, m.code_length) for m in b.members] == [("field", "x;;I", None), ("method", "m()V", 3)]
    assert [tuple(x) for x in b.references] == [("method", "La/C;", "call()V")]
    assert {r.class_id for r in classfiles.missing(classfiles.decode(entries)).collect()} == {"Ljava/lang/Object;", "La/I;"}


@pytest.mark.parametrize("data", [b"", b"\0" * 20, class_file()[:40]])
def test_no_class_files(data):
    with pytest.raises(classfiles.ClassFormatError):
        classfiles.parse_class(data)


SIGNATURES = ["Ljava/util/List<Ljava/lang/String;>;", "<K:Ljava/lang/Object;V::Ljava/lang/Comparable<TV;>;>La/B<TK;>.Inner<*>;La/I;", "<T:Ljava/lang/Object;>(TT;[I+Ljava/util/Map<-TT;*>;)V^La/E;", "[[J"]


def test_signatures(spark):
    df = spark.createDataFrame([(s,) for s in SIGNATURES], "s string")
    assert [r.s for r in df.select(F.array_join(signatures.tokens(F.col("s")), "").alias("s")).collect()] == SIGNATURES
    pairs = spark.createDataFrame([("<T:La/O;>Lx<TT;>;", "<Q:La/O;>Lx<TQ;>;"), ("Lx<*>;", "Lx<+Ly;>;"), ("Lx;", "Ly;"), ("Lx;", None), ("Lx;", "Lx;Lx;")], "a string, b string")
    got = [r.v for r in pairs.select(signatures.same_structure(F.col("a"), F.col("b")).alias("v")).collect()]
    assert got == [True, False, False, None, False]


def test_instructions():
    from linkgraph.sources.bytecode import instructions

    head = bytes([16, 0xFF, 17, 1, 0, 28, 21, 5, 132, 1, 0xFF, 18, 7, 178, 0, 9, 197, 0, 3, 2, 167, 0xFF, 0xF0, 196, 132, 0, 1, 0xFF, 0xFE, 196, 25, 1, 0])
    table = bytes([170]) + b"\0" * (-(len(head) + 1) % 4) + struct.pack(">iii", 0, 3, 4) + b"\0" * 8
    lookup = bytes([171]) + b"\0" * (-(len(head) + len(table) + 1) % 4) + struct.pack(">ii", 0, 2) + struct.pack(">iiii", -5, 0, 9, 0)
    got = [(r["index"], r["op"], r["kind"], r["num"], r["ref"], r["keys"]) for r in instructions(head + table + lookup + bytes([177]), lambda i: ("t", f"c{i}"))]
    assert got == [
        (0, 16, "int", -1, None, None), (1, 17, "int", 256, None, None), (2, 21, "var", 2, None, None), (3, 21, "var", 5, None, None), (4, 132, "inc", -1, None, [1]), (5, 18, "ldc", None, "c7", None),
        (6, 178, "field", None, "c9", None), (7, 197, "multi", 2, "c3", None), (8, 167, "jump", -1, None, None), (9, 132, "inc", -2, None, [1]), (10, 25, "var", 256, None, None),
        (11, 170, "table", None, None, [3, 4]), (12, 171, "lookup", None, None, [-5, 9]), (13, 177, "op", None, None, None),
    ]
    with pytest.raises(ValueError):
        list(instructions(bytes([17, 1]), None))


def calling_class(name, other):
    """A class whose method calls m() of another and loads a string and a number."""
    pool = []

    def add(raw: bytes) -> int:
        pool.append(raw)
        return len(pool)

    utf = lambda s: add(b"\1" + struct.pack(">H", len(s)) + s.encode())
    cls = lambda s: add(b"\7" + struct.pack(">H", utf(s)))
    this, up = cls(name), cls("java/lang/Object")
    call = add(b"\12" + struct.pack(">HH", cls(other), add(b"\14" + struct.pack(">HH", utf("m"), utf("()V")))))
    text, number = add(b"\10" + struct.pack(">H", utf("said"))), add(b"\3" + struct.pack(">i", 77))
    method, desc, code = utf("run"), utf("()V"), utf("Code")
    insns = bytes([18, text, 18, number, 16, 5, 4, 184]) + struct.pack(">H", call) + bytes([177])
    body = struct.pack(">HHI", 4, 0, len(insns)) + insns + struct.pack(">HH", 0, 0)
    out = struct.pack(">IHHH", 0xCAFEBABE, 0, 61, len(pool) + 1) + b"".join(pool) + struct.pack(">HHHHH", 1, this, up, 0, 0)
    return out + struct.pack(">HHHHHHI", 1, 8, method, desc, 1, code, len(body)) + body + struct.pack(">H", 0)


def test_code_and_damaged_classes(spark):
    entries = spark.createDataFrame([("x", "a/B.class", bytearray(calling_class("a/B", "a/C"))), ("x", "bad.class", bytearray(b"\xca\xfe\xba\xbe\0\0")), ("x", "cut.class", bytearray(calling_class("a/B", "a/C")[:-20]))], "archive string, entry string, content binary")
    classes = classfiles.decode(entries)
    assert [(r.class_id, r.error is None) for r in classes.orderBy("class_id").collect()] == [(None, False), (None, False), ("La/B;", True)]
    assert [tuple(r) for r in classfiles.edges(classes).collect()] == [("La/B;.run()V", 4, 184, "call", "La/C;", "m()V")]
    assert sorted((r.type, r.value) for r in classfiles.constants(classes).collect()) == [("I", "1"), ("I", "5"), ("I", "77"), ("Ljava/lang/String;", "said")]
    assert classfiles.decode(entries, skip_code=True).where("class_id is not null").first().members[0].code is None


def test_class_path_is_loaded_as_far_as_needed(spark):
    rows = [("x", "a/C.class", calling_class("a/C", "a/D")), ("y", "a/C.class", calling_class("a/C", "never")), ("y", "a/D.class", calling_class("a/D", "a/B")), ("y", "a/Unused.class", b"not read")]
    entries = spark.createDataFrame([(a, e, bytearray(c)) for a, e, c in rows], "archive string, entry string, content binary")
    start = classfiles.decode(spark.createDataFrame([("in", "a/B.class", bytearray(calling_class("a/B", "a/C")))], entries.schema))
    got = {r.class_id: r.origin for r in classfiles.load(start, entries, ["x", "y"]).collect()}
    assert got == {"La/B;": "in", "La/C;": "x", "La/D;": "y", "Ljava/lang/Object;": None}


def test_match_file_headers():
    from linkgraph.sources import matchfile

    text = "Matches saved now, input files:\n\ta:\n\t\tone.jar\n\t\t12\tAAEC\ttwo.jar\n\tcp a:\n\t\t7\tSHA1\tAwQ=\tthree.jar\n\tnon-obf cls a\tx.*\nc\tA\tB\n"
    got = [tuple(r.values()) for r in matchfile.parse_inputs(text)]
    assert got == [("a", "one.jar", None, None, None, None), ("a", "two.jar", 12, "SHA256", b"\0\1\2", None), ("cp a", "three.jar", 7, "SHA1", b"\3\4", None), ("non-obf cls a", None, None, None, None, "x.*")]
    for bad in ("nothing", "Matches saved now:\n\t\tfile", "Matches saved now:\n\tother\tx"):
        with pytest.raises(matchfile.FormatError):
            list(matchfile.parse_inputs(bad))
