"""Method bodies as instruction rows."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

INSTRUCTION = "struct<index:int,op:int,kind:string,num:bigint,ref:string,type:string,keys:array<bigint>>"
#: Operand bytes by ranges of opcodes (first, last, bytes); others have none.
OPERANDS = ((16, 16, 1), (17, 17, 2), (18, 18, 1), (19, 20, 2), (21, 25, 1), (54, 58, 1), (132, 132, 2), (153, 168, 2), (169, 169, 1), (178, 184, 2), (185, 186, 4), (187, 187, 2), (188, 188, 1), (189, 189, 2), (192, 193, 2), (197, 197, 3), (198, 199, 2), (200, 201, 4))
#: Kinds by ranges of opcodes.
KINDS = ((16, 17, "int"), (18, 20, "ldc"), (21, 25, "var"), (54, 58, "var"), (132, 132, "inc"), (153, 168, "jump"), (169, 169, "var"), (170, 170, "table"), (171, 171, "lookup"), (178, 181, "field"), (182, 185, "method"), (186, 186, "dynamic"), (187, 187, "type"), (188, 188, "int"), (189, 189, "type"), (192, 193, "type"), (197, 197, "multi"), (198, 201, "jump"))
TABLE, LOOKUP, WIDE, INC = 170, 171, 196, 132


def in_range(table: tuple, op: int, other):
    return next((value for first, last, value in table if first <= op <= last), other)


def instructions(code: bytes, constant: Callable[[int], tuple[str | None, str | None]]) -> Iterator[dict]:
    """The instructions of a body in order; constant(i) gives what constant i of the class refers to, as (type, text).

    Loads and stores with the slot in their opcode count as those with an operand. num is the operand: a
    number, a slot, an increment, dimensions, or the direction of a jump; keys are the bounds of a table
    switch, the keys of a look-up switch, or the slot of an increment."""
    at, index = 0, 0
    while at < len(code):
        start, op = at, code[at]
        row = {"index": index, "op": op, "kind": in_range(KINDS, op, "op"), "num": None, "ref": None, "type": None, "keys": None}
        at += 1
        if 26 <= op <= 45 or 59 <= op <= 78:
            first, base = (26, 21) if op <= 45 else (59, 54)
            row |= {"op": base + (op - first) // 4, "kind": "var", "num": (op - first) % 4}
        elif op in (TABLE, LOOKUP):
            at += -at % 4
            _, low, high = struct.unpack_from(">iii", code, at) if op == TABLE else (*struct.unpack_from(">ii", code, at), 0)
            at += 12 if op == TABLE else 8
            row["keys"] = [low, high] if op == TABLE else [struct.unpack_from(">i", code, at + 8 * i)[0] for i in range(low)]
            at += 4 * (high - low + 1) if op == TABLE else 8 * low
        elif op == WIDE:
            op = code[at]
            slot, step = struct.unpack_from(">Hh", code + b"\0\0", at + 1)
            row |= {"op": op, "kind": "inc", "num": step, "keys": [slot]} if op == INC else {"op": op, "kind": "var", "num": slot}
            at += 5 if op == INC else 3
        else:
            size, kind = in_range(OPERANDS, op, 0), row["kind"]
            raw = code[at : at + size]
            at += size
            if kind == "inc":
                row |= {"num": struct.unpack(">b", raw[1:])[0], "keys": [raw[0]]}
            elif kind in ("ldc", "field", "method", "dynamic", "type", "multi"):
                row["type"], row["ref"] = constant(int.from_bytes(raw[: 1 if size == 1 else 2], "big"))
                row["num"] = raw[2] if kind == "multi" else None
            elif kind == "jump":
                offset = int.from_bytes(raw, "big", signed=True)
                row["num"] = (offset > 0) - (offset < 0)
            elif size:
                row["num"] = int.from_bytes(raw, "big", signed=kind == "int")
        if at > len(code) or at <= start:
            raise ValueError("the body ends within an instruction")
        yield row
        index += 1
