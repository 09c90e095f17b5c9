"""Comparison of instructions, for edit similarity and alignment of method bodies.

An instruction is a struct of op, kind, num, ref, type and keys (sources/bytecode.py). ref and type name
entities as the matches so far see them: those of side B that are matched carry the id of their match, so
that compatible ones have equal ids; null is what is unknown.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .similarity import all_partners, edit_tables

#: What an instruction of each kind is compared by, beside its opcode.
STRICT = {"int": ("num",), "type": ("ref",), "field": ("ref",), "method": ("ref",), "jump": ("num",), "ldc": ("type", "ref"), "table": ("keys",), "lookup": ("keys",), "multi": ("num", "ref")}


def cost(x: Column, y: Column) -> Column:
    """0 for similar instructions, 1 for possibly similar ones, 2 for distinct ones.

    Opcodes must be equal, and then: numbers, jump directions, switch keys and constants; types, fields and
    methods, of which two unknown ones are similar and one is not; for dynamic calls the bootstrap (ref) and,
    where it makes a lambda, its target (type) and tag (num). Variables that are unknown are similar, compatible
    ones of other types possibly; an increment's step counts first. Everything else is similar."""
    same = lambda *names: [x[n].eqNullSafe(y[n]) for n in names]
    variable = F.when(x["ref"].isNull() | y["ref"].isNull(), 0).when(x["ref"] != y["ref"], 2).when(~x["type"].eqNullSafe(y["type"]), 1).otherwise(0)
    out = F.when(x["op"] != y["op"], 2)
    for kind, names in STRICT.items():
        fits = F.lit(True)
        for test in same(*names):
            fits = fits & test
        out = out.when(x["kind"] == kind, F.when(fits, 0).otherwise(2))
    lambda_ = x["type"].isNotNull() | y["type"].isNotNull()
    bootstrap, target, tag = same("ref", "type", "num")
    out = out.when(x["kind"] == "dynamic", F.when(~bootstrap, 2).when(lambda_ & ~(target & tag), 2).otherwise(0))
    out = out.when((x["kind"] == "inc") & ~same("num")[0], 2).when(x["kind"].isin("var", "inc"), variable)
    return out.otherwise(0)


#: The fields that can tell instructions apart, beside their kind.
COMPARED = ("op", "num", "ref", "type", "keys")


def cost_table(a: list[dict], b: list[dict]) -> np.ndarray:
    """cost() of each instruction of a with each of b."""
    codes: dict = {}

    def column(items: list[dict], name: str) -> np.ndarray:
        """Equal values, null ones too, as equal numbers; 0 is null."""
        values = [tuple(v) if isinstance(v := i[name], (list, np.ndarray)) else v for i in items]
        return np.array([0 if v is None else codes.setdefault((name, v), len(codes) + 1) for v in values], np.int64)

    cols = {n: (column(a, n)[:, None], column(b, n)[None, :]) for n in COMPARED}
    kinds = np.array([i["kind"] or "op" for i in a], dtype=object)[:, None]
    return _replacing(cols, lambda kind: kinds == kind)


def _replacing(cols: dict[str, tuple[np.ndarray, np.ndarray]], of_kind: Callable[[str], np.ndarray]) -> np.ndarray:
    """cost() from codes of both sides, 0 for null, and where the first instructions are of a kind."""
    same = {n: x == y for n, (x, y) in cols.items()}
    out = np.zeros(same["op"].shape, np.int64)
    for kind, names in STRICT.items():
        out[of_kind(kind) & ~np.logical_and.reduce([same[n] for n in names])] = 2
    some_lambda = (cols["type"][0] > 0) | (cols["type"][1] > 0)
    out[of_kind("dynamic") & (~same["ref"] | some_lambda & ~(same["type"] & same["num"]))] = 2
    variable = of_kind("var") | of_kind("inc")
    known = (cols["ref"][0] > 0) & (cols["ref"][1] > 0)
    out[variable & known & same["ref"] & ~same["type"]] = 1
    out[variable & known & ~same["ref"] | of_kind("inc") & ~same["num"]] = 2
    out[~same["op"]] = 2
    return out


def _values(instructions: pa.Array, name: str) -> pa.Array:
    """A field of instructions; keys as text, so that equal ones are equal values."""
    out = pc.struct_field(instructions, name)
    if not pa.types.is_list(out.type):
        return out
    sizes = pc.fill_null(pc.list_value_length(out), 0).to_numpy(zero_copy_only=False)
    items = pc.fill_null(pc.list_flatten(out).cast(pa.string()), "null")
    text = pc.binary_join(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), items), ",")
    return pc.if_else(out.is_null(), pa.scalar(None, pa.string()), text)


def _codes(a: pa.Array, b: pa.Array, name: str) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """A field of the instructions of both sides: equal values, null ones too, as equal numbers; 0 is null. And the values
    from number 1 on."""
    x, y = _values(a, name), _values(b, name)
    both = pa.concat_arrays([x, y.cast(x.type)]).dictionary_encode()
    codes = pc.fill_null(both.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    return codes[: len(x)], codes[len(x) :], both.dictionary


#: Cells of the edit tables that are made at once, about.
CELLS = 2_000_000


def _shapes(a: pa.Array, b: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For the pairs of bodies with as many instructions on each side, none of them empty: their rows, the places of their first
    instructions in all of a, and the costs of replacing (pair, instruction of a, instruction of b)."""
    (size_a, start_a), (size_b, start_b) = map(_extent, (a, b))
    flat_a, flat_b = pc.list_flatten(a), pc.list_flatten(b)
    cols = {n: _codes(flat_a, flat_b, n)[:2] for n in COMPARED}
    kinds, _, names = _codes(flat_a, flat_b, "kind")
    number = {kind: n for n, kind in enumerate(names.to_pylist(), 1)}
    rows = np.flatnonzero((size_a > 0) & (size_b > 0))
    rows = rows[np.lexsort((size_b[rows], size_a[rows]))]
    changes = np.flatnonzero(np.diff(size_a[rows]) | np.diff(size_b[rows])) + 1
    for alike in np.split(rows, changes) if len(rows) else []:
        n, m = size_a[alike[0]], size_b[alike[0]]
        step = max(1, CELLS // (n * m))
        for some in (alike[i : i + step] for i in range(0, len(alike), step)):
            x, y = start_a[some][:, None] + np.arange(n), start_b[some][:, None] + np.arange(m)
            kind = kinds[x][:, :, None]
            yield some, x, _replacing({k: (u[x][:, :, None], v[y][:, None, :]) for k, (u, v) in cols.items()}, lambda k: kind == number.get(k, -1))  # noqa: B023


def _extent(bodies: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """How many instructions each body has, -1 if it is null, and where they start among all."""
    size = pc.fill_null(pc.list_value_length(bodies), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    held = np.maximum(size, 0)
    return size, np.cumsum(held) - held


@F.arrow_udf(T.DoubleType())
def code_similarity(bodies: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Edit similarity of two arrays of instructions; null where one is. Bodies of equal sizes share their numpy calls."""
    for a, b in bodies:
        size_a, size_b = _extent(a)[0], _extent(b)[0]
        score = ((size_a == 0) & (size_b == 0)).astype(float)
        for rows, _, costs in _shapes(a, b):
            score[rows] = 1 - edit_tables(costs)[:, -1, -1] / (2 * max(costs.shape[1:]))
        yield pa.array(score, mask=(size_a < 0) | (size_b < 0))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def code_alignment(bodies: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """For each instruction of the first body the place of its partner in the second, or -1."""
    for a, b in bodies:
        size_a, size_b = _extent(a)[0], _extent(b)[0]
        there = (size_a >= 0) & (size_b >= 0)
        out = np.full(np.maximum(size_a, 0).sum(), -1, np.int32)
        for _, places, costs in _shapes(a, b):
            out[places] = all_partners(costs)
        out = out[np.repeat(there, np.maximum(size_a, 0))]
        ends = np.concatenate([[0], np.cumsum(np.where(there, size_a, 0))]).astype(np.int32)
        yield pa.ListArray.from_arrays(pa.array(ends), pa.array(out), mask=pa.array(~there))


def method_similarity(same_return: Column, arguments: Column, n_a: Column, open_b: Column, aligned: Column, longer: Column, code_a: Column, code_b: Column) -> Column:
    """0.05 for the return type, 0.2 for the arguments, 0.75 for the aligned share of the longer body.

    arguments is the sum of the similarities of matched arguments, n_a the number of A's, open_b of B's
    without a match; no argument at all counts as 1, as do two empty bodies. Of methods without a body (code
    false) two are equal and one is different."""
    args = F.when(n_a + open_b > 0, arguments / (n_a + open_b)).otherwise(1.0)
    content = F.when(longer > 0, aligned / longer).otherwise(1.0)
    whole = F.when(same_return, 0.05).otherwise(0.0) + 0.2 * args + 0.75 * content
    return F.when(code_a & code_b, whole).when(code_a | code_b, 0.0).otherwise(1.0)
