"""Generic signatures as token arrays, and their structural comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A formal parameter's name (before ':'), a type variable, a class, a nested part, or one sign or primitive.
TOKEN = r"([^<>:;./\[()^*+-]+(?=:)|T[^;<]+;|L[^<;.]+|\.[^<;.]+|[BCDFIJSVZ<>()\[*+^:;-])"


def tokens(signature: Column) -> Column:
    """The tokens in order; joined they are the signature again."""
    return F.regexp_extract_all(signature, F.lit(TOKEN), 1)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), for which value is computed once, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def kinds(signature: Column) -> Column:
    """Tokens as (kind, name): names of parameters and type variables do not count, those of classes do."""

    def one(x: Column, i: Column, all_: Column) -> Column:
        named = (F.get(all_, i + 1) == ":") & ~x.isin("<", ">", ":", ";", "*", "+", "-", "^", "[", "(", ")")
        kind = F.when(named, "parameter").when(x.rlike(r"^T.+;$"), "variable").when(x.rlike(r"^[L.].+"), "class").otherwise(x)
        return bound(kind, lambda k: F.struct(k.alias("kind"), F.when(k == "class", x).alias("name")))

    return bound(tokens(signature), lambda all_: F.transform(all_, lambda x, i: one(x, i, all_)))


def same_structure(a: Column, b: Column, classes: Callable[[Column, Column], Column] = lambda x, y: x == y) -> Column:
    """Null when either is; else whether both have the same tokens, with classes compared by the given test."""

    def fits(both: Column) -> Column:
        same = F.forall(F.arrays_zip(both["x"].alias("x"), both["y"].alias("y")), lambda p: F.coalesce((p["x"]["kind"] == p["y"]["kind"]) & ((p["x"]["kind"] != "class") | classes(p["x"]["name"], p["y"]["name"])), F.lit(False)))
        return (F.size(both["x"]) == F.size(both["y"])) & same

    return F.when(a.isNotNull() & b.isNotNull(), bound(F.struct(kinds(a).alias("x"), kinds(b).alias("y")), fits))
