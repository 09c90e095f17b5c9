"""A small stack language for filtering ranked pairs, compiled to one Column.

Words are split at white space. `a` and `b` are the two entities of a row, and the stack starts with b.
Their columns begin with a_ and b_: id, name, mapped, aux, aux2, super (a class's super class by name),
class (the name of a member's class; without it the entity is a class) and ancestors (names of all classes
that its class can be assigned to).
A program that leaves one condition is the filter; one that leaves two values tests them for equality.
A program that cannot be compiled filters nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions import names


class ProgramError(ValueError):
    """The program cannot be compiled."""


@dataclass(frozen=True)
class Value:
    kind: str  # entity, class (by name), text or condition
    column: Column | None = None
    side: str = ""


TEXT_PARTS: dict[str, Callable[[Column], Column]] = {
    "class": names.simple_name,
    "package": lambda c: F.coalesce(names.package(c), F.lit("")),
    "inner": names.inner,
    "outer": lambda c: F.coalesce(names.outer(c), F.lit("")),
}
TEXT_TESTS: dict[str, Callable[[Column, Column], Column]] = {
    "startswith": lambda s, t: s.startswith(t),
    "endswith": lambda s, t: s.endswith(t),
    "contains": lambda s, t: s.contains(t),
}
#: Words that read a column of an entity, with the column's name (behind the entity's prefix).
ATTRIBUTES = {"name": "name", "mapped": "mapped", "mappedname": "mapped", "aux": "aux", "auxname": "aux", "aux2": "aux2", "aux2name": "aux2", "supercls": "super"}


def class_of(value: Value, columns: list[str]) -> Column:
    """The name of the class that a value stands for: a member's is its owner, a text names one."""
    if value.kind == "condition":
        raise ProgramError("a condition is no class")
    if value.kind != "entity":
        return value.column
    return F.col(f"{value.side}_class" if f"{value.side}_class" in columns else f"{value.side}_name")


def instance_of(x: Value, y: Value, columns: list[str]) -> Value:
    """Whether the class of x can be assigned to that of y."""
    if x.kind != "entity" or f"{x.side}_ancestors" not in columns:
        raise ProgramError("nothing is known of what this can be assigned to")
    return Value("condition", F.coalesce(F.array_contains(F.col(f"{x.side}_ancestors"), class_of(y, columns)), F.lit(False)))


def equal(x: Value, y: Value, columns: list[str]) -> Value:
    """Entities are equal by id; an entity and a text when the text is its name; a class is equal to a member or a text
    when it is the member's class or of that name."""
    if "condition" in (x.kind, y.kind):
        if x.kind != y.kind:
            raise ProgramError("a condition equals only a condition")
        return Value("condition", x.column.eqNullSafe(y.column))
    if "class" in (x.kind, y.kind):
        return Value("condition", F.coalesce(class_of(x, columns) == class_of(y, columns), F.lit(False)))
    side = lambda v, other: F.col(f"{v.side}_id" if other.kind == "entity" else f"{v.side}_name") if v.kind == "entity" else v.column
    return Value("condition", F.coalesce(side(x, y) == side(y, x), F.lit(False)))


def compile_program(program: str, columns: list[str]) -> Column:
    stack = [Value("entity", side="b")]

    def pop(kind: str) -> Value:
        if not stack:
            raise ProgramError("the stack is empty")
        value = stack.pop()
        if kind != "any" and value.kind != kind:
            raise ProgramError(f"{kind} expected, {value.kind} found")
        return value

    for token in program.split():
        word = token.lower()
        if word in ("a", "b"):
            stack.append(Value("entity", side=word))
        elif word == "dup":
            stack.append(pop("any"))
            stack.append(stack[-1])
        elif word == "swap":
            y, x = pop("any"), pop("any")
            stack += [y, x]
        elif word in ATTRIBUTES:
            column = f"{pop('entity').side}_{ATTRIBUTES[word]}"
            if column not in columns:
                raise ProgramError(f"there is no column {column}")
            stack.append(Value("class" if word == "supercls" else "text", F.col(column)))
        elif word == "instanceof":
            y, x = pop("any"), pop("any")
            stack.append(instance_of(x, y, columns))
        elif word in TEXT_PARTS:
            stack.append(Value("text", TEXT_PARTS[word](pop("text").column)))
        elif word in TEXT_TESTS:
            t, s = pop("text"), pop("text")
            stack.append(Value("condition", F.coalesce(TEXT_TESTS[word](s.column, t.column), F.lit(False))))
        elif word in ("eq", "equals"):
            y, x = pop("any"), pop("any")
            stack.append(equal(x, y, columns))
        elif word == "not":
            stack.append(Value("condition", ~pop("condition").column))
        elif word in ("and", "or"):
            y, x = pop("condition"), pop("condition")
            stack.append(Value("condition", x.column & y.column if word == "and" else x.column | y.column))
        else:
            stack.append(Value("text", F.lit(token.strip('"'))))
    if len(stack) == 2:
        stack = [equal(*stack, columns)]
    if len(stack) != 1 or stack[0].kind != "condition":
        raise ProgramError("the program leaves no condition")
    return stack[0].column


def filter_ranked(ranked, program: str):
    """The rows that pass; all rows when the program is blank or cannot be compiled."""
    if not program.strip():
        return ranked
    try:
        return ranked.where(compile_program(program, ranked.columns))
    except ProgramError:
        return ranked


def simple_filter(ranked, text: str):
    """Rows whose score and name, written as '0.123 name', contain the text, whatever its case."""
    shown = F.concat_ws(" ", F.format_string("%.3f", F.col("score")), F.col("b_name"))
    return ranked.where(F.contains(F.lower(shown), F.lit(text.lower())))
