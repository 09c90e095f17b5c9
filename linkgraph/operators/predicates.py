"""Whether two entities can be the same, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def compatible_names(obfuscated_a: Column, obfuscated_b: Column, name_a: Column, name_b: Column, both_or_none: bool = False) -> Column:
    """Both obfuscated: yes; one: unless both or none must be; neither: when the names are equal."""
    return F.when(obfuscated_a & obfuscated_b, True).when(obfuscated_a | obfuscated_b, not both_or_none).otherwise(name_a == name_b)


def nullable(a: Column, b: Column, test: Column) -> Column:
    """Both absent: yes; one: no; else test."""
    return F.when(a.isNull() & b.isNull(), True).when(a.isNull() | b.isNull(), False).otherwise(test)


def compatible_classes(same: Column, match_a: Column, id_b: Column, matchable: Column, dims_a: Column, dims_b: Column, names: Column) -> Column:
    """The same entity; else an existing match decides; else both matchable, equally many dimensions, names fit."""
    return F.when(same, True).when(match_a.isNotNull(), match_a == id_b).otherwise(matchable & (dims_a == dims_b) & names)


def compatible_members(owners: Column, special_a: Column, special_b: Column, names: Column, name_a: Column, name_b: Column, group_match_a: Column, group_b: Column) -> Column:
    """Owners compatible; constructors agree by name; a matched group decides; else names fit."""
    special = special_a | special_b
    return owners & F.when(special & (name_a != name_b), False).when(group_match_a.isNotNull(), group_match_a == group_b).otherwise(names)


def can_match(id_b: Column, match_a: Column, matchable_a: Column, matchable_b: Column, same_kind: Column | None = None) -> Column:
    """Whether two entities that are there can be matched by hand: not yet with each other, both matchable, and of one kind
    (methods or fields, arguments or local variables)."""
    kind = F.lit(True) if same_kind is None else same_kind
    return F.coalesce(id_b.isNotNull() & kind & ~match_a.eqNullSafe(id_b) & matchable_a & matchable_b, F.lit(False))


def toggled(matchable: Column, matched: Column, potential: Column) -> Column:
    """Whether an entity is matchable after the toggle: an unmatchable one is; a matchable one is not, unless it is matched
    or nothing could be its match anyway."""
    return F.when(~matchable, True).when(matched | ~potential, True).otherwise(False)
