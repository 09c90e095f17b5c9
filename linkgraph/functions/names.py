"""Names and ids of entities: paths with '/' and '$', descriptors, flags, escapes, natural order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Primitive types and their words.
PRIMITIVES = {"B": "byte", "C": "char", "D": "double", "F": "float", "I": "int", "J": "long", "S": "short", "V": "void", "Z": "boolean"}
#: Access bits of a class and their words.
CLASS_FLAGS = {1: "public", 2: "private", 4: "protected", 8: "static", 16: "final", 32: "super", 512: "interface", 1024: "abstract", 4096: "synthetic", 8192: "annotation", 16384: "enum"}


def id_of(name: Column) -> Column:
    return F.when(name.startswith("["), name).otherwise(F.concat(F.lit("L"), name, F.lit(";")))


def name_of(id_: Column) -> Column:
    return F.regexp_extract(id_, r"(?s)^L(.*);$", 1)


def package(name: Column) -> Column:
    """Up to the last '/', null if there is none."""
    return F.when(F.instr(name, "/") > 0, F.regexp_extract(name, r"(?s)^(.*)/", 1))


def simple_name(name: Column) -> Column:
    return F.substring_index(name, "/", -1)


def outer(name: Column) -> Column:
    """Up to the last '$' that does not start its segment, null if there is none."""
    found = F.regexp_extract(name, r"(?s)^(.*[^/])\$", 1)
    return F.when(found != "", found)


def inner(name: Column) -> Column:
    return F.substring_index(name, "$", -1)


def nested(outer_name: Column, inner_name: Column) -> Column:
    """Null as soon as a part is."""
    return F.concat(outer_name, F.lit("$"), inner_name)


def natural_key(text: Column) -> Column:
    """A string whose order is the natural one: digit runs, without leading zeros, begin with their length, so Brand#5
    comes before Brand#13, whatever the number of digits."""
    runs = F.regexp_extract_all(text, F.lit(r"([0-9]+|[^0-9]+)"), 1)

    def number(x: Column) -> Column:
        digits = F.regexp_replace(x, "^0+(?=[0-9])", "")
        return F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)

    return F.array_join(F.transform(runs, lambda x: F.when(x.rlike("^[0-9]"), number(x)).otherwise(x)), "")


def html_escape(text: Column) -> Column:
    #: '&' goes first
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, text)


def flag_words(access: Column, words: dict[int, str] = CLASS_FLAGS) -> Column:
    """The words of the set bits in ascending order; what is left is a hexadecimal number."""
    parts = [F.when(access.bitwiseAND(F.lit(bit)) != 0, F.lit(word)) for bit, word in words.items()]
    known = sum(words)
    rest = access.bitwiseAND(F.lit(~known))
    return F.concat_ws(" ", *parts, F.when(rest != 0, F.concat(F.lit("0x"), F.lower(F.hex(rest)))))


def is_identifier(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[\p{L}_$][\p{L}\p{Nd}_$]*$"), F.lit(False))


def display_type(id_: Column) -> Column:
    """Dots for '/', words for primitives, '[]' for each dimension."""
    base = F.regexp_replace(id_, r"^\[+", "")
    dims = F.length(id_) - F.length(base)
    word = reduce(lambda x, p: F.when(base == p[0], p[1]).otherwise(x), PRIMITIVES.items(), F.replace(name_of(base), F.lit("/"), F.lit(".")))
    return F.concat(word, F.repeat(F.lit("[]"), dims))


def resolve_name(mapped: Column, matched_mapped: Column, plain: Column, readable: Column, matched_plain: Column, matched_readable: Column, aux: Column, tmp: Column) -> Column:
    """The name to show: mapped, the match's mapped, plain if readable, the match's plain if readable, aux, tmp, plain."""
    return F.coalesce(mapped, matched_mapped, F.when(readable, plain), F.when(matched_readable, matched_plain), aux, tmp, plain)


#: Namespaces and what they may show: plain, mapped and temporary names, the number of an auxiliary name.
NAMESPACES = {
    "plain": (True, False, False, 0),
    "mapped": (False, True, False, 0),
    "aux": (False, False, False, 1),
    "aux2": (False, False, False, 2),
    "mapped_plain": (True, True, False, 0),
    "mapped_aux_plain": (True, True, False, 1),
    "mapped_aux2_plain": (True, True, False, 2),
    "mapped_tmp_plain": (True, True, True, 0),
    "mapped_loctmp_plain": (True, True, False, 0),
    "uid_plain": (True, False, False, 0),
    "tmp_plain": (True, False, True, 0),
    "loctmp_plain": (True, False, False, 0),
    "aux_plain": (True, False, False, 1),
    "aux2_plain": (True, False, False, 2),
}


def class_name(ns: str, own: str, match: str, outer_name: Column, match_outer_name: Column, prefix: str = "class_") -> Column:
    """The name of a class in a namespace, composed with its outer class.

    own and match are the prefixes of the columns name, obfuscated, mapped, aux, aux2, tmp, uid and outer
    (the plain name of the outer class) of the class and of its match, whose columns are null where there is
    none; outer_name and match_outer_name are the outer classes' names in this namespace. The first of what
    the namespace may show counts: mapped, the match's mapped, a readable plain name, the match's, aux, the
    match's, the match's temporary one, the own one, the plain one. A name of the match is only taken
    where it can stand here: not from an obfuscated inner class whose name is no identifier, for a class
    that is no inner one.
    """
    plain, mapped, tmp, aux = NAMESPACES[ns]
    a, b = lambda c: F.col(f"{own}{c}"), lambda c: F.col(f"{match}{c}")
    local = lambda full, outer: F.when(outer.isNull(), full).otherwise(inner(full))
    if ns == "plain":
        return a("name")

    def transferable(name: Column) -> Column:
        fits = ~b("obfuscated") | a("outer").isNotNull() | b("outer").isNull() | name.rlike(r"^[\p{L}_$]")
        return F.when((name != "") & fits, name)

    auxiliary = {1: "aux", 2: "aux2"}.get(aux)
    choices: list[tuple[Column, bool]] = []
    if mapped:
        choices += [(a("mapped"), False), (transferable(b("mapped")), True), (F.when(~a("obfuscated"), local(a("name"), a("outer"))), False), (F.when(~b("obfuscated"), local(b("name"), b("outer"))), True)]
    if auxiliary:
        choices += [(a(auxiliary), False), (transferable(b(auxiliary)), True)]
    if tmp:
        choices += [(b("tmp"), True)]
    if tmp or "loctmp" in ns:
        choices += [(a("tmp"), False)]
    if plain:
        choices += [(local(a("name"), a("outer")), False)]
    found = F.coalesce(*[F.when(c.isNotNull(), F.struct(c.alias("name"), F.lit(theirs).alias("theirs"))) for c, theirs in choices])
    name, theirs = found["name"], found["theirs"]
    here, there = a("outer").isNotNull(), b("outer").isNotNull()
    composed = (
        F.when(~theirs | (here == there), F.when(here, nested(outer_name, name)).otherwise(name))
        .when(here, nested(outer_name, simple_name(name)))
        .otherwise(F.concat(F.coalesce(F.concat(package(match_outer_name), F.lit("/")), F.lit("")), name))
    )
    if ns == "uid_plain":
        number = uid(a("uid"), b("uid"))
        return F.when(number >= 0, F.concat(F.lit(prefix), number.cast("string"))).otherwise(composed)
    return composed


def record_names(field_obfuscated: Column, method_obfuscated: Column, field_name: Column, method_name: Column, field_mapped: Column, method_mapped: Column) -> Column:
    """(field, method): the mapped names that a record's field and its accessor get; null where one keeps what it has.

    At most one of them changes: the accessor when it is obfuscated and the field is readable, or the accessor has no
    mapped name, or the field has one; else the field. Two readable names, or equal ones, stay."""
    differ = (field_obfuscated | method_obfuscated) & ~field_name.eqNullSafe(method_name)
    to_method = method_obfuscated & (~field_obfuscated | ~method_mapped | field_mapped)
    return F.struct(F.when(differ & ~to_method, method_name).alias("field"), F.when(differ & to_method, field_name).alias("method"))


def handle_kind(tag: Column, owner_is_interface: Column) -> Column:
    """What a method handle (tag 1 to 9) refers to: a field, a method, a constructor, or an interface's method."""
    return F.when(tag.between(1, 4), "field").when(tag == 9, "interface method").when(tag == 8, "constructor").when(tag.isin(6, 7) & owner_is_interface, "interface method").when(tag.between(5, 7), "method")


def uid(own: Column, matched: Column) -> Column:
    return F.coalesce(F.least(own, matched), F.lit(-1))
