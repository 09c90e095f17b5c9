"""Between match files and entities: which rows of a file can be applied, and which rows a state of matches gives.

Entities of a side are a Known: classes (class_id, matchable, mapped), members (class_id, member_id, kind, matchable, mapped)
and variables (class_id, member_id, kind, idx, matchable, mapped); mapped tells whether the entity, or something in it
that it does not inherit, has a mapped name. Kinds are those of match files. Entities of the tables are real.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Known:
    classes: DataFrame
    members: DataFrame
    variables: DataFrame


CLASS, MEMBER, VARIABLE = ["class"], ["class", "member"], ["class", "member", "idx"]


def _keyed(df: DataFrame, side: str, keys: list[str], kinds: bool) -> DataFrame:
    names = {"class": "class_id", "member": "member_id", "idx": "idx"}
    return df.select(*[F.col(names[k]).alias(f"{side}_{k}") for k in keys], *(["kind"] if kinds else []), F.col("matchable").alias(f"{side}_matchable"))


def resolve(matches: DataFrame, a: Known, b: Known) -> DataFrame:
    """The rows of a match file with status: ok; unknown a or unknown b, where an entity does not exist; unmatchable,
    where one of both may not be matched; skipped, where the line that a row belongs to is not ok.

    A line that takes an entity out of matching only needs that entity (and, for members and variables, a class or
    method line above it that is ok; what a side's method has can be taken out even if its partner is unknown).
    """
    out = None
    parents: DataFrame | None = None
    for kinds, keys, name in ((("class",), CLASS, "classes"), (("method", "field"), MEMBER, "members"), (("arg", "var"), VARIABLE, "variables")):
        rows, deep = matches.where(F.col("kind").isin(*kinds)), len(keys) > 1
        for s, side in (("a", a), ("b", b)):
            rows = rows.join(_keyed(getattr(side, name), s, keys, deep), [f"{s}_{k}" for k in keys] + (["kind"] if deep else []), "left")
        unknown = lambda s: (F.coalesce("side", F.lit(s)) == s) & F.col(f"{s}_matchable").isNull()
        barred = ~F.col("unmatchable") & (~F.col("a_matchable") | ~F.col("b_matchable"))
        status = F.when(unknown("a"), "unknown a").when(unknown("b"), "unknown b").when(barred, "unmatchable").otherwise("ok")
        if parents is None:
            judged = rows.withColumn("status", status)
        else:
            above = keys[:-1]
            judged = rows.join(parents, [f"{s}_{k}" for s in "ab" for k in above], "left")
            lonely = F.col("unmatchable") & (F.col("side") == "a") & (F.col("above") == "unknown b") & (F.lit(len(keys)) == 3)
            judged = judged.withColumn("status", F.when((F.coalesce("above", F.lit("")) == "ok") | F.coalesce(lonely, F.lit(False)), status).otherwise("skipped"))
        here = judged.where("not unmatchable and kind not in ('field', 'arg', 'var')")
        parents = here.groupBy(*[f"{s}_{k}" for s in "ab" for k in keys]).agg(F.min("status").alias("above")) if len(keys) < 3 else None
        judged = judged.select(*matches.columns, "status")
        out = judged if out is None else out.unionByName(judged)
    return out


def rows_to_save(a: Known, b: Known, classes: DataFrame, members: DataFrame, variables: DataFrame, save_unmapped: bool = True) -> DataFrame:
    """Rows of a match file for the matches: classes (a_class, b_class), members (kind, a_class, a_member, b_class, b_member) and
    variables (kind, a_class, a_member, a_idx, b_class, b_member, b_idx).

    An entity is saved when it is matched or may not be matched, and has a mapped name, or save_unmapped is set. Entities of
    b's side have rows of their own only where they may not be matched. Members are saved below matched classes that are,
    variables below matched methods that are. Where b's entity decides, a's side is null.
    """
    wanted = F.lit(True) if save_unmapped else F.col("mapped")
    idx, text = (lambda v: F.lit(v).cast("int")), (lambda v: F.lit(v).cast("string"))
    empty = {"a_class": text(None), "b_class": text(None), "a_member": text(None), "b_member": text(None), "a_idx": idx(None), "b_idx": idx(None)}

    def shaped(df: DataFrame, side: str | None, **given) -> DataFrame:
        cols = {**empty, **{c: F.col(c) for c in empty if c in df.columns}, **given}
        kind = F.col("kind") if "kind" in df.columns else F.lit("class")
        return df.select(kind.alias("kind"), *[c.alias(n) for n, c in cols.items()], text(side).alias("side"), F.lit(side is not None).alias("unmatchable"))

    own = lambda df, s, *more: df.select(F.col("class_id").alias(f"{s}_class"), *more, "matchable", "mapped")
    ca, cb = own(a.classes, "a"), own(b.classes, "b")
    saved = ca.where(wanted).join(classes, "a_class").select("a_class", "b_class")
    rows = shaped(saved, None)
    rows = rows.unionByName(shaped(ca.where(~F.col("matchable") & wanted).join(classes, "a_class", "left_anti"), "a"))
    rows = rows.unionByName(shaped(cb.where(~F.col("matchable") & wanted).join(classes, "b_class", "left_anti"), "b"))

    def inside(rows: DataFrame, name: str, keys: list[str], pairs: DataFrame, above: DataFrame) -> tuple[DataFrame, DataFrame]:
        columns = lambda s: [f"{s}_{k}" for k in keys[1:]]
        names = {"member": "member_id", "idx": "idx"}
        of = lambda side, s: own(getattr(side, name), s, "kind", *[F.col(names[k]).alias(f"{s}_{k}") for k in keys[1:]])
        up = lambda s: [f"{s}_{k}" for k in keys[:-1]]
        mine, theirs = of(a, "a").join(above, up("a")), of(b, "b").join(above, up("b"))
        on_a, on_b = ["kind", "a_class", *columns("a")], ["kind", "b_class", *columns("b")]
        both = mine.where(wanted).drop("b_class", *[c for c in up("b") if c in mine.columns]).join(pairs, on_a)
        alone = lambda df, on: df.where(~F.col("matchable") & wanted).join(pairs.select(*on), on, "left_anti")
        return rows.unionByName(shaped(both, None)).unionByName(shaped(alone(mine, on_a), "a")).unionByName(shaped(alone(theirs, on_b), "b")), both

    rows, below = inside(rows, "members", MEMBER, members, saved)
    methods = below.where("kind = 'method'").select("a_class", "a_member", "b_class", "b_member")
    return inside(rows, "variables", VARIABLE, variables, methods)[0]
