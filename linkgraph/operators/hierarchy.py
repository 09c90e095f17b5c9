"""Members along class hierarchies: groups that share a name, and what overrides what.

Classes come as (child, parent) edges, members as (member, owner, id, barrier, ...): id is the name with
its descriptor, barrier tells private and static ones, which share with nobody.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import keep
from .graphs import components


def groups(ancestors: DataFrame, members: DataFrame) -> DataFrame:
    """(member, group): the smallest member of each group. ancestors is closure(edges).

    Members with one id that stand above one class, or in it, are one group, and so are groups that
    share a member. Only classes that nothing extends are looked at, since all others are above one.
    Barriers are groups of their own."""
    open_ = members.where("not barrier").select("member", "owner", "id")
    inner = ancestors.where("depth > 0").select(F.col("ancestor").alias("node")).distinct()
    leaves = ancestors.join(inner, "node", "left_anti").select("node", F.col("ancestor").alias("owner"))
    alone = open_.select(F.col("owner").alias("node"), "owner").distinct().join(ancestors.select("node").distinct(), "node", "left_anti")
    seen = keep(leaves.unionByName(alone).join(open_, "owner").select("node", "id", "member"))
    first = seen.groupBy("node", "id").agg(F.min("member").alias("first"))
    links = seen.join(first, ["node", "id"]).where("member <> first").select(F.col("member").alias("a"), F.col("first").alias("b")).distinct()
    found = components(links).select(F.col("node").alias("member"), F.col("comp").alias("group"))
    return members.select("member").join(found, "member", "left").select("member", F.coalesce("group", "member").alias("group"))


def overrides(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(member, parent): the nearest members with the same id along each way up. A way ends where the id is declared;
    barriers are passed over, and neither they nor constructors (id beginning with <) override."""
    open_ = keep(members.where("not barrier and not startswith(id, '<')").select("member", "owner", "id"))
    declared = open_.select(F.col("owner").alias("at"), "id", F.col("member").alias("parent"))
    up = keep(edges.select(F.col("child").alias("at"), F.col("parent").alias("above")).where("at is not null and above is not null").distinct())
    ways = keep(open_.join(up, open_["owner"] == up["at"]).select("member", "id", F.col("above").alias("at")).distinct())
    found = None
    while not ways.isEmpty():
        hits = keep(ways.join(declared, ["at", "id"]).select("member", "id", "at", "parent"))
        found = hits.select("member", "parent") if found is None else found.unionByName(hits.select("member", "parent"))
        further = ways.join(hits.select("member", "at").distinct(), ["member", "at"], "left_anti")
        ways = keep(further.join(up, "at").select("member", "id", F.col("above").alias("at")).distinct())
    return open_.sparkSession.createDataFrame([], declared.select(F.col("parent").alias("member"), "parent").schema) if found is None else found.distinct()


def ancestry(parents: DataFrame, origins: DataFrame) -> DataFrame:
    """(member, has_parent, is_root) from overrides, direct and indirect, and the origins (member, origin) that supply a
    member: whether some origin supplies an overridden member too, and whether some origin does not."""
    from .graphs import closure

    above = closure(parents.select(F.col("member").alias("child"), "parent")).where("depth > 0").select(F.col("node").alias("member"), F.col("ancestor").alias("parent"))
    theirs = above.join(origins.select(F.col("member").alias("parent"), "origin"), "parent").select("member", "origin").distinct().withColumn("there", F.lit(True))
    both = origins.select("member", "origin").distinct().join(theirs, ["member", "origin"], "left").withColumn("there", F.coalesce("there", F.lit(False)))
    return both.groupBy("member").agg(F.bool_or("there").alias("has_parent"), F.bool_or(~F.col("there")).alias("is_root"))


def mapped_children(members: DataFrame, variables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(owner, has_mapped) of classes and (member, has_mapped, all_args) of methods.

    members are (member, owner, kind, mapped, has_parent), variables (member, is_arg, mapped). A class has mapped
    children when a field is mapped, or a method that overrides nothing is, or a method has a mapped
    argument or variable. all_args tells whether all arguments are mapped; it holds without arguments."""
    inside = variables.groupBy("member").agg(F.bool_or("mapped").alias("has_mapped"), F.bool_and(F.col("mapped") | ~F.col("is_arg")).alias("all_args"))
    methods = members.where("kind = 'method'").join(inside, "member", "left").select("member", F.coalesce("has_mapped", F.lit(False)).alias("has_mapped"), F.coalesce("all_args", F.lit(True)).alias("all_args"))
    counted = members.join(methods.select("member", F.col("has_mapped").alias("_inside")), "member", "left")
    own = F.when(F.col("kind") == "field", F.col("mapped")).otherwise((F.col("mapped") & ~F.col("has_parent")) | F.coalesce("_inside", F.lit(False)))
    return counted.groupBy("owner").agg(F.bool_or(own).alias("has_mapped")), methods
