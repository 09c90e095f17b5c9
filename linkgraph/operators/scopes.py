"""Names resolved in scopes, by places of falling priority."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import keep


def resolve_names(references: DataFrame, types: DataFrame, imports: DataFrame, packages: DataFrame, outer: DataFrame) -> DataFrame:
    """(scope, name, type, how, ambiguous) for the distinct references (scope, name).

    Places in order: what a scope imports by name (scope, name, type; it need not be among the types); the packages that it
    imports whole (scope, package, at), the smallest at first, for package/name; the types nested in the scope, then in the one
    around it (outer: scope, around), and so on outwards, for scope$name. A reference is settled at the first place that
    has a type (types: type) and goes no further; of several types at one place the first in order is taken, and
    ambiguous says so. type and how are null where no place has one.
    """
    open_ = keep(references.select("scope", "name").distinct())
    known = types.select("type").distinct()
    settled = None

    def settle(hits: DataFrame, how: str) -> None:
        """hits (scope, name, at, type): takes the references with hits out of what is open."""
        nonlocal open_, settled
        first = hits.groupBy("scope", "name").agg(F.min("at").alias("at"))
        found = hits.join(first, ["scope", "name", "at"]).groupBy("scope", "name").agg(F.min("type").alias("type"), (F.count_distinct("type") > 1).alias("ambiguous")).select("scope", "name", "type", F.lit(how).alias("how"), "ambiguous")
        found = keep(found)
        settled = found if settled is None else settled.unionByName(found)
        open_ = keep(open_.join(found.select("scope", "name"), ["scope", "name"], "left_anti"))

    settle(open_.join(imports.select("scope", "name", "type"), ["scope", "name"]).withColumn("at", F.lit(0)), "import")
    whole = open_.join(packages.select("scope", "package", "at"), "scope").withColumn("type", F.concat_ws("/", "package", "name"))
    settle(whole.join(known, "type", "left_semi").select("scope", "name", "at", "type"), "package")
    around = keep(open_.select("scope").distinct().withColumn("place", F.col("scope")))
    step = 0
    while not around.isEmpty():
        nested = open_.join(around, "scope").withColumn("type", F.concat_ws("$", "place", "name"))
        settle(nested.join(known, "type", "left_semi").select("scope", "name", F.lit(step).alias("at"), "type"), "nested" if step == 0 else f"around {step}")
        left = open_.select("scope").distinct()
        around = keep(around.join(left, "scope", "left_semi").join(outer.select(F.col("scope").alias("place"), "around"), "place").select("scope", F.col("around").alias("place")))
        step += 1
    none = F.lit(None).cast("string")
    return settled.unionByName(open_.select("scope", "name", none.alias("type"), none.alias("how"), F.lit(False).alias("ambiguous")))


def propagate_arguments(members: DataFrame, arguments: DataFrame) -> DataFrame:
    """(member, idx, name) of all arguments (member, idx, name) after names have spread in hierarchy groups (members:
    member, group) of several members: an argument without a name takes that of the first member of its group that
    has one at this place; those that have one keep it."""
    several = members.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group")
    grouped = arguments.join(members.select("member", "group"), "member")
    given = grouped.where("name is not null").join(several, "group", "left_semi").groupBy("group", "idx").agg(F.min_by("name", "member").alias("given"))
    return grouped.join(given, ["group", "idx"], "left").select("member", "idx", F.coalesce("name", "given").alias("name"))
