"""Consecutive numbers in a global order, without a task that sees all rows; and what is built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import keep


def number_in_order(df: DataFrame, keys: list, start: int = 0) -> DataFrame:
    """df with number: start + 1, start + 2, ... in the order of keys. Range partitions count their own rows, and only
    their sizes, one row a partition, are summed."""
    parted = keep(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_m", F.monotonically_increasing_id()))
    part, within = F.shiftright("_m", 33), F.col("_m").bitwiseAND((1 << 33) - 1)
    sizes = parted.groupBy(part.alias("_p")).count()
    before = sizes.select("_p", (F.coalesce(F.sum("count").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + start + 1).alias("_b"))
    return parted.withColumn("_p", part).join(F.broadcast(before), "_p").withColumn("number", F.col("_b") + within).drop("_m", "_p", "_b")


def group_names(members: DataFrame, prefix: str) -> DataFrame:
    """(member, name): temporary names of the obfuscated members (member, owner, group, obfuscated, order, owner_order).

    The members of a group of several share one name, prefix and a number that counts those groups in the order of their
    first obfuscated member; a member alone in its group is counted within its owner."""
    sizes = members.groupBy("group").agg(F.count("*").alias("size"))
    wanted = members.where("obfuscated").join(sizes, "group")
    shared = wanted.where("size > 1").groupBy("group").agg(F.min(F.struct("owner_order", "order")).alias("first"))
    named = number_in_order(shared.select("group", F.col("first.owner_order").alias("_o"), F.col("first.order").alias("_i"), F.col("group").alias("_g")), ["_o", "_i", "_g"], -1)
    virtual = wanted.where("size > 1").join(named, "group").select("member", F.concat(F.lit(f"v{prefix}"), F.col("number").cast("string")).alias("name"))
    at = F.row_number().over(W.partitionBy("owner").orderBy("order", "member")) - 1
    alone = wanted.where("size = 1").select("member", F.concat(F.lit(prefix), at.cast("string")).alias("name"))
    return virtual.unionByName(alone)


def group_numbers(members: DataFrame, start: int) -> DataFrame:
    """(member, uid): the next numbers for the groups that have an obfuscated member without a uid, in the order of their
    first such member (owner_order, order); all members of a group share its number, and no number is left out."""
    asked = members.where("obfuscated and uid is null").groupBy("group").agg(F.min(F.struct("owner_order", "order")).alias("first"))
    numbered = number_in_order(asked.select("group", F.col("first.owner_order").alias("_o"), F.col("first.order").alias("_i"), F.col("group").alias("_g")), ["_o", "_i", "_g"], start)
    return members.join(numbered.select("group", "number"), "group").select("member", F.col("number").alias("uid"))
