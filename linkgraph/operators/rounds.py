"""Rounds of matching: each scores under the matches of the round before, then applies what it accepts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import keep


def apply_matches(old: DataFrame, new: DataFrame) -> DataFrame:
    """old and new as (a, b); a new pair takes both its ends out of older pairs."""
    left = old.join(new.select("a"), "a", "left_anti").join(new.select("b"), "b", "left_anti")
    return left.select("a", "b").unionByName(new.select("a", "b"))


def unmatch(matches: DataFrame, ends: DataFrame, members: DataFrame, of: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Takes the owners in ends (a) out of matches, and their members (owner, a) out of the member matches."""
    gone = members.join(ends.select(F.col("a").alias("owner")), "owner", "left_semi").select("a")
    return matches.join(ends.select("a"), "a", "left_anti"), of.join(gone, "a", "left_anti")


def match_members(pairs: DataFrame, members_a: DataFrame, members_b: DataFrame, classes: DataFrame, matches: DataFrame, old: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The matches (a, b) after the members of pairs (a, b), whose owners are matched, are matched too; and the members
    (a, b; one of them null) that lost their match, whose arguments and variables lose theirs.

    members are (member, group, owner), classes the matched owners. Where no member of a's hierarchy group
    is matched with one of b's, both groups lose their matches, and each member of a's group whose owner is
    matched goes with the smallest member of b's group in that owner's match. Where the groups are paired
    already, only the two change partners. pairs are of different groups, or of paired ones. Where the caller has them,
    old is matches with group_a, owner_a, group_b and owner_b of their members, and pairs have group_a and group_b."""
    side = lambda m, s: m.select(F.col("member").alias(s), F.col("group").alias(f"group_{s}"), F.col("owner").alias(f"owner_{s}"))
    a, b = side(members_a, "a"), side(members_b, "b")
    placed = {"group_a", "group_b"} <= set(pairs.columns)
    if old is None or not placed:
        a, b = keep(a), keep(b)
    old = keep(matches.select("a", "b").join(a, "a").join(b, "b")) if old is None else old
    pairs = pairs.select("a", "b", "group_a", "group_b") if placed else pairs.select("a", "b").join(a, "a").join(b, "b")
    paired = old.select("group_a", "group_b").distinct().withColumn("paired", F.lit(True))
    asked = keep(pairs.join(paired, ["group_a", "group_b"], "left").join(old.select("a", "b", F.lit(True).alias("there")), ["a", "b"], "left").where("there is null"))
    new_groups = keep(asked.where("paired is null").select("group_a", "group_b").distinct())
    single = asked.where("paired").select("a", "b")
    kept = old.join(new_groups, "group_a", "left_anti").join(new_groups, "group_b", "left_anti").join(single.select("a"), "a", "left_anti").join(single.select("b"), "b", "left_anti").select("a", "b")
    owners = classes.select(F.col("a").alias("owner_a"), F.col("b").alias("owner_b"))
    grouped = new_groups.join(a, "group_a").join(owners, "owner_a").join(b, ["group_b", "owner_b"]).groupBy("a").agg(F.min("b").alias("b"))
    after = keep(kept.unionByName(grouped).unionByName(single))
    lost = old.select("a", "b").join(after, ["a", "b"], "left_anti")
    ends = lost.select("a", F.lit(None).cast(lost.schema["b"].dataType).alias("b")).unionByName(lost.select(F.lit(None).cast(lost.schema["a"].dataType).alias("a"), "b"))
    return after, ends


def to_fixpoint(start: DataFrame, step: Callable[[DataFrame], DataFrame], most: int = 100) -> DataFrame:
    """Applies what step(matches) accepts until it accepts nothing new. Every round is written to the shared folder.
    Raises if most rounds have all accepted something and the next one still does."""
    matches = keep(start)
    for n in range(most + 1):
        fresh = keep(step(matches).join(matches, ["a", "b"], "left_anti"))
        if fresh.isEmpty():
            return matches
        if n < most:
            matches = keep(apply_matches(matches, fresh))
    raise RuntimeError(f"matches are still accepted after {most} rounds")


def status(entities: DataFrame, matches: DataFrame) -> DataFrame:
    """(kind, matched, total, percent) of the entities (kind, a)."""
    hit = entities.join(matches.select("kind", "a", F.lit(1).alias("hit")).distinct(), ["kind", "a"], "left")
    counted = hit.groupBy("kind").agg(F.count("hit").alias("matched"), F.count("*").alias("total"))
    return counted.withColumn("percent", F.round(100 * F.col("matched") / F.nullif("total", F.lit(0)), 2))
