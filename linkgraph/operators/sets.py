"""Soft similarity of sets of entities, under the matches so far."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import keep


def soft_sets(left: DataFrame, right: DataFrame, matches: DataFrame, one_sided: bool = True) -> DataFrame:
    """Soft similarity of sets given as rows (pair, elem, kind).

    Elements of both sides that are the same or matched with each other agree. A matched element whose
    partner is not there counts against the pair. An element without a match agrees when the other side
    still has one of its kind. score = (total - against) / total; one side empty: 0, or no row where
    one_sided is not set. A pair without any row on either side has no row here: its score is 1.

    Both sides meet by element, then what only one side has by partner, and what is left by kind: sums and
    small sets of kinds, combined before each shuffle.
    """
    kinds = lambda side: F.collect_set(F.when(F.col("left") == side, F.struct("kind")))
    tagged = lambda side, df: df.select("pair", "elem", "kind", F.lit(side).alias("left"))
    rows = keep(tagged(True, left).unionByName(tagged(False, right)).groupBy("pair", "elem").agg(kinds(True).alias("l"), kinds(False).alias("r")))
    sizes = rows.groupBy("pair").agg(F.sum(F.size("l")).alias("l"), F.sum(F.size("r")).alias("r"))
    single = rows.where((F.size("l") == 0) | (F.size("r") == 0) | F.col("elem").isNull())
    partners = matches.select(F.col("a").alias("elem"), F.col("b").alias("partner"))
    a = single.where(F.size("l") > 0).select("pair", "elem", "l").join(partners, "elem", "left").select("pair", F.col("partner").alias("elem"), F.explode("l.kind").alias("kind"))
    b = single.where(F.size("r") > 0).select("pair", "elem", "r")
    met = a.where("elem is not null").groupBy("pair", "elem").agg(F.count("*").alias("n"), F.lit(None).cast(rows.schema["r"].dataType).alias("r"))
    by_partner = met.unionByName(b.select("pair", "elem", F.lit(0).cast("bigint").alias("n"), "r")).groupBy("pair", "elem").agg(F.sum("n").alias("n"), F.first("r", ignorenulls=True).alias("r"))
    lost = by_partner.where(F.col("r").isNull()).select("pair", "n")
    kept_b = by_partner.where((F.col("n") == 0) | F.col("elem").isNull()).select("pair", F.explode("r.kind").alias("kind"))
    count = lambda side: F.count(F.when(F.col("left") == side, 1))
    of_kind = a.where("elem is null").select("pair", "kind", F.lit(True).alias("left")).unionByName(kept_b.select("pair", "kind", F.lit(False).alias("left"))).groupBy("pair", "kind").agg(count(True).alias("x"), count(False).alias("y"))
    x, y = F.col("x"), F.col("y")
    open_ = of_kind.select("pair", F.when(F.col("kind").isNull() | (x == 0) | (y == 0), x + y).otherwise(0).alias("n"))
    against = lost.unionByName(open_).groupBy("pair").agg(F.sum("n").alias("against"))
    total = F.col("l") + F.col("r")
    score = F.when((F.col("l") == 0) | (F.col("r") == 0), 0.0).otherwise((total - F.coalesce("against", F.lit(0))) / total)
    return (sizes if one_sided else sizes.where("l > 0 and r > 0")).join(against, "pair", "left").select("pair", score.alias("score"))
