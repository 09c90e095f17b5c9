"""Joins of intervals that overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import keep

#: Probes of one bin that a task meets; a bin with more is split.
BIN_PROBES = 4096


def overlapping(intervals: DataFrame, probes: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of rows of intervals and probes with equal keys whose half-open ranges (start, end as bigint) overlap:
    the keys, `interval` and `probe` as structs of the whole rows. Empty ranges, and null ends, overlap with nothing.

    A range of at most 2 ** n lies in one or two bins of that width, whatever the spread of lengths. Two ranges meet at
    the width of the longer one, in the bin in which the later one starts, so each pair is found once and only ranges
    that are near each other are compared. Each side is put into its own width and the wider ones that the other side has
    (at most 64 numbers come to the driver). A bin with very many probes is split: its probes are dealt out, and its
    intervals go to every part.
    """
    clean = lambda df, name: df.where("end > start").select(*keys, "start", "end", F.ceil(F.log2(F.col("end") - F.col("start"))).cast("int").alias("level"), F.struct(*df.columns).alias(name))
    left, right = keep(clean(intervals, "interval")), keep(clean(probes, "probe"))
    levels = {side: sorted(r[0] for r in df.select("level").distinct().collect()) for side, df in (("interval", left), ("probe", right))}

    def binned(df: DataFrame, name: str, others: list[int]) -> DataFrame:
        own = F.array(F.col("level"))
        wide = F.array_distinct(F.concat(own, F.filter(F.array(*[F.lit(x) for x in others]).cast("array<int>"), lambda x: x > F.col("level"))))
        at = df.select(*keys, "start", "end", F.col("level").alias("own"), name, F.explode(wide).alias("level"))
        bins = F.sequence(F.expr("shiftright(start, level)"), F.expr("shiftright(end - 1, level)"))
        return at.select(*keys, "level", F.explode(bins).alias("bin"), F.struct("start", "end", "own", name).alias(name))

    a, b = binned(left, "interval", levels["probe"]), binned(right, "probe", levels["interval"])
    place = [*keys, "level", "bin"]
    full = keep(b.groupBy(*place).agg(F.ceil(F.count("*") / BIN_PROBES).cast("int").alias("parts")).where("parts > 1"))
    if full.isEmpty():
        a, b = a.withColumn("part", F.lit(0)), b.withColumn("part", F.lit(0))
    else:
        parts = F.coalesce("parts", F.lit(1))
        a = a.join(full, place, "left").select(*place, "interval", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
        b = b.join(full, place, "left").select(*place, "probe", F.pmod(F.xxhash64("probe"), parts).cast("int").alias("part"))
    x, y = (lambda c: F.col(f"interval.{c}")), (lambda c: F.col(f"probe.{c}"))
    meet = (F.greatest(x("own"), y("own")) == F.col("level")) & (x("start") < y("end")) & (y("start") < x("end"))
    here = F.expr("bin = shiftright(greatest(interval.start, probe.start), level)")
    return a.join(b, [*place, "part"]).where(meet & here).select(*keys, F.col("interval.interval").alias("interval"), F.col("probe.probe").alias("probe"))
