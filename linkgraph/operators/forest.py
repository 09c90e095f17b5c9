"""Forests with numbered nodes: descendants are ranges of numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import forget, keep, stored
from .intervals import overlapping
from .numbering import number_in_order


def labels(nodes: DataFrame, order: list) -> DataFrame:
    """(node, parent, first, size, depth) of nodes (node, parent, and the columns of order; parent is null for roots).

    first numbers the nodes from 1 such that every node is followed by its descendants, siblings in the given order; the
    descendants of a node, itself included, are the size numbers from first on. The tour that enters and leaves every node,
    where leaves that follow each other are one, is a list, which is ranked by doubling: each round, every event skips as
    far as all rounds before together, so there are log2 of twice the nodes rounds at most, whatever the depth. A node whose parent is not in nodes is a root. Cycles are no forest.
    """
    spark = nodes.sparkSession
    known = nodes.select(F.col("node").alias("parent")).distinct()
    none = F.lit(None).cast(nodes.schema["parent"].dataType)
    rooted = nodes.join(known, "parent", "left_semi").unionByName(nodes.join(known, "parent", "left_anti").withColumn("parent", none))
    numbered = keep(number_in_order(rooted, [F.asc_nulls_first("parent"), *order, "node"]).select("node", "parent", "number"))
    up = numbered.select(F.col("node").alias("parent"), F.col("number").alias("above"))
    child = numbered.join(up, "parent").groupBy(F.col("above").alias("number")).agg(F.min("number").alias("child"))
    placed = keep(_in_runs(numbered.join(up, "parent", "left").join(child, "number", "left")))
    runs = keep(placed.groupBy("run").agg(F.count("*").alias("n"), F.first("above").alias("above"), F.max("child").alias("child")))
    after = runs.select((F.col("run") - 1).alias("last"), F.col("above").alias("next_above"), F.lit(True).alias("has_next"))
    # events: 2n enters the run that begins with node n, 2n + 1 leaves it
    linked = runs.withColumn("last", F.col("run") + F.col("n") - 1).join(after, "last", "left")
    sibling = F.col("has_next") & F.col("above").eqNullSafe(F.col("next_above"))
    enter = F.struct((2 * F.col("run")).alias("event"), F.coalesce(2 * F.col("child"), 2 * F.col("run") + 1).alias("next"), F.col("n").alias("nodes"), F.lit(1).cast("bigint").alias("net"))
    leave = F.struct((2 * F.col("run") + 1).alias("event"), F.when(F.coalesce(sibling, F.lit(False)), 2 * (F.col("last") + 1)).otherwise(2 * F.col("above") + 1).alias("next"), F.lit(0).cast("bigint").alias("nodes"), F.lit(-1).cast("bigint").alias("net"))
    tour, path = stored(linked.select(F.explode(F.array(enter, leave)).alias("e")).select("e.*"), "tour")
    while not tour.where("next is not null").isEmpty():
        ahead = tour.select(F.col("event").alias("next"), F.col("next").alias("further"), F.col("nodes").alias("more"), F.col("net").alias("more_net"))
        step = tour.join(ahead, "next", "left").select("event", F.col("further").alias("next"), (F.col("nodes") + F.coalesce("more", F.lit(0))).alias("nodes"), (F.col("net") + F.coalesce("more_net", F.lit(0))).alias("net"))
        tour, path, before = *stored(step, "tour"), path
        forget(spark, before)
    # nodes: how many are entered from an event to the end; net: minus the depth at the event
    ends = tour.groupBy(F.shiftright("event", 1).alias("run")).agg(F.max("nodes").alias("from_enter"), F.min("nodes").alias("from_leave"), F.min(F.when(F.col("event") % 2 == 1, F.col("net"))).alias("net"))
    found, total = placed.join(ends, "run"), numbered.count()
    size = F.when(F.col("child").isNull(), F.lit(1).cast("bigint")).otherwise(F.col("from_enter") - F.col("from_leave"))
    return keep(found.select("node", "parent", (total - F.col("from_enter") + 1 + F.col("number") - F.col("run")).alias("first"), size.alias("size"), (-F.col("net") - 1).cast("int").alias("depth")))


#: Numbers in a block are 2 ** RUN_BITS; a run of leaves ends with its block.
RUN_BITS = 12


def _in_runs(placed: DataFrame) -> DataFrame:
    """placed (number, above, child, ...) with run: siblings without children that follow each other share the number of the
    first of them; every other node is a run of its own."""
    by = W.partitionBy(F.shiftright("number", RUN_BITS)).orderBy("number")
    leaf = F.col("child").isNull()
    goes_on = leaf & F.coalesce(F.lag(leaf).over(by), F.lit(False)) & F.col("above").eqNullSafe(F.lag("above").over(by))
    return placed.withColumn("_on", goes_on).withColumn("run", F.max(F.when(~F.col("_on"), F.col("number"))).over(by.rowsBetween(W.unboundedPreceding, 0))).drop("_on")


def inside(number, first, size):
    """Whether a number is that of a descendant (or the node itself)."""
    return (number >= first) & (number < first + size)


def jumps(labelled: DataFrame) -> DataFrame:
    """(node, k, up, up_first, up_size): the ancestor 2 ** k steps above each node, as long as there is one."""
    at = labelled.select(F.col("node").alias("up"), F.col("first").alias("up_first"), F.col("size").alias("up_size"))
    step = keep(labelled.where("parent is not null").select("node", F.lit(0).alias("k"), F.col("parent").alias("up")).join(at, "up"))
    out, k = step, 0
    while True:
        further = step.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("up_first").alias("next_first"), F.col("up_size").alias("next_size"))
        k += 1
        step = keep(step.join(further, "up").select("node", F.lit(k).alias("k"), F.col("next").alias("up"), F.col("next_first").alias("up_first"), F.col("next_size").alias("up_size")))
        if step.isEmpty():
            return out
        out = out.unionByName(step.select(*out.columns))


def lowest_common(pairs: DataFrame, labelled: DataFrame) -> DataFrame:
    """(a, b, common) of the pairs (a, b) whose nodes have a common ancestor: from a, the farthest jumps to ancestors
    that do not hold b, and one step more. Rounds are the logarithm of the depth, and each joins the pairs once."""
    up = keep(jumps(labelled))
    side = lambda s: labelled.select(F.col("node").alias(s), F.col("first").alias(f"first_{s}"), F.col("size").alias(f"size_{s}"), F.col("parent").alias(f"parent_{s}"))
    both = pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b")
    holds = inside(F.col("first_b"), F.col("first_a"), F.col("size_a"))
    done = both.where(holds).select("a", "b", F.col("a").alias("common"))
    open_ = keep(both.where(~holds).select("a", "b", "first_b", F.col("a").alias("at"), F.col("parent_a").alias("above")))
    most = up.agg(F.max("k")).first()[0]
    for k in range(-1 if most is None else most, -1, -1):
        jump = up.where(F.col("k") == k).select(F.col("node").alias("at"), "up", "up_first", "up_size")
        moves = F.col("up").isNotNull() & ~inside(F.col("first_b"), F.col("up_first"), F.col("up_size"))
        open_ = keep(open_.join(jump, "at", "left").select("a", "b", "first_b", F.when(moves, F.col("up")).otherwise(F.col("at")).alias("at")))
    last = open_.select("a", "b", "first_b", "at").join(labelled.select(F.col("node").alias("at"), "parent"), "at").join(labelled.select(F.col("node").alias("parent"), "first", "size"), "parent").where(inside(F.col("first_b"), F.col("first"), F.col("size")))
    return done.unionByName(last.select("a", "b", F.col("parent").alias("common")))


def assignable(pairs: DataFrame, labelled: DataFrame, extra: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) of which b is a or above a, along the forest and extra edges (child, parent), such as
    interfaces. Within the forest that is a test of ranges; extra edges are walked alone, each from the nodes below its child
    to its parent, and further where another extra edge starts above that, until no pair gets on. What is reached is kept once.
    """
    number = lambda s: labelled.select(F.col("node").alias(s), F.col("first").alias(f"first_{s}"), F.col("size").alias(f"size_{s}"))
    both = keep(pairs.select("a", "b").distinct().join(number("a"), "a").join(number("b"), "b"))
    up = inside(F.col("first_a"), F.col("first_b"), F.col("size_b"))
    found = both.where(up).select("a", "b")
    ends = extra.select(F.col("child").alias("a"), F.col("parent").alias("b")).distinct().join(number("a"), "a").join(number("b"), "b")
    edge = keep(ends.select(F.col("first_a").alias("low"), (F.col("first_a") + F.col("size_a")).alias("end"), F.col("first_b").alias("to")))
    seen = keep(both.where(~up).select("a", F.col("first_a").alias("at")).distinct())
    reached, todo = seen.limit(0), seen
    while not todo.isEmpty():
        hits = keep(stabbed(todo, edge).select("a", F.col("to").alias("at")).distinct())
        todo = keep(hits.join(seen, ["a", "at"], "left_anti"))
        seen = keep(seen.unionByName(todo))
        reached = reached.unionByName(todo)
    more = both.where(~up).join(reached, "a").where(inside(F.col("at"), F.col("first_b"), F.col("size_b")))
    return found.unionByName(more.select("a", "b").distinct())


def stabbed(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """points (at, ...) with the ranges (low, end, ...) of a forest that hold them: the join of intervals."""
    probes = points.select(F.lit(0).alias("_all"), F.col("at").alias("start"), (F.col("at") + 1).alias("end"), F.struct(*points.columns).alias("point"))
    spans = ranges.select(F.lit(0).alias("_all"), F.col("low").alias("start"), F.col("end").alias("end"), F.struct(*ranges.columns).alias("range"))
    return overlapping(spans, probes, ["_all"]).select("probe.point.*", "interval.range.*")
