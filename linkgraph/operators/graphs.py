"""Hierarchies and components as Spark loops over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import forget, stored


def closure(edges: DataFrame) -> DataFrame:
    """(node, ancestor, depth): all ancestors along (child, parent) edges with the least number of steps; a node is
    its own ancestor at depth 0. Steps double each round, and a pair seen before goes no further."""
    spark = edges.sparkSession
    base = edges.select(F.col("child").alias("node"), F.col("parent").alias("ancestor")).where("node is not null and ancestor is not null").distinct()
    found, path = stored(base.withColumn("depth", F.lit(1)), "closure")
    n = found.count()
    while True:
        more = found.alias("x").join(found.alias("y"), F.col("x.ancestor") == F.col("y.node")).select(F.col("x.node").alias("node"), F.col("y.ancestor").alias("ancestor"), (F.col("x.depth") + F.col("y.depth")).alias("depth"))
        found, path, before = *stored(found.unionByName(more).groupBy("node", "ancestor").agg(F.min("depth").alias("depth")), "closure"), path
        forget(spark, before)
        if (now := found.count()) == n:
            break
        n = now
    nodes = base.select("node").union(base.select("ancestor")).distinct()
    return nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth")).unionByName(found.where("node <> ancestor"))


#: Edges of a round that one task writes, at least.
EDGES_A_TASK = 100_000


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) for each node of edges that has a neighbour; comp is the smallest node of its component.

    Large star and small star in turn: every neighbour above a node goes to the least node around it, then every
    neighbour below to the least of those. Components stay what they are, and the edges become stars around their least
    nodes, in some log2 of the longest chain rounds (18 for a chain of 100,000). A round is one job that writes its
    edges to the shared folder; nothing of them reaches the driver but their number and a sum of hashes, which show
    when a round changed nothing. The least nodes are found with partial aggregation and joined back; the edges of a node
    with very many neighbours are spread over all tasks (_with_least).
    """
    spark = edges.sparkSession

    def written(df: DataFrame, tasks: int | None) -> tuple[DataFrame, str, dict]:
        """df in the shared folder, and what shows whether it changed."""
        watch = Observation()
        marked = df.observe(watch, F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20)")), F.lit(0)).alias("hash"))
        return *stored(marked.coalesce(tasks) if tasks else marked, "edges"), watch.get

    high, low = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    now, path, mark = written(edges.where(F.col(a) != F.col(b)).select(high, low).distinct(), None)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hubs = mark["n"] > EDGES_A_TASK  # no node has more pairs than there are edges
        down = _with_least(both.withColumn("of", F.col("v")), hubs).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"), F.col("u").alias("of"))
        ends = F.explode(F.array(F.struct("v", "least"), F.struct(F.col("u").alias("v"), "least"))).alias("e")
        small = _with_least(down, hubs).select(ends).where("e.v <> e.least").select(F.col("e.v").alias("u"), F.col("e.least").alias("v"))
        before, old = path, mark
        now, path, mark = written(small.distinct(), 1 + mark["n"] // EDGES_A_TASK)
        forget(spark, before)
        if mark == old:
            break
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots.select("node", F.col("node").alias("comp")))


def _with_least(pairs: DataFrame, hubs: bool = True) -> DataFrame:
    """The pairs (u, v, of) with the least node around u, itself included; of differs among the pairs of a node.

    Nodes with more than EDGES_A_TASK pairs are few: they are broadcast with their least nodes, and their pairs go where
    those of `of` do. The others meet their least nodes in a shuffle. Without hubs, no node has so many: the plan is
    half as large, and so is what the driver holds of it over many rounds."""
    if not hubs:
        return pairs.join(pairs.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least")), "u")
    counted = pairs.groupBy("u").agg(F.min("v").alias("v"), F.count("*").alias("n")).select("u", F.least("u", "v").alias("least"), "n")
    hubs = counted.where(F.col("n") > EDGES_A_TASK).select("u", F.col("least").alias("of_hub"))
    others = counted.where(F.col("n") <= EDGES_A_TASK).select(F.col("u").alias("at"), "least")
    dealt = pairs.join(F.broadcast(hubs), "u", "left").withColumn("at", F.when(F.col("of_hub").isNull(), F.col("u")).otherwise(F.col("of")))
    return dealt.join(others, "at", "left").select("u", "v", F.coalesce("of_hub", "least").alias("least"))


def lowest_common(pairs: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(a, b, common): the common ancestor with the least summed depth, ties to the smaller id."""
    left = ancestors.select(F.col("node").alias("a"), "ancestor", F.col("depth").alias("da"))
    right = ancestors.select(F.col("node").alias("b"), "ancestor", F.col("depth").alias("db"))
    both = pairs.join(left, "a").join(right, ["b", "ancestor"])
    return both.groupBy("a", "b").agg(F.min_by("ancestor", F.struct(F.col("da") + F.col("db"), "ancestor")).alias("common"))


def resolve(references: DataFrame, ancestors: DataFrame, declared: DataFrame) -> DataFrame:
    """(node, member, owner): the nearest ancestor that declares the member, ties to the smaller id; null if none."""
    near = references.join(ancestors, "node").join(declared.select(F.col("owner").alias("ancestor"), "member"), ["ancestor", "member"])
    best = near.groupBy("node", "member").agg(F.min_by("ancestor", F.struct("depth", "ancestor")).alias("owner"))
    return references.join(best, ["node", "member"], "left")


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """First wins: the first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
