"""Queries over hierarchies, components and interval joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import forest
from ..operators.graphs import closure, components, first_of, resolve
from ..operators.intervals import overlapping
from .registry import Tables, query

EDGES = "e AS (SELECT 'c' || c_custkey AS child, 'n' || c_nationkey AS parent FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"
CLOSURE = f"{EDGES}, cl(node, ancestor, depth) AS (SELECT node, node, 0 FROM (SELECT child AS node FROM e UNION SELECT parent FROM e) UNION ALL SELECT cl.node, e.parent, cl.depth + 1 FROM cl JOIN e ON cl.ancestor = e.child)"


def edges(t: Tables) -> DataFrame:
    """customer -> nation -> region."""
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    return t.customer.select(name("c", "c_custkey").alias("child"), name("n", "c_nationkey").alias("parent")).unionByName(t.nation.select(name("n", "n_nationkey").alias("child"), name("r", "n_regionkey").alias("parent")))


@query("ancestor_closure", f"WITH RECURSIVE {CLOSURE} SELECT node, ancestor, CAST(depth AS INTEGER) AS depth FROM cl")
def ancestor_closure(t: Tables) -> DataFrame:
    return closure(edges(t))


@query("hierarchy_depth", f"WITH RECURSIVE {CLOSURE} SELECT node, CAST(max(depth) AS INTEGER) AS depth FROM cl GROUP BY node")
def hierarchy_depth(t: Tables) -> DataFrame:
    return closure(edges(t)).groupBy("node").agg(F.max("depth").alias("depth"))


@query("sibling_counts", f"WITH {EDGES} SELECT child AS node, count(*) OVER (PARTITION BY parent) AS siblings FROM e")
def sibling_counts(t: Tables) -> DataFrame:
    e = edges(t)
    return e.join(e.groupBy("parent").agg(F.count("*").alias("siblings")), "parent").select(F.col("child").alias("node"), "siblings")


@query("assignable_semi_join", f"WITH RECURSIVE {CLOSURE} SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM cl WHERE node = 'c' || c_custkey AND ancestor = 'r1')")
def assignable_semi_join(t: Tables) -> DataFrame:
    """Customers below a region: those whose number lies in its range."""
    labelled = forest.labels(nodes_of(t), [])
    top = labelled.where("node = 'r1'").select("first", "size")  # one row
    below = labelled.join(F.broadcast(top.select(F.col("first").alias("low"), F.col("size").alias("n"))), forest.inside(F.col("first"), F.col("low"), F.col("n")), "left_semi").select("node")
    return t.customer.join(below, F.concat(F.lit("c"), F.col("c_custkey").cast("string")) == below["node"], "left_semi").select("c_custkey", "c_name")


def nodes_of(t: Tables) -> DataFrame:
    """(node, parent) of regions, nations and customers."""
    e = edges(t).select(F.col("child").alias("node"), "parent")
    return e.unionByName(t.region.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"), F.lit(None).cast("string").alias("parent")))


@query("lowest_common_ancestor", f"WITH RECURSIVE {CLOSURE}, p AS (SELECT 'c' || c_custkey AS a, 'c' || (c_custkey + 1) AS b FROM customer) SELECT a, b, arg_min(x.ancestor, (x.depth + y.depth, x.ancestor)) AS common FROM p JOIN cl x ON x.node = a JOIN cl y ON y.node = b AND y.ancestor = x.ancestor GROUP BY a, b")
def lowest_common_ancestor(t: Tables) -> DataFrame:
    """Each customer with the next one: jumps over ancestors that do not hold the other one's number."""
    name = lambda k: F.concat(F.lit("c"), (F.col("c_custkey") + k).cast("string"))
    return forest.lowest_common(t.customer.select(name(0).alias("a"), name(1).alias("b")), forest.labels(nodes_of(t), []))


@query(
    "member_resolution",
    f"""WITH RECURSIVE {CLOSURE}, d AS (SELECT DISTINCT owner, member FROM (SELECT 'c' || o_custkey AS owner, o_orderpriority AS member FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT 'n' || n_nationkey, '1-URGENT' FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'r' || r_regionkey, '2-HIGH' FROM region)),
q AS (SELECT DISTINCT 'c' || o_custkey AS node, o_orderpriority AS member FROM orders)
SELECT q.node, q.member, arg_min(cl.ancestor, (cl.depth, cl.ancestor)) FILTER (WHERE d.owner IS NOT NULL) AS owner FROM q LEFT JOIN cl ON cl.node = q.node LEFT JOIN d ON d.owner = cl.ancestor AND d.member = q.member GROUP BY ALL""",
)
def member_resolution(t: Tables) -> DataFrame:
    """Which ancestor of a customer declares a member: itself, its nation or its region, the nearest first."""
    c = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    own = t.orders.where("o_orderkey % 3 = 0").select(c.alias("owner"), F.col("o_orderpriority").alias("member"))
    nation = t.nation.where("n_nationkey % 2 = 0").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("owner"), F.lit("1-URGENT").alias("member"))
    region = t.region.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("owner"), F.lit("2-HIGH").alias("member"))
    wanted = t.orders.select(c.alias("node"), F.col("o_orderpriority").alias("member")).distinct()
    return resolve(wanted, closure(edges(t)), own.union(nation).union(region).distinct()).select("node", "member", "owner")


@query("components", "SELECT c_custkey AS node, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS comp FROM customer QUALIFY count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) > 1")
def component_labels(t: Tables) -> DataFrame:
    """Customers joined with the next one of their nation and segment: long chains, whose ends SQL knows without walking."""
    next_ = F.lead("c_custkey").over(W.partitionBy("c_nationkey", "c_mktsegment").orderBy(F.xxhash64("c_custkey"), "c_custkey"))
    return components(t.customer.select(F.col("c_custkey").alias("a"), next_.alias("b")).where("b is not null"))


@query("components_all")
def component_labels_all(t: Tables) -> DataFrame:
    """Orders joined through lines of the same part: chains of neighbours, not all pairs. No SQL: its recursion holds every
    pair of a component, here nearly all orders."""
    return order_components(t.lineitem)


def order_components(lines: DataFrame) -> DataFrame:
    l = lines.select(F.col("l_orderkey").alias("a"), "l_partkey")
    e = l.withColumn("b", F.lag("a").over(W.partitionBy("l_partkey").orderBy("a"))).where("b is not null and a <> b")
    return components(e.select("a", "b"))


OVERLAPS = """WITH v AS (SELECT user_id, event_id, ts AS s, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS e FROM events), p AS (SELECT user_id, event_id AS probe, ts AS s, ts + INTERVAL 10 MINUTE AS e FROM events)
SELECT probe, count(*) AS overlaps, min(v.event_id) AS first_event FROM p JOIN v ON v.user_id = p.user_id AND v.s < p.e AND v.e > p.s WHERE v.e IS NOT NULL GROUP BY probe"""


@query("overlap_slots", OVERLAPS)
def overlap_slots(t: Tables) -> DataFrame:
    """Intervals between a user's events that overlap a probe of ten minutes at each event."""
    return overlaps(t.events)


@query("overlap_slots_all", OVERLAPS)
def overlap_slots_all(t: Tables) -> DataFrame:
    """The same by the general join of intervals, which does not ask that they lie end to end."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    by = W.partitionBy("user_id").orderBy("ts", "event_id")
    events = t.events.select("user_id", "event_id", micros.alias("start"), F.lead(micros).over(by).alias("end"))
    probes = events.select("user_id", "event_id", "start", (F.col("start") + 600 * 1_000_000).alias("end"))
    return overlapping(events, probes, ["user_id"]).groupBy(F.col("probe.event_id").alias("probe")).agg(F.count("*").alias("overlaps"), F.min("interval.event_id").alias("first_event"))


LIVE = """WITH v AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS s, epoch_us(ts) + CAST(power(4, event_id % 9) AS BIGINT) * 1000000 AS e FROM events),
p AS (SELECT user_id, event_id AS probe, event_type, epoch_us(ts) - 60000000 * (event_id % 90) AS s, epoch_us(ts) + 1000000 AS e FROM events)"""


@query("overlap_intervals", LIVE + " SELECT probe, count(*) AS overlaps, min(v.event_id) AS first_event, CAST(sum(least(v.e, p.e) - greatest(v.s, p.s)) AS BIGINT) AS shared FROM p JOIN v ON v.user_id = p.user_id AND v.event_type = p.event_type AND v.s < p.e AND v.e > p.s GROUP BY probe")
def overlap_intervals(t: Tables) -> DataFrame:
    """Events of a second to eighteen hours, nested, overlapping and with gaps, against probes of a second to ninety minutes: how
    many of its user and type each probe overlaps, the first of them, and how long together."""
    overlap = F.least("interval.end", "probe.end") - F.greatest("interval.start", "probe.start")
    return live_events(t).groupBy(F.col("probe.event_id").alias("probe")).agg(F.count("*").alias("overlaps"), F.min("interval.event_id").alias("first_event"), F.sum(overlap).alias("shared"))


def live_events(t: Tables) -> DataFrame:
    at, k = F.unix_micros(F.col("ts").cast("timestamp")), F.col("event_id")
    v = t.events.select("user_id", "event_type", "event_id", at.alias("start"), (at + F.pow(F.lit(4), k % 9).cast("bigint") * 1_000_000).alias("end"))
    p = t.events.select("user_id", "event_type", "event_id", (at - 60_000_000 * (k % 90)).alias("start"), (at + 1_000_000).alias("end"))
    return overlapping(v, p, ["user_id", "event_type"])


@query("variable_at", LIVE + ", c AS (SELECT probe, v.event_id AS var, row_number() OVER (PARTITION BY probe ORDER BY v.event_id) AS n FROM p JOIN v ON v.user_id = p.user_id AND v.event_type = p.event_type AND v.s < p.e AND v.e > p.s) SELECT p.probe, c.var FROM p LEFT JOIN c ON c.probe = p.probe AND n = 1")
def variable_at(t: Tables) -> DataFrame:
    """The first variable of a slot (user and type) whose range overlaps an instruction's, none where there is no such one."""
    first = live_events(t).groupBy(F.col("probe.event_id").alias("probe")).agg(F.min("interval.event_id").alias("var"))
    return t.events.select(F.col("event_id").alias("probe")).join(first, "probe", "left")


def overlaps(events: DataFrame) -> DataFrame:
    """A user's intervals lie end to end, so those that a probe overlaps are the one open at its start and those that
    start within it: a window over the user's events, without a join."""
    by = W.partitionBy("user_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    v = events.select("user_id", "event_id", micros.alias("at")).withColumn("end", F.lead("at").over(by.orderBy("at", "event_id")))
    last = F.max(F.struct("at", "event_id", "end")).over(by.orderBy("at").rangeBetween(W.unboundedPreceding, 0))
    within = by.orderBy("at").rangeBetween(1, 600 * 1_000_000 - 1)
    started = F.when(F.col("end").isNotNull(), F.col("event_id"))
    found = v.select(F.col("event_id").alias("probe"), "at", last.alias("open"), F.count(started).over(within).alias("n"), F.min(started).over(within).alias("first"))
    is_open = F.coalesce(F.col("open.end") > F.col("at"), F.lit(False))
    counted = found.select("probe", (F.col("n") + is_open.cast("bigint")).alias("overlaps"), F.least("first", F.when(is_open, F.col("open.event_id"))).alias("first_event"))
    return counted.where("overlaps > 0").groupBy("probe").agg(F.sum("overlaps").alias("overlaps"), F.min("first_event").alias("first_event"))


@query("asof_forward", "SELECT o_orderkey, o_custkey, (SELECT min(l_shipdate) FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate >= o_orderdate) AS next_ship FROM orders")
def asof_forward(t: Tables) -> DataFrame:
    """The first ship date of an order at or after its date."""
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    hit = o.join(t.lineitem.select("l_orderkey", "l_shipdate"), (F.col("o_orderkey") == F.col("l_orderkey")) & (F.col("l_shipdate") >= F.col("o_orderdate"))).groupBy("o_orderkey").agg(F.min("l_shipdate").alias("next_ship"))
    return o.join(hit, "o_orderkey", "left").select("o_orderkey", "o_custkey", "next_ship")


@query("call_edges_in_out", "WITH e AS (SELECT DISTINCT user_id AS src, event_type AS dst FROM events), o AS (SELECT CAST(src AS VARCHAR) AS node, count(*) AS n_out, 0 AS n_in FROM e GROUP BY src UNION ALL SELECT dst, 0, count(*) FROM e GROUP BY dst) SELECT node, CAST(sum(n_out) AS BIGINT) AS n_out, CAST(sum(n_in) AS BIGINT) AS n_in FROM o GROUP BY node")
def call_edges_in_out(t: Tables) -> DataFrame:
    e = t.events.select(F.col("user_id").cast("string").alias("src"), F.col("event_type").alias("dst")).distinct()
    ends = e.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    return ends.groupBy("x.node").agg(F.sum("x.o").alias("n_out"), F.sum("x.i").alias("n_in"))


@query("outer_detection", "WITH c AS (SELECT c_custkey AS id, c_nationkey AS n, c_mktsegment AS s FROM customer), f AS (SELECT n, s, min(id) AS outer_id FROM c GROUP BY n, s), a AS (SELECT c_custkey AS id, c_custkey - 100 AS named FROM customer WHERE c_custkey % 10 = 0) SELECT c.id, coalesce(x.id, CASE WHEN f.outer_id <> c.id THEN f.outer_id END) AS outer_id FROM c JOIN f USING (n, s) LEFT JOIN a ON a.id = c.id LEFT JOIN c x ON x.id = a.named")
def outer_detection(t: Tables) -> DataFrame:
    """The outer entity: the one that a row names, if it exists, else the first of its group."""
    c = t.customer.select(F.col("c_custkey").alias("id"), "c_nationkey", "c_mktsegment")
    first = c.groupBy("c_nationkey", "c_mktsegment").agg(F.min("id").alias("first"))
    named = c.select(F.col("id").alias("exists"))
    wanted = F.when(F.col("id") % 10 == 0, F.col("id") - 100)
    return c.withColumn("wanted", wanted).join(named, F.col("wanted") == F.col("exists"), "left").join(first, ["c_nationkey", "c_mktsegment"]).select("id", F.coalesce("exists", F.when(F.col("first") != F.col("id"), F.col("first"))).alias("outer_id"))


@query("ancestry_flags", "WITH l AS (SELECT o_custkey AS c, o_orderpriority AS p, o_orderkey AS o, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS n FROM orders) SELECT o, n > 1 AS has_parent, n = 1 AS is_root FROM l")
def ancestry_flags(t: Tables) -> DataFrame:
    """An order overrides the earlier ones of its customer with the same priority; the first is a root."""
    first = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("first"))
    return t.orders.join(first, ["o_custkey", "o_orderpriority"]).select(F.col("o_orderkey").alias("o"), (F.col("o_orderkey") > F.col("first")).alias("has_parent"), (F.col("o_orderkey") == F.col("first")).alias("is_root"))


@query("dedupe_first_wins", "SELECT doc_id, copies FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n, count(*) OVER (PARTITION BY text) AS copies FROM documents) WHERE n = 1")
def dedupe_first_wins(t: Tables) -> DataFrame:
    """One document for each text, by a 256-bit key, so texts are not shuffled and copies combine before."""
    return t.documents.groupBy(F.sha2("text", 256).alias("k")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


@query("limit_children", "SELECT c_nationkey, c_custkey, n FROM (SELECT c_nationkey, c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS n FROM customer) WHERE n <= 10 OR c_custkey = 77")
def limit_children(t: Tables) -> DataFrame:
    """At most ten children of a node, and the one on the path in any case."""
    w = W.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return t.customer.select("c_nationkey", "c_custkey", F.row_number().over(w).alias("n")).where("n <= 10 or c_custkey = 77")


@query("first_versions", "SELECT l_partkey, l_orderkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS n FROM lineitem) WHERE n = 1")
def first_versions(t: Tables) -> DataFrame:
    return first_of(t.lineitem, ["l_partkey"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"]).select("l_partkey", "l_orderkey", "l_suppkey")
