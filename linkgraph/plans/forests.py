"""Queries on forests of customers, nations and regions, and on names and numbers of hierarchy groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import forest
from ..operators import hierarchy as hier
from ..operators.graphs import closure
from ..operators.numbering import group_names, group_numbers
from ..operators.scopes import propagate_arguments, resolve_names
from ..storage import keep
from .hierarchy import CLOSURE, EDGES, edges
from .members import TOPS, members
from .registry import Tables, query


def tree(t: Tables) -> DataFrame:
    """(node, parent, name) of regions, nations and customers."""
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    regions = t.region.select(name("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    nations = t.nation.select(name("n", "n_nationkey").alias("node"), name("r", "n_regionkey").alias("parent"), F.col("n_name").alias("name"))
    return regions.unionByName(nations).unionByName(t.customer.select(name("c", "c_custkey").alias("node"), name("n", "c_nationkey").alias("parent"), F.col("c_name").alias("name")))


NEST = """WITH p AS (SELECT 'r' || r_regionkey AS node, [{'l': len(r_name), 's': r_name, 'k': 'r' || r_regionkey}] AS path FROM region),
q AS (SELECT 'n' || n_nationkey AS node, list_append(p.path, {'l': len(n_name), 's': n_name, 'k': 'n' || n_nationkey}) AS path FROM nation JOIN p ON p.node = 'r' || n_regionkey),
c AS (SELECT 'c' || c_custkey AS node, list_append(q.path, {'l': len(c_name), 's': c_name, 'k': 'c' || c_custkey}) AS path FROM customer JOIN q ON q.node = 'n' || c_nationkey),
every AS (SELECT * FROM p UNION ALL SELECT * FROM q UNION ALL SELECT * FROM c)
SELECT node, row_number() OVER (ORDER BY path) AS first, CAST(len(path) - 1 AS INTEGER) AS depth FROM every"""


@query("nest_order", NEST)
def nest_order(t: Tables) -> DataFrame:
    """The order in which names are written: nested ones behind what they are nested in, shorter names first."""
    return forest.labels(tree(t), [F.length("name"), F.col("name")]).select("node", "first", "depth")


@query("subtree_ranges", f"WITH RECURSIVE {CLOSURE} SELECT ancestor AS node, count(*) AS size, CAST(sum(CASE WHEN node LIKE 'c%' THEN 1 ELSE 0 END) AS BIGINT) AS customers FROM cl GROUP BY 1")
def subtree_ranges(t: Tables) -> DataFrame:
    """How many nodes, and how many customers, are at or below each node: lookups in a range of numbers."""
    labelled = forest.labels(tree(t), [F.col("name")])
    customers = labelled.where("startswith(node, 'c')").select(F.col("node").alias("customer"), F.col("first").alias("at"))
    spans = labelled.select("node", "size", F.col("first").alias("low"), (F.col("first") + F.col("size")).alias("end"))
    held = forest.stabbed(customers, spans).groupBy("node").agg(F.count("*").alias("customers"))
    return labelled.select("node", "size").join(held, "node", "left").select("node", "size", F.coalesce("customers", F.lit(0)).alias("customers"))


#: Beside the tree: nations and some customers implement regions, and regions customers' nations of another branch.
EXTRA = """x AS (SELECT 'n' || n_nationkey AS child, 'r' || (n_nationkey + 1) % 5 AS parent FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT 'c' || c_custkey, 'n' || c_custkey % 25 FROM customer WHERE c_custkey % 7 = 0),
wanted AS (SELECT 'c' || c_custkey AS a, 'r' || c_custkey % 5 AS b FROM customer UNION SELECT 'c' || c_custkey, 'n' || c_custkey * 3 % 25 FROM customer UNION SELECT 'n' || n_nationkey, 'r' || unnest(range(5)) FROM nation)"""


@query("assignable_with_interfaces", f"WITH RECURSIVE {EDGES}, {EXTRA}, g AS (SELECT * FROM e UNION SELECT * FROM x), up AS (SELECT a AS node, a AS ancestor FROM wanted UNION SELECT up.node, g.parent FROM up JOIN g ON g.child = up.ancestor) SELECT a, b FROM wanted WHERE (a, b) IN (SELECT (node, ancestor) FROM up)")
def assignable_with_interfaces(t: Tables) -> DataFrame:
    """Which of some classes can be assigned to which, along a tree and interfaces, with diamonds; no table of all ancestors."""
    name = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    k, n = F.col("c_custkey"), F.col("n_nationkey")
    extra = t.nation.where("n_nationkey % 3 = 0").select(name("n", n).alias("child"), name("r", (n + 1) % 5).alias("parent")).unionByName(t.customer.where("c_custkey % 7 = 0").select(name("c", k).alias("child"), name("n", k % 25).alias("parent")))
    wanted = t.customer.select(name("c", k).alias("a"), F.explode(F.array(name("r", k % 5), name("n", k * 3 % 25))).alias("b"))
    wanted = wanted.unionByName(t.nation.select(name("n", n).alias("a"), F.explode(F.array(*[name("r", F.lit(i)) for i in range(5)])).alias("b")))
    return forest.assignable(wanted, forest.labels(tree(t), [F.col("name")]), extra)


def grouped_members(t: Tables) -> DataFrame:
    """Members with their groups; uids of some; owners and members in the order of their names."""
    m = keep(members(t))
    of = hier.groups(keep(closure(edges(t))), m)
    return keep(m.join(of, "member").select("member", "owner", "group", (F.col("obfuscated") & (F.col("id") != "<init>")).alias("obfuscated"), F.when(F.col("k") % 7 == 0, F.col("k")).alias("uid"), F.col("id").alias("order"), F.col("owner").alias("owner_order")))


GROUPED = f'WITH RECURSIVE {TOPS}, gm AS (SELECT mem.member, mem.owner, mem.id, grp."group" AS g, mem.obfuscated AND mem.id <> \'<init>\' AS hidden, CASE WHEN mem.k % 7 = 0 THEN mem.k END AS uid, count(*) OVER (PARTITION BY grp."group") AS size FROM mem JOIN grp USING (member))'


@query("group_tmp_names", f"{GROUPED}, s AS (SELECT g, row_number() OVER (ORDER BY f, g) - 1 AS n FROM (SELECT g, min({{'o': owner, 'i': id}}) AS f FROM gm WHERE hidden AND size > 1 GROUP BY 1)) SELECT member, 'vmb' || n AS name FROM gm JOIN s USING (g) WHERE hidden AND size > 1 UNION ALL SELECT member, 'mb' || (row_number() OVER (PARTITION BY owner ORDER BY id, member) - 1) FROM gm WHERE hidden AND size = 1")
def group_tmp_names(t: Tables) -> DataFrame:
    """Temporary names: one for a whole hierarchy, numbers within a class for members alone."""
    return group_names(grouped_members(t), "mb")


@query("group_uid_assign", f"{GROUPED}, s AS (SELECT g, 1000 + row_number() OVER (ORDER BY f, g) AS uid FROM (SELECT g, min({{'o': owner, 'i': id}}) AS f FROM gm WHERE hidden AND uid IS NULL GROUP BY 1)) SELECT member, s.uid FROM gm JOIN s USING (g)")
def group_uid_assign(t: Tables) -> DataFrame:
    """The next uids for hierarchies in name order; every member of a hierarchy has its uid."""
    return group_numbers(grouped_members(t), 1000)


#: Types of suppliers in packages of their nations, and of customers nested in themselves, their nations and regions.
SCOPES = """ty AS (SELECT 's' || s_nationkey || '/T' || s_suppkey % 40 AS type FROM supplier UNION SELECT 'c' || c_custkey || '$T' || c_custkey % 40 FROM customer WHERE c_custkey % 2 = 0 UNION SELECT 'n' || c_nationkey || '$T' || c_custkey % 20 FROM customer UNION SELECT 'r' || n_regionkey || '$T' || n_nationkey + 10 FROM nation),
im AS (SELECT DISTINCT 'c' || o_custkey AS scope, 'T' || o_orderkey % 40 AS name, 's' || o_orderkey % 7 || '/T' || o_orderkey % 40 AS type FROM orders WHERE o_orderpriority = '1-URGENT'),
pk AS (SELECT 'c' || c_custkey AS scope, 's' || c_nationkey AS package, 1 AS pos FROM customer UNION ALL SELECT 'c' || c_custkey, 's' || (c_nationkey + 7) % 25, 2 FROM customer),
rf AS (SELECT DISTINCT 'c' || o_custkey AS scope, 'T' || o_orderkey % 40 AS name, 'n' || c_nationkey AS n, 'r' || n_regionkey AS r FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
hit AS (SELECT scope, name, im.type, 0 AS pos, 'import' AS how FROM rf JOIN im USING (scope, name) UNION ALL SELECT scope, name, package || '/' || name, pos, 'package' FROM rf JOIN pk USING (scope) WHERE package || '/' || name IN (SELECT type FROM ty)
UNION ALL SELECT scope, name, scope || '$' || name, 3, 'nested' FROM rf WHERE scope || '$' || name IN (SELECT type FROM ty) UNION ALL SELECT scope, name, n || '$' || name, 4, 'around 1' FROM rf WHERE n || '$' || name IN (SELECT type FROM ty) UNION ALL SELECT scope, name, r || '$' || name, 5, 'around 2' FROM rf WHERE r || '$' || name IN (SELECT type FROM ty)),
best AS (SELECT *, min(pos) OVER (PARTITION BY scope, name) AS least FROM hit)
SELECT rf.scope, rf.name, min(b.type) AS type, min(b.how) AS how, count(DISTINCT b.type) > 1 AS ambiguous FROM rf LEFT JOIN best b ON b.scope = rf.scope AND b.name = rf.name AND b.pos = b.least GROUP BY 1, 2"""


@query("resolved_names", f"WITH {SCOPES}")
def resolved_names(t: Tables) -> DataFrame:
    """Names that orders use in the scope of their customer: imports, whole packages, then nested types outwards."""
    name = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    col = F.col
    types = t.supplier.select(F.concat(name("s", col("s_nationkey")), name("/T", col("s_suppkey") % 40)).alias("type"))
    types = types.unionByName(t.customer.where("c_custkey % 2 = 0").select(F.concat(name("c", col("c_custkey")), name("$T", col("c_custkey") % 40)).alias("type")))
    types = types.unionByName(t.customer.select(F.concat(name("n", col("c_nationkey")), name("$T", col("c_custkey") % 20)).alias("type")))
    types = types.unionByName(t.nation.select(F.concat(name("r", col("n_regionkey")), name("$T", col("n_nationkey") + 10)).alias("type")))
    used = t.orders.select(name("c", col("o_custkey")).alias("scope"), name("T", col("o_orderkey") % 40).alias("name"), F.concat(name("s", col("o_orderkey") % 7), name("/T", col("o_orderkey") % 40)).alias("type"), "o_orderpriority")
    packages = t.customer.select(name("c", col("c_custkey")).alias("scope"), F.explode(F.array(F.struct(name("s", col("c_nationkey")).alias("package"), F.lit(1).alias("at")), F.struct(name("s", (col("c_nationkey") + 7) % 25).alias("package"), F.lit(2).alias("at")))).alias("p")).select("scope", "p.*")
    outer = edges(t).select(col("child").alias("scope"), col("parent").alias("around"))
    return resolve_names(used, types, used.where("o_orderpriority = '1-URGENT'"), packages, outer)


@query("propagate_arguments", "WITH a AS (SELECT l_orderkey AS member, l_linenumber AS idx, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2), g AS (SELECT a.member, idx, CASE WHEN p % 5 = 0 THEN 'arg' || p END AS name, o_custkey AS c, o_orderpriority AS pr FROM a JOIN orders ON o_orderkey = a.member) SELECT member, idx, coalesce(name, arg_min(name, member) FILTER (WHERE name IS NOT NULL) OVER (PARTITION BY c, pr, idx)) AS name FROM g")
def propagate_arguments_(t: Tables) -> DataFrame:
    """Names of arguments spread over the orders of one customer and priority."""
    p = F.col("p")
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("member"), F.col("l_linenumber").alias("idx")).agg(F.min("l_partkey").alias("p"))
    group = F.concat_ws(":", F.col("o_custkey").cast("string"), "o_orderpriority")
    return propagate_arguments(t.orders.select(F.col("o_orderkey").alias("member"), group.alias("group")), lines.select("member", "idx", F.when(p % 5 == 0, F.concat(F.lit("arg"), p.cast("string"))).alias("name")))
