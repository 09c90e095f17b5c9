"""Queries that carry matches to and from files, and descriptors from one namespace to another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.descriptors import translate
from ..sources import matchfile
from ..sources.matchstate import Known, resolve, rows_to_save
from ..storage import keep, work_dir
from .entities import CLASS_PAIRS, class_pairs
from .registry import Tables, query

#: Lines of an order up to the second are arguments; the lines with one number of an order are one variable.
LINES = "(SELECT DISTINCT l_orderkey AS o, l_linenumber - 1 AS i FROM lineitem)"
ENTITIES = f"""{CLASS_PAIRS},
kc AS (SELECT c_custkey AS c, c_custkey % 11 <> 3 AS matchable, c_custkey % 4 = 0 AS mapped FROM customer),
km AS (SELECT o_custkey AS c, o_orderkey AS m, CASE WHEN o_orderstatus = 'P' THEN 'field' ELSE 'method' END AS kind, o_orderkey % 13 <> 5 AS matchable, o_orderkey % 3 = 0 AS mapped, o_orderpriority AS p FROM orders),
kv AS (SELECT c, m, CASE WHEN i < 2 THEN 'arg' ELSE 'var' END AS kind, i, (m + i) % 17 <> 2 AS matchable, (m + i) % 5 = 0 AS mapped FROM {LINES} JOIN km ON m = o AND km.kind = 'method'),
pm AS (SELECT cp.a, cp.b, x.kind, min(x.m) AS am, min(y.m) AS bm FROM cp JOIN km x ON x.c = cp.a JOIN km y ON y.c = cp.b AND y.p = x.p AND y.kind = x.kind GROUP BY cp.a, cp.b, x.kind, x.p),
pv AS (SELECT pm.a, pm.b, am, bm, x.kind, x.i FROM pm JOIN kv x ON x.m = am JOIN kv y ON y.m = bm AND y.i = x.i)"""


def entities(t: Tables) -> tuple[Known, dict[str, DataFrame]]:
    """All customers, orders and lines as entities, and pairs of them: class pairs, orders of one kind and priority, lines by number.

    Numbers are kept; their names are made where they are read."""
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    classes = t.customer.select(name("c", "c_custkey").alias("class_id"), (F.col("c_custkey") % 11 != 3).alias("matchable"), (F.col("c_custkey") % 4 == 0).alias("mapped"))
    kind = F.when(F.col("o_orderstatus") == "P", "field").otherwise("method")
    orders = keep(t.orders.select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("m"), kind.alias("kind"), F.col("o_orderpriority").alias("p")))
    members = orders.select(name("c", "c").alias("class_id"), name("m", "m").alias("member_id"), "kind", (F.col("m") % 13 != 5).alias("matchable"), (F.col("m") % 3 == 0).alias("mapped"))
    lines = t.lineitem.select(F.col("l_orderkey").alias("m"), (F.col("l_linenumber") - 1).alias("idx")).distinct()
    of = keep(lines.join(orders.where("kind = 'method'").select("c", "m"), "m").withColumn("kind", F.when(F.col("idx") < 2, "arg").otherwise("var")))
    k = F.col("m") + F.col("idx")
    variables = of.select(name("c", "c").alias("class_id"), name("m", "m").alias("member_id"), "kind", "idx", (k % 17 != 2).alias("matchable"), (k % 5 == 0).alias("mapped"))
    pairs = keep(class_pairs(t).select("a", "b"))
    side = lambda s: orders.select(F.col("c").alias(s), "kind", "p", F.col("m").alias(f"m{s}"))
    pm = keep(pairs.join(side("a"), "a").join(side("b"), ["b", "kind", "p"]).groupBy("a", "b", "kind", "p").agg(F.min("ma").alias("ma"), F.min("mb").alias("mb")))
    vs = lambda s: of.select(F.col("m").alias(f"m{s}"), "kind", "idx")
    pv = keep(pm.select("a", "b", "ma", "mb").join(vs("a"), "ma").join(vs("b"), ["mb", "kind", "idx"]))
    ends = lambda df, *more: df.select(name("c", "a").alias("a_class"), name("c", "b").alias("b_class"), *more)
    m_ends = [name("m", "ma").alias("a_member"), name("m", "mb").alias("b_member")]
    matched = {"classes": ends(pairs), "members": ends(pm, "kind", *m_ends), "variables": ends(pv, "kind", *m_ends, F.col("idx").alias("a_idx"), F.col("idx").alias("b_idx"))}
    return Known(classes, members, variables), matched


def only(known: Known, parity: int) -> Known:
    """One side: classes with even or odd numbers and what is in them."""
    part = lambda df: df.where(F.expr("cast(substring(class_id, 2) as bigint)") % 2 == parity)
    return Known(part(known.classes), part(known.members), part(known.variables))


RESOLVED = f"""WITH {ENTITIES},
jc AS (SELECT a, b, CASE WHEN a % 9 = 0 THEN 'unknown a' WHEN b % 9 = 0 THEN 'unknown b' WHEN NOT x.matchable OR NOT y.matchable THEN 'unmatchable' ELSE 'ok' END AS s FROM cp JOIN kc x ON x.c = a JOIN kc y ON y.c = b),
jm AS (SELECT pm.*, CASE WHEN jc.s <> 'ok' THEN 'skipped' WHEN am % 10 = 7 THEN 'unknown a' WHEN bm % 10 = 8 THEN 'unknown b' WHEN NOT x.matchable OR NOT y.matchable THEN 'unmatchable' ELSE 'ok' END AS s FROM pm JOIN jc USING (a, b) JOIN km x ON x.m = am JOIN km y ON y.m = bm),
jv AS (SELECT pv.kind, CASE WHEN jm.s <> 'ok' THEN 'skipped' WHEN pv.i = 5 THEN 'unknown a' WHEN NOT x.matchable OR NOT y.matchable THEN 'unmatchable' ELSE 'ok' END AS s FROM pv JOIN jm USING (a, b, am, bm) JOIN kv x ON x.m = am AND x.i = pv.i JOIN kv y ON y.m = bm AND y.i = pv.i)
SELECT kind, s AS status, count(*) AS n FROM (SELECT 'class' AS kind, s FROM jc UNION ALL SELECT kind, s FROM jm UNION ALL SELECT kind, s FROM jv) GROUP BY 1, 2"""


@query("resolved_matches", RESOLVED)
def resolved_matches(t: Tables) -> DataFrame:
    """A match file of all pairs, read against tables that lack some entities: what can be applied, by kind and status."""
    known, matched = entities(t)
    none = lambda df, *names: df.select("*", *[F.lit(None).cast(c).alias(n) for n, c in names])
    no_idx, no_member = (("a_idx", "int"), ("b_idx", "int")), (("a_member", "string"), ("b_member", "string"))
    rows = none(matched["classes"].withColumn("kind", F.lit("class")), *no_member, *no_idx).unionByName(none(matched["members"], *no_idx)).unionByName(matched["variables"])
    path = work_dir(t.spark, "matches")
    matchfile.write_matches(rows.select("*", F.lit(None).cast("string").alias("side"), F.lit(False).alias("unmatchable")), path)
    number = lambda c: F.expr(f"cast(substring({c}, 2) as bigint)")

    def lacking(side: Known, digit: int, idx: int | None) -> Known:
        there = number("member_id") % 10 != digit
        variables = side.variables if idx is None else side.variables.where(F.col("idx") != idx)
        return Known(side.classes.where(number("class_id") % 9 != 0), side.members.where(there), variables)

    judged = resolve(matchfile.read_matches(t.spark, path), lacking(only(known, 0), 7, 5), lacking(only(known, 1), 8, None))
    return judged.groupBy("kind", "status").agg(F.count("*").alias("n"))


def saved_sql(unmapped: str) -> str:
    w = lambda alias: f"({unmapped} OR {alias}.mapped)"
    return f"""SELECT 'class' AS kind, NULL AS side, a AS ac, b AS bc, NULL AS am, NULL AS bm, NULL AS ai, NULL AS bi FROM sc
UNION ALL SELECT 'class', 'a', c, NULL, NULL, NULL, NULL, NULL FROM kc WHERE c % 2 = 0 AND NOT matchable AND {w('kc')} AND c NOT IN (SELECT a FROM cp)
UNION ALL SELECT 'class', 'b', NULL, c, NULL, NULL, NULL, NULL FROM kc WHERE c % 2 = 1 AND NOT matchable AND {w('kc')} AND c NOT IN (SELECT b FROM cp)
UNION ALL SELECT kind, NULL, a, b, am, bm, NULL, NULL FROM sm
UNION ALL SELECT km.kind, 'a', sc.a, sc.b, km.m, NULL, NULL, NULL FROM km JOIN sc ON sc.a = km.c WHERE NOT matchable AND {w('km')} AND km.m NOT IN (SELECT am FROM pm)
UNION ALL SELECT km.kind, 'b', sc.a, sc.b, NULL, km.m, NULL, NULL FROM km JOIN sc ON sc.b = km.c WHERE NOT matchable AND {w('km')} AND km.m NOT IN (SELECT bm FROM pm)
UNION ALL SELECT pv.kind, NULL, pv.a, pv.b, pv.am, pv.bm, pv.i, pv.i FROM pv JOIN sm USING (a, b, am, bm) JOIN kv x ON x.m = am AND x.i = pv.i WHERE sm.kind = 'method' AND {w('x')}
UNION ALL SELECT kv.kind, 'a', sm.a, sm.b, sm.am, sm.bm, kv.i, NULL FROM kv JOIN sm ON sm.am = kv.m AND sm.kind = 'method' WHERE NOT matchable AND {w('kv')} AND (kv.m, kv.i) NOT IN (SELECT (am, i) FROM pv)
UNION ALL SELECT kv.kind, 'b', sm.a, sm.b, sm.am, sm.bm, NULL, kv.i FROM kv JOIN sm ON sm.bm = kv.m AND sm.kind = 'method' WHERE NOT matchable AND {w('kv')} AND (kv.m, kv.i) NOT IN (SELECT (bm, i) FROM pv)"""


def saved_query(unmapped: str) -> str:
    return f"""WITH {ENTITIES}, sc AS (SELECT a, b FROM cp JOIN kc ON kc.c = a WHERE {unmapped} OR kc.mapped), sm AS (SELECT pm.a, pm.b, pm.kind, am, bm FROM pm JOIN sc USING (a, b) JOIN km x ON x.m = am WHERE {unmapped} OR x.mapped), r AS ({saved_sql(unmapped)})
SELECT kind, side, 'c' || ac AS a_class, 'c' || bc AS b_class, 'm' || am AS a_member, 'm' || bm AS b_member, CAST(ai AS INTEGER) AS a_idx, CAST(bi AS INTEGER) AS b_idx FROM r"""


@query("saved_matches", saved_query("TRUE"))
def saved_matches(t: Tables) -> DataFrame:
    """Rows of a match file: all that is matched, and all that may not be matched."""
    return saved(t, True)


@query("saved_mapped_matches", saved_query("FALSE"))
def saved_mapped_matches(t: Tables) -> DataFrame:
    """The same for entities with mapped names."""
    return saved(t, False)


def saved(t: Tables, unmapped: bool) -> DataFrame:
    known, matched = entities(t)
    rows = rows_to_save(only(known, 0), only(known, 1), matched["classes"], matched["members"], matched["variables"], unmapped)
    return rows.select("kind", "side", "a_class", "b_class", "a_member", "b_member", "a_idx", "b_idx")


DESCRIPTORS = """WITH l AS (SELECT l_orderkey AS o, l_linenumber AS i, min(l_suppkey) AS s FROM lineitem GROUP BY 1, 2),
p AS (SELECT o, i, repeat('[', CAST(i % 3 AS INTEGER)) AS dims, s FROM l),
n AS (SELECT ns, k, CASE ns WHEN 'plain' THEN 'p/S' || k WHEN 'mapped' THEN CASE WHEN k % 29 <> 0 THEN 'named/Supplier' || k END ELSE 't/S' || k END AS name FROM (SELECT s_suppkey AS k FROM supplier), (SELECT unnest(['plain', 'mapped', 'tmp']) AS ns)),
c AS (SELECT ns, k, CASE ns WHEN 'plain' THEN 'p/C' || k WHEN 'mapped' THEN 'named/Customer' || k ELSE CASE WHEN k % 7 <> 0 THEN 't/C' || k END END AS name FROM (SELECT c_custkey AS k FROM customer), (SELECT unnest(['plain', 'mapped', 'tmp']) AS ns)),
a AS (SELECT p.o, n.ns, string_agg(dims || 'L' || n.name || ';' || CASE WHEN i % 2 = 0 THEN 'I' ELSE 'J' END, '' ORDER BY i) AS args, bool_or(n.name IS NULL) AS gap FROM p JOIN n ON n.k = p.s GROUP BY 1, 2)
SELECT o_orderkey AS o, a.ns, CASE WHEN NOT a.gap THEN '(' || a.args || ')' || CASE WHEN o_orderstatus = 'P' THEN 'V' ELSE 'L' || c.name || ';' END END AS descriptor FROM orders JOIN a ON a.o = o_orderkey LEFT JOIN c ON c.k = o_custkey AND c.ns = a.ns"""


@query("translated_descriptors", DESCRIPTORS)
def translated_descriptors(t: Tables) -> DataFrame:
    """Descriptors of orders as methods (suppliers of their lines in arrays, and numbers; a customer or nothing is returned) in
    three namespaces; null where a class has no name there."""
    text = lambda c: F.col(c).cast("string")
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("i")).agg(F.min("l_suppkey").alias("s"))
    arg = F.concat(F.repeat(F.lit("["), F.col("i") % 3), F.lit("Lp/S"), text("s"), F.lit(";"), F.when(F.col("i") % 2 == 0, "I").otherwise("J"))
    args = lines.groupBy("o").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", arg.alias("arg")))), lambda x: x["arg"]), "").alias("args"))
    back = F.when(F.col("o_orderstatus") == "P", "V").otherwise(F.concat(F.lit("Lp/C"), text("o_custkey"), F.lit(";")))
    rows = keep(t.orders.join(args, F.col("o") == F.col("o_orderkey")).select("o", F.concat(F.lit("("), "args", F.lit(")"), back).alias("plain")))
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    out = rows.select("o", F.lit("plain").alias("ns"), F.col("plain").alias("descriptor"))
    for ns, of_s, of_c in (("mapped", F.when(s % 29 != 0, F.concat(F.lit("named/Supplier"), s.cast("string"))), F.concat(F.lit("named/Customer"), c.cast("string"))), ("tmp", F.concat(F.lit("t/S"), s.cast("string")), F.when(c % 7 != 0, F.concat(F.lit("t/C"), c.cast("string"))))):
        names = t.supplier.select(F.concat(F.lit("p/S"), text("s_suppkey")).alias("class_name"), of_s.alias("name")).unionByName(t.customer.select(F.concat(F.lit("p/C"), text("c_custkey")).alias("class_name"), of_c.alias("name")))
        done = rows.join(translate(rows, names, "plain"), "plain").select("o", F.lit(ns).alias("ns"), F.col("translated").alias("descriptor"))
        out = out.unionByName(done)
    return out
