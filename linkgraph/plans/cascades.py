"""Queries on matches applied with all that follows from them: customers are classes, some with array classes, their
orders' priorities are members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import cascade
from ..storage import keep
from .registry import Tables, query

#: Even customers are one side, odd ones the other; class ids are ten times the customer and the number of dimensions.
SIDES = """k AS (SELECT c_custkey AS id, c_nationkey AS n, c_mktsegment AS s, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment, c_custkey % 2 ORDER BY c_custkey) AS r FROM customer),
pa AS (SELECT * FROM k WHERE id % 2 = 0), pb AS (SELECT * FROM k WHERE id % 2 = 1),
ra AS (SELECT id * 10 + d AS cls, CASE WHEN d > 0 THEN id * 10 END AS element, d FROM pa, (SELECT unnest([0, 1, 2]) AS d) WHERE d = 0 OR (d = 1 AND id // 2 % 2 = 0) OR (d = 2 AND id // 2 % 3 = 0)),
rb AS (SELECT id * 10 + d AS cls, CASE WHEN d > 0 THEN id * 10 END AS element, d FROM pb, (SELECT unnest([0, 1, 2]) AS d) WHERE d = 0 OR (d = 1 AND id // 2 % 2 = 0) OR (d = 2 AND id // 2 % 5 = 0)),
o0 AS (SELECT x.id * 10 AS a, y.id * 10 AS b, x.r FROM pa x JOIN pb y ON x.n = y.n AND x.s = y.s AND y.r = x.r + 1 WHERE x.r % 3 <> 0),
old AS (SELECT a, b FROM o0 UNION ALL SELECT a + 1, b + 1 FROM o0 WHERE r % 2 = 0 AND a + 1 IN (SELECT cls FROM ra) AND b + 1 IN (SELECT cls FROM rb)),
s0 AS (SELECT x.id * 10 AS a, y.id * 10 AS b, x.r FROM pa x JOIN pb y ON x.n = y.n AND x.s = y.s AND y.r = x.r),
d1 AS (SELECT a, b FROM s0 WHERE r % 4 = 1 UNION ALL SELECT a + 1, b + 1 FROM s0 WHERE r % 4 = 3 AND a + 1 IN (SELECT cls FROM ra) AND b + 1 IN (SELECT cls FROM rb))"""


def one_round(before: str, delta: str, n: int) -> str:
    """The pairs after a round, its lost owners and the next delta."""
    return f"""m{n} AS (SELECT * FROM {before} WHERE a IN (SELECT a FROM {delta}) OR b IN (SELECT b FROM {delta})),
c{n} AS (SELECT * FROM {before} EXCEPT ALL SELECT * FROM m{n} UNION ALL SELECT * FROM {delta}),
d{n + 1} AS (SELECT x.cls AS a, y.cls AS b FROM {delta} q JOIN ra x ON x.element = q.a JOIN rb y ON y.element = q.b AND y.d = x.d WHERE y.cls NOT IN (SELECT b FROM c{n})
UNION ALL SELECT x.element, y.element FROM {delta} q JOIN ra x ON x.cls = q.a AND x.d > 0 JOIN rb y ON y.cls = q.b WHERE x.element NOT IN (SELECT a FROM c{n}))"""


CLASSES = f"""{SIDES}, {one_round('old', 'd1', 1)}, {one_round('c1', 'd2', 2)}, {one_round('c2', 'd3', 3)},
lost_a AS (SELECT a FROM d1 WHERE a IN (SELECT a FROM m1) UNION SELECT a FROM d2 WHERE a IN (SELECT a FROM m2) UNION SELECT a FROM d3 WHERE a IN (SELECT a FROM m3)),
lost_b AS (SELECT b FROM d1 WHERE b IN (SELECT b FROM m1) UNION SELECT b FROM d2 WHERE b IN (SELECT b FROM m2) UNION SELECT b FROM d3 WHERE b IN (SELECT b FROM m3)),
fresh AS (SELECT * FROM (SELECT * FROM d1 UNION SELECT * FROM d2 UNION SELECT * FROM d3) INTERSECT SELECT * FROM c3)"""

MEMBERS = """mm AS (SELECT DISTINCT o_custkey * 100 + CAST(substr(o_orderpriority, 1, 1) AS BIGINT) * 10 + CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS member, o_custkey * 10 AS owner, CASE WHEN o_orderpriority LIKE '5%' THEN 'field' ELSE 'method' END AS kind,
o_orderpriority || ':' || o_orderstatus AS id, o_orderpriority AS name, (o_custkey + CAST(substr(o_orderpriority, 1, 1) AS BIGINT)) % 4 = 0 AS hidden,
CASE WHEN o_custkey % 3 = 0 THEN 'own' || o_custkey || ':' || o_orderpriority || ':' || o_orderstatus ELSE n_regionkey || ':' || c_mktsegment || ':' || o_orderpriority || ':' || o_orderstatus || ':' || o_custkey % 40 // 2 END AS grp
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
ma AS (SELECT * FROM mm WHERE owner // 10 % 2 = 0), mb AS (SELECT * FROM mm WHERE owner // 10 % 2 = 1),
om AS (SELECT x.kind, x.member AS a, y.member AS b, x.owner AS oa, y.owner AS ob, x.grp AS ga, y.grp AS gb FROM o0 JOIN ma x ON x.owner = o0.a JOIN mb y ON y.owner = o0.b AND y.id = x.id WHERE x.name NOT LIKE '4%'),
left_ AS (SELECT * FROM om WHERE oa NOT IN (SELECT a FROM lost_a) AND ob NOT IN (SELECT b FROM lost_b)),
fa AS (SELECT f.b AS ob, x.* FROM fresh f JOIN ma x ON x.owner = f.a), fb AS (SELECT y.* FROM fresh f JOIN mb y ON y.owner = f.b),
nm AS (SELECT owner, kind, name, min(member) AS member, bool_or(hidden) AS hidden FROM fb GROUP BY ALL HAVING count(*) = 1),
rd AS (SELECT fa.kind, fa.member AS a, coalesce(i.member, nm.member) AS b FROM fa LEFT JOIN fb i ON i.owner = fa.ob AND i.kind = fa.kind AND i.id = fa.id LEFT JOIN nm ON nm.owner = fa.ob AND nm.kind = fa.kind AND nm.name = fa.name WHERE NOT fa.hidden AND NOT coalesce(i.hidden, nm.hidden)),
gp AS (SELECT ga, min(gb) AS gb FROM left_ WHERE kind = 'method' GROUP BY 1), big AS (SELECT grp FROM mb WHERE kind = 'method' GROUP BY 1 HAVING count(*) > 1),
al AS (SELECT fa.member AS a, min(y.member) AS b FROM fa JOIN gp ON gp.ga = fa.grp JOIN big ON big.grp = gp.gb JOIN fb y ON y.owner = fa.ob AND y.grp = gp.gb AND y.kind = 'method' WHERE fa.kind = 'method' AND fa.member NOT IN (SELECT a FROM rd) GROUP BY 1),
fp AS (SELECT min(a) AS a, b FROM (SELECT a, min(b) AS b FROM rd WHERE kind = 'field' GROUP BY 1) GROUP BY 2),
q AS (SELECT DISTINCT z.a, z.b, x.grp AS ga, y.grp AS gb FROM (SELECT a, b FROM rd WHERE kind = 'method' UNION ALL SELECT a, b FROM al) z JOIN ma x ON x.member = z.a JOIN mb y ON y.member = z.b),
pr AS (SELECT DISTINCT ga, gb FROM left_ WHERE kind = 'method'), qp AS (SELECT q.*, pr.ga IS NOT NULL AS paired FROM q LEFT JOIN pr USING (ga, gb)),
ng AS (SELECT min(ga) AS ga, gb FROM (SELECT ga, min(gb) AS gb FROM qp WHERE NOT paired GROUP BY 1) GROUP BY 2),
sg AS (SELECT a, b FROM (SELECT min(a) AS a, b FROM (SELECT a, min(b) AS b FROM qp WHERE paired GROUP BY 1) GROUP BY 2) WHERE a NOT IN (SELECT member FROM ma WHERE kind = 'method' AND grp IN (SELECT ga FROM ng)) AND (a, b) NOT IN (SELECT (a, b) FROM left_)),
sm AS (SELECT a, b FROM left_ WHERE kind = 'method' AND ga NOT IN (SELECT ga FROM ng) AND gb NOT IN (SELECT gb FROM ng) AND a NOT IN (SELECT a FROM sg) AND b NOT IN (SELECT b FROM sg)
UNION ALL SELECT x.member, min(y.member) FROM ng JOIN ma x ON x.grp = ng.ga AND x.kind = 'method' JOIN c3 ON c3.a = x.owner JOIN mb y ON y.grp = ng.gb AND y.owner = c3.b AND y.kind = 'method' GROUP BY 1 UNION ALL SELECT a, b FROM sg),
sf AS (SELECT a, b FROM left_ WHERE kind = 'field' AND a NOT IN (SELECT a FROM fp) AND b NOT IN (SELECT b FROM fp) UNION ALL SELECT a, b FROM fp)"""


def sides(t: Tables) -> tuple[DataFrame, cascade.Side, cascade.Side]:
    """(id, n, s, r) of customers, and both sides."""
    w = W.partitionBy("c_nationkey", "c_mktsegment", F.col("c_custkey") % 2).orderBy("c_custkey")
    k = keep(t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("s"), F.row_number().over(w).alias("r")))
    half, digit = F.floor(F.col("id") / 2), F.substring("o_orderpriority", 1, 1).cast("bigint")
    text = lambda c: F.col(c).cast("string")
    status = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    identity = F.concat_ws(":", "o_orderpriority", "o_orderstatus")
    shared = F.concat_ws(":", text("n_regionkey"), "c_mktsegment", identity, F.floor(F.col("o_custkey") % 40 / 2).cast("string"))
    group = F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("own"), F.concat_ws(":", text("o_custkey"), identity))).otherwise(shared)
    known = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    members = keep(t.orders.join(known, F.col("c_custkey") == F.col("o_custkey")).select((F.col("o_custkey") * 100 + digit * 10 + status).alias("member"), (F.col("o_custkey") * 10).alias("owner"), F.when(digit == 5, "field").otherwise("method").alias("kind"), identity.alias("id"), F.col("o_orderpriority").alias("name"), ((F.col("o_custkey") + digit) % 4 == 0).alias("obfuscated"), group.alias("group")).distinct())
    none = t.spark.createDataFrame([], "variable bigint, method bigint, is_arg boolean")

    def side(parity: int, doubles: int) -> cascade.Side:
        dims = F.array_compact(F.array(F.lit(0), F.when(half % 2 == 0, 1), F.when(half % doubles == 0, 2)))
        classes = k.where(F.col("id") % 2 == parity).select("id", F.explode(dims).alias("dims")).select((F.col("id") * 10 + F.col("dims")).alias("cls"), F.when(F.col("dims") > 0, F.col("id") * 10).alias("element"), "dims")
        return cascade.Side(keep(classes), members.where(F.floor(F.col("owner") / 10) % 2 == parity), none)

    return k, side(0, 3), side(1, 5)


def start_and_asked(t: Tables, k: DataFrame, a: cascade.Side, b: cascade.Side) -> tuple[cascade.Matches, DataFrame]:
    """Matches before: classes with the next one of the other side, their members by id; and the classes asked for."""
    x = k.where("id % 2 = 0").select("n", "s", "r", (F.col("id") * 10).alias("a"))
    y = lambda back: k.where("id % 2 = 1").select("n", "s", (F.col("r") - back).alias("r"), (F.col("id") * 10).alias("b"))
    arrays = lambda df: df.select((F.col("a") + 1).alias("a"), (F.col("b") + 1).alias("b")).join(a.classes.select(F.col("cls").alias("a")), "a", "left_semi").join(b.classes.select(F.col("cls").alias("b")), "b", "left_semi")
    old = keep(x.join(y(1), ["n", "s", "r"]).where("r % 3 <> 0").select("a", "b", "r"))
    same = x.join(y(0), ["n", "s", "r"]).select("a", "b", "r")
    one = lambda side, s: side.members.select(F.col("owner").alias(s), "id", "kind", "name", F.col("member").alias(f"m{s}"))
    members = keep(old.select("a", "b").join(one(a, "a"), "a").join(one(b, "b").drop("kind", "name"), ["b", "id"]).where("name not like '4%'").select("kind", F.col("ma").alias("a"), F.col("mb").alias("b")))
    of = lambda kind: members.where(F.col("kind") == kind).select("a", "b")
    pairs = lambda df: df.select("a", "b")
    before = cascade.Matches(keep(pairs(old).unionByName(pairs(arrays(old.where("r % 2 = 0"))))), of("method"), of("field"), t.spark.createDataFrame([], "a bigint, b bigint"))
    return before, keep(pairs(same.where("r % 4 = 1")).unionByName(pairs(arrays(same.where("r % 4 = 3")))))


@query("cascade_matches", f"WITH {CLASSES}, {MEMBERS} SELECT 'class' AS kind, a, b FROM c3 UNION ALL SELECT 'method', a, b FROM sm UNION ALL SELECT 'field', a, b FROM sf")
def cascade_matches(t: Tables) -> DataFrame:
    """All matches after some classes were matched by hand: arrays, elements, readable members and groups follow."""
    k, a, b = sides(t)
    before, asked = start_and_asked(t, k, a, b)
    return kinds(cascade.match_classes(asked, a, b, before))


def kinds(matches: cascade.Matches) -> DataFrame:
    out = None
    for kind, df in (("class", matches.classes), ("method", matches.methods), ("field", matches.fields)):
        one = df.select(F.lit(kind).alias("kind"), "a", "b")
        out = one if out is None else out.unionByName(one)
    return out


UNMATCHED = f"""WITH {SIDES}, z0 AS (SELECT a FROM old WHERE (a // 10) % 5 = 0 AND a % 10 = 0), z1 AS (SELECT a FROM z0 UNION SELECT cls FROM ra WHERE element IN (SELECT a FROM z0) AND cls IN (SELECT a FROM old)),
mmm AS (SELECT DISTINCT o_custkey * 100 + CAST(substr(o_orderpriority, 1, 1) AS BIGINT) * 10 + CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS member, o_custkey * 10 AS owner, o_orderpriority AS name, o_orderpriority || ':' || o_orderstatus AS id FROM orders)
SELECT 'class' AS kind, a, b FROM old WHERE a NOT IN (SELECT a FROM z1) UNION ALL SELECT CASE WHEN x.name LIKE '5%' THEN 'field' ELSE 'method' END, x.member, y.member FROM o0 JOIN mmm x ON x.owner = o0.a JOIN mmm y ON y.owner = o0.b AND y.id = x.id WHERE x.name NOT LIKE '4%' AND o0.a NOT IN (SELECT a FROM z1)"""


@query("cascade_unmatch", UNMATCHED)
def cascade_unmatch(t: Tables) -> DataFrame:
    """All matches after some classes lost theirs, with their arrays and members."""
    k, a, b = sides(t)
    before, _ = start_and_asked(t, k, a, b)
    gone = before.classes.where("floor(a / 10) % 5 = 0 and a % 10 = 0").select("a")
    return kinds(cascade.unmatch_classes(gone, a, b, before))


@query("group_uids", f"WITH {SIDES}, lost_a AS (SELECT NULL::BIGINT AS a WHERE FALSE), lost_b AS (SELECT NULL::BIGINT AS b WHERE FALSE), fresh AS (SELECT a, b FROM o0 WHERE FALSE), c3 AS (SELECT * FROM old), {MEMBERS}, u AS (SELECT grp, min(member) AS uid FROM ma WHERE kind = 'method' AND member % 7 = 0 GROUP BY 1), ub AS (SELECT gb AS grp, min(uid) AS uid FROM (SELECT DISTINCT ga, gb FROM left_ WHERE kind = 'method') p JOIN u ON u.grp = p.ga GROUP BY 1) SELECT 'a' AS side, member, uid FROM ma JOIN u USING (grp) WHERE kind = 'method' UNION ALL SELECT 'b', member, uid FROM mb JOIN ub USING (grp) WHERE kind = 'method'")
def group_uids(t: Tables) -> DataFrame:
    """Uids given to some methods reach all members of their groups and of the groups these are matched with."""
    k, a, b = sides(t)
    before, _ = start_and_asked(t, k, a, b)
    given = a.members.where("kind = 'method' and member % 7 = 0").select("member", F.col("member").alias("uid"))
    x, y = cascade.give_uids(given, a, b, before)
    return x.select(F.lit("a").alias("side"), "member", "uid").unionByName(y.select(F.lit("b").alias("side"), "member", "uid"))
