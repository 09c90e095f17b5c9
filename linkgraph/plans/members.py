"""Queries on members: hierarchy groups, overrides, names in all namespaces, compatibility, records, signatures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..filters import simple_filter
from ..functions import names
from ..functions import similarity as sim
from ..functions.signatures import same_structure
from ..operators import hierarchy as hier
from ..operators.graphs import closure
from ..operators.predicates import can_match, compatible_classes, compatible_members, toggled
from ..operators.rounds import match_members
from ..storage import keep
from .entities import CLASS_PAIRS, class_pairs
from .hierarchy import CLOSURE, edges
from .linking import BEST, CONTEST, ORDER_PAIRS, PART, best_parts, order_pairs
from .registry import Tables, query

#: Members of customers (their priorities), nations and regions; '5-LOW' is a constructor.
MEMBERS = """d AS (SELECT 'c' || o_custkey AS owner, CASE WHEN o_orderpriority = '5-LOW' THEN '<init>' ELSE o_orderpriority END AS id, min(o_orderkey) AS k FROM orders GROUP BY 1, 2
UNION ALL SELECT 'n' || n_nationkey, i, n_nationkey FROM nation, (VALUES ('1-URGENT'), ('2-HIGH'), ('<init>')) v(i) WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'r' || r_regionkey, i, r_regionkey + 1 FROM region, (VALUES ('2-HIGH'), ('3-MEDIUM')) v(i)),
mem AS (SELECT owner || ':' || id AS member, owner, id, k, k % 5 = 0 AS barrier, k % 3 <> 0 AS obfuscated FROM d)"""
TOPS = f"{CLOSURE}, {MEMBERS}, tops AS (SELECT m.member, m.id, arg_max(x.owner, cl.depth) AS top FROM mem m JOIN cl ON cl.node = m.owner JOIN mem x ON x.owner = cl.ancestor AND x.id = m.id AND NOT x.barrier WHERE NOT m.barrier GROUP BY 1, 2), grp AS (SELECT member, min(member) OVER (PARTITION BY id, top) AS \"group\" FROM tops UNION ALL SELECT member, member FROM mem WHERE barrier)"


def members(t: Tables) -> DataFrame:
    order_id = F.when(F.col("o_orderpriority") == "5-LOW", "<init>").otherwise(F.col("o_orderpriority"))
    owner = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string")).alias("owner")
    own = t.orders.groupBy(owner("c", "o_custkey"), order_id.alias("id")).agg(F.min("o_orderkey").alias("k"))
    ids = lambda *x: F.explode(F.array(*map(F.lit, x))).alias("id")
    nation = t.nation.where("n_nationkey % 2 = 0").select(owner("n", "n_nationkey"), ids("1-URGENT", "2-HIGH", "<init>"), F.col("n_nationkey").alias("k"))
    region = t.region.select(owner("r", "r_regionkey"), ids("2-HIGH", "3-MEDIUM"), (F.col("r_regionkey") + 1).alias("k"))
    every = own.unionByName(nation).unionByName(region)
    return every.select(F.concat_ws(":", "owner", "id").alias("member"), "owner", "id", "k", (F.col("k") % 5 == 0).alias("barrier"), (F.col("k") % 3 != 0).alias("obfuscated"))


@query("hierarchy_groups", f'WITH RECURSIVE {TOPS} SELECT member, "group" FROM grp')
def hierarchy_groups(t: Tables) -> DataFrame:
    """Members that share their name along a hierarchy; private and static ones share with nobody."""
    return hier.groups(keep(closure(edges(t))), keep(members(t)))


@query("group_readability", f'WITH RECURSIVE {TOPS} SELECT "group", count(*) AS members, bool_and(obfuscated) AS obfuscated FROM grp JOIN mem USING (member) GROUP BY 1')
def group_readability(t: Tables) -> DataFrame:
    """A group's name is obfuscated only if that of all its members is."""
    m = keep(members(t))
    grouped = hier.groups(keep(closure(edges(t))), m).join(m.select("member", "obfuscated"), "member")
    return grouped.groupBy("group").agg(F.count("*").alias("members"), F.bool_and("obfuscated").alias("obfuscated"))


@query("override_edges", f"WITH RECURSIVE {CLOSURE}, {MEMBERS} SELECT m.member, arg_min(x.member, cl.depth) AS parent FROM mem m JOIN cl ON cl.node = m.owner AND cl.depth > 0 JOIN mem x ON x.owner = cl.ancestor AND x.id = m.id AND NOT x.barrier WHERE NOT m.barrier AND m.id <> '<init>' GROUP BY 1")
def override_edges(t: Tables) -> DataFrame:
    return hier.overrides(edges(t), members(t))


ORIGINS = "org AS (SELECT DISTINCT 'c' || o_custkey || ':' || CASE WHEN o_orderpriority = '5-LOW' THEN '<init>' ELSE o_orderpriority END AS member, o_orderstatus AS origin FROM orders UNION ALL SELECT member, 'F' FROM mem WHERE owner LIKE 'n%' UNION ALL SELECT member, 'O' FROM mem WHERE owner LIKE 'r%')"


@query("origin_ancestry", f"WITH RECURSIVE {CLOSURE}, {MEMBERS}, {ORIGINS}, up AS (SELECT DISTINCT m.member, o.origin FROM mem m JOIN cl ON cl.node = m.owner AND cl.depth > 0 JOIN mem x ON x.owner = cl.ancestor AND x.id = m.id AND NOT x.barrier JOIN org o ON o.member = x.member WHERE NOT m.barrier AND m.id <> '<init>') SELECT o.member, bool_or(u.member IS NOT NULL) AS has_parent, bool_or(u.member IS NULL) AS is_root FROM org o LEFT JOIN up u ON u.member = o.member AND u.origin = o.origin GROUP BY 1")
def origin_ancestry(t: Tables) -> DataFrame:
    """Whether an origin of a member supplies what it overrides, and whether one does not."""
    m = keep(members(t))
    order_id = F.when(F.col("o_orderpriority") == "5-LOW", "<init>").otherwise(F.col("o_orderpriority"))
    own = t.orders.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit(":"), order_id).alias("member"), F.col("o_orderstatus").alias("origin")).distinct()
    above = lambda prefix, origin: m.where(F.col("owner").startswith(prefix)).select("member", F.lit(origin).alias("origin"))
    return hier.ancestry(hier.overrides(edges(t), m), own.unionByName(above("n", "F")).unionByName(above("r", "O")))


def namespace_sql() -> str:
    """The fallback order of each namespace as a coalesce, and the composition with the outer class."""
    out = []
    for ns, (plain, mapped, tmp, aux) in names.NAMESPACES.items():
        if ns == "plain":
            out.append("x.name AS plain")
            continue
        can = "WHEN (NOT y.obfuscated OR x.outer_ IS NOT NULL OR y.outer_ IS NULL OR regexp_matches({0}, '^[a-zA-Z_$]')) THEN {0}"
        parts = []
        if mapped:
            parts += [("x.mapped", 0), (f"CASE {can.format('y.mapped')} END", 1), ("CASE WHEN NOT x.obfuscated THEN x.local END", 0), ("CASE WHEN NOT y.obfuscated THEN y.local END", 1)]
        if aux:
            col = ("aux", "aux2")[aux - 1]
            parts += [(f"x.{col}", 0), (f"CASE {can.format('y.' + col)} END", 1)]
        if tmp:
            parts.append(("y.tmp", 1))
        if tmp or "loctmp" in ns:
            parts.append(("x.tmp", 0))
        if plain:
            parts.append(("x.local", 0))
        name = "coalesce(" + ", ".join(p for p, _ in parts) + ")"
        theirs = "CASE " + " ".join(f"WHEN {p} IS NOT NULL THEN {w}" for p, w in parts) + " END"
        composed = f"CASE WHEN {name} IS NULL THEN NULL WHEN {theirs} = 0 OR (x.outer_ IS NULL) = (y.outer_ IS NULL) THEN CASE WHEN x.outer_ IS NULL THEN {name} ELSE x.outer_ || '$' || {name} END WHEN x.outer_ IS NOT NULL THEN x.outer_ || '$' || string_split({name}, '/')[-1] ELSE 'q/' || {name} END"
        if ns == "uid_plain":
            composed = f"CASE WHEN coalesce(least(x.uid, y.uid), x.uid, y.uid) >= 0 THEN 'class_' || coalesce(least(x.uid, y.uid), x.uid, y.uid) ELSE {composed} END"
        out.append(f"{composed} AS {ns}")
    flag = lambda n, c: f"CASE WHEN k % {n} = 0 THEN {c} END"
    base = f"c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 1 THEN 'q/Out' || c_nationkey END AS outer_ FROM customer), e AS (SELECT *, coalesce(outer_ || '$', 'p/') || 'N' || k AS name, CASE WHEN outer_ IS NULL THEN 'p/N' || k ELSE 'N' || k END AS local, k % 2 = 0 AS obfuscated, {flag(5, chr(39) + 'm/M' + chr(39) + ' || k')} AS mapped, {flag(7, chr(39) + 'a/A' + chr(39) + ' || k')} AS aux, {flag(6, chr(39) + 'B' + chr(39) + ' || k')} AS aux2, {flag(3, chr(39) + 't/T' + chr(39) + ' || k')} AS tmp, {flag(11, 'k')} AS uid FROM c)"
    return f"WITH {base} SELECT x.k, {', '.join(out)} FROM e x LEFT JOIN e y ON y.k = x.k + 3"


@query("name_spaces", namespace_sql())
def name_spaces(t: Tables) -> DataFrame:
    """A customer's name in all namespaces under the match with the third next; every fourth one is an inner class,
    whose outer class has its plain name everywhere."""
    k = F.col("c_custkey")
    text = lambda prefix: F.concat(F.lit(prefix), k.cast("string"))
    outer = F.when(k % 4 == 1, F.concat(F.lit("q/Out"), F.col("c_nationkey").cast("string")))
    e = t.customer.select(k.alias("k"), outer.alias("outer"), F.concat(F.coalesce(F.concat(outer, F.lit("$")), F.lit("p/")), text("N")).alias("name"), (k % 2 == 0).alias("obfuscated"), F.when(k % 5 == 0, text("m/M")).alias("mapped"), F.when(k % 7 == 0, text("a/A")).alias("aux"), F.when(k % 6 == 0, text("B")).alias("aux2"), F.when(k % 3 == 0, text("t/T")).alias("tmp"), F.when(k % 11 == 0, k).alias("uid"))
    x, y = (e.select(*[F.col(c).alias(f"{s}_{c}") for c in e.columns]) for s in "xy")
    both = x.join(y, F.col("y_k") == F.col("x_k") + 3, "left")
    return both.select(F.col("x_k").alias("k"), *[names.class_name(ns, "x_", "y_", F.col("x_outer"), F.col("y_outer")).alias(ns) for ns in names.NAMESPACES])


@query("outer_fallback", "WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'c' || c_custkey // 3 || '$' || c_custkey ELSE 'c' || c_custkey END AS name, CASE WHEN c_custkey % 10 = 0 THEN 'given' || c_custkey % 4 END AS given, CASE WHEN c_custkey % 7 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'table' || c_custkey % 5 END END AS listed FROM customer), n AS (SELECT k, name, coalesce(given, listed) AS sure, CASE WHEN name LIKE '%$%' THEN regexp_extract(name, '^(.*)\\$', 1) END AS guess FROM c) SELECT n.k, coalesce(n.sure, o.name) AS outer_name, n.sure IS NOT NULL AND NOT EXISTS (SELECT 1 FROM c z WHERE z.name = n.sure) AS created FROM n LEFT JOIN c o ON o.name = n.guess")
def outer_fallback(t: Tables) -> DataFrame:
    """The outer class: the attribute's, else the inner-class table's, else that before the last '$' if it exists.
    The first two are created when they do not exist."""
    k = F.col("c_custkey")
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    name = F.when(k % 3 == 0, F.concat(text("c", F.floor(k / 3)), F.lit("$"), k.cast("string"))).otherwise(text("c", k))
    sure = F.coalesce(F.when(k % 10 == 0, text("given", k % 4)), F.when((k % 7 == 0) & (k % 2 == 0), text("table", k % 5)))
    c = t.customer.select(k.alias("k"), name.alias("name"), sure.alias("sure")).withColumn("guess", names.outer(F.col("name")))
    there = c.select(F.col("name").alias("there")).distinct()
    found = c.join(there, F.coalesce("sure", "guess") == F.col("there"), "left")
    return found.select("k", F.coalesce("sure", "there").alias("outer_name"), (F.col("sure").isNotNull() & F.col("there").isNull()).alias("created"))


@query("record_fix", "WITH r AS (SELECT o_orderkey AS o, min(l_partkey) AS f FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1), n AS (SELECT o, f % 2 = 0 AS fo, o % 3 <> 0 AS mo, CASE WHEN f % 4 = 0 THEN 'map' || f ELSE 'f' || f END AS fn, CASE WHEN o % 5 = 0 THEN 'map' || o ELSE 'f' || f END AS mn, f % 4 = 0 AS fm, o % 5 = 0 AS mm FROM r), d AS (SELECT *, (fo OR mo) AND fn <> mn AS differ, mo AND (NOT fo OR NOT mm OR fm) AS to_method FROM n) SELECT o, CASE WHEN differ AND NOT to_method THEN mn END AS field, CASE WHEN differ AND to_method THEN fn END AS method FROM d")
def record_fix(t: Tables) -> DataFrame:
    """Which of a record's field and accessor takes the other's name."""
    f = t.lineitem.groupBy(F.col("l_orderkey").alias("o")).agg(F.min("l_partkey").alias("f")).join(t.orders.select(F.col("o_orderkey").alias("o")), "o")
    text = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    fm, mm = F.col("f") % 4 == 0, F.col("o") % 5 == 0
    fixed = names.record_names(F.col("f") % 2 == 0, F.col("o") % 3 != 0, F.when(fm, text("map", "f")).otherwise(text("f", "f")), F.when(mm, text("map", "o")).otherwise(text("f", "f")), fm, mm)
    return f.select("o", fixed.alias("x")).select("o", "x.field", "x.method")


@query("handle_kinds", "SELECT DISTINCT l_orderkey, l_linenumber, CASE WHEN l_linenumber + 2 <= 4 THEN 'field' WHEN l_linenumber + 2 = 9 THEN 'interface method' WHEN l_linenumber + 2 = 8 THEN 'constructor' WHEN l_linenumber + 2 IN (6, 7) AND l_orderkey % 2 = 0 THEN 'interface method' ELSE 'method' END AS kind FROM lineitem")
def handle_kinds(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", names.handle_kind(F.col("l_linenumber") + 2, F.col("l_orderkey") % 2 == 0).alias("kind")).distinct()


@query("potential_class_equality", f"WITH {CLASS_PAIRS} SELECT a, b, CASE WHEN a % 4 = 0 THEN CASE WHEN a % 8 = 0 THEN b ELSE b + 2 END = b ELSE bal_a > -500 AND bal_b > -500 AND a % 3 = b % 3 AND CASE WHEN bal_a < 0 AND bal_b < 0 THEN TRUE WHEN bal_a < 0 OR bal_b < 0 THEN TRUE ELSE a % 10 = (b - 1) % 10 END END AS potential FROM cp")
def potential_class_equality(t: Tables) -> DataFrame:
    return class_pairs(t).select("a", "b", class_equality().alias("potential"))


def class_equality() -> F.Column:
    """Of the columns of class_pairs: a match of every fourth decides, balances say what is obfuscated or matchable."""
    from ..operators.predicates import compatible_names

    a, b, x, y = F.col("a"), F.col("b"), F.col("bal_a"), F.col("bal_b")
    match = F.when(a % 4 == 0, F.when(a % 8 == 0, b).otherwise(b + 2))
    fits = compatible_names(x < 0, y < 0, a % 10, (b - 1) % 10)
    return compatible_classes(F.lit(False), match, b, (x > -500) & (y > -500), a % 3, b % 3, fits)


MEMBER_PAIRS = f"{CLASS_PAIRS}, q AS (SELECT a, b, x.o_orderkey AS x, y.o_orderkey AS y, x.o_orderpriority AS px, y.o_orderpriority AS py, x.o_orderstatus AS sx, y.o_orderstatus AS sy FROM cp JOIN orders x ON x.o_custkey = a JOIN orders y ON y.o_custkey = b)"


@query("potential_member_equality", f"WITH {MEMBER_PAIRS} SELECT x, y, a % 7 <> 0 AND CASE WHEN (sx = 'P' OR sy = 'P') AND px <> py THEN FALSE WHEN x % 6 = 0 THEN (x + y) % 2 = 0 ELSE px = py END AS potential FROM q")
def potential_member_equality(t: Tables) -> DataFrame:
    """Members of matched classes: owners compatible, constructors (status P) by name, a matched group decides."""
    side = lambda s, k: t.orders.select(F.col("o_custkey").alias(s), F.col("o_orderkey").alias(k), F.col("o_orderpriority").alias(f"p{k}"), F.col("o_orderstatus").alias(f"s{k}"))
    q = class_pairs(t).join(side("a", "x"), "a").join(side("b", "y"), "b")
    group = F.when(F.col("x") % 6 == 0, F.col("x") % 2)
    test = compatible_members(F.col("a") % 7 != 0, F.col("sx") == "P", F.col("sy") == "P", F.col("px") == F.col("py"), F.col("px"), F.col("py"), group, F.col("y") % 2)
    return q.select("x", "y", test.alias("potential"))


POTENTIAL = "CASE WHEN a % 4 = 0 THEN CASE WHEN a % 8 = 0 THEN b ELSE b + 2 END = b ELSE bal_a > -500 AND bal_b > -500 AND a % 3 = b % 3 AND CASE WHEN bal_a < 0 AND bal_b < 0 THEN TRUE WHEN bal_a < 0 OR bal_b < 0 THEN TRUE ELSE a % 10 = (b - 1) % 10 END END AS potential"
TYPED = """nx AS (SELECT c_custkey AS c, coalesce(lead(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment, c_custkey % 2 ORDER BY c_custkey), c_custkey) AS nx FROM customer),
om AS (SELECT o_custkey AS c, o_orderkey AS o, CASE WHEN o_orderstatus = 'F' THEN o_custkey ELSE nx END AS type, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders JOIN nx ON nx.c = o_custkey)"""


@query("type_scores", f"WITH {CLASS_PAIRS}, e AS (SELECT a, b, {POTENTIAL} FROM cp), {TYPED} SELECT x.o AS a, y.o AS b, CASE WHEN coalesce(e.potential, FALSE) THEN 1.0 ELSE 0.0 END AS type_score, CASE WHEN coalesce(e.potential, FALSE) THEN 1.0 ELSE 0.5 END AS similarity FROM cp JOIN om x ON x.c = cp.a JOIN om y ON y.c = cp.b AND y.n = x.n LEFT JOIN e ON e.a = x.type AND e.b = y.type")
def type_scores(t: Tables) -> DataFrame:
    """The n-th orders of matched customers scored by whether their types can be equal: 1 or 0 as a scorer, 1 or 0.5 as
    the similarity of matched fields and variables. An order's type is its customer, or the next one of its kind."""
    possible = class_pairs(t).select(F.col("a").alias("type_a"), F.col("b").alias("type_b"), class_equality().alias("potential"))
    kin = W.partitionBy("c_nationkey", "c_mktsegment", F.col("c_custkey") % 2).orderBy("c_custkey")
    following = t.customer.select("c_custkey", F.coalesce(F.lead("c_custkey").over(kin), F.col("c_custkey")).alias("next"))
    members = t.orders.join(following, F.col("o_custkey") == F.col("c_custkey")).withColumn("n", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")))
    kind = F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")).otherwise(F.col("next"))
    side = lambda s: members.select(F.col("o_custkey").alias(f"c_{s}"), "n", F.col("o_orderkey").alias(s), kind.alias(f"type_{s}"))
    typed = class_pairs(t).select(F.col("a").alias("c_a"), F.col("b").alias("c_b")).join(side("a"), "c_a").join(side("b"), ["c_b", "n"])
    hit = F.coalesce("potential", F.lit(False))
    return typed.join(possible, ["type_a", "type_b"], "left").select("a", "b", F.when(hit, 1.0).otherwise(0.0).alias("type_score"), F.when(hit, 1.0).otherwise(0.5).alias("similarity"))


@query("simple_text_filter", PART + BEST + "SELECT a, b FROM (SELECT t.a, t.b, printf('%.3f', power(raw / 16, 2)) || ' ' || p_brand AS shown FROM t JOIN part ON p_partkey = t.b) WHERE contains(lower(shown), 'brand#1')")
def simple_text_filter(t: Tables) -> DataFrame:
    """Ranked candidates whose score and name contain a text, whatever its case."""
    ranked = best_parts(t, CONTEST, 10).select("a", "b", sim.normalised(F.col("raw"), 16.0).alias("score"), F.col("brand_b").alias("b_name"))
    return simple_filter(ranked, "BRAND#1").select("a", "b")


SIGNATURE = "CASE WHEN {0}.p_size >= 5 THEN string_split({0}.p_name, ' ') END"


@query("signature_scores", f"WITH s AS (SELECT p_partkey AS k, CASE WHEN p_size >= 5 THEN p_name END AS n FROM part) SELECT x.k AS a, y.k AS b, CASE WHEN x.n IS NULL AND y.n IS NULL THEN 1.0 WHEN x.n IS NULL OR y.n IS NULL THEN 0.0 WHEN x.n = y.n THEN 1.0 ELSE 0.0 END AS score FROM s x JOIN s y ON y.k = x.k + 1")
def signature_scores(t: Tables) -> DataFrame:
    """Generic signatures by structure: names of type variables, which differ in all parts, do not count."""
    word = lambda i: F.element_at(F.split("p_name", " "), i)
    var = F.concat(F.lit("V"), F.col("p_partkey").cast("string"))
    text = F.concat(F.lit("<"), var, F.lit(":Lbase/"), word(1), F.lit(";>Lpkg/"), word(-1), F.lit("<T"), var, F.lit(";[I>;"))
    s = t.part.select("p_partkey", F.when(F.col("p_size") >= 5, text).alias("sig"))
    # spread by key: the file may be one task's, and the comparison costs more than the rows
    x = s.select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1).alias("b"), F.col("sig").alias("x")).repartition("b")
    y = s.select(F.col("p_partkey").alias("b"), F.col("sig").alias("y"))
    score = sim.null_rule(F.col("x"), F.col("y"), F.when(same_structure(F.col("x"), F.col("y")), 1.0).otherwise(0.0))
    return x.join(y, "b").select("a", "b", score.alias("score"))


GREEDY = f"""WITH RECURSIVE {CLASS_PAIRS}, g AS (SELECT o_custkey AS c, list({{'p': o_orderpriority, 'n': n}} ORDER BY o_orderkey) AS m FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1),
r AS (SELECT a, b, x.m AS ma, y.m AS mb, y.m AS rest, 0 AS i, CAST(0 AS DOUBLE) AS total FROM cp JOIN g x ON x.c = a JOIN g y ON y.c = b
UNION ALL SELECT a, b, ma, mb, CASE WHEN best.s > 0 THEN list_concat(rest[:-best.j - 1], rest[-best.j + 1:]) ELSE rest END, i + 1, total + coalesce(best.s, 0) FROM (SELECT *, list_aggregate(list_transform(range(1, len(rest) + 1), lambda j: {{'s': CASE WHEN rest[j].p <> ma[i + 1].p THEN 0.0 ELSE 1 - abs(rest[j].n - ma[i + 1].n) / greatest(rest[j].n, ma[i + 1].n) END, 'j': -j}}), 'max') AS best FROM r WHERE i < len(ma)))
SELECT a, b, round(total / greatest(len(ma), len(mb)), 6) AS score FROM r WHERE i = len(ma)"""


@query("similar_methods_greedy", GREEDY)
def similar_methods_greedy(t: Tables) -> DataFrame:
    """Members of a class one after the other take the compatible one with the nearest code length that is left."""
    lengths = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    m = t.orders.join(lengths, "o_orderkey").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", F.col("o_orderpriority").alias("p"), "n"))), lambda x: F.struct(x["p"].alias("p"), x["n"].alias("n"))).alias("m"))
    side = lambda s: m.select(F.col("o_custkey").alias(s), F.col("m").alias(f"m_{s}"))
    both = class_pairs(t).join(side("a"), "a").join(side("b"), "b")
    score = sim.greedy_pairs("m_a", "m_b", lambda x, y: F.when(x["p"] == y["p"], sim.count_ratio(x["n"], y["n"])).otherwise(0.0))
    return both.select("a", "b", F.round(score, 6).alias("score"))


GROUP_SQL = f"""WITH {CLASS_PAIRS}, mm AS (SELECT o_custkey * 10 + CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS member, o_custkey AS owner, CASE WHEN o_custkey % 3 = 0 THEN 'own' || (o_custkey * 10 + CAST(substr(o_orderpriority, 1, 1) AS BIGINT)) ELSE n_regionkey || ':' || c_mktsegment || ':' || o_orderpriority || ':' || o_custkey % 40 // 2 END AS grp FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL),
ma AS (SELECT * FROM mm WHERE owner % 2 = 0), mb AS (SELECT * FROM mm WHERE owner % 2 = 1), old AS (SELECT x.member AS a, y.member AS b, x.grp AS ga, y.grp AS gb FROM cp JOIN ma x ON x.owner = cp.a JOIN mb y ON y.owner = cp.b AND y.member % 10 = x.member % 10 WHERE cp.a % 7 < 2 AND x.member % 10 <> 4),
asked AS (SELECT x.member AS a, y.member AS b, x.grp AS ga, y.grp AS gb FROM cp JOIN ma x ON x.owner = cp.a JOIN mb y ON y.owner = cp.b AND y.member % 10 = x.member % 10 WHERE cp.a % 5 = 0 AND x.member % 10 IN (1, 4)),
paired AS (SELECT DISTINCT ga, gb FROM old), todo AS (SELECT q.*, p.ga IS NOT NULL AS paired FROM asked q LEFT JOIN paired p USING (ga, gb) WHERE (a, b) NOT IN (SELECT (a, b) FROM old)), ng AS (SELECT DISTINCT ga, gb FROM todo WHERE NOT paired), sg AS (SELECT a, b FROM todo WHERE paired)
SELECT a, b FROM old WHERE ga NOT IN (SELECT ga FROM ng) AND gb NOT IN (SELECT gb FROM ng) AND a NOT IN (SELECT a FROM sg) AND b NOT IN (SELECT b FROM sg)
UNION ALL SELECT x.member, min(y.member) FROM ng JOIN ma x ON x.grp = ng.ga JOIN cp ON cp.a = x.owner JOIN mb y ON y.grp = ng.gb AND y.owner = cp.b GROUP BY 1 UNION ALL SELECT a, b FROM sg"""


@query("match_member_groups", GROUP_SQL)
def match_member_groups(t: Tables) -> DataFrame:
    """Matching members with their hierarchy groups: some groups are paired already, others lose what they had."""
    number = F.col("o_custkey") * 10 + F.substring("o_orderpriority", 1, 1).cast("bigint")
    c = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    text = lambda x: x.cast("string")
    shared = F.concat_ws(":", text(F.col("n_regionkey")), "c_mktsegment", "o_orderpriority", text(F.floor(F.col("o_custkey") % 40 / 2)))
    group = F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("own"), text(number))).otherwise(shared)
    m = keep(t.orders.join(c, F.col("c_custkey") == F.col("o_custkey")).select(number.alias("member"), F.col("o_custkey").alias("owner"), group.alias("group")).distinct())
    a, b = m.where("owner % 2 = 0"), m.where("owner % 2 = 1")
    classes = keep(class_pairs(t).select("a", "b"))
    one = lambda s, df: df.select(F.col("member").alias(s), F.col("owner").alias(f"o{s}"), (F.col("member") % 10).alias("digit"))
    alike = keep(classes.select(F.col("a").alias("oa"), F.col("b").alias("ob")).join(one("a", a), "oa").join(one("b", b), ["ob", "digit"]))
    after, _ = match_members(alike.where("oa % 5 = 0 and digit in (1, 4)").select("a", "b"), a, b, classes, alike.where("oa % 7 < 2 and digit <> 4").select("a", "b"))
    return after


@query("match_guards", f"WITH {ORDER_PAIRS}, e AS (SELECT m.a, m.b, CASE WHEN m.a % 3 = 0 THEN m.b WHEN m.a % 3 = 1 THEN m.b + 2 END AS match_a, x.o_orderstatus = y.o_orderstatus AS same_kind, x.o_totalprice > 100000 AS ma, y.o_totalprice > 100000 AS mb, x.o_orderpriority = y.o_orderpriority AS potential FROM m JOIN orders x ON x.o_orderkey = m.a JOIN orders y ON y.o_orderkey = m.b) SELECT a, b, same_kind AND match_a IS DISTINCT FROM b AND ma AND mb AS can_match, NOT ma OR match_a IS NOT NULL OR NOT potential AS matchable_after FROM e")
def match_guards(t: Tables) -> DataFrame:
    """Which pairs could be matched by hand, and what a toggle would make of the first of each."""
    side = lambda s: t.orders.select(F.col("o_orderkey").alias(s), F.col("o_orderstatus").alias(f"st_{s}"), (F.col("o_totalprice") > 100000).alias(f"m_{s}"), F.col("o_orderpriority").alias(f"p_{s}"))
    a, b = F.col("a"), F.col("b")
    match = F.when(a % 3 == 0, b).when(a % 3 == 1, b + 2)
    e = order_pairs(t).join(side("a"), "a").join(side("b"), "b")
    return e.select("a", "b", can_match(b, match, F.col("m_a"), F.col("m_b"), F.col("st_a") == F.col("st_b")).alias("can_match"), toggled(F.col("m_a"), match.isNotNull(), F.col("p_a") == F.col("p_b")).alias("matchable_after"))


@query("mapped_children", "WITH v AS (SELECT l_orderkey AS o, bool_or(l_partkey % 19 = 0) AS has, bool_and(l_partkey % 3 = 0 OR l_partkey % 19 = 0 OR l_linenumber > 2) AS every FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2) GROUP BY 1), w AS (SELECT l_orderkey AS o, bool_or(l_partkey % 19 = 0 OR l_partkey % 3 = 0 AND l_linenumber <= 2) AS has FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2) GROUP BY 1) SELECT o_custkey AS owner, bool_or(CASE WHEN o_orderstatus = 'P' THEN o_orderkey % 7 = 0 ELSE (o_orderkey % 7 = 0 AND o_orderkey % 2 = 0) OR coalesce(w.has, FALSE) END) AS has_mapped, count(CASE WHEN o_orderstatus <> 'P' AND coalesce(v.every, TRUE) THEN 1 END) AS all_args FROM orders LEFT JOIN v ON v.o = o_orderkey LEFT JOIN w ON w.o = o_orderkey GROUP BY 1")
def mapped_children(t: Tables) -> DataFrame:
    """Customers with mapped orders or lines (orders of status P are fields, lines up to the second are arguments), and
    how many of their methods have all arguments mapped."""
    k = F.col("o_orderkey")
    m = keep(t.orders.select(k.alias("member"), F.col("o_custkey").alias("owner"), F.when(F.col("o_orderstatus") == "P", "field").otherwise("method").alias("kind"), (k % 7 == 0).alias("mapped"), (k % 2 == 1).alias("has_parent")))
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("member"), "l_linenumber").agg(F.min("l_partkey").alias("p"))
    is_arg = F.col("l_linenumber") <= 2
    variables = lines.select("member", is_arg.alias("is_arg"), ((F.col("p") % 19 == 0) | is_arg & (F.col("p") % 3 == 0)).alias("mapped"))
    classes, methods = hier.mapped_children(m, variables)
    counted = methods.where("all_args").join(m.select("member", "owner"), "member").groupBy("owner").agg(F.count("*").alias("all_args"))
    return classes.join(counted, "owner", "left").select("owner", "has_mapped", F.coalesce("all_args", F.lit(0)).alias("all_args"))
