"""Queries on entities as an object graph: customers as classes (super: nation), orders as their methods,
suppliers of their lines as fields, and the references between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import names
from ..functions import similarity as sim
from ..operators.sets import soft_sets
from ..storage import keep
from .linking import ORDER_PAIRS, order_pairs
from .registry import Tables, query

#: The k-th even with the k-th odd customer of a nation and segment.
CLASS_PAIRS = "k AS (SELECT c_custkey AS id, c_nationkey AS n, c_mktsegment AS s, c_acctbal AS bal, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment, c_custkey % 2 ORDER BY c_custkey) AS r FROM customer), cp AS (SELECT x.id AS a, y.id AS b, x.bal AS bal_a, y.bal AS bal_b FROM k x JOIN k y ON x.n = y.n AND x.s = y.s AND x.r = y.r AND x.id % 2 = 0 AND y.id % 2 = 1)"


def class_pairs(t: Tables) -> DataFrame:
    w = W.partitionBy("c_nationkey", "c_mktsegment", F.col("c_custkey") % 2).orderBy("c_custkey")
    k = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal", F.row_number().over(w).alias("r"))
    side = lambda s, rest: k.where(F.col("c_custkey") % 2 == rest).select("c_nationkey", "c_mktsegment", "r", F.col("c_custkey").alias(s), F.col("c_acctbal").alias(f"bal_{s}"))
    return side("a", 0).join(side("b", 1), ["c_nationkey", "c_mktsegment", "r"]).select("a", "b", "bal_a", "bal_b")


def orders_of(t: Tables, s: str) -> DataFrame:
    return t.orders.select(F.col("o_custkey").alias(s), F.col("o_orderkey").alias("o"), F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("st"))


@query("compat_class_pairs", f"WITH {CLASS_PAIRS} SELECT a, b, CASE WHEN bal_a < 0 AND bal_b < 0 THEN TRUE WHEN bal_a < 0 OR bal_b < 0 THEN TRUE ELSE a % 10 = (b - 1) % 10 END AS compatible, CASE WHEN bal_a < 0 AND bal_b < 0 THEN TRUE WHEN bal_a < 0 OR bal_b < 0 THEN FALSE ELSE a % 10 = (b - 1) % 10 END AS both_or_none FROM cp")
def compat_class_pairs(t: Tables) -> DataFrame:
    """Names agree when both are obfuscated (negative balance), or one is unless both or none must be, or equal."""
    from ..operators.predicates import compatible_names

    a, b = F.col("bal_a") < 0, F.col("bal_b") < 0
    x, y = F.col("a") % 10, (F.col("b") - 1) % 10
    return class_pairs(t).select("a", "b", compatible_names(a, b, x, y, False).alias("compatible"), compatible_names(a, b, x, y, True).alias("both_or_none"))


@query("null_rule_scores", f"WITH {CLASS_PAIRS}, f AS (SELECT o_custkey AS c, min(o_orderkey) AS first FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000 GROUP BY 1) SELECT a, b, CASE WHEN x.first IS NULL AND y.first IS NULL THEN 1.0 WHEN x.first IS NULL OR y.first IS NULL THEN 0.0 WHEN x.first % 3 = y.first % 3 THEN 1.0 ELSE 0.0 END AS score FROM cp LEFT JOIN f x ON x.c = a LEFT JOIN f y ON y.c = b")
def null_rule_scores(t: Tables) -> DataFrame:
    first = t.orders.where("o_orderstatus = 'F' and o_totalprice > 300000").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first"))
    side = lambda s: first.select(F.col("o_custkey").alias(s), F.col("first").alias(f"first_{s}"))
    x, y = F.col("first_a"), F.col("first_b")
    return class_pairs(t).join(side("a"), "a", "left").join(side("b"), "b", "left").select("a", "b", sim.null_rule(x, y, F.when(x % 3 == y % 3, 1.0).otherwise(0.0)).alias("score"))


@query("regex_obf_flags", "SELECT o_orderkey, regexp_full_match('c' || o_custkey || '/m' || o_orderkey || 'V', 'c\\d*[02468]/m.*') AND o_orderstatus <> 'P' AS obfuscated, o_custkey % 2 = 0 AS is_input FROM orders")
def regex_obf_flags(t: Tables) -> DataFrame:
    """A member is obfuscated when owner/name fully matches the pattern and it is no special one (status P)."""
    full = F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("/m"), F.col("o_orderkey").cast("string"), F.lit("V"))
    return t.orders.select("o_orderkey", (full.rlike(r"^(?:c\d*[02468]/m.*)$") & (F.col("o_orderstatus") != "P")).alias("obfuscated"), (F.col("o_custkey") % 2 == 0).alias("is_input"))


@query("display_list", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def display_list(t: Tables) -> DataFrame:
    mapped = t.orders.where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.where("c_acctbal > 0").join(mapped, "c_custkey", "left_semi").select("c_custkey", "c_name").orderBy("c_name")


@query("info_projection", "SELECT c.c_custkey, c.c_name || CASE WHEN c.c_custkey % 5 = 0 THEN ' - m' || c.c_custkey ELSE '' END AS title, n.n_name AS parent, (SELECT count(*) FROM orders WHERE o_custkey = c.c_custkey) AS members, (SELECT string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) FROM orders WHERE o_custkey = c.c_custkey) AS kinds FROM customer c JOIN nation n ON n_nationkey = c_nationkey")
def info_projection(t: Tables) -> DataFrame:
    o = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("members"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ", ").alias("kinds"))
    c = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).join(o, "c_custkey", "left")
    title = F.concat("c_name", F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit(" - m"), F.col("c_custkey").cast("string"))).otherwise(""))
    return c.select("c_custkey", title.alias("title"), F.col("n_name").alias("parent"), F.coalesce("members", F.lit(0)).alias("members"), "kinds")


RELATIONS = {"suppliers": "l_suppkey", "parts": "l_partkey"}


def relation_sql() -> str:
    parts = []
    for kind, col in RELATIONS.items():
        parts.append(f"SELECT '{kind}' AS relation, a, b, CASE WHEN len(x.s) = 0 AND len(y.s) = 0 THEN 1.0 WHEN x.s IS NULL OR y.s IS NULL THEN 0.0 ELSE 2 * len(list_intersect(x.s, y.s)) / (len(x.s) + len(y.s)) END AS score FROM cp JOIN (SELECT o_custkey AS c, list(DISTINCT {col}) AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) x ON x.c = a JOIN (SELECT o_custkey AS c, list(DISTINCT {col}) AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) y ON y.c = b")
    return f"WITH {CLASS_PAIRS} SELECT relation, a, b, round(score, 6) AS score FROM ({' UNION ALL '.join(parts)})"


@query("relation_set_scores", relation_sql())
def relation_set_scores(t: Tables) -> DataFrame:
    """Soft sets of what a class's members use, without matches: shared elements agree, others count against."""
    used = keep(t.orders.select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("l_orderkey")).join(t.lineitem, "l_orderkey").select("c", *RELATIONS.values()))
    pairs, none = keep(class_pairs(t)), t.spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))
    out = None
    for kind, col in RELATIONS.items():
        elems = used.select("c", F.col(col).alias("elem")).distinct()
        rows = lambda s, kind_of: pairs.select(F.struct("a", "b").alias("pair"), F.col(s).alias("c")).join(elems, "c").select("pair", "elem", kind_of.alias("kind"))  # noqa: E731, B023
        one = soft_sets(rows("a", F.lit("l")), rows("b", F.lit("r")), none, one_sided=False)
        named = one.select(F.lit(kind).alias("relation"), "pair.a", "pair.b", F.round("score", 6).alias("score"))
        out = named if out is None else out.unionByName(named)
    return out


@query("constant_set_scores", f"WITH {CLASS_PAIRS}, s AS (SELECT o_custkey AS c, list(DISTINCT o_orderpriority) AS p, list(DISTINCT CAST(o_totalprice / 50000 AS INTEGER)) AS q FROM orders GROUP BY 1) SELECT a, b, round(len(list_intersect(x.p, y.p)) / len(list_distinct(list_concat(x.p, y.p))), 6) AS strings, round(len(list_intersect(x.q, y.q)) / len(list_distinct(list_concat(x.q, y.q))), 6) AS numbers FROM cp JOIN s x ON x.c = a JOIN s y ON y.c = b")
def constant_set_scores(t: Tables) -> DataFrame:
    s = t.orders.groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("p"), F.collect_set(F.round(F.col("o_totalprice") / 50000).cast("int")).alias("q"))
    side = lambda k: s.select(F.col("o_custkey").alias(k), F.col("p").alias(f"p_{k}"), F.col("q").alias(f"q_{k}"))
    both = class_pairs(t).join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", F.round(sim.jaccard(F.col("p_a"), F.col("p_b")), 6).alias("strings"), F.round(sim.jaccard(F.col("q_a"), F.col("q_b")), 6).alias("numbers"))


@query("member_position_scores", f"WITH {ORDER_PAIRS}, p AS (SELECT o_orderkey AS o, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT a, b, round(1 - abs((x.i / greatest(x.n - 1, 1)) - (y.i / greatest(y.n - 1, 1))), 6) AS score FROM m JOIN p x ON x.o = a JOIN p y ON y.o = b")
def member_position_scores(t: Tables) -> DataFrame:
    """Relative positions of matched members among their siblings."""
    w = W.partitionBy("o_custkey")
    p = t.orders.select(F.col("o_orderkey").alias("o"), ((F.row_number().over(w.orderBy("o_orderkey")) - 1) / F.greatest(F.count("*").over(w) - 1, F.lit(1))).alias("p"))
    side = lambda s: p.select(F.col("o").alias(s), F.col("p").alias(f"p_{s}"))
    return order_pairs(t).join(side("a"), "a").join(side("b"), "b").select("a", "b", F.round(1 - F.abs(F.col("p_a") - F.col("p_b")), 6).alias("score"))


@query("arg_list_similarity", f"WITH {ORDER_PAIRS}, s AS (SELECT l_orderkey AS o, string_agg(CAST(l_linenumber AS VARCHAR), '' ORDER BY l_linenumber) AS s FROM lineitem GROUP BY 1) SELECT a, b, round(1 - levenshtein(x.s, y.s) / greatest(length(x.s), length(y.s)), 6) AS score FROM m JOIN s x ON x.o = a JOIN s y ON y.o = b")
def arg_list_similarity(t: Tables) -> DataFrame:
    s = t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l_linenumber")), lambda x: x.cast("string")), "").alias("s"))
    side = lambda k: s.select(F.col("l_orderkey").alias(k), F.col("s").alias(f"s_{k}"))
    return order_pairs(t).join(side("a"), "a").join(side("b"), "b").select("a", "b", F.round(sim.edit_similarity(F.col("s_a"), F.col("s_b")), 6).alias("score"))


@query("code_similarity")
def code_similarity(t: Tables) -> DataFrame:
    """Lines of matched orders as instruction lists: flag as opcode, quantity class as operand."""
    item = F.concat_ws(":", "l_returnflag", (F.col("l_quantity") / 10).cast("int").cast("string"))
    s = t.lineitem.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", item.alias("i")))), lambda x: x["i"]).alias("s"))
    side = lambda k: s.select(F.col("l_orderkey").alias(k), F.col("s").alias(f"s_{k}"))
    return order_pairs(t).join(side("a"), "a").join(side("b"), "b").select("a", "b", F.round(sim.weighted_edit_similarity("s_a", "s_b"), 6).alias("score"))


@query("field_similarity", f"WITH {ORDER_PAIRS} SELECT a, b, CASE WHEN x.o_orderpriority = y.o_orderpriority THEN 1.0 ELSE 0.5 END AS score FROM m JOIN orders x ON x.o_orderkey = a JOIN orders y ON y.o_orderkey = b")
def field_similarity(t: Tables) -> DataFrame:
    side = lambda s: t.orders.select(F.col("o_orderkey").alias(s), F.col("o_orderpriority").alias(f"p_{s}"))
    return order_pairs(t).join(side("a"), "a").join(side("b"), "b").select("a", "b", F.when(F.col("p_a") == F.col("p_b"), 1.0).otherwise(0.5).alias("score"))


MEMBERS = f"WITH {CLASS_PAIRS}, s AS (SELECT a, b, x.o_orderkey AS x, y.o_orderkey AS y, power((CASE WHEN x.o_orderpriority = y.o_orderpriority THEN 6.0 ELSE 0.0 END + CASE WHEN x.o_orderstatus = y.o_orderstatus THEN 4.0 ELSE 0.0 END) / 10, 2) AS v FROM cp JOIN orders x ON x.o_custkey = a JOIN orders y ON y.o_custkey = b)"


def member_scores(t: Tables) -> DataFrame:
    x = orders_of(t, "a").withColumnsRenamed({"o": "x", "p": "px", "st": "sx"})
    y = orders_of(t, "b").withColumnsRenamed({"o": "y", "p": "py", "st": "sy"})
    raw = F.when(F.col("px") == F.col("py"), 6.0).otherwise(0.0) + F.when(F.col("sx") == F.col("sy"), 4.0).otherwise(0.0)
    return class_pairs(t).join(x, "a").join(y, "b").select("a", "b", "x", "y", sim.normalised(raw, 10.0).alias("v"))


@query("members_full", MEMBERS + ", r AS (SELECT a, b, x, v, row_number() OVER (PARTITION BY a, b, x ORDER BY v DESC, y) AS n, lead(v) OVER (PARTITION BY a, b, x ORDER BY v DESC, y) AS w FROM s), g AS (SELECT a, b, sum(v) AS v FROM r WHERE n = 1 AND v >= 0.8 AND (w IS NULL OR w < v * (1 - 0.08)) GROUP BY a, b), c AS (SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1) SELECT a, b, round(CASE WHEN coalesce(x.n, 0) = 0 AND coalesce(y.n, 0) = 0 THEN 1.0 ELSE coalesce(v, 0) / greatest(coalesce(x.n, 0), coalesce(y.n, 0)) END, 6) AS score FROM cp LEFT JOIN g USING (a, b) LEFT JOIN c x ON x.c = a LEFT JOIN c y ON y.c = b")
def members_full(t: Tables) -> DataFrame:
    """Accepted member scores of a class pair over the larger number of members."""
    w = W.partitionBy("a", "b", "x").orderBy(F.desc("v"), "y")
    top = member_scores(t).withColumn("n", F.row_number().over(w)).where("n <= 2").groupBy("a", "b", "x").agg(F.max(F.when(F.col("n") == 1, F.col("v"))).alias("v"), F.max(F.when(F.col("n") == 2, F.col("v"))).alias("w"))
    good = top.where("v >= 0.8 and (w is null or w < v * (1 - 0.08))").groupBy("a", "b").agg(F.sum("v").alias("v"))
    n = lambda s: t.orders.groupBy(F.col("o_custkey").alias(s)).agg(F.count("*").alias(f"n_{s}"))
    both = class_pairs(t).join(good, ["a", "b"], "left").join(n("a"), "a", "left").join(n("b"), "b", "left")
    most = F.greatest(F.coalesce("n_a", F.lit(0)), F.coalesce("n_b", F.lit(0)))
    return both.select("a", "b", F.round(sim.ratio(F.coalesce("v", F.lit(0.0)), most.cast("double")), 6).alias("score"))


@query("similar_methods", MEMBERS + " SELECT a, b, round(sum(best), 6) AS score FROM (SELECT a, b, x, max(v) AS best FROM s GROUP BY a, b, x) GROUP BY a, b")
def similar_methods(t: Tables) -> DataFrame:
    """The best score of each member, started anew for each."""
    return member_scores(t).groupBy("a", "b", "x").agg(F.max("v").alias("best")).groupBy("a", "b").agg(F.round(F.sum("best"), 6).alias("score"))


@query("potential_match_flags", f"WITH {CLASS_PAIRS} SELECT o_orderkey AS x, EXISTS (SELECT 1 FROM cp JOIN orders y ON y.o_custkey = cp.b WHERE cp.a = o.o_custkey AND y.o_orderpriority = o.o_orderpriority) AS potential FROM orders o WHERE o_custkey % 2 = 0")
def potential_match_flags(t: Tables) -> DataFrame:
    """Whether some member of the matched owner is compatible."""
    theirs = class_pairs(t).join(orders_of(t, "b"), "b").select("a", "p").distinct().withColumn("hit", F.lit(True))
    return orders_of(t, "a").where("a % 2 = 0").join(theirs, ["a", "p"], "left").select(F.col("o").alias("x"), F.coalesce("hit", F.lit(False)).alias("potential"))


@query("matchable_cascade", "SELECT o_orderkey, o_totalprice > 1000 AND c_acctbal > 0 AS matchable FROM orders JOIN customer ON c_custkey = o_custkey")
def matchable_cascade(t: Tables) -> DataFrame:
    """A member can be matched only if its owner can."""
    return t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", ((F.col("o_totalprice") > 1000) & (F.col("c_acctbal") > 0)).alias("matchable"))


@query("method_group_match", f"WITH {CLASS_PAIRS}, g AS (SELECT o_custkey AS c, o_orderpriority AS h, list(o_orderkey ORDER BY o_orderkey) AS m FROM orders GROUP BY 1, 2) SELECT a, b, x.h, least(len(x.m), len(y.m)) AS members, x.m[1] AS first_a, y.m[1] AS first_b FROM cp JOIN g x ON x.c = a JOIN g y ON y.c = b AND y.h = x.h")
def method_group_match(t: Tables) -> DataFrame:
    """Groups of members are matched through the matched owners; members pair off in order."""
    g = t.orders.groupBy("o_custkey", F.col("o_orderpriority").alias("h")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))
    side = lambda s: g.select(F.col("o_custkey").alias(s), "h", F.col("n").alias(f"n_{s}"), F.col("first").alias(f"first_{s}"))
    return class_pairs(t).join(side("a"), "a").join(side("b"), ["b", "h"]).select("a", "b", "h", F.least("n_a", "n_b").alias("members"), "first_a", "first_b")


@query("hierarchy_semi_join", f"WITH {CLASS_PAIRS} SELECT x.o_orderkey AS x, count(*) AS candidates FROM cp JOIN orders x ON x.o_custkey = a JOIN orders y ON y.o_custkey = b AND y.o_orderpriority = x.o_orderpriority GROUP BY 1")
def hierarchy_semi_join(t: Tables) -> DataFrame:
    """Candidates of a member are those of the matched owner in the matched group."""
    theirs = orders_of(t, "b").groupBy("b", "p").agg(F.count("*").alias("candidates"))
    return class_pairs(t).join(orders_of(t, "a"), "a").join(theirs, ["b", "p"]).select(F.col("o").alias("x"), "candidates")


@query("array_propagation", f"WITH {CLASS_PAIRS}, d AS (SELECT DISTINCT o_custkey AS e, CAST(o_orderkey % 3 AS INTEGER) + 1 AS dims FROM orders) SELECT a, b, x.dims FROM cp JOIN d x ON x.e = a JOIN d y ON y.e = b AND y.dims = x.dims")
def array_propagation(t: Tables) -> DataFrame:
    """Array classes match when their elements do and their dimensions are equal."""
    d = t.orders.select(F.col("o_custkey").alias("e"), ((F.col("o_orderkey") % 3).cast("int") + 1).alias("dims")).distinct()
    return class_pairs(t).join(d.withColumnRenamed("e", "a"), "a").join(d.withColumnRenamed("e", "b"), ["b", "dims"]).select("a", "b", "dims")


@query("component_link", "WITH l AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS f, l_quantity AS q FROM lineitem), g AS (SELECT o_orderkey AS o, o_custkey % 7 + 1 AS n FROM orders) SELECT o, f FROM (SELECT g.o, l.f, row_number() OVER (PARTITION BY g.o ORDER BY l.q DESC, l.f) AS r FROM g JOIN l ON l.o = g.o AND l.n = g.n) WHERE r = 1")
def component_link(t: Tables) -> DataFrame:
    """The component behind an accessor: same owner and type, the one with the most evidence."""
    g = t.orders.select(F.col("o_orderkey").alias("o"), (F.col("o_custkey") % 7 + 1).alias("n"))
    l = t.lineitem.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").cast("bigint").alias("n"), F.col("l_partkey").alias("f"), F.col("l_quantity").alias("q"))
    return g.join(l, ["o", "n"]).groupBy("o").agg(F.min_by("f", F.struct(-F.col("q"), "f")).alias("f"))


@query("record_name_fix", "WITH f AS (SELECT l_orderkey AS o, min(l_partkey) AS f FROM lineitem GROUP BY 1) SELECT o_orderkey, coalesce(CASE WHEN f % 4 = 0 THEN 'part' || f END, 'order' || o_orderkey) AS name FROM orders JOIN f ON f.o = o_orderkey")
def record_name_fix(t: Tables) -> DataFrame:
    """An accessor takes its component's name where that has one."""
    f = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_partkey").alias("f"))
    named = F.when(F.col("f") % 4 == 0, F.concat(F.lit("part"), F.col("f").cast("string")))
    return t.orders.join(f, "o_orderkey").select("o_orderkey", F.coalesce(named, F.concat(F.lit("order"), F.col("o_orderkey").cast("string"))).alias("name"))


@query("var_name_uniqueness", "SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) = 1 AS is_unique FROM lineitem")
def var_name_uniqueness(t: Tables) -> DataFrame:
    n = F.count("*").over(W.partitionBy("l_orderkey", "l_linenumber"))
    return t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", (n == 1).alias("is_unique"))


@query("load_counters", "SELECT event_type AS kind, count(*) AS rows_in, count(CASE WHEN value > 50 THEN 1 END) AS names, count(DISTINCT user_id) AS owners FROM events GROUP BY 1")
def load_counters(t: Tables) -> DataFrame:
    return t.events.groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("rows_in"), F.count(F.when(F.col("value") > 50, 1)).alias("names"), F.countDistinct("user_id").alias("owners"))


@query("distinct_refs", "SELECT DISTINCT l_suppkey AS src, l_returnflag AS dst FROM lineitem")
def distinct_refs(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_suppkey").alias("src"), F.col("l_returnflag").alias("dst")).distinct()


@query("mapping_order", "SELECT url, row_number() OVER (ORDER BY length(url), url, page_id) AS n FROM pages")
def mapping_order(t: Tables) -> DataFrame:
    """Shorter names first, then by name."""
    from ..operators.numbering import number_in_order

    keyed = t.pages.select("url", "page_id", F.length("url").alias("len"))
    return number_in_order(keyed, ["len", "url", "page_id"], 0).select("url", F.col("number").alias("n"))


@query("uid_name_order", "SELECT s_name, row_number() OVER (ORDER BY s_name, s_suppkey) AS uid FROM supplier")
def uid_name_order(t: Tables) -> DataFrame:
    from ..operators.numbering import number_in_order

    return number_in_order(t.supplier.select("s_name", "s_suppkey"), ["s_name", "s_suppkey"], 0).select("s_name", F.col("number").alias("uid"))


@query("id_functions", "SELECT p_partkey, 'L' || replace(p_name, ' ', '/') || ';' AS id, string_split(p_name, ' ')[-1] AS simple, replace(p_name, ' ', '.') AS display FROM part")
def id_functions(t: Tables) -> DataFrame:
    n = F.replace("p_name", F.lit(" "), F.lit("/"))
    id_ = names.id_of(n)
    return t.part.select("p_partkey", id_.alias("id"), names.simple_name(names.name_of(id_)).alias("simple"), names.display_type(id_).alias("display"))


@query("flag_text", "SELECT p_partkey, concat_ws(' ', CASE WHEN p_size & 1 <> 0 THEN 'public' END, CASE WHEN p_size & 2 <> 0 THEN 'private' END, CASE WHEN p_size & 4 <> 0 THEN 'protected' END, CASE WHEN p_size & 8 <> 0 THEN 'static' END, CASE WHEN p_size & 16 <> 0 THEN 'final' END, CASE WHEN p_size & 32 <> 0 THEN 'super' END) AS flags FROM part")
def flag_text(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", names.flag_words(F.col("p_size")).alias("flags"))


@query("identifier_check", "SELECT p_partkey, regexp_full_match(replace(p_name, ' ', '_'), '[\\p{L}_$][\\p{L}\\p{Nd}_$]*') AS whole, regexp_full_match(p_brand, '[\\p{L}_$][\\p{L}\\p{Nd}_$]*') AS brand FROM part")
def identifier_check(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", names.is_identifier(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("whole"), names.is_identifier(F.col("p_brand")).alias("brand"))


@query("base64_hash", "SELECT doc_id, base64(unhex(sha256(text))) AS b64, substr(sha256(text), 1, 12) AS prefix FROM documents")
def base64_hash(t: Tables) -> DataFrame:
    h = F.sha2("text", 256)
    return t.documents.select("doc_id", F.base64(F.unhex(h)).alias("b64"), F.substring(h, 1, 12).alias("prefix"))


@query("iso_stamp", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM events")
def iso_stamp(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp"))


@query("sanitize", "SELECT doc_id, sha256(regexp_replace(text, '[\\r\\n]', '_', 'g')) AS clean FROM documents")
def sanitize(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2(F.regexp_replace("text", r"[\r\n]", "_"), 256).alias("clean"))


@query("array_helpers", "SELECT conv_id, CAST(list_position(r, 'assistant') AS BIGINT) AS first_answer, list_contains(r, 'system') AS has_system FROM (SELECT conv_id, list(role ORDER BY turn, role) AS r FROM conversations GROUP BY 1)")
def array_helpers(t: Tables) -> DataFrame:
    r = t.conversations.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("r"))
    at = F.array_position("r", F.lit("assistant"))
    return r.select("conv_id", F.when(at > 0, at).alias("first_answer"), F.array_contains("r", "system").alias("has_system"))
