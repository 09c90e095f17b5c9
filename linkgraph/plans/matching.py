"""Automatic matching of customers (classes), their orders (methods), what they buy from a supplier (fields), and the
lines of orders (the first three as arguments, the others as local variables): even keys with odd ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions.similarity import mismatch_bound
from ..operators.automatch import Kind, State, auto_match, match_pass
from ..operators.blocking import nearest_lists, two_alike
from ..operators.ranking import Registry, Scorer
from ..storage import keep
from .registry import Tables, query

THRESHOLDS = {"absolute": 0.5, "relative": 0.085}


def registry(*scorers: Scorer) -> Registry:
    out = Registry()
    for s in scorers:
        out.add(s)
    return out


def ratio_scorer(name: str, weight: float, column: str, *levels: str) -> Scorer:
    score = lambda: sim.count_ratio(F.col(f"{column}_a"), F.col(f"{column}_b"))
    return Scorer(name, weight, score, levels) if levels else Scorer(name, weight, score)


def equal_scorer(name: str, weight: float, column: str) -> Scorer:
    return Scorer(name, weight, lambda: F.when(F.col(f"{column}_a") == F.col(f"{column}_b"), 1.0).otherwise(0.0))


def sides(df: DataFrame, key: str, join: list[str]) -> tuple[DataFrame, DataFrame]:
    """Even rows with columns *_a, odd ones with *_b; join columns keep their names."""
    side = lambda rest, s: df.where(F.col(key) % 2 == rest).select(F.col(key).alias(s), *join, *[F.col(c).alias(f"{c}_{s}") for c in df.columns if c not in (key, *join)])
    return side(0, "a"), side(1, "b")


def kinds(t: Tables) -> tuple[Kind, list[Kind], list[Kind]]:
    orders = t.orders.select(F.col("o_orderkey").alias("o"), F.col("o_custkey").alias("c"), F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("st"), F.round("o_totalprice").cast("bigint").alias("price"))
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o")).agg(F.count("*").alias("n"))
    methods_ = keep(orders.join(lines, "o", "left").na.fill(0, ["n"]))
    per_class = methods_.groupBy("c").agg(F.count("*").alias("n"), F.count(F.when(F.col("p") == "1-URGENT", 1)).alias("urgent"))
    classes_ = keep(t.customer.select(F.col("c_custkey").alias("c"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("s"), F.round(F.abs("c_acctbal")).cast("bigint").alias("bal")).join(per_class, "c", "left").na.fill(0, ["n", "urgent"]))
    fields_ = keep(t.lineitem.join(orders.select(F.col("o").alias("l_orderkey"), "c"), "l_orderkey").groupBy("c", F.col("l_suppkey").alias("supplier")).agg(F.sum("l_quantity").cast("bigint").alias("q"), F.count("*").alias("n")))
    vars_ = keep(t.lineitem.groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").cast("bigint").alias("line")).agg(F.sum("l_quantity").cast("bigint").alias("q"), F.min("l_partkey").alias("part")))

    def class_pairs(state: State, level: str) -> DataFrame:
        """Pairs that can be among the best two of a class: of each group of classes that agree in all but the balance, and
        that the bound leaves, the nearest by balance; and all pairs whose members are matched with each other.

        Of classes that are alike in all that counts, two are taken: a pair of either cannot win, and contests as all would."""
        all_a, all_b = sides(classes_, "c", ["nation", "n"])
        all_a, all_b = all_a.join(state["classes"].select("a"), "a", "left_anti"), all_b.join(state["classes"].select("b"), "b", "left_anti")
        hits = None
        if level != "initial":
            # how many of its members are matched with members of the other one; classes of these are like no other
            owner = methods_.select("o", "c")
            ends = state["methods"].join(owner.select(F.col("o").alias("a"), F.col("c").alias("ca")), "a").join(owner.select(F.col("o").alias("b"), F.col("c").alias("cb")), "b")
            hits = keep(ends.groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.count("*").alias("hits")))
        two = lambda df, s: two_alike(df, s, ["nation", "n", f"s_{s}", f"urgent_{s}", f"bal_{s}"], hits)
        a, b = keep(two(all_a, "a")), keep(two(all_b, "b"))
        bound = mismatch_bound(classes.scorers.maximum(level), **THRESHOLDS) + 1e-6
        lost = 5 * (F.col("s_a") != F.col("s_b")).cast("int") + 4 * (1 - sim.count_ratio(F.col("urgent_a"), F.col("urgent_b")))
        group = ["nation", "n", "s_b", "urgent_b"]
        asked = a.join(b.select(group).distinct(), ["nation", "n"]).where(lost <= bound).withColumn("value", F.col("bal_a"))
        lists = nearest_lists(asked.select(*group, "value"), b.select(*group, "b", F.col("bal_b").alias("value")), group, 2)
        near = asked.join(lists, [*group, "value"]).drop("value").withColumn("near", F.explode("near")).select("*", "near.b", F.col("near.value").alias("bal_b")).drop("near")
        if hits is None:
            return near
        of_b = all_b.withColumnsRenamed({"nation": "nation_b", "n": "n_b"})
        met = hits.join(all_a, "a").join(of_b, "b").where("nation = nation_b and n = n_b")
        others = near.join(hits.select("a", "b"), ["a", "b"], "left_anti").withColumn("hits", F.lit(0).cast("bigint"))
        return others.unionByName(met.select(others.columns))

    def method_pairs(state: State, level: str) -> DataFrame:
        side = lambda s: methods_.select(F.col("c").alias(f"c{s}"), "p", F.col("o").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("st", "price", "n")])
        owners = state["classes"].select(F.col("a").alias("ca"), F.col("b").alias("cb"))
        return owners.join(side("a"), "ca").join(side("b"), ["cb", "p"])

    def field_pairs(state: State, level: str) -> DataFrame:
        key = lambda c: (F.col(c) * (1 << 32) + F.col("supplier"))
        side = lambda s: fields_.select(F.col("c").alias(f"c{s}"), "supplier", F.col("q").alias(f"q_{s}"), F.col("n").alias(f"n_{s}"))
        owners = state["classes"].select(F.col("a").alias("ca"), F.col("b").alias("cb"))
        return owners.join(side("a"), "ca").join(side("b"), ["cb", "supplier"]).withColumns({"a": key("ca"), "b": key("cb")})

    def variable_pairs(first: int, last: int):
        def pairs(state: State, level: str) -> DataFrame:
            some = vars_.where(F.col("line").between(first, last))
            side = lambda s: some.select(F.col("o").alias(f"o{s}"), F.col("line").alias(f"line_{s}"), F.col("part").alias(f"part_{s}"), F.col("q").alias(f"q_{s}"))
            owners = state["methods"].select(F.col("a").alias("oa"), F.col("b").alias("ob"))
            both = owners.join(side("a"), "oa").join(side("b"), "ob")
            return both.withColumns({s: F.col(f"o{s}") * 100 + F.col(f"line_{s}") for s in "ab"})

        return pairs

    members = Scorer("members", 6, lambda: sim.ratio(F.col("hits").cast("double"), F.col("n").cast("double")), ("intermediate", "full", "extra"))
    classes = Kind("classes", class_pairs, registry(equal_scorer("segment", 5, "s"), ratio_scorer("balance", 8, "bal"), ratio_scorer("urgent", 4, "urgent"), members), True)
    methods = Kind("methods", method_pairs, registry(equal_scorer("status", 3, "st"), ratio_scorer("price", 8, "price"), ratio_scorer("code", 5, "n", "full", "extra")), True)
    fields = Kind("fields", field_pairs, registry(ratio_scorer("quantity", 6, "q"), ratio_scorer("count", 4, "n")), True)
    variable = lambda: registry(equal_scorer("part", 2, "part"), equal_scorer("index", 6, "line"), ratio_scorer("usage", 6, "q"))
    return classes, [methods, fields], [Kind("args", variable_pairs(1, 3), variable(), True), Kind("locals", variable_pairs(4, 99), variable(), True)]


def nothing(t: Tables) -> State:
    return {name: t.spark.createDataFrame([], "a bigint, b bigint") for name in ("classes", "methods", "fields", "args", "locals")}


def all_of(state: State) -> DataFrame:
    out = None
    for name, matches in state.items():
        one = matches.select(F.lit(name).alias("kind"), "a", "b")
        out = one if out is None else out.unionByName(one)
    return out


def pass_sql(name: str, scored: str, maximum: float) -> str:
    """CTEs of one pass: name holds what is accepted and not contested among the rows (a, b, raw) of scored."""
    score, order = f"power(round(raw, 9) / {maximum}, 2)", "OVER (PARTITION BY a ORDER BY round(raw, 9) DESC, b)"
    return f"""{name}_w AS (SELECT a, b, {score} AS score, row_number() {order} AS rn, lead({score}) {order} AS second FROM ({scored})), {name}_k AS (SELECT a, b FROM {name}_w WHERE rn = 1 AND score >= {THRESHOLDS['absolute']} AND (second IS NULL OR second < score * (1 - {THRESHOLDS['relative']}))), {name} AS (SELECT a, b FROM {name}_k WHERE b IN (SELECT b FROM {name}_k GROUP BY b HAVING count(*) = 1))"""


def count_ratio_sql(x: str, y: str) -> str:
    return f"CASE WHEN {x} = {y} THEN 1.0 ELSE 1 - abs({x} - {y}) / greatest({x}, {y}) END"


def open_sql(*done: str) -> str:
    return " AND ".join(f"a.k NOT IN (SELECT a FROM {d}) AND b.k NOT IN (SELECT b FROM {d})" for d in done) or "TRUE"


CLASS_SQL = f"SELECT a.k AS a, b.k AS b, CASE WHEN a.s = b.s THEN 5.0 ELSE 0.0 END + 8 * ({count_ratio_sql('a.bal', 'b.bal')}) + 4 * ({count_ratio_sql('a.urgent', 'b.urgent')}) AS raw FROM cls a JOIN cls b ON a.nation = b.nation AND a.n = b.n AND a.k % 2 = 0 AND b.k % 2 = 1 WHERE "
AUTO_SQL = f"""WITH mth AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderpriority AS p, o_orderstatus AS st, CAST(round(o_totalprice) AS BIGINT) AS price FROM orders),
cls AS (SELECT c_custkey AS k, c_nationkey AS nation, c_mktsegment AS s, CAST(round(abs(c_acctbal)) AS BIGINT) AS bal, coalesce(n, 0) AS n, coalesce(urgent, 0) AS urgent FROM customer LEFT JOIN (SELECT c, count(*) AS n, count(CASE WHEN p = '1-URGENT' THEN 1 END) AS urgent FROM mth GROUP BY 1) ON c = c_custkey),
fld AS (SELECT c, l_suppkey AS s, CAST(sum(l_quantity) AS BIGINT) AS q, count(*) AS n FROM lineitem JOIN mth ON mth.k = l_orderkey GROUP BY 1, 2),
{pass_sql('c1', CLASS_SQL + open_sql(), 17)}, {pass_sql('c2', CLASS_SQL + open_sql('c1'), 17)}, cc AS (SELECT * FROM c1 UNION ALL SELECT * FROM c2),
{pass_sql('m1', f"SELECT a.k AS a, b.k AS b, CASE WHEN a.st = b.st THEN 3.0 ELSE 0.0 END + 8 * ({count_ratio_sql('a.price', 'b.price')}) AS raw FROM cc JOIN mth a ON a.c = cc.a JOIN mth b ON b.c = cc.b AND b.p = a.p", 11)},
{pass_sql('f1', f"SELECT a.c * 4294967296 + a.s AS a, b.c * 4294967296 + b.s AS b, 6 * ({count_ratio_sql('a.q', 'b.q')}) + 4 * ({count_ratio_sql('a.n', 'b.n')}) AS raw FROM cc JOIN fld a ON a.c = cc.a JOIN fld b ON b.c = cc.b AND b.s = a.s", 10)},
h AS (SELECT x.c AS ca, y.c AS cb, count(*) AS hits FROM m1 JOIN mth x ON x.k = m1.a JOIN mth y ON y.k = m1.b GROUP BY 1, 2),
{pass_sql('c3', CLASS_SQL.replace(' AS raw FROM cls a', ' + 6 * CASE WHEN a.n = 0 THEN 1.0 ELSE coalesce(h.hits, 0) / a.n END AS raw FROM cls a').replace(' WHERE ', ' LEFT JOIN h ON h.ca = a.k AND h.cb = b.k WHERE ') + open_sql('cc'), 23)}
SELECT 'classes' AS kind, a, b FROM cc UNION ALL SELECT 'classes', a, b FROM c3 UNION ALL SELECT 'methods', a, b FROM m1 UNION ALL SELECT 'fields', a, b FROM f1"""


@query("auto_match_rounds", AUTO_SQL)
def auto_match_rounds(t: Tables) -> DataFrame:
    """The first rounds: classes twice at the first level, then members and classes at the second."""
    (classes, members, _), state = kinds(t), nothing(t)
    for kind, level in ((classes, "initial"), (classes, "initial"), *[(m, "intermediate") for m in members], (classes, "intermediate")):
        match_pass(kind, level, state, **THRESHOLDS)
    return all_of({name: state[name] for name in ("classes", "methods", "fields")})


@query("auto_match_all")
def auto_match_all(t: Tables) -> DataFrame:
    """All levels and kinds until nothing more is matched. No SQL: the number of rounds depends on the data."""
    classes, members, variables = kinds(t)
    return all_of(auto_match(classes, members, variables, nothing(t), **THRESHOLDS))
