"""Queries on instructions: the lines of an order are the body of a method, matched orders are matched methods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import instructions as ins
from ..functions import similarity as sim
from ..operators.callsites import call_site_scores
from ..operators.kept import KeptPairs
from ..storage import keep
from .linking import ORDER_PAIRS, order_pairs
from .registry import Tables, query

#: The kinds of instructions, by part number.
KINDS = ("int", "var", "type", "field", "method", "dynamic", "jump", "ldc", "inc", "table", "lookup", "multi", "op")


def line_instructions(t: Tables) -> DataFrame:
    """(o, n, i): one instruction for each order and line number."""
    first = t.lineitem.groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").cast("bigint").alias("n")).agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"), F.min("l_returnflag").alias("f"), F.min(F.col("l_quantity").cast("bigint")).alias("q"))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("p") % len(KINDS) + 1).cast("int"))
    none = lambda c: F.when(F.col("s") % 4 > 0, c)
    i = F.struct((F.col("p") % len(KINDS) * 10 + F.col("s") % 2).cast("int").alias("op"), kind.alias("kind"), (F.col("q") % 3).alias("num"), none(F.concat(F.lit("r"), (F.col("s") % 3).cast("string"))).alias("ref"), F.when(F.col("f") != "A", F.col("f")).alias("type"), F.array(F.col("q") % 2).alias("keys"))
    return first.select("o", "n", i.alias("i"))


LINE_SQL = f"l AS (SELECT l_orderkey AS o, l_linenumber AS n, min(l_partkey) AS p, min(l_suppkey) AS s, min(l_returnflag) AS f, min(CAST(trunc(l_quantity) AS BIGINT)) AS q FROM lineitem GROUP BY 1, 2), i AS (SELECT o, n, p % 13 * 10 + s % 2 AS op, p % 13 AS kind, q % 3 AS num, CASE WHEN s % 4 > 0 THEN 'r' || s % 3 END AS ref, CASE WHEN f <> 'A' THEN f END AS type, q % 2 AS keys FROM l)"
VARIABLE_SQL = "CASE WHEN x.ref IS NULL OR y.ref IS NULL THEN 0 WHEN x.ref <> y.ref THEN 2 WHEN x.type IS DISTINCT FROM y.type THEN 1 ELSE 0 END"
COST_SQL = f"""CASE WHEN x.op <> y.op THEN 2 WHEN x.kind IN (0, 6) THEN CASE WHEN x.num = y.num THEN 0 ELSE 2 END WHEN x.kind = 1 THEN {VARIABLE_SQL} WHEN x.kind IN (2, 3, 4) THEN CASE WHEN x.ref IS NOT DISTINCT FROM y.ref THEN 0 ELSE 2 END
WHEN x.kind = 5 THEN CASE WHEN x.ref IS DISTINCT FROM y.ref THEN 2 WHEN (x.type IS NOT NULL OR y.type IS NOT NULL) AND (x.type IS DISTINCT FROM y.type OR x.num <> y.num) THEN 2 ELSE 0 END WHEN x.kind = 7 THEN CASE WHEN x.type IS NOT DISTINCT FROM y.type AND x.ref IS NOT DISTINCT FROM y.ref THEN 0 ELSE 2 END
WHEN x.kind = 8 THEN CASE WHEN x.num <> y.num THEN 2 ELSE {VARIABLE_SQL} END WHEN x.kind IN (9, 10) THEN CASE WHEN x.keys = y.keys THEN 0 ELSE 2 END WHEN x.kind = 11 THEN CASE WHEN x.num = y.num AND x.ref IS NOT DISTINCT FROM y.ref THEN 0 ELSE 2 END ELSE 0 END"""


@query("instruction_costs", f"WITH {ORDER_PAIRS}, {LINE_SQL} SELECT m.a, m.b, x.n AS x, y.n AS y, CAST({COST_SQL} AS INTEGER) AS cost FROM m JOIN i x ON x.o = m.a JOIN i y ON y.o = m.b")
def instruction_costs(t: Tables) -> DataFrame:
    """The comparator of instructions on all pairs of lines of matched orders (at most some tens for a pair of orders)."""
    i = line_instructions(t)
    side = lambda s, c: i.select(F.col("o").alias(s), F.col("n").alias(c), F.col("i").alias(f"i_{c}"))
    both = order_pairs(t).join(side("a", "x"), "a").join(side("b", "y"), "b")
    return both.select("a", "b", "x", "y", ins.cost(F.col("i_x"), F.col("i_y")).alias("cost"))


def bodies(t: Tables) -> DataFrame:
    """(a, b, body_a, body_b) of matched orders."""
    body = line_instructions(t).groupBy("o").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "i"))), lambda x: x["i"]).alias("body"))
    side = lambda s: body.select(F.col("o").alias(s), F.col("body").alias(f"body_{s}"))
    return order_pairs(t).join(side("a"), "a", "left").join(side("b"), "b", "left")


@query("body_similarity")
def body_similarity(t: Tables) -> DataFrame:
    """Edit similarity of bodies under the comparator. Orders without lines have no body: two are equal, one is different."""
    b = bodies(t).withColumn("score", ins.code_similarity("body_a", "body_b"))
    return b.select("a", "b", F.round(sim.null_rule(F.col("body_a"), F.col("body_b"), F.col("score")), 6).alias("score"))


#: References that are known to be the same on both sides, round by round.
KNOWN_REFERENCES = (("r0",), ("r0", "r1"), ("r0", "r1"))


@query("body_similarity_rounds")
def body_similarity_rounds(t: Tables) -> DataFrame:
    """Similarity of bodies over three rounds, in which references of the second side, which has names of its own, become
    known: what a round does not change is not aligned again. No SQL: alignment is beyond it; a test holds each round
    against similarities computed anew."""
    return kept_rounds(bodies(t), KeptPairs(t.spark))


def kept_rounds(pairs: DataFrame, kept: KeptPairs) -> DataFrame:
    pairs, out = keep(pairs), None
    for number, known in enumerate(KNOWN_REFERENCES, 1):
        one = kept.values(known_as(pairs, known), "body_a", "body_b", ins.code_similarity("body_a", "body_b"))
        score = F.round(sim.null_rule(F.col("body_a"), F.col("body_b"), F.col("value")), 6)
        one = one.select(F.lit(number).alias("round"), "a", "b", score.alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


def known_as(pairs: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """pairs whose second bodies have references under names of their own, but for known ones."""
    name = lambda x: F.when(x["ref"].isin(*known), x["ref"]).otherwise(F.concat(F.lit("other "), x["ref"]))
    return pairs.withColumn("body_b", F.transform("body_b", lambda x: x.withField("ref", name(x))))


@query("method_similarity")
def method_similarity(t: Tables) -> DataFrame:
    """Similarity of matched orders: the priority is the return type, lines up to the third are arguments (matched with
    those of their number; another flag counts half), all lines are the body."""
    arguments = t.lineitem.where("l_linenumber <= 3").groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n")).agg(F.min("l_returnflag").alias("f"))
    pairs = keep(order_pairs(t))
    args = lambda s: pairs.join(arguments.select(F.col("o").alias(s), "n", F.col("f").alias(f"f_{s}")), s)
    matched = args("a").join(args("b"), ["a", "b", "n"], "full")
    same = F.when(F.col("f_a") == F.col("f_b"), 1.0).when(F.col("f_a").isNotNull() & F.col("f_b").isNotNull(), 0.5).otherwise(0.0)
    counted = matched.groupBy("a", "b").agg(F.sum(same).alias("arguments"), F.count("f_a").alias("n_a"), F.count(F.when(F.col("f_a").isNull(), 1)).alias("open_b"))
    partner = ins.code_alignment("body_a", "body_b")
    aligned = bodies(t).select("a", "b", F.size(F.filter(partner, lambda x: x >= 0)).alias("aligned"), F.greatest(F.size("body_a"), F.size("body_b")).alias("longer"), F.col("body_a").isNotNull().alias("code_a"), F.col("body_b").isNotNull().alias("code_b"))
    kind = lambda s: t.orders.select(F.col("o_orderkey").alias(s), F.col("o_orderpriority").alias(f"p_{s}"))
    all_ = pairs.join(counted, ["a", "b"], "left").join(aligned, ["a", "b"]).join(kind("a"), "a").join(kind("b"), "b").na.fill(0, ["arguments", "n_a", "open_b"])
    c = F.col
    return all_.select("a", "b", F.round(ins.method_similarity(c("p_a") == c("p_b"), c("arguments"), c("n_a"), c("open_b"), c("aligned"), c("longer"), c("code_a"), c("code_b")), 6).alias("similarity"))


SITE_SQL = f"WITH {ORDER_PAIRS}, u AS (SELECT DISTINCT l_orderkey AS src, l_linenumber AS at, l_suppkey AS target FROM lineitem), pr AS (SELECT s_suppkey AS a, s_suppkey + 1 AS b FROM supplier), cal AS (SELECT DISTINCT pr.a, pr.b, u.src FROM pr JOIN u ON u.target = pr.a WHERE u.src % 2 = 0), pl AS (SELECT cal.*, m.b AS dst, EXISTS (SELECT 1 FROM u WHERE u.src = m.b AND u.target = cal.b) AS there FROM cal LEFT JOIN m ON m.a = cal.src), h AS (SELECT a, b, 0 AS hit FROM pl WHERE NOT there UNION ALL SELECT pl.a, pl.b, CASE WHEN EXISTS (SELECT 1 FROM u y WHERE y.src = pl.dst AND y.at = x.at AND y.target = pl.b) THEN 1 ELSE 0 END FROM pl JOIN u x ON x.src = pl.src AND x.target = pl.a WHERE there AND EXISTS (SELECT 1 FROM u z WHERE z.src = pl.dst AND z.at = x.at)) SELECT pr.a, pr.b, round(CASE WHEN count(hit) = 0 THEN 1.0 ELSE sum(hit) / count(hit) END, 6) AS score FROM pr LEFT JOIN h USING (a, b) GROUP BY 1, 2"


#: Suppliers and orders are numbered apart.
APART = -1_000_000_000_000


def sites(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_orderkey").alias("src"), F.col("l_linenumber").alias("at"), (F.col("l_suppkey") + APART).alias("target")).distinct()


def supplier_pairs(t: Tables) -> DataFrame:
    return t.supplier.select((F.col("s_suppkey") + APART).alias("a"), (F.col("s_suppkey") + APART + 1).alias("b"))


@query("call_site_scores", SITE_SQL)
def call_sites(t: Tables) -> DataFrame:
    """Neighbouring suppliers judged by the orders that use them; lines of matched orders with one number are aligned."""
    s = keep(sites(t))
    matches = keep(order_pairs(t).select(F.col("a").alias("src"), F.col("b").alias("dst")))
    at = lambda k: s.select(F.col("src").alias(k), "at").distinct()
    aligned = matches.join(at("src"), "src").join(at("dst"), ["dst", "at"]).select("src", "dst", "at", F.col("at").alias("partner"))
    scored = call_site_scores(supplier_pairs(t), s.where("src % 2 = 0"), s.where("src % 2 = 1"), matches, aligned)
    return scored.select((F.col("a") - APART).alias("a"), (F.col("b") - APART).alias("b"), F.round("score", 6).alias("score"))


@query("aligned_call_sites")
def aligned_call_sites(t: Tables) -> DataFrame:
    """The same with the alignment of bodies. No SQL: the alignment is the way back through an edit table."""
    s = keep(sites(t))
    numbered = keep(line_instructions(t).groupBy("o").agg(F.array_sort(F.collect_list(F.struct("n", "i"))).alias("x")).select("o", F.transform("x", lambda y: y["n"]).alias("at"), F.transform("x", lambda y: y["i"]).alias("body")))
    side = lambda k: numbered.select(F.col("o").alias(k), F.col("at").alias(f"at_{k}"), F.col("body").alias(f"body_{k}"))
    matches = keep(order_pairs(t).select(F.col("a").alias("src"), F.col("b").alias("dst")))
    both = matches.join(side("src"), "src").join(side("dst"), "dst").withColumn("partner", ins.code_alignment("body_src", "body_dst"))
    places = F.transform("partner", lambda p, i: F.struct(F.get("at_src", i).cast("int").alias("at"), F.when(p >= 0, F.get("at_dst", p)).cast("int").alias("partner")))
    aligned = both.select("src", "dst", F.explode(places).alias("p")).select("src", "dst", "p.at", "p.partner").where("partner is not null")
    scored = call_site_scores(supplier_pairs(t), s.where("src % 2 = 0"), s.where("src % 2 = 1"), matches, aligned)
    return scored.select((F.col("a") - APART).alias("a"), (F.col("b") - APART).alias("b"), F.round("score", 6).alias("score"))
