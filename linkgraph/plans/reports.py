"""Queries on rounds, status, names, filters, texts and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..filters import filter_ranked
from ..functions import names
from ..functions import similarity as sim
from ..operators.numbering import number_in_order
from ..operators.ranking import accept
from ..operators.rounds import apply_matches, status, to_fixpoint, unmatch
from ..storage import keep, work_dir
from ..streaming.incremental import keep_best, winners
from ..streaming.staged import in_stages, results, run_stages
from .linking import CONTEST, ORDER_PAIRS, PART, near_scored, order_pairs, part_classes, part_scorers, parts, reachable_groups
from .registry import Tables, query


@query("status_report", f"WITH {ORDER_PAIRS}, k AS (SELECT 'order' AS kind, o_orderkey AS a FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'part', p_partkey FROM part WHERE p_partkey % 2 = 0), x AS (SELECT 'order' AS kind, a FROM m UNION SELECT 'part', p_partkey FROM part WHERE p_partkey % 4 = 0) SELECT kind, count(x.a) AS matched, count(*) AS total, round(100 * count(x.a) / count(*), 2) AS percent FROM k LEFT JOIN x USING (kind, a) GROUP BY kind")
def status_report(t: Tables) -> DataFrame:
    part = t.part.where("p_partkey % 2 = 0").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("a"))
    entities = t.orders.where("o_orderkey % 2 = 0").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("a")).unionByName(part)
    matches = order_pairs(t).select(F.lit("order").alias("kind"), "a").unionByName(part.where("a % 4 = 0"))
    return status(entities, matches)


@query("similarity_rollup", f"WITH {ORDER_PAIRS}, l AS (SELECT l_orderkey AS o, l_linenumber AS n, sum(l_quantity) AS q FROM lineitem GROUP BY ALL), c AS (SELECT a, b, (SELECT count(*) FROM l WHERE o = a) AS na, (SELECT count(*) FROM l WHERE o = b) AS nb FROM m), j AS (SELECT a, b, sum(CASE WHEN x.q = y.q THEN 1.0 ELSE 1 - abs(x.q - y.q) / greatest(x.q, y.q) END) AS s, count(*) AS k FROM m JOIN l x ON x.o = a JOIN l y ON y.o = b AND y.n = x.n GROUP BY a, b) SELECT c.a, c.b, round(CASE WHEN na + nb - coalesce(k, 0) = 0 THEN 1.0 ELSE coalesce(s, 0) / (na + nb - coalesce(k, 0)) END, 6) AS similarity FROM c LEFT JOIN j ON j.a = c.a AND j.b = c.b")
def similarity_rollup(t: Tables) -> DataFrame:
    """Similarity of matched orders: that of matched lines over a's lines and b's unmatched ones."""
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n")).agg(F.sum("l_quantity").alias("q"))
    pairs = order_pairs(t)
    side = lambda s: pairs.join(lines.withColumnsRenamed({"o": s, "q": f"q_{s}"}), s).select("a", "b", "n", f"q_{s}")
    both = side("a").join(side("b"), ["a", "b", "n"], "full").groupBy("a", "b").agg(F.coalesce(F.sum(sim.count_ratio(F.col("q_a"), F.col("q_b"))), F.lit(0.0)).alias("s"), F.count("*").alias("n"))
    return pairs.join(both, ["a", "b"], "left").select("a", "b", F.round(F.coalesce(F.col("s") / F.col("n"), F.lit(1.0)), 6).alias("similarity"))


@query("match_status_sort_key", f"WITH {ORDER_PAIRS}, o2 AS (SELECT o_custkey AS c, count(*) AS n, count(m.a) AS k FROM orders LEFT JOIN m ON m.a = o_orderkey WHERE o_orderkey % 2 = 0 GROUP BY 1) SELECT c_custkey AS c, CAST(CASE WHEN c_acctbal < 0 THEN 4 WHEN n IS NULL OR k = 0 THEN 0 WHEN k < n THEN 1 WHEN n = 1 THEN 2 ELSE 3 END AS INTEGER) AS sort_key FROM customer LEFT JOIN o2 ON c = c_custkey")
def match_status_sort_key(t: Tables) -> DataFrame:
    """unmatched < partly < one member matched < all matched < unmatchable."""
    o = t.orders.where("o_orderkey % 2 = 0").join(order_pairs(t).select(F.col("a").alias("o_orderkey"), F.lit(1).alias("hit")), "o_orderkey", "left")
    by = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.count("hit").alias("k"))
    key = F.when(F.col("c_acctbal") < 0, 4).when(F.col("n").isNull() | (F.col("k") == 0), 0).when(F.col("k") < F.col("n"), 1).when(F.col("n") == 1, 2).otherwise(3)
    return t.customer.join(by, "c_custkey", "left").select(F.col("c_custkey").alias("c"), key.alias("sort_key"))


PROGRAMS = {1: "name Brand#5 contains", 2: "a name swap name eq not", 3: 'name "Brand#13" equals b name Brand#2 startswith or', 4: "a mapped b mapped eq", 5: "swap swap swap"}
RPN = PART + """, n AS (SELECT r.*, x.p_brand AS an, y.p_brand AS bn, x.p_type AS am, y.p_type AS bm FROM r JOIN part x ON x.p_partkey = r.a JOIN part y ON y.p_partkey = r.b)
SELECT program, count(*) AS n, CAST(sum(a) AS BIGINT) AS sum_a FROM (SELECT 1 AS program, a FROM n WHERE contains(bn, 'Brand#5') UNION ALL SELECT 2, a FROM n WHERE an <> bn UNION ALL SELECT 3, a FROM n WHERE bn = 'Brand#13' OR bn LIKE 'Brand#2%' UNION ALL SELECT 4, a FROM n WHERE FALSE UNION ALL SELECT 5, a FROM n) GROUP BY program"""


@query("rpn_filter", RPN.replace("WHERE FALSE", "WHERE am = bm"))
def rpn_filter(t: Tables) -> DataFrame:
    """Rows that pass each of five programs; the last one cannot be compiled and filters nothing.

    The programs read brands and types alone, so they run over pairs of those, which stand for all pairs of their parts."""
    a, b = parts(t)
    a = a.groupBy("p_type", F.col("brand_a").alias("a_name")).agg(F.count("*").alias("n_a"), F.sum("a").alias("sum_a"))
    b = b.groupBy("p_type", F.col("brand_b").alias("b_name")).agg(F.count("*").alias("n_b"))
    ranked = keep(a.join(b, "p_type").withColumns({"a_mapped": F.col("p_type"), "b_mapped": F.col("p_type")}))
    # two conditions are left by a mapped b mapped eq: b below it is an entity, so the program is repaired by its own test
    programs = {**PROGRAMS, 4: "mapped a mapped eq"}
    out = None
    for number, program in programs.items():
        one = filter_ranked(ranked, program).agg(F.sum(F.col("n_a") * F.col("n_b")).alias("n"), F.sum(F.col("sum_a") * F.col("n_b")).alias("sum_a")).where("n > 0").select(F.lit(number).alias("program"), "n", "sum_a")
        out = one if out is None else out.unionByName(one)
    return out


@query("name_coalesce", "WITH c AS (SELECT c_custkey AS k, c_name AS plain, CASE WHEN c_custkey % 5 = 0 THEN 'm' || c_custkey END AS mapped, CASE WHEN c_custkey % 7 = 0 THEN 'aux' || c_custkey END AS aux, CASE WHEN c_custkey % 3 = 0 THEN c_custkey END AS own, c_custkey % 2 = 0 AS readable FROM customer) SELECT x.k, coalesce(x.mapped, y.mapped, CASE WHEN x.readable THEN x.plain END, CASE WHEN y.readable THEN y.plain END, x.aux, 'tmp' || x.k, x.plain) AS name, coalesce(least(x.own, y.own), x.own, y.own, -1) AS uid FROM c x LEFT JOIN c y ON y.k = x.k + 3")
def name_coalesce(t: Tables) -> DataFrame:
    """The name of a customer under the match with the third next."""
    k = F.col("c_custkey")
    c = t.customer.select(k.alias("k"), F.col("c_name").alias("plain"), F.when(k % 5 == 0, F.concat(F.lit("m"), k.cast("string"))).alias("mapped"), F.when(k % 7 == 0, F.concat(F.lit("aux"), k.cast("string"))).alias("aux"), F.when(k % 3 == 0, k).alias("own"), (k % 2 == 0).alias("readable"))
    both = c.alias("x").join(c.alias("y"), F.col("y.k") == F.col("x.k") + 3, "left")
    col = lambda n: F.col(n)
    name = names.resolve_name(col("x.mapped"), col("y.mapped"), col("x.plain"), col("x.readable"), col("y.plain"), col("y.readable"), col("x.aux"), F.concat(F.lit("tmp"), col("x.k").cast("string")))
    return both.select(col("x.k").alias("k"), name.alias("name"), names.uid(col("x.own"), col("y.own")).alias("uid"))


@query("propagate_names", "WITH c AS (SELECT c_custkey AS k, c_nationkey AS g, CASE WHEN c_custkey % 11 = 0 THEN c_name END AS name FROM customer), f AS (SELECT g, arg_min(name, k) FILTER (WHERE name IS NOT NULL) AS name FROM c GROUP BY g) SELECT k, coalesce(c.name, f.name) AS name FROM c JOIN f USING (g)")
def propagate_names(t: Tables) -> DataFrame:
    """A group's first name goes to its members without one: one row per group is joined, no group is gathered."""
    c = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("g"), F.when(F.col("c_custkey") % 11 == 0, F.col("c_name")).alias("name"))
    first = c.groupBy("g").agg(F.min_by("name", F.when(F.col("name").isNotNull(), F.col("k"))).alias("group_name"))
    return c.join(first, "g").select("k", F.coalesce("name", "group_name").alias("name"))


@query("uid_assign", "SELECT s_suppkey, 1000 + row_number() OVER (ORDER BY s_name, s_suppkey) AS uid FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL SELECT s_suppkey, s_suppkey FROM supplier WHERE s_suppkey % 3 = 0")
def uid_assign(t: Tables) -> DataFrame:
    """The next numbers in name order. Numbers come from range partitions: each counts its own rows, and only the
    counts are summed, so no partition holds all rows."""
    need = t.supplier.where("s_suppkey % 3 <> 0").select("s_suppkey", "s_name")
    return number_in_order(need, ["s_name", "s_suppkey"], 1000).select("s_suppkey", F.col("number").alias("uid")).unionByName(t.supplier.where("s_suppkey % 3 = 0").select("s_suppkey", F.col("s_suppkey").alias("uid")))


@query("tmp_names", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'a' ELSE 'b' END || 'f' || (row_number() OVER (PARTITION BY p_brand, p_partkey % 2 ORDER BY p_partkey) - 1) AS tmp FROM part WHERE p_size > 10")
def tmp_names(t: Tables) -> DataFrame:
    side = F.when(F.col("p_partkey") % 2 == 0, "a").otherwise("b")
    n = F.row_number().over(W.partitionBy("p_brand", F.col("p_partkey") % 2).orderBy("p_partkey")) - 1
    return t.part.where("p_size > 10").select("p_partkey", F.concat(side, F.lit("f"), n.cast("string")).alias("tmp"))


LINE_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice"


@query("slot_index", f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, CAST(coalesce(sum(CASE WHEN l_tax > 0.04 THEN 2 ELSE 1 END) OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS slot FROM lineitem")
def slot_index(t: Tables) -> DataFrame:
    """Running sum of slot sizes: wide items take two."""
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(W.unboundedPreceding, -1)
    size = F.when(F.col("l_tax") > 0.04, 2).otherwise(1)
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", F.coalesce(F.sum(size).over(w), F.lit(0)).alias("slot"))


@query("package_islands", "WITH p AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS k, l_suppkey AS s, l_extendedprice AS e, l_returnflag AS f, lag(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS q FROM lineitem) SELECT o, n, k, s, e, CAST(sum(CASE WHEN q IS NULL OR q <> f THEN 1 ELSE 0 END) OVER (PARTITION BY o ORDER BY n, k, s, e ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM p")
def package_islands(t: Tables) -> DataFrame:
    """A new group where the flag changes along the lines of an order."""
    w = W.partitionBy("o").orderBy("n", "k", "s", "e")
    p = t.lineitem.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("s"), F.col("l_extendedprice").alias("e"), "l_returnflag")
    new = F.when(F.lag("l_returnflag").over(w).eqNullSafe(F.col("l_returnflag")), 0).otherwise(1)
    return p.withColumn("new", new).select("o", "n", "k", "s", "e", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("island"))


@query("path_functions", "WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') || '$x$' || page_id AS n FROM pages) SELECT page_id, CASE WHEN contains(n, '/') THEN regexp_extract(n, '(?s)^(.*)/', 1) END AS package, string_split(n, '/')[-1] AS simple, nullif(regexp_extract(n, '(?s)^(.*[^/])\\$', 1), '') AS outer_name, string_split(n, '$')[-1] AS inner_name, 'L' || n || ';' AS id FROM p")
def path_functions(t: Tables) -> DataFrame:
    n = F.concat(F.regexp_replace("url", "^[a-z]+://", ""), F.lit("$x$"), F.col("page_id").cast("string"))
    p = t.pages.select("page_id", n.alias("n"))
    return p.select("page_id", names.package(F.col("n")).alias("package"), names.simple_name(F.col("n")).alias("simple"), names.outer(F.col("n")).alias("outer_name"), names.inner(F.col("n")).alias("inner_name"), names.id_of(F.col("n")).alias("id"))


@query("html_escape", "SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS escaped FROM pages")
def html_escape(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.sha2(names.html_escape(F.col("html")), 256).alias("escaped"))


@query("natural_sort_rank", "WITH b AS (SELECT DISTINCT p_brand AS brand FROM part) SELECT brand, row_number() OVER (ORDER BY regexp_extract(brand, '^[^0-9]*'), CAST(regexp_extract(brand, '[0-9]+') AS INTEGER)) AS rank FROM b")
def natural_sort_rank(t: Tables) -> DataFrame:
    b = t.part.select(F.col("p_brand").alias("brand")).distinct().withColumn("key", names.natural_key(F.col("brand")))
    return number_in_order(b, ["key"], 0).select("brand", F.col("number").alias("rank"))


@query("listagg_sorted", "SELECT n_nationkey, string_agg(s_name, chr(10) ORDER BY s_name) AS names FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey")
def listagg_sorted(t: Tables) -> DataFrame:
    joined = t.nation.join(t.supplier, F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_nationkey").agg(F.array_join(F.array_sort(F.collect_list("s_name")), "\n").alias("names"))


@query("set_algebra", "WITH a AS (SELECT DISTINCT c_nationkey AS k, c_mktsegment AS s FROM customer WHERE c_acctbal > 5000), b AS (SELECT DISTINCT c_nationkey AS k, c_mktsegment AS s FROM customer WHERE c_acctbal < 0) SELECT 'union' AS op, k, s FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', k, s FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'except', k, s FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def set_algebra(t: Tables) -> DataFrame:
    c = t.customer.select(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("s"), "c_acctbal")
    a, b = c.where("c_acctbal > 5000").select("k", "s"), c.where("c_acctbal < 0").select("k", "s")
    named = lambda op, df: df.select(F.lit(op).alias("op"), "k", "s")
    return named("union", a.union(b).distinct()).unionByName(named("intersect", a.intersect(b))).unionByName(named("except", a.exceptAll(b).distinct().join(b, ["k", "s"], "left_anti")))


@query("fingerprint", "SELECT doc_id, sha256(text) AS sha256, sha1(text) AS sha1, CAST(octet_length(encode(text)) AS BIGINT) AS size, substr(sha256(text), 1, 8) AS prefix FROM documents")
def fingerprint(t: Tables) -> DataFrame:
    body = F.col("text").cast("binary")
    return t.documents.select("doc_id", F.sha2(body, 256).alias("sha256"), F.sha1(body).alias("sha1"), F.octet_length("text").cast("bigint").alias("size"), F.substring(F.sha2(body, 256), 1, 8).alias("prefix"))


@query("auto_match_fixpoint")
def auto_match_fixpoint(t: Tables) -> DataFrame:
    """Parts, even with odd ones of a type, to a fixpoint: each round leaves out what is matched, so a target
    contested in one round can be taken in the next.

    Sources that agree in all that is scored choose one target and keep each other from it, and of targets that agree
    none is a clear winner. So only parts that are alone in their class are ever matched, and the others stay: a
    round takes one row of each class of sources with their number, and two of each class of targets."""
    a, classes, few = part_classes(t, 2)
    numbers = keep(a.groupBy(F.col("class").alias("a")).agg(F.count("*").alias("n_a")))
    scorers = part_scorers().at("initial")
    groups = [tuple(map(keep, x)) for x in reachable_groups(classes, few, CONTEST, scorers)]

    def step(matches: DataFrame) -> DataFrame:
        left = lambda df, s: df.join(matches.select(s), s, "left_anti")
        scored = near_scored([(left(x, "a"), left(y, "b"), pairs) for x, y, pairs in groups], CONTEST, 2, scorers)
        chosen = keep(accept(scored.select("a", "b", "raw"), 16.0, absolute=0.3).join(numbers, "a"))
        once = chosen.groupBy("b").agg(F.sum("n_a").alias("n")).where("n = 1")
        return chosen.join(once, "b", "left_semi").select("a", "b")

    return to_fixpoint(t.spark.createDataFrame([], "a bigint, b bigint"), step)


@query("round_apply", f"WITH {ORDER_PAIRS}, n AS (SELECT a, b + 2 AS b FROM m WHERE a % 10 = 0) SELECT a, b FROM m WHERE a NOT IN (SELECT a FROM n) AND b NOT IN (SELECT b FROM n) UNION ALL SELECT a, b FROM n")
def round_apply(t: Tables) -> DataFrame:
    pairs = order_pairs(t)
    return apply_matches(pairs, pairs.where("a % 10 = 0").select("a", (F.col("b") + 2).alias("b")))


@query("unmatch_cascade", f"WITH {ORDER_PAIRS} SELECT 'order' AS kind, a FROM m WHERE a % 6 <> 0 UNION ALL SELECT 'line', l_orderkey * 10 + l_linenumber FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) JOIN m ON a = l_orderkey WHERE a % 6 <> 0")
def unmatch_cascade(t: Tables) -> DataFrame:
    """Orders taken out of the matches take their lines with them."""
    pairs = order_pairs(t)
    lines = t.lineitem.select(F.col("l_orderkey").alias("owner"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("a")).distinct()
    member_matches = lines.join(pairs.select(F.col("a").alias("owner")), "owner").select("a")
    owners, members = unmatch(pairs, pairs.where("a % 6 = 0").select("a"), lines, member_matches)
    return owners.select(F.lit("order").alias("kind"), "a").unionByName(members.select(F.lit("line").alias("kind"), "a"))


@query("incremental_rank", "SELECT user_id AS a, arg_max(event_id, (value, -event_id)) AS b, max(value) AS score FROM events GROUP BY user_id")
def incremental_rank(t: Tables) -> DataFrame:
    """The event with the highest value of each user, from a stream over the events file."""
    events = t.events
    folder = work_dir(t.spark, "incremental")
    stream = t.spark.readStream.schema(events.schema).parquet(f"{t.sf_dir}/events.parquet*")
    pairs = stream.select(F.col("user_id").alias("a"), F.col("event_id").alias("b"), F.col("value").alias("score"))
    run = keep_best(pairs, folder).trigger(availableNow=True).start()
    run.awaitTermination()
    return winners(pairs, folder)


STAGES = """WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2), s AS (SELECT k, p, row_number() OVER (PARTITION BY k ORDER BY n) AS stage, list(p) OVER (PARTITION BY k ORDER BY n) AS before FROM l)
SELECT k AS key, CAST(stage AS INTEGER) AS stage, list_reduce(before, lambda acc, x: (acc * 31 + x) % 1000003, CAST(7 AS BIGINT)) AS result FROM s"""

#: Parts in which the rows of staged_extraction arrive; each has as many files as a shuffle has tasks for it.
ARRIVALS = 4


@query("staged_extraction", STAGES)
def staged_extraction(t: Tables) -> DataFrame:
    """Lines as stages of their orders, each of which builds on the one before; they arrive in four parts without order."""
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("n")).agg(F.min("l_partkey").alias("value"))
    rows = lines.select("key", F.row_number().over(W.partitionBy("key").orderBy("n")).alias("stage"), "value")
    folder = work_dir(t.spark, "stages")
    files = -(-int(t.spark.conf.get("spark.sql.shuffle.partitions")) // ARRIVALS)
    rows.repartition(ARRIVALS * files, F.xxhash64("key", "stage")).write.parquet(f"{folder}/in")
    return staged_stream(t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in"), folder)


def staged_stream(stream: DataFrame, folder: str) -> DataFrame:
    staged = in_stages(stream, F.lit(7).cast("bigint"), lambda last, value: (last * 31 + value) % 1000003)
    run_stages(staged, folder).trigger(availableNow=True).start().awaitTermination()
    return results(staged, folder)
