"""Queries that write what they read from the tables to files, and read it back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..filters import filter_ranked
from ..operators.graphs import closure
from ..sources import archives, matchfile, nametable
from ..storage import keep, work_dir
from .entities import CLASS_PAIRS, class_pairs
from .hierarchy import CLOSURE, edges
from .linking import BEST, CONTEST, PART, best_parts
from .registry import Tables, query


MATCH_ROWS = f"""WITH {CLASS_PAIRS}, o AS (SELECT o_custkey AS c, o_orderpriority AS p, min(o_orderkey) AS o FROM orders GROUP BY 1, 2),
r AS (SELECT 'class' AS kind, 'c' || a AS a_class, 'c' || b AS b_class, NULL AS a_member, NULL AS b_member, NULL AS side FROM cp
UNION ALL SELECT 'method', 'c' || a, 'c' || b, 'm' || x.o, 'm' || y.o, NULL FROM cp JOIN o x ON x.c = a JOIN o y ON y.c = b AND y.p = x.p
UNION ALL SELECT 'class', 'c' || c_custkey, NULL, NULL, NULL, 'a' FROM customer WHERE c_custkey % 2 = 0 AND c_custkey NOT IN (SELECT a FROM cp))"""


def match_rows(t: Tables) -> DataFrame:
    """Matched classes and members, and classes without a partner, as rows of a match file."""
    pairs = class_pairs(t).select("a", "b")
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    o = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("o"))
    side = lambda s: o.select(F.col("o_custkey").alias(s), "o_orderpriority", F.col("o").alias(f"o_{s}"))
    methods = pairs.join(side("a"), "a").join(side("b"), ["b", "o_orderpriority"])
    none = F.lit(None).cast("string")
    shape = lambda df, kind, *c: df.select(F.lit(kind).alias("kind"), *[x.alias(n) for x, n in zip(c, ("a_class", "b_class", "a_member", "b_member", "side"), strict=True)])
    single = t.customer.where("c_custkey % 2 = 0").join(pairs, F.col("c_custkey") == F.col("a"), "left_anti")
    rows = shape(pairs, "class", name("c", "a"), name("c", "b"), none, none, none)
    rows = rows.unionByName(shape(methods, "method", name("c", "a"), name("c", "b"), name("m", "o_a"), name("m", "o_b"), none))
    rows = rows.unionByName(shape(single, "class", name("c", "c_custkey"), none, none, none, F.lit("a")))
    return rows.select("*", F.col("side").isNotNull().alias("unmatchable"), F.lit(None).cast("int").alias("a_idx"), F.lit(None).cast("int").alias("b_idx"))


COLUMNS = ["kind", "a_class", "b_class", "a_member", "b_member", "side"]


@query("match_file_round_trip", MATCH_ROWS + " SELECT * FROM r")
def match_file_round_trip(t: Tables) -> DataFrame:
    path = work_dir(t.spark, "matches")
    matchfile.write_matches(match_rows(t), path)
    return matchfile.read_matches(t.spark, path).select(COLUMNS)


@query("known_matches", MATCH_ROWS + ", kn AS (SELECT *, coalesce(a_class NOT LIKE '%4', TRUE) AND coalesce(b_class NOT LIKE '%7', TRUE) AS known FROM r) SELECT kind, known, count(*) AS n FROM kn GROUP BY 1, 2")
def known_matches(t: Tables) -> DataFrame:
    """Rows of a match file whose classes exist, and the others."""
    path = work_dir(t.spark, "matches")
    matchfile.write_matches(match_rows(t), path)
    there = lambda end: t.customer.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("class_id")).where(~F.col("class_id").endswith(end))
    known, unknown = matchfile.known(matchfile.read_matches(t.spark, path), there("4"), there("7"))
    count = lambda df, value: df.groupBy("kind").agg(F.count("*").alias("n")).select("kind", F.lit(value).alias("known"), "n")
    return count(known, True).unionByName(count(unknown, False))


@query("match_file_inputs", "SELECT CASE doc_id % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'cp' WHEN 3 THEN 'cp a' ELSE 'cp b' END AS section, 'doc' || doc_id AS file, CASE WHEN doc_id % 3 > 0 THEN CAST(octet_length(encode(text)) AS BIGINT) END AS size, CASE doc_id % 3 WHEN 1 THEN 'SHA256' WHEN 2 THEN 'SHA1' END AS algorithm, CASE doc_id % 3 WHEN 1 THEN sha256(text) WHEN 2 THEN sha1(text) END AS hash FROM documents")
def match_file_inputs(t: Tables) -> DataFrame:
    """A header line for each document, in the three forms of headers by turns; a file has some 50,000 of them."""
    body, form = F.col("text").cast("binary"), F.col("doc_id") % 3
    section = F.element_at(F.array(*[F.lit(s) for s in matchfile.SECTIONS]), (F.col("doc_id") % 5 + 1).cast("int"))
    name, size = F.concat(F.lit("doc"), F.col("doc_id").cast("string")), F.octet_length("text").cast("string")
    old = F.concat_ws("\t", size, F.base64(F.unhex(F.sha2(body, 256))), name)
    new = F.concat_ws("\t", size, F.lit("SHA1"), F.base64(F.unhex(F.sha1(body))), name)
    line = F.when(form == 0, name).when(form == 1, old).otherwise(new)
    path = work_dir(t.spark, "headers")
    files = 1 + t.documents.count() // 50_000
    grouped = t.documents.groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(files)).alias("part"), section.alias("section")).agg(F.concat(F.lit("\t"), F.first(section), F.lit(":\n\t\t"), F.array_join(F.collect_list(line), "\n\t\t")).alias("lines"))
    texts = grouped.groupBy("part").agg(F.concat(F.lit(f"{matchfile.HEAD}now, input files:\n"), F.array_join(F.collect_list("lines"), "\n")).alias("value"))
    texts.repartition("part").write.partitionBy("part").text(path)
    read = matchfile.read_inputs(t.spark, f"{path}/*")
    return read.select("section", "file", "size", "algorithm", F.lower(F.hex("hash")).alias("hash"))


NAME_ROWS = "e AS (SELECT c_custkey AS k, 'c' || c_custkey AS class_name, CASE WHEN c_custkey % 3 = 0 THEN 'old' || c_custkey END AS mapped, CASE WHEN c_custkey % 4 = 0 THEN 'note ' || c_custkey END AS comment FROM customer), n AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'new' || c_custkey END AS dst_name, CASE WHEN c_custkey % 6 = 0 THEN 'said ' || c_custkey END AS comment FROM customer WHERE c_custkey % 5 > 0)"


def named_classes(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Classes with mapped names and comments, and a table of further ones, from a file."""
    k = F.col("c_custkey")
    text = lambda prefix: F.concat(F.lit(prefix), k.cast("string"))
    key = [F.lit("class").alias("kind"), text("c").alias("class_name"), *[F.lit(None).cast(c).alias(n) for n, c in (("member_name", "string"), ("desc", "string"), ("idx", "int"))]]
    entities = t.customer.select(*key, F.when(k % 3 == 0, text("old")).alias("mapped"), F.when(k % 4 == 0, text("note ")).alias("comment"))
    rows = t.customer.where("c_custkey % 5 > 0").select(*key, F.lit("mapped").alias("ns"), F.when(k % 2 == 0, text("new")).alias("dst_name"), F.when(k % 6 == 0, text("said ")).alias("comment"))
    path = work_dir(t.spark, "names")
    nametable.write_names(rows, path)
    return entities, nametable.read_names(t.spark, path)


@query("name_table_merge", f"WITH {NAME_ROWS} SELECT e.class_name, coalesce(e.mapped, n.dst_name) AS kept, coalesce(n.dst_name, e.mapped) AS replaced, coalesce(e.comment, n.comment) AS comment_kept, coalesce(n.comment, e.comment) AS comment_replaced FROM e LEFT JOIN n USING (k)")
def name_table_merge(t: Tables) -> DataFrame:
    """Names of a table join the entities': what is there stays, or is replaced."""
    entities, rows = named_classes(t)
    rows = keep(rows)
    merged = lambda replace, tag: nametable.merge_names(entities, rows, "mapped", "mapped", replace).select("class_name", F.col("mapped").alias(tag), F.col("comment").alias(f"comment_{tag}"))
    return merged(False, "kept").join(merged(True, "replaced"), "class_name")


@query("name_table_export", f"WITH {NAME_ROWS} SELECT 'full' AS verbosity, class_name, mapped, comment FROM e WHERE mapped IS NOT NULL OR comment IS NOT NULL UNION ALL SELECT 'minimal', class_name, mapped, comment FROM e WHERE mapped IS NOT NULL OR comment IS NOT NULL UNION ALL SELECT 'cleared', class_name, NULL, NULL FROM e")
def name_table_export(t: Tables) -> DataFrame:
    """What a table of the mapped names would hold at two verbosities, and the entities after clearing."""
    entities, _ = named_classes(t)
    part = lambda tag, df: df.select(F.lit(tag).alias("verbosity"), "class_name", "mapped", "comment")
    return part("full", nametable.export(entities, "mapped")).unionByName(part("minimal", nametable.export(entities, "mapped", "minimal"))).unionByName(part("cleared", nametable.cleared(entities)))


@query("namespace_titles", "SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'official' WHEN 1 THEN 'named' WHEN 2 THEN 'intermediary' WHEN 3 THEN 'tmp' WHEN 4 THEN 'aux' ELSE 'aux2' END AS title FROM customer")
def namespace_titles(t: Tables) -> DataFrame:
    titles = F.array(*[F.lit(x) for x in nametable.TITLES.values()])
    return t.customer.select("c_custkey", F.element_at(titles, (F.col("c_custkey") % 6 + 1).cast("int")).alias("title"))


@query("container_uri", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url ELSE 'zip:' || url END AS container FROM pages")
def container_uri(t: Tables) -> DataFrame:
    """The archive behind an entry's URI."""
    uri = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("jar:"), "url", F.lit("!/x"), F.col("page_id").cast("string"))).otherwise(F.concat(F.lit("zip:"), "url"))
    return t.pages.select("page_id", archives.container(uri).alias("container"))


@query("locate_inputs", "WITH d AS (SELECT doc_id, 'doc' || doc_id AS file, octet_length(encode(text)) AS size FROM documents), f AS (SELECT file, CASE WHEN doc_id % 5 = 0 THEN size + 1 ELSE size END AS size, 'd2' AS folder, doc_id FROM d WHERE doc_id % 3 = 0 UNION ALL SELECT file, size, 'd0', doc_id FROM d WHERE doc_id % 2 = 0 UNION ALL SELECT file, size, 'd1', doc_id FROM d) SELECT d.file, arg_min(f.folder || '/' || f.doc_id, CASE folder WHEN 'd2' THEN 1 ELSE 2 END) AS path FROM d LEFT JOIN f ON f.file = d.file AND f.size = d.size AND folder IN ('d2', 'd0') GROUP BY 1")
def locate_inputs(t: Tables) -> DataFrame:
    """Where each document lies as a file: in the first of two folders that has its name and size. A third one does not count."""
    k, size = F.col("doc_id"), F.octet_length("text")
    file, none = F.concat(F.lit("doc"), k.cast("string")).alias("file"), F.lit(None).cast("string").alias("sha256")
    places = F.array_compact(F.array(F.when(k % 3 == 0, F.struct(F.lit("d2").alias("folder"), F.when(k % 5 == 0, size + 1).otherwise(size).alias("size"))), F.when(k % 2 == 0, F.struct(F.lit("d0").alias("folder"), size.alias("size"))), F.struct(F.lit("d1").alias("folder"), size.alias("size"))))
    found = t.documents.select(file, none, k.cast("string").alias("k"), F.explode(places).alias("p")).select("file", "sha256", "p.size", "p.folder", F.concat_ws("/", "p.folder", "k").alias("path"))
    return archives.locate(t.documents.select(file, size.alias("size"), none), found, ["d2", "d0"]).select("file", "path")


INSTANCE = f"WITH RECURSIVE {CLOSURE}, " + (PART + BEST).replace("WITH s AS", "s AS", 1).strip() + ", w AS (SELECT l_partkey, arg_min(o_custkey, o_orderkey) AS c FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1), q AS (SELECT t.a, t.b, 'c' || w.c AS cls FROM t LEFT JOIN w ON w.l_partkey = t.b), z AS (SELECT a, b, cls, coalesce(list(ancestor) FILTER (WHERE ancestor IS NOT NULL), []) AS up FROM q LEFT JOIN cl ON cl.node = cls GROUP BY 1, 2, 3) SELECT program, count(*) AS n, CAST(sum(b) AS BIGINT) AS sum_b FROM (SELECT 1 AS program, b FROM z WHERE list_contains(up, 'r1') UNION ALL SELECT 2, b FROM z WHERE NOT list_contains(up, 'n3') UNION ALL SELECT 3, b FROM z UNION ALL SELECT 4, b FROM z WHERE list_contains(up, 'n5')) GROUP BY 1"


@query("rpn_instanceof", INSTANCE)
def rpn_instanceof(t: Tables) -> DataFrame:
    """Filter programs on classes of members: what they can be assigned to, and super classes that equal a name. The third is
    none and filters nothing. A part belongs to the customer of its first order."""
    up = closure(edges(t)).groupBy("node").agg(F.collect_set("ancestor").alias("b_ancestors"), F.max(F.when(F.col("depth") == 1, F.col("ancestor"))).alias("b_super"))
    first = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("l_partkey").alias("b")).agg(F.min_by("o_custkey", "o_orderkey").alias("c"))
    owner = first.select("b", F.concat(F.lit("c"), F.col("c").cast("string")).alias("b_class"))
    ranked = best_parts(t, CONTEST, 10).select("a", "b", F.col("a").alias("a_id"), F.col("b").alias("b_id"), F.concat(F.lit("part"), F.col("b").cast("string")).alias("b_name")).join(owner, "b", "left")
    ranked = keep(ranked.join(up, ranked["b_class"] == up["node"], "left").drop("node").withColumn("b_ancestors", F.coalesce("b_ancestors", F.array().cast("array<string>"))))
    programs = {1: "r1 instanceof", 2: "n3 instanceof not", 3: "b supercls supercls r2 equals and", 4: "supercls n5 equals"}
    out = None
    for number, program in programs.items():
        one = filter_ranked(ranked, program).agg(F.count("*").alias("n"), F.sum("b").alias("sum_b")).select(F.lit(number).alias("program"), "n", "sum_b")
        out = one if out is None else out.unionByName(one)
    return out.where("n > 0")
