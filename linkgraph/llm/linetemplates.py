"""Line dedup by a log-template tree, with DataFrame functions only.

A line goes down a tree of fixed depth: its token count, then its first tokens with digits masked.
A leaf holds as many templates as its lines ask for: of the tokens behind the first ones, a line's
template keeps the share that must agree, namely those that most documents of the leaf have at their
position, and leaves the others open; lines that keep the same tokens are one template. Templates
that recur across documents are dropped from all but the document with the smallest id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_key

#: A table of 64-bit keys is broadcast up to this many rows (some 16 MB); beyond it the join shuffles.
BROADCAST_ROWS = 500_000


def _masked(text: F.Column) -> F.Column:
    """Digit runs become 0 and blanks within lines one space."""
    return F.regexp_replace(F.regexp_replace(text, "[0-9]+", "0"), r"[ \t\r\f\x0B]+", " ")


def lines_of(text: F.Column) -> F.Column:
    """Array of pos and masked line, without blank ones."""
    return F.filter(F.transform(F.split(_masked(text), "\n"), lambda x, i: F.struct(i.alias("pos"), F.trim(x).alias("line"))), lambda x: x["line"] != "")


def line_keys(docs: DataFrame, key: str, text: str, depth: int, min_tokens: int) -> DataFrame:
    """One row per document: id, tkey and lines (array of pos, own: the line's key, and leaf: null for lines of fewer
    than min_tokens tokens)."""

    def one(x: F.Column) -> F.Column:
        tokens = F.split(x["line"], " ")
        leaf = F.when(F.size(tokens) >= min_tokens, F.xxhash64(F.size(tokens), F.slice(tokens, 1, depth)))
        return F.struct(x["pos"].alias("pos"), F.xxhash64(x["line"]).alias("own"), leaf.alias("leaf"))

    body = F.col(f"`{text}`")
    return cut(docs.select(F.col(f"`{key}`").alias("id"), text_key(body).alias("tkey"), F.transform(lines_of(body), one).alias("lines")))


def _exploded(keys: DataFrame, *wanted: str) -> DataFrame:
    return keys.select("id", "tkey", F.explode("lines").alias("l")).select("id", "tkey", *[f"l.{w}" for w in wanted])


def _small(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def line_templates(docs: DataFrame, text: str, lines: DataFrame, depth: int, agree: float, min_documents: int) -> DataFrame:
    """(own, template) of the lines in leaves of several lines and at least min_documents documents."""
    leaves = lines.where("leaf is not null").groupBy("leaf").agg(F.sum("documents").alias("d"), F.count("*").alias("n")).where((F.col("d") >= min_documents) & (F.col("n") > 1))
    held = cut(lines.join(_small(cut(leaves.select("leaf"))), "leaf").select("own", "leaf", "documents"))
    texts = docs.select(F.explode(F.transform(lines_of(F.col(f"`{text}`")), lambda x: x["line"])).alias("line")).withColumn("own", F.xxhash64("line"))
    distinct = texts.join(_small(held), "own").groupBy("own").agg(F.any_value("line").alias("line"), F.min("leaf").alias("leaf"), F.min("documents").alias("documents"))
    tokens = F.split("line", " ")
    behind = cut(distinct.where(F.size(tokens) > depth).select("own", "leaf", "documents", F.slice(tokens, F.lit(depth + 1), F.size(tokens)).alias("behind")))
    need = F.ceil(agree * F.size("behind") - 1e-9).cast("int")
    at = behind.select("own", "leaf", "documents", need.alias("need"), F.posexplode("behind").alias("at", "token"))
    common = cut(at.groupBy("leaf", "at", "token").agg(F.sum("documents").alias("n")).where(F.col("n") >= min_documents))
    ranked = at.join(_small(common), ["leaf", "at", "token"]).groupBy("own").agg(F.min("leaf").alias("leaf"), F.min("need").alias("need"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "at", "token"))).alias("top"))
    fixed = F.transform(F.slice("top", F.lit(1), F.col("need")), lambda x: F.struct(x["at"].alias("at"), x["token"].alias("token")))
    return cut(ranked.where(F.size("top") >= F.col("need")).select("own", F.xxhash64("leaf", fixed).alias("template")))


def recurring_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", depth: int = 4, agree: float = 0.6, min_documents: int = 8, min_tokens: int = 3, keys: DataFrame | None = None) -> DataFrame:
    """(own, keeper): keys of the masked lines that recur or whose template does, and the document that keeps them.

    A line or template recurs when documents of at least min_documents classes have it. The class of a
    document is what it has beside common lines, that is lines and templates of at least min_documents
    documents, or all its lines and templates if there is nothing else; so copies of a whole document
    count once, and passages of any length recur wherever they stand. Both counts are exact but for
    equal hashes. Lines of fewer than min_tokens tokens never recur. keys: line_keys() of docs.
    """
    keys = line_keys(docs, key, text, depth, min_tokens) if keys is None else keys
    per_document = _exploded(keys, "own", "leaf").groupBy("own", "id").agg(F.min("leaf").alias("leaf"))
    lines = cut(per_document.groupBy("own").agg(F.count("*").alias("documents"), F.min("id").alias("keeper"), F.min("leaf").alias("leaf")))
    templates = line_templates(docs, text, lines, depth, agree, min_documents)
    holders = _exploded(keys, "own").join(_small(templates), "own").select("template", "id").distinct()
    general = holders.groupBy("template").count().where(F.col("count") >= min_documents).select("template")
    in_general = cut(templates.join(_small(cut(general)), "template").select("own", "template"))
    once = lines.where(F.col("documents") >= min_documents).select("own", F.col("leaf").isNotNull().alias("long"), F.lit(None).cast("bigint").alias("template"))
    common = cut(once.unionByName(in_general.select("own", F.lit(True).alias("long"), "template")).groupBy("own").agg(F.max("long").alias("long"), F.max("template").alias("template")))
    marked = _exploded(keys, "own").join(_small(common), "own", "left")
    rare, what = F.col("long").isNull(), F.xxhash64(F.coalesce("template", "own"))
    low = F.pmod(what, F.lit(1 << 40))  # sums of these do not overflow
    documents = marked.groupBy("id").agg(F.sum(F.when(rare, low)).alias("r1"), F.bit_xor(F.when(rare, what)).alias("r2"), F.sum(low).alias("a1"), F.bit_xor(what).alias("a2"), F.collect_set(F.when(F.col("long"), F.col("own"))).alias("owns"))
    classes = F.when(F.col("r1").isNotNull(), F.xxhash64("r1", "r2")).otherwise(F.xxhash64("a1", "a2"))
    pairs = cut(documents.select(classes.alias("class"), F.explode("owns").alias("own")).distinct())
    often = lambda by, df: df.groupBy(by).count().where(F.col("count") >= min_documents).select(by)
    keepers = lines.select("own", "keeper")
    alone = often("own", pairs).join(keepers, "own")
    recurring = cut(often("template", pairs.join(_small(in_general), "own").select("template", "class").distinct()))
    members = cut(in_general.join(_small(recurring), "template").join(keepers, "own"))
    first = members.groupBy("template").agg(F.min("keeper").alias("keeper"))
    by_template = members.select("template", "own").join(_small(first), "template").select("own", "keeper")
    return cut(alone.unionByName(by_template).groupBy("own").agg(F.min("keeper").alias("keeper")))


def drop_recurring_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", depth: int = 4, min_tokens: int = 3, **options) -> DataFrame:
    """docs with recurring lines taken out of the text, n_lines and n_dropped.

    Documents keep their row even when nothing of the text is left; blank lines and the order of the
    others stay. Null texts have no lines. Rows without a key lose recurring lines unless only such rows
    have them. Rows that share a key are one document. Columns of docs named like an added one are replaced.
    """
    keys = line_keys(docs, key, text, depth, min_tokens)
    found = recurring_lines(docs, key, text, depth=depth, min_tokens=min_tokens, keys=keys, **options)
    gone = _exploded(keys, "pos", "own").join(_small(found), "own").where(~F.col("id").eqNullSafe(F.col("keeper")))
    positions = gone.groupBy("id", "tkey").agg(F.collect_set("pos").alias("gone"))
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    left = docs.select(F.struct(*[docs[f"`{c}`"] for c in names]).alias("row"))
    body = F.col(f"row.`{text}`")
    joined = left.join(positions, F.col(f"row.`{key}`").eqNullSafe(positions["id"]) & (text_key(body) == positions["tkey"]), "left")
    split = F.split(body, "\n")
    kept = F.array_join(F.filter(split, lambda x, i: ~F.array_contains("gone", i)), "\n")
    cleaned = F.when(F.col("gone").isNull(), body).otherwise(kept)
    return joined.select(*[(cleaned if c == text else F.col(f"row.`{c}`")).alias(c) for c in names], F.coalesce(F.size(F.filter(split, lambda x: F.trim(x) != "")), F.lit(0)).cast("bigint").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_dropped"))


def digest(cleaned: DataFrame) -> DataFrame:
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
