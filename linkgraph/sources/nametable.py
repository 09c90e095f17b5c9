"""Name tables: tab-separated rows (kind, class_name, member_name, desc, idx, ns, dst_name, comment)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = "kind string, class_name string, member_name string, `desc` string, idx int, ns string, dst_name string, comment string"
KEY = ["kind", "class_name", "member_name", "desc", "idx"]
#: The default column title of each namespace.
TITLES = {"plain": "official", "mapped": "named", "uid": "intermediary", "tmp": "tmp", "aux": "aux", "aux2": "aux2"}


def read_names(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NAMES).option("sep", "\t").option("header", True).csv(path)


def write_names(names: DataFrame, path: str) -> None:
    names.select("kind", "class_name", "member_name", "desc", "idx", "ns", "dst_name", "comment").write.option("sep", "\t").option("header", True).mode("errorifexists").csv(path)


def merge_names(entities: DataFrame, names: DataFrame, ns: str, field: str, replace: bool = False) -> DataFrame:
    """entities (KEY columns, field, comment) with the names of namespace ns. Without replace a name that is there
    stays; a uid keeps the minimum in either case. A table that names an entity twice gives its smallest name."""
    new = names.where(F.col("ns") == ns).groupBy(*KEY).agg(F.min("dst_name").alias("_new"), F.min("comment").alias("_comment"))
    same = [entities[k].eqNullSafe(new[k]) for k in KEY]
    on = same[0]
    for s in same[1:]:
        on = on & s
    joined = entities.join(new, on, "left")
    old, fresh = entities[field], F.col("_new")
    if field == "uid":
        merged = F.least(old, fresh.cast("int"))
    else:
        merged = F.coalesce(fresh, old) if replace else F.coalesce(old, fresh)
    comment = F.coalesce("_comment", entities["comment"]) if replace else F.coalesce(entities["comment"], F.col("_comment"))
    return joined.select(*[(merged.alias(c) if c == field else comment.alias(c) if c == "comment" else entities[c]) for c in entities.columns])


def unknown(names: DataFrame, entities: DataFrame) -> DataFrame:
    """Classes that a table names and that do not exist, each once."""
    return names.select("class_name").distinct().join(entities.select("class_name"), "class_name", "left_anti")


def export(entities: DataFrame, field: str, verbosity: str = "full", fields_first: bool = False) -> DataFrame:
    """Rows to write. full: all with a name or comment; roots: members only where they begin (column is_root, if there); minimal:
    also without names equal to the plain one. Outer classes come before inner ones, classes before members."""
    named = entities.where(F.col(field).isNotNull() | F.col("comment").isNotNull())
    if verbosity in ("roots", "minimal"):
        root = F.coalesce("is_root", F.lit(True)) if "is_root" in entities.columns else F.lit(True)
        named = named.where((F.col("kind") == "class") | root)
    if verbosity == "minimal":
        named = named.where(~F.coalesce(F.col(field) == F.coalesce("member_name", "class_name"), F.lit(False)) | F.col("comment").isNotNull())
    kinds = ["class", "field", "method", "arg", "var"] if fields_first else ["class", "method", "field", "arg", "var"]
    rank = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind"))
    depth = F.size(F.split("class_name", r"\$"))
    return named.orderBy(depth, F.length("class_name"), "class_name", rank, F.length("member_name"), "member_name", "desc", "idx")


def counts(names: DataFrame) -> DataFrame:
    return names.groupBy("kind").agg(F.count("dst_name").alias("names"), F.count("comment").alias("comments"))


def cleared(entities: DataFrame) -> DataFrame:
    return entities.withColumns({"mapped": F.lit(None).cast("string"), "comment": F.lit(None).cast("string")})
