"""Descriptors of fields and methods under the names of a namespace."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A class name, or a character of the other parts: primitive types, array dimensions, parentheses.
PART = r"L[^;]+;|."
CLASS = "L([^;]+);"


def translate(descriptors: DataFrame, names: DataFrame, column: str = "descriptor") -> DataFrame:
    """(column, translated) for each distinct descriptor: class names are replaced by those in names (class_name, name); null
    where a class is not in names or has none. Primitive types and the rest stay.

    Only class names meet the names, each once a descriptor; the other parts have no name, would meet in one task, and
    are put in from the descriptor itself. A descriptor has 255 parameters at most, so what is collected is small.
    """
    one = descriptors.select(column).where(F.col(column).isNotNull()).distinct().withColumn("inner", F.array_distinct(F.regexp_extract_all(column, F.lit(CLASS), 1)))
    known = names.groupBy(F.col("class_name").alias("inner")).agg(F.min("name").alias("name"))
    found = one.select(column, F.explode("inner").alias("inner")).join(known, "inner", "left").groupBy(column).agg(F.collect_list(F.struct("inner", "name")).alias("found"))
    none = one.where(F.size("inner") == 0).select(column, F.array().cast(found.schema["found"].dataType).alias("found"))
    parts, inner = F.regexp_extract_all(column, F.lit(PART), 0), lambda p: F.substr(p, F.lit(2), F.length(p) - 2)
    named = F.transform(parts, lambda p: F.when(F.length(p) > 1, F.concat(F.lit("L"), F.try_element_at("by_name", inner(p)), F.lit(";"))).otherwise(p))
    unnamed = F.exists("found", lambda x: x["name"].isNull())
    whole = found.unionByName(none).withColumn("by_name", F.map_from_entries("found"))
    return whole.select(column, F.when(~unnamed, F.array_join(named, "")).alias("translated"))
