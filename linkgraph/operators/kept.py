"""Values of pairs that cost much to compute, kept over rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stored, work_dir


class KeptPairs:
    """A table of values by the content of both ends, in the shared folder. A round computes what is missing, appends it
    in a part of its own, and reads the rest.

    A value must depend on nothing but the two contents. What it depends on beside the entities themselves, such as
    matches, belongs into the contents (a matched reference under its partner's name): a match that changes gives other
    contents, so no value has to be taken back, and values of contents that come again count again. Contents stand for
    themselves by two 64-bit hashes each.
    """

    KEYS = ["_a1", "_a2", "_b1", "_b2"]

    def __init__(self, spark: SparkSession, value_type: str = "double"):
        self.spark, self.path, self.rounds = spark, work_dir(spark, "kept-pairs"), 0
        self.schema = ", ".join(f"{k} bigint" for k in self.KEYS) + f", value {value_type}"

    def table(self) -> DataFrame:
        if not self.rounds:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{n}" for n in range(self.rounds)])

    def values(self, pairs: DataFrame, a: str, b: str, value: Column) -> DataFrame:
        """pairs with value: value of the columns a and b, computed once for each distinct pair of contents that no
        earlier round had. Copies of one pair of contents meet in partial aggregation, so a very common one is no hot key."""
        text = lambda c: F.to_json(F.struct(F.col(c).alias("c")))  # noqa: E731  # hashes of the values themselves skip nulls
        hashes = dict(zip(self.KEYS, [h for c in (a, b) for h in (F.xxhash64(text(c)), F.xxhash64(F.lit(1), text(c)))], strict=True))
        keyed = pairs.withColumns(hashes)
        asked = keyed.groupBy(*self.KEYS).agg(F.any_value(F.struct(a, b)).alias("_ends"))
        missing, _ = stored(asked.join(self.table(), self.KEYS, "left_anti").select(*self.KEYS, "_ends.*"), "missing")
        missing.withColumn("value", value).select(*self.KEYS, "value").write.mode("overwrite").parquet(f"{self.path}/{self.rounds}")
        self.rounds += 1
        return keyed.join(self.table(), self.KEYS).drop(*self.KEYS)
