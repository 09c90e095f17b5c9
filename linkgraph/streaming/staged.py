"""Stages that an entity passes in order, whatever the order in which their rows arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def in_stages(rows: DataFrame, start: Column, step: Callable[[Column, Column], Column]) -> DataFrame:
    """(key, done, results) of rows (key, stage, value), a batch or a stream: done stages from 1 on without a gap, and
    what step makes of the result before (start at first) and the value of each.

    A row that comes before those of earlier stages waits in the state of its key, and passes once they have; of several
    rows of one stage the smallest value counts among those there when it is passed. An entity has few stages, so what is
    kept for a key is small.
    """
    seen = F.array_sort(F.collect_set(F.struct("stage", "value")))
    none = F.struct(F.lit(0).alias("done"), start.alias("last"), F.array().cast(f"array<{rows.select(start.alias('x')).schema['x'].dataType.simpleString()}>").alias("results"))

    def passed(state: Column, row: Column) -> Column:
        result = step(state["last"], row["value"])
        after = F.struct((state["done"] + 1).alias("done"), result.alias("last"), F.concat(state["results"], F.array(result)).alias("results"))
        return F.when(row["stage"] == state["done"] + 1, after).otherwise(state)

    return rows.groupBy("key").agg(F.aggregate(seen, none, passed).alias("s")).select("key", "s.done", "s.results")


def run_stages(staged: DataFrame, folder: str) -> DataStreamWriter:
    """Writes, for each batch of a stream through in_stages(), the keys that it touched to folder/updates; the log in folder
    lets a new run go on."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/updates/batch={number}")

    return staged.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/log")


def results(staged: DataFrame, folder: str) -> DataFrame:
    """(key, stage, result) after all batches so far: those of the update of a key that has the most stages."""
    spark = staged.sparkSession
    spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in staged.schema]).write.mode("overwrite").parquet(f"{folder}/updates/batch=-1")
    updates = spark.read.schema(staged.schema).parquet(f"{folder}/updates/batch=*")
    last = updates.groupBy("key").agg(F.max_by("results", "done").alias("results"))
    return last.select("key", F.posexplode("results").alias("stage", "result")).select("key", F.col("stage") + 1, "result").toDF("key", "stage", "result")
