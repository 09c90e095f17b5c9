"""Best match so far of a stream of candidates, with one state per source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def best_of(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a").agg(F.max_by(F.struct("b", "score"), F.struct("score", -F.col("b"))).alias("w")).select("a", "w.b", "w.score")


def keep_best(pairs: DataFrame, folder: str) -> DataStreamWriter:
    """Keeps the winner of each source in the state of a streaming aggregation, and writes to folder/updates the winners
    that a batch touched, whose number follows the batch and not what was seen before.

    A batch that runs again after a failure overwrites its own part, and the log in folder lets a new run go on where the
    last one ended, so any number of restarts gives the rows of one run.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/updates/batch={number}")

    return best_of(pairs).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/log")


def winners(pairs: DataFrame, folder: str) -> DataFrame:
    """The winners after all batches so far. pairs: the stream, for its columns. An update of a source is never worse than
    the one before, so the best of its updates is the last one."""
    spark = pairs.sparkSession
    schema = best_of(pairs).schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/updates/batch=-1")
    return best_of(spark.read.schema(schema).parquet(f"{folder}/updates/batch=*"))
