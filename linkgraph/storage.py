"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def _hadoop(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session may leave it unset (tests); it then
    gets a temporary folder of this machine, which a cluster could not read, so there this raises."""
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
        files, there = _hadoop(spark, spark.sparkContext.getCheckpointDir())
        files.deleteOnExit(there)
    return base.rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, below a folder of this application that goes when the driver ends."""
    own = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    files, there = _hadoop(spark, own)
    if not files.exists(there):
        files.mkdirs(there)
        files.deleteOnExit(there)
    return f"{own}/{name}-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for the queries that run in here."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def without_leftovers(spark: SparkSession):
    """Queries that end in here delete their shuffle files at once, and do not wait for the driver's garbage collector."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df, written as Parquet and read again, and its folder for forget(). Neither a lost executor nor the plan or the
    size estimates of what follows reach behind it."""
    path = work_dir(df.sparkSession, name)
    with without_leftovers(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        files, there = _hadoop(spark, path)
        files.delete(there, True)


def keep(df: DataFrame) -> DataFrame:
    """stored(), for tables that stay until the driver ends."""
    return stored(df, "kept")[0]
