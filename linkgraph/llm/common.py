"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..storage import shared_dir, without_leftovers

#: Texts handed to Python at once: this many UTF-8 bytes, or one longer text.
CHUNK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    with without_leftovers(df.sparkSession):
        return df.checkpoint(eager=True)


def chunks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose strings in column stay near CHUNK_BYTES."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        per_row = max(1, col.nbytes // max(1, batch.num_rows))
        step = max(1, CHUNK_BYTES // per_row)
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def with_columns_from(df: DataFrame, column: str, added: str, fn: Callable[[], Callable[[list], list[list]]]) -> DataFrame:
    """df with the columns of the DDL string added, computed by Python from one column.

    fn() is called once per task and returns a function from a list of values to one list per added
    column. All other columns pass through as Arrow arrays; a column of df with the name of an added
    one is replaced.
    """
    new = T.StructType.fromDDL(added)
    names = set(new.names)
    kept = df.select(*[df[f"`{c}`"] for c in df.columns if c not in names])
    arrow = to_arrow_schema(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = fn()
        for batch in chunks(batches, column):
            at = batch.schema.get_field_index(column)
            made = work(batch.column(at).to_pylist())
            arrays = [pa.array(values, type=field.type) for values, field in zip(made, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns + arrays, names=[*batch.schema.names, *new.names])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *new.fields]))


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_key(text) -> F.Column:
    """64 bits that stand for the text of a row beside its doc_id."""
    return F.xxhash64(text)
