"""Two-pass external shuffle into shards, with DataFrame functions only.

Pass one scatters the rows by seeded hashes into memory-sized buckets of the shards; pass two takes
one bucket after the other, shuffles it (the built-in shuffle() is a Fisher-Yates shuffle) and writes
it. Slots follow from the numbers of rows in the written buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import setting, without_leftovers, work_dir

#: Tasks of the second pass; where there are more buckets, a task takes several, one at a time.
MOST_TASKS = 100_000
#: The first slots of so many buckets are broadcast (some 12 MB); more are joined with a shuffle.
BROADCAST_BUCKETS = 500_000


def shard_of(key: F.Column, shards: int, seed: int) -> F.Column:
    """Consistent shard of a key: stage n = 1, 2, ... takes over a key with probability 1/(n+1), so one
    more shard moves only the keys that the new shard takes."""
    out = F.lit(0)
    for n in range(1, shards):
        out = F.when(F.pmod(F.xxhash64(key, F.lit(seed), F.lit(n)), F.lit(n + 1)) == 0, F.lit(n)).otherwise(out)
    return out.cast("int")


def text_bytes(text: F.Column) -> F.Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")


def numbered_copies(docs: DataFrame, size: F.Column, bucket_bytes: int) -> tuple[DataFrame, int]:
    """(row, copy) for the rows of docs, and the bytes of all of them. copy tells wholly equal rows apart where there
    are so many of them that they fill buckets, and is 0 elsewhere."""
    same = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    by_row = docs.select(same.alias("same"), size.alias("size")).groupBy("same").agg(F.sum("size").alias("bytes"))
    total, most = by_row.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.max("bytes"), F.lit(0))).first()
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), same.alias("same"))
    if most <= bucket_bytes // 4:
        return rows.select("row", F.lit(0).cast("bigint").alias("copy")), total
    often = by_row.where(F.col("bytes") > bucket_bytes // 4).select("same")
    counted = rows.join(often, "same", "left_semi").groupBy("row").count()
    copies = counted.select("row", F.explode(F.sequence(F.lit(1), F.col("count"))).alias("copy"))
    return rows.join(often, "same", "left_anti").select("row", F.lit(0).cast("bigint").alias("copy")).unionByName(copies), total


def shuffle_into_shards(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text", seed: int = 20240229, bucket_bytes: int = 16 << 20, path: str | None = None) -> DataFrame:
    """docs with size, shard, slot (gapless from 0 in each shard, in random order) and grown_shard (the
    shard if there were one more), read from the shards that it writes under path: a folder for each shard,
    with its buckets in shuffled order.

    The law is key: the key and the number of shards alone decide the shard. The bucket in a shard is
    uniform by another hash of key, text and copy, so a hot text, source or row is no hot bucket. Rows with
    one key share its shard; wholly equal rows are interchangeable. Null keys hash as null and share a
    shard. Null and empty texts have size 8. Columns of docs named like an added one are replaced.
    bucket_bytes bounds the mean bucket, and a task holds one bucket at a time.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in ("size", "shard", "slot", "grown_shard")]
    docs = docs.select(*[docs[f"`{c}`"] for c in names])
    numbered, total = numbered_copies(docs, text_bytes(F.col(f"`{text}`")) + 8, bucket_bytes)
    per_shard = max(1, -(-total // (shards * bucket_bytes)))
    rows = numbered.select("row", shard_of(F.col(f"row.`{key}`"), shards, seed).alias("shard"), F.xxhash64(F.lit(seed), F.col(f"row.`{key}`"), F.col(f"row.`{text}`"), "copy").alias("scatter"))
    scattered = (
        rows.withColumn("bucket", F.pmod(F.xxhash64("scatter", F.lit(seed + 1)), F.lit(per_shard)).cast("int"))
        .repartition(min(shards * per_shard, MOST_TASKS), "shard", "bucket")
        .sortWithinPartitions("shard", "bucket", "scatter")
    )
    mixed = scattered.groupBy("shard", "bucket").agg(F.shuffle(F.collect_list("row"), F.lit(seed)).alias("rows"))
    written = mixed.select("shard", "bucket", F.posexplode("rows").alias("at", "row")).sortWithinPartitions("shard", "bucket", "at")
    path = path or work_dir(spark, "shards")
    with without_leftovers(spark), setting(spark, "spark.sql.execution.useObjectHashAggregateExec", "false"):  # by order: one bucket in memory
        written.write.partitionBy("shard").parquet(path)
    buckets = spark.read.schema(written.schema).parquet(path)
    in_shard = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    before = buckets.groupBy("shard", "bucket").count().select("shard", "bucket", F.coalesce(F.sum("count").over(in_shard), F.lit(0)).alias("first"))
    if shards * per_shard <= BROADCAST_BUCKETS:
        before = F.broadcast(before)
    return buckets.join(before, ["shard", "bucket"]).select(
        *[F.col(f"row.`{c}`").alias(c) for c in names],
        (text_bytes(F.col(f"row.`{text}`")) + 8).alias("size"),
        "shard",
        (F.col("first") + F.col("at")).cast("bigint").alias("slot"),
        shard_of(F.col(f"row.`{key}`"), shards + 1, seed).alias("grown_shard"),
    )


def digest(shuffled: DataFrame) -> DataFrame:
    return shuffled.select("doc_id", "size", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")
