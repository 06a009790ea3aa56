"""Incremental sync of landed pages into a table of one row per key.

Pages arrive as files; records come again when pages overlap or a run is repeated. The stream drops a
(key, modified) that it has seen within the watermark of the landing time, and each micro-batch is
merged into the table: only the hash buckets that it touches are read, merged by the newest version of
each key and written again. Merging is idempotent, so a batch that runs twice, or a page that is
delivered twice, changes nothing. The table itself is the high-water mark: the next fetch starts at
its newest modification.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .pipeline import checkpoint_for, dedup_redelivered

BUCKETS = 64


def newest(rows: DataFrame, key: str, modified: str) -> DataFrame:
    """One row per key: the newest, of equally new ones the greatest (a partial aggregate, so a key
    that comes very often is combined in its tasks)."""
    others = [c for c in rows.columns if c not in (key, modified)]
    return rows.groupBy(key).agg(F.max(F.struct(modified, *others)).alias("__r")).select(key, "__r.*").select(*rows.columns)


def read_synced(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The synced table; empty before its first batch."""
    try:
        return spark.read.schema(StructType([*schema.fields, StructField("bucket", IntegerType())])).parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], StructType([*schema.fields, StructField("bucket", IntegerType())]))


def upsert_batch(batch: DataFrame, batch_id: int, path: str, key: str, modified: str, buckets: int = BUCKETS) -> None:
    """Merge one micro-batch into the table at ``path``: touched buckets are merged into a staged table
    first and then replaced, as a table cannot be read while it is overwritten."""
    spark, schema = batch.sparkSession, batch.schema
    incoming = newest(batch, key, modified).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    incoming = incoming.persist()
    touched = [r["bucket"] for r in incoming.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
    if touched:
        old = read_synced(spark, path, schema).where(F.col("bucket").isin(touched))
        staged = f"{path}.staged/{batch_id}"
        merged = newest(old.unionByName(incoming).drop("bucket"), key, modified)
        merged.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).write.mode("overwrite").parquet(staged)
        spark.read.parquet(staged).repartition("bucket").write.mode("overwrite") \
            .option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    incoming.unpersist()


def sync(stream: DataFrame, path: str, name: str, key: str, modified: str, landed: str, delay: str = "7 days", buckets: int = BUCKETS):
    """Start the sync of a stream of records into ``path``; ``landed`` is the event time of the dedup."""
    seen = dedup_redelivered(stream, key, modified, delay, landed).drop(landed)
    return (seen.writeStream.foreachBatch(lambda b, i: upsert_batch(b, i, path, key, modified, buckets))
            .option("checkpointLocation", checkpoint_for(stream.sparkSession, name)).trigger(availableNow=True).start())


def since_mark(records: DataFrame, synced: DataFrame, modified: str) -> DataFrame:
    """Records that a fetch resuming from ``synced`` must bring: modified at or after its newest
    modification (all, if it is empty). Records at the mark come again; merging them changes nothing."""
    mark = synced.agg(F.max(modified).alias("__mark"))  # one row
    return records.join(F.broadcast(mark)).where(F.col("__mark").isNull() | (F.col(modified) >= F.col("__mark"))).drop("__mark")
