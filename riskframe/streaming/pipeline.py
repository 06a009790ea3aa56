"""Streaming sinks, late-label stream join and incremental sync (S6-S8), plus a runner.

Checkpoints always go under the shared ``spark.checkpoint.dir`` (read from the
session); a run survives executor loss and restarts from its checkpoint.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..session import checkpoint_dir


def checkpoint_for(spark, name: str, fresh: bool = False) -> str:
    """Checkpoint folder of stream ``name`` under the shared checkpoint dir. Stable by default,
    so a restarted query resumes where it stopped; ``fresh`` gives a new folder for one-shot
    runs that must read their whole input every time (evaluation queries)."""
    leaf = f"{name}-{uuid.uuid4().hex[:8]}" if fresh else name
    return os.path.join(checkpoint_dir(spark), "streams", leaf)


def run_available_now(df: DataFrame, name: str) -> DataFrame:
    """Run a streaming DataFrame (append) over everything available now into a file sink in the run's
    own folder under the shared checkpoint dir; return what it wrote."""
    spark = df.sparkSession
    folder = checkpoint_for(spark, name, fresh=True)
    path, schema = os.path.join(folder, "out"), StructType([StructField(f.name, f.dataType) for f in df.schema])
    spark.createDataFrame([], schema).write.parquet(path)    # a stream without input writes nothing
    q = (df.writeStream.outputMode("append").format("parquet").option("path", path)
         .option("checkpointLocation", os.path.join(folder, "state")).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(schema).parquet(path)


def write_log_batch(batch: DataFrame, batch_id: int, path: str, partition_by=("log_date",)) -> None:
    """Idempotent micro-batch write: the batch lands in its own (partition..., batch_id)
    folders and replaces exactly those (dynamic partition overwrite), so a batch re-run
    after a failure between write and commit leaves one copy, never two."""
    batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite") \
         .option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by, "batch_id").parquet(path)


def append_log(df: DataFrame, path: str, name: str, partition_by=("log_date",)):
    """Prediction log as a stream appended to a date-partitioned parquet table.

    The checkpoint (stable per ``name``, in the shared folder) makes a restarted query
    resume after its last committed batch; :func:`write_log_batch` makes a re-delivered
    batch replace its own output, so the log is exactly-once across restarts."""
    spark = df.sparkSession

    def write(batch: DataFrame, batch_id: int):
        write_log_batch(batch, batch_id, path, partition_by)

    d = df.withColumn("log_date", F.to_date("predicted_at")) if "log_date" not in df.columns else df
    return (d.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_for(spark, name))
            .trigger(availableNow=True).start())


def late_label_stream_join(preds: DataFrame, labels: DataFrame, key: str, pred_ts: str, label_ts: str,
                           max_delay: str = "30 days", watermark: str = "1 day") -> DataFrame:
    """Stream-stream left outer join: a label counts when it arrives within ``max_delay`` after
    the prediction; both sides watermarked so join state is bounded."""
    p = preds.withWatermark(pred_ts, watermark).alias("p")
    lab = labels.withWatermark(label_ts, watermark).alias("l")
    cond = (F.col(f"p.{key}") == F.col(f"l.{key}")) & \
           (F.col(f"l.{label_ts}") >= F.col(f"p.{pred_ts}")) & \
           (F.col(f"l.{label_ts}") <= F.col(f"p.{pred_ts}") + F.expr(f"INTERVAL {max_delay}"))
    return p.join(lab, cond, "leftOuter")


def late_labels(preds: DataFrame, labels: DataFrame, key: str, pred_ts: str, label_ts: str, truth: str,
                max_delay: str = "30 days", watermark: str = "1 day") -> DataFrame:
    """The rows of ``preds`` with the ``truth`` and ``label_ts`` of a label in time, else null."""
    j = late_label_stream_join(preds, labels.select(key, label_ts, truth), key, pred_ts, label_ts, max_delay, watermark)
    return j.select("p.*", f"l.{truth}", f"l.{label_ts}")


def append_stream(df: DataFrame, path: str, name: str):
    """Start a stream into a parquet folder; a restart under the same ``name`` goes on where it stopped."""
    return (df.writeStream.outputMode("append").format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint_for(df.sparkSession, name)).trigger(availableNow=True).start())


def dedup_redelivered(stream: DataFrame, key: str, modified: str, delay: str = "1 day", landed: str | None = None) -> DataFrame:
    """Drop re-delivered (id, modified) records within the watermark delay of ``landed`` (of
    ``modified`` if none is given: then records older than the watermark are dropped as late)."""
    return stream.withWatermark(landed or modified, delay).dropDuplicatesWithinWatermark([key, modified])


def upsert_view(history: DataFrame, key: str, modified: str) -> DataFrame:
    """S8 read side: latest version per id (partial aggregate, skew-safe)."""
    others = [c for c in history.columns if c != key]
    return history.groupBy(key).agg(F.max_by(F.struct(*others), F.col(modified)).alias("__r")).select(key, "__r.*")
