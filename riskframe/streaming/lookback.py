"""Prediction log as a stream with per-day counts, and drift over a look-back of days.

Each micro-batch appends its rows to the date-partitioned log and its counts per (day, feature,
value) to a counts table, both in folders of their own batch, so a batch that runs again after a
failure replaces its output. Counts merge by addition: a look-back of seven days reads seven days of
counts and never the log, and no event is read again however often the job runs.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift as D
from .pipeline import checkpoint_for, write_log_batch


def day_counts(rows: DataFrame, features: list[str]) -> DataFrame:
    """(log_date, feature, value, n) of rows with ``log_date``; nulls and NaN are left out."""
    long = rows.select("log_date", F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features])))
    return long.where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy("log_date", "feature", "value").agg(F.count(F.lit(1)).alias("n"))


def log_and_count(stream: DataFrame, ts: str, features: list[str], path: str, name: str):
    """Start the stream: log rows under ``path``/log, day counts under ``path``/counts. A restart under
    the same ``name`` goes on after the last committed batch."""
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int):
        rows = batch.withColumn("log_date", F.to_date(ts))
        write_log_batch(rows, batch_id, f"{path}/log")
        write_log_batch(day_counts(rows, features), batch_id, f"{path}/counts")

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_for(spark, name))
            .trigger(availableNow=True).start())


def counts_between(spark: SparkSession, path: str, start: str | None, end: str) -> DataFrame:
    """(feature, value, n) of the days [start, end); the filter on the partition column prunes the rest."""
    days = spark.read.parquet(f"{path}/counts").where(F.col("log_date") < F.lit(end).cast("date"))
    if start:
        days = days.where(F.col("log_date") >= F.lit(start).cast("date"))
    return days.groupBy("feature", "value").agg(F.sum("n").alias("n"))


def lookback_drift(spark: SparkSession, path: str, as_of: str, days: int = 7) -> DataFrame:
    """(feature, psi, n_ref, n_cur, ks_statistic): the ``days`` before ``as_of`` against all days before them."""
    start = str(datetime.date.fromisoformat(as_of) - datetime.timedelta(days=days))
    ref, cur = counts_between(spark, path, None, start), counts_between(spark, path, start, as_of)
    both = ref.select("feature", "value", F.col("n").alias("r"), F.lit(0).cast("long").alias("q")).unionByName(
        cur.select("feature", "value", F.lit(0).cast("long").alias("r"), F.col("n").alias("q")))
    return D.drift_of_counts(both)
