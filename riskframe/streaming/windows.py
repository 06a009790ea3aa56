"""Event-time windowed monitors (S1-S4). Every function is ``DataFrame -> DataFrame`` and works
unchanged on a static DataFrame (the batch twin) or a streaming one; streaming callers add a
watermark first (:func:`with_watermark`) so window state is dropped once a window closes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import read_table


def events_stream(spark, sf_dir: str, table: str = "events", max_files_per_trigger: int | None = None) -> DataFrame:
    """File-source stream over a table's parquet file(s) with the batch schema (never inferred)."""
    schema = read_table(spark, sf_dir, table).schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(sf_dir)


def with_watermark(df: DataFrame, ts: str, delay: str = "10 minutes") -> DataFrame:
    """Watermark on ``ts`` for streams (event time must be a session-zone TIMESTAMP); batch: no-op."""
    if not df.isStreaming:
        return df
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def _win(df: DataFrame, ts: str, duration: str, slide: str | None = None):
    # a watermarked column must be windowed as is (a cast would hide the watermark)
    t = F.col(ts) if dict(df.dtypes)[ts] == "timestamp" else F.col(ts).cast("timestamp")
    return F.window(t, duration, slide) if slide else F.window(t, duration)


def request_rate(df: DataFrame, ts: str = "ts", duration: str = "1 minute", seconds: int = 60) -> DataFrame:
    """Requests per window and per second."""
    g = df.groupBy(_win(df, ts, duration).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n",
                    (F.col("n") / F.lit(float(seconds))).alias("rate_per_sec"))


def latency_quantiles(df: DataFrame, value: str, ts: str = "ts", duration: str = "5 minutes",
                      exact: bool = True) -> DataFrame:
    """p50 / p95 per window (exact linear percentile, or bounded-memory approximate)."""
    probs = [0.5, 0.95]
    pct = F.percentile(value, probs) if exact else F.percentile_approx(value, probs, 10000)
    g = df.groupBy(_win(df, ts, duration).alias("w")).agg(pct.alias("q"), F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n",
                    F.col("q")[0].alias("p50"), F.col("q")[1].alias("p95"))


def label_mix(df: DataFrame, label: str, ts: str = "ts", duration: str = "1 hour") -> DataFrame:
    """S3: count per label per window."""
    g = df.groupBy(_win(df, ts, duration).alias("w"), F.col(label)).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), label, "n")


def error_ratio(df: DataFrame, is_error, ts: str = "ts", duration: str = "5 minutes", slide: str = "1 minute",
                threshold: float = 0.05) -> DataFrame:
    """Share of errors per sliding window and the threshold flag."""
    e = is_error if not isinstance(is_error, str) else F.col(is_error)
    g = df.groupBy(_win(df, ts, duration, slide).alias("w")).agg(F.count_if(e).alias("n_error"),
                                                             F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n_error", "n",
                    (F.col("n_error") / F.col("n")).alias("error_ratio"),
                    ((F.col("n_error") / F.col("n")) > threshold).alias("alert"))
