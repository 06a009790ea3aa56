"""Threshold alerts held for a duration.

Batch: gaps-and-islands over per-window metric rows, windowed per series key.
Stream: Spark counts events per (series, window) under a watermark, which drops
late events of closed windows; a second, sliding aggregation over the closed
windows' rows fires once when a run reaches the hold length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import with_watermark


def held_alerts(per_window: DataFrame, key: str, start: str, metric: str, threshold: float,
                hold: int, step_seconds: int) -> DataFrame:
    """Batch S5: runs of consecutive windows (``step_seconds`` apart) with metric > threshold;
    one alert per run of length >= ``hold``: (key, run_start, fired_at, run_windows)."""
    b = per_window.where(F.col(metric) > threshold).select(
        key, F.col(start).cast("timestamp").alias("__s"))
    idx = (F.unix_seconds("__s") / F.lit(step_seconds)).cast("long")
    w = Window.partitionBy(key).orderBy("__s")    # per series; rows are window results, not events
    b = b.withColumn("__grp", idx - F.row_number().over(w))
    runs = b.groupBy(key, "__grp").agg(F.min("__s").alias("run_start"), F.count(F.lit(1)).alias("run_windows"))
    return runs.where(F.col("run_windows") >= hold).select(
        key, "run_start",
        (F.col("run_start") + F.make_dt_interval(secs=F.lit((hold - 1) * step_seconds))).alias("fired_at"),
        "run_windows")


def held_alerts_stream(events: DataFrame, key: str, ts: str, hit, step_seconds: int, ratio_threshold: float,
                       hold: int, delay: str = "10 minutes") -> DataFrame:
    """Streaming S5: per series, alert once the hit ratio per ``step_seconds`` window stays above
    ``ratio_threshold`` for ``hold`` consecutive windows. Output mode append.

    The events of each (series, window) are counted first; a window counts once the watermark (``delay``
    behind the latest event of any series) passes its end. An alert is due where, of ``hold + 1`` windows
    in a row, all but the first are above the threshold: a longer run has only one such place."""
    h = hit if not isinstance(hit, str) else F.col(hit)
    d = with_watermark(events, ts, delay).select(F.col(key).cast("string").alias("series"), ts, h.alias("hit"))
    per = d.groupBy("series", F.window(ts, f"{step_seconds} seconds").alias("w")).agg(
        (F.count_if("hit") / F.count(F.lit(1))).alias("ratio"))
    above = per.where(F.col("ratio") > ratio_threshold).select(
        "series", F.window_time("w").alias("at"), F.col("w.start").alias("start"))
    rows = above.groupBy("series", F.window("at", f"{(hold + 1) * step_seconds} seconds", f"{step_seconds} seconds").alias("span")) \
        .agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("run_start"))
    due = rows.where((F.col("n") == hold) & (F.col("run_start") > F.col("span.start")))
    return due.select("series", "run_start",
                      (F.col("run_start") + F.make_dt_interval(secs=F.lit((hold - 1) * step_seconds))).alias("fired_at"))
