"""Streaming monitors (S1-S8): batch twins with oracles, and stream runs.

The batch twins call exactly the functions the streams use; the stream runs
read the events table through the file source, watermark it, and run with an
``availableNow`` trigger into a file sink (append mode: only windows closed
by the watermark are emitted, so their rows are a subset of the batch twin).
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions._util import round_half_away as rnd
from ..session import read_table
from ..streaming import alerts as AL
from ..streaming import lookback as LB
from ..streaming import pipeline as P
from ..streaming import sync as SY
from ..streaming import windows as W
from . import monitoring as MO
from . import sqlfrag as S

R9 = 9


def _ntz(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


def request_rate_1m(spark: SparkSession, sf_dir: str):
    """S1 batch twin: requests per minute and per second."""
    r = W.request_rate(read_table(spark, sf_dir, "events"), "ts", "1 minute", 60)
    return _ntz(r, "window_start", "window_end").select("window_start", "window_end", "n",
                                                        rnd("rate_per_sec", R9).alias("rate_per_sec"))


RATE_SQL = f"""SELECT time_bucket(INTERVAL 1 minute, ts) AS window_start, time_bucket(INTERVAL 1 minute, ts) + INTERVAL 1 minute AS window_end,
  count(*) AS n, {S.round_dp("count(*) / 60.0", R9)} AS rate_per_sec FROM events GROUP BY 1, 2"""


def latency_quantiles_5m(spark, sf_dir):
    """S2 batch twin: p50/p95 latency per 5 minutes."""
    log = X.predictions_log(spark, sf_dir)
    r = W.latency_quantiles(log, "latency_ms", "predicted_at", "5 minutes")
    return _ntz(r, "window_start", "window_end").select("window_start", "window_end", "n",
                                                        rnd("p50", R9).alias("p50"), rnd("p95", R9).alias("p95"))


LATQ_SQL = X.with_views("predictions_log") + f"""
SELECT time_bucket(INTERVAL 5 minute, predicted_at) AS window_start, time_bucket(INTERVAL 5 minute, predicted_at) + INTERVAL 5 minute AS window_end,
  count(*) AS n, {S.round_dp("quantile_cont(latency_ms, 0.5)", R9)} AS p50, {S.round_dp("quantile_cont(latency_ms, 0.95)", R9)} AS p95
FROM predictions_log GROUP BY 1, 2"""


def severity_mix_1h(spark, sf_dir):
    """S3 batch twin: predicted label counts per hour."""
    log = X.predictions_log(spark, sf_dir)
    return _ntz(W.label_mix(log, "prediction", "predicted_at", "1 hour"), "window_start", "window_end")


MIX_SQL = X.with_views("predictions_log") + """
SELECT time_bucket(INTERVAL 1 hour, predicted_at) AS window_start, time_bucket(INTERVAL 1 hour, predicted_at) + INTERVAL 1 hour AS window_end,
  prediction, count(*) AS n FROM predictions_log GROUP BY 1, 2, 3"""


def error_ratio_5m(spark, sf_dir):
    """S4 batch twin: error share per sliding 5-minute window (1-minute slide), alert above 5%."""
    r = W.error_ratio(read_table(spark, sf_dir, "events"), F.col("event_type") == "error", "ts")
    return _ntz(r, "window_start", "window_end").select("window_start", "window_end", "n_error", "n",
                                                        rnd("error_ratio", R9).alias("error_ratio"), "alert")


ERR_SQL = f"""WITH x AS (SELECT date_trunc('minute', ts) - INTERVAL (k) MINUTE AS window_start, event_type
  FROM events, (SELECT unnest(range(5)) AS k))
SELECT window_start, window_start + INTERVAL 5 minute AS window_end, count(*) FILTER (WHERE event_type = 'error') AS n_error,
  count(*) AS n, {S.round_dp("count(*) FILTER (WHERE event_type = 'error') / count(*)", R9)} AS error_ratio,
  count(*) FILTER (WHERE event_type = 'error') / count(*) > 0.05 AS alert FROM x GROUP BY 1, 2"""

HELD = {"threshold": 0.3, "hold": 2, "step": 3600}


def held_error_alerts(spark, sf_dir):
    """S5 batch twin: hourly error share above 30% held for 2 consecutive hours."""
    e = read_table(spark, sf_dir, "events").withColumn("series", F.lit("all"))
    per = e.groupBy("series", F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w")).agg(
        (F.count_if(F.col("event_type") == "error") / F.count(F.lit(1))).alias("ratio")) \
        .select("series", F.col("w.start").alias("window_start"), "ratio")
    a = AL.held_alerts(per, "series", "window_start", "ratio", HELD["threshold"], HELD["hold"], HELD["step"])
    return _ntz(a, "run_start", "fired_at")


HELD_SQL = f"""WITH per AS (SELECT 'all' AS series, time_bucket(INTERVAL 1 hour, ts) AS ws,
  count(*) FILTER (WHERE event_type = 'error') / count(*) AS ratio FROM events GROUP BY 1, 2),
b AS (SELECT series, ws, CAST(epoch(ws) AS BIGINT) // 3600 - row_number() OVER (PARTITION BY series ORDER BY ws) AS grp
  FROM per WHERE ratio > {HELD['threshold']}),
runs AS (SELECT series, grp, min(ws) AS run_start, count(*) AS run_windows FROM b GROUP BY series, grp)
SELECT series, run_start, run_start + INTERVAL {HELD['hold'] - 1} HOUR AS fired_at, run_windows FROM runs WHERE run_windows >= {HELD['hold']}"""


def stream_request_rate(spark, sf_dir):
    """S1 as a stream: file source -> watermark -> 1-minute counts -> file sink (append)."""
    s = W.with_watermark(W.events_stream(spark, sf_dir), "ts", "10 minutes")
    r = W.request_rate(s, "ts", "1 minute", 60)
    return P.run_available_now(r, "request_rate")


def stream_held_alerts(spark, sf_dir):
    """S5 as a stream: hourly counts of the events file source under a watermark, then a sliding
    aggregation over their rows. One series, as in the batch twin; only window rows meet in its group."""
    s = W.events_stream(spark, sf_dir).withColumn("series", F.lit("all"))
    a = AL.held_alerts_stream(s, "series", "ts", F.col("event_type") == "error", HELD["step"],
                              HELD["threshold"], HELD["hold"])
    return P.run_available_now(a, "held_alerts")


LOOKBACK_DAYS = 7


def _logged(spark, sf_dir):
    e = W.events_stream(spark, sf_dir)
    return e.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", F.from_json("props", "k INT")["k"])


def lookback_drift(spark, sf_dir):
    """The prediction log written as a stream with its counts per day, then drift of the last
    seven days before the cut against all days before them, from the counts alone."""
    path = P.checkpoint_for(spark, "lookback", fresh=True)
    LB.log_and_count(_logged(spark, sf_dir), "ts", MO.NUMERIC, path, f"{path.rsplit('/', 1)[1]}-state").awaitTermination()
    r = LB.lookback_drift(spark, path, MO.CUT, LOOKBACK_DAYS)
    return r.select("feature", rnd("psi", R9).alias("psi"), "n_ref", "n_cur", rnd("ks_statistic", R9).alias("ks_statistic"))


_START = f"TIMESTAMP '{MO.CUT}' - INTERVAL {LOOKBACK_DAYS} DAY"
_LOOKBACK_SIDES = MO.SIDES_SQL.replace("FROM events)", f"FROM events WHERE ts < TIMESTAMP '{MO.CUT}')").replace(
    f"ts < TIMESTAMP '{MO.CUT}' THEN", f"ts < {_START} THEN")
LOOKBACK_SQL = f"""SELECT p.feature, p.psi, k.n_ref, k.n_cur, k.ks_statistic FROM ({MO.PSI_SQL.replace(MO.SIDES_SQL, _LOOKBACK_SIDES)}) p
JOIN ({MO.KS_SQL.replace(MO.SIDES_SQL, _LOOKBACK_SIDES)}) k USING (feature)"""

LABELS_CLOSED = "2024-01-20"


def late_labels_stream(spark, sf_dir):
    """Predictions and their labels as two streams, joined within three days under watermarks. Only
    predictions old enough for their range to be closed are returned: of these every one has its
    label or, once the watermark has passed, null."""
    preds = W.events_stream(spark, sf_dir).select("event_id", F.col("ts").cast("timestamp").alias("predicted_at"), F.col("event_type").alias("prediction"))
    labels = W.events_stream(spark, sf_dir).where(F.col("event_id") % 3 == 0).select(
        "event_id", (F.col("ts").cast("timestamp") + F.make_dt_interval(days=(F.col("event_id") % 5).cast("int"))).alias("labeled_at"),
        F.when(F.col("value") >= 50, "HIGH").otherwise("LOW").alias("truth"))
    out = P.run_available_now(P.late_labels(preds, labels, "event_id", "predicted_at", "labeled_at", "truth", "3 days", "1 day"), "late_labels")
    return _ntz(out.where(F.col("predicted_at") < F.lit(LABELS_CLOSED).cast("timestamp")), "predicted_at", "labeled_at")


LATE_LABELS_SQL = f"""WITH l AS (SELECT event_id, ts + to_days(CAST(event_id % 5 AS INTEGER)) AS labeled_at, CASE WHEN value >= 50 THEN 'HIGH' ELSE 'LOW' END AS truth
  FROM events WHERE event_id % 3 = 0)
SELECT e.event_id, e.ts AS predicted_at, e.event_type AS prediction, l.truth, l.labeled_at FROM events e LEFT JOIN l
  ON e.event_id = l.event_id AND l.labeled_at >= e.ts AND l.labeled_at <= e.ts + INTERVAL 3 DAY WHERE e.ts < TIMESTAMP '{LABELS_CLOSED}'"""


def _records(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = X.cves(spark, sf_dir).select("cve_id", "o_orderkey", "published_date", "base_score").join(o, "o_orderkey")
    return c.select("o_orderkey", "cve_id", F.date_add("published_date", (F.col("o_custkey") % 30).cast("int")).alias("last_modified"), "base_score")


def incremental_sync(spark, sf_dir):
    """Two deliveries of the feed synced by two runs of one stream. The second brings the other
    half of the records, repeats every fifth and a newer version of every third."""
    path = P.checkpoint_for(spark, "sync", fresh=True)
    r, key = _records(spark, sf_dir), F.col("o_orderkey")
    newer = r.where(key % 3 == 0).withColumn("last_modified", F.date_add("last_modified", 60)).withColumn("base_score", F.col("base_score") + 0.5)
    pages = [r.where(key % 2 == 0), r.where((key % 2 != 0) | (key % 5 == 0)).unionByName(newer)]
    schema = "cve_id string, last_modified date, base_score double, landed timestamp"
    for day, page in enumerate(pages, 1):
        page.select("cve_id", "last_modified", "base_score", F.lit(f"2024-01-0{day} 00:00:00").cast("timestamp").alias("landed")) \
            .write.mode("append").parquet(f"{path}/pages")
        stream = spark.readStream.schema(schema).parquet(f"{path}/pages")
        SY.sync(stream, f"{path}/table", f"{path.rsplit('/', 1)[1]}-state", "cve_id", "last_modified", "landed").awaitTermination()
    return spark.read.parquet(f"{path}/table").select("cve_id", "last_modified", "base_score")


_RECORDS_SQL = X.with_views("cves") + """,
r AS (SELECT c.o_orderkey, c.cve_id, c.published_date + CAST(o.o_custkey % 30 AS INTEGER) AS last_modified, c.base_score FROM cves c JOIN orders o USING (o_orderkey))
"""
SYNC_SQL = _RECORDS_SQL + """SELECT cve_id, CASE WHEN o_orderkey % 3 = 0 THEN last_modified + 60 ELSE last_modified END AS last_modified,
  CASE WHEN o_orderkey % 3 = 0 THEN base_score + 0.5 ELSE base_score END AS base_score FROM r"""

STORED_UNTIL = "1997-12-31"


def resumed_fetch(spark, sf_dir):
    """A1: what a fetch must bring that resumes at the high-water mark of the records stored so far."""
    r = _records(spark, sf_dir)
    stored = r.where(F.col("last_modified") <= F.lit(STORED_UNTIL).cast("date"))
    return SY.since_mark(r, stored, "last_modified").select("cve_id", "last_modified")


RESUMED_SQL = _RECORDS_SQL + f"""SELECT cve_id, last_modified FROM r
WHERE last_modified >= (SELECT max(last_modified) FROM r WHERE last_modified <= DATE '{STORED_UNTIL}')"""

QUERIES = {
    "lookback_drift": (lookback_drift, LOOKBACK_SQL),
    "late_labels_stream": (late_labels_stream, LATE_LABELS_SQL),
    "incremental_sync": (incremental_sync, SYNC_SQL),
    "resumed_fetch": (resumed_fetch, RESUMED_SQL),
    "request_rate_1m": (request_rate_1m, RATE_SQL),
    "latency_quantiles_5m": (latency_quantiles_5m, LATQ_SQL),
    "severity_mix_1h": (severity_mix_1h, MIX_SQL),
    "error_ratio_5m": (error_ratio_5m, ERR_SQL),
    "held_error_alerts": (held_error_alerts, HELD_SQL),
    "stream_request_rate": (stream_request_rate, None),
    "stream_held_alerts": (stream_held_alerts, None),
}
