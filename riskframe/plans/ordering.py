"""Ordered-split and history plans."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import dates as DT
from ..functions._util import round_half_away as rnd
from ..operators import splits as SP
from . import sqlfrag as S

R9 = 9
REF_TS = "2002-01-01 00:00:00"      # reference instant for elapsed-day features (argument)


def _cves_ordered(spark, sf_dir):
    c = X.cves(spark, sf_dir)
    return c.withColumn("year_published", F.year("published_date"))


def temporal_split(spark: SparkSession, sf_dir: str):
    """70/15/15 split by (year, published date, id) rank."""
    c = _cves_ordered(spark, sf_dir)
    r = SP.temporal_split(c, ["year_published", "published_date"], ["cve_id"])
    return r.select("cve_id", "rank", "split")


def _split_sql(train=0.70, val=0.15) -> str:
    return X.with_views("cves") + f""",
r AS (SELECT cve_id, row_number() OVER (ORDER BY year(published_date), published_date, cve_id) - 1 AS rank,
  count(*) OVER () AS n FROM cves)
SELECT cve_id, rank, CASE WHEN rank < floor(n * {S.dbl(train)}) THEN 'train'
  WHEN rank < floor(n * {S.dbl(train + val)}) THEN 'val' ELSE 'test' END AS split FROM r"""


def walk_forward_folds(spark, sf_dir, n_folds: int = 5):
    """Per fold and role, row count and date range."""
    c = _cves_ordered(spark, sf_dir)
    f = SP.walk_forward_folds(c, ["year_published", "published_date"], ["cve_id"], n_folds)
    return f.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.min("published_date").alias("first_date"),
                                         F.max("published_date").alias("last_date"))


def _folds_sql(k=5) -> str:
    return X.with_views("cves") + f""",
r AS (SELECT cve_id, published_date, row_number() OVER (ORDER BY year(published_date), published_date, cve_id) - 1 AS rank,
  count(*) OVER () AS n FROM cves),
s AS (SELECT *, n // {k + 1} AS size FROM r),
x AS (SELECT s.*, f.fold, CASE WHEN rank < size * f.fold THEN 'train'
  WHEN rank < least(size * (f.fold + 1), n) THEN 'val' END AS role,
  least(size * (f.fold + 1), n) > size * f.fold AS nonempty
  FROM s, (SELECT CAST(unnest(range(1, {k + 1})) AS INTEGER) AS fold) f)
SELECT fold, role, count(*) AS n, min(published_date) AS first_date, max(published_date) AS last_date
FROM x WHERE role IS NOT NULL AND nonempty GROUP BY fold, role"""


def holdout_split(spark, sf_dir):
    """First 80% by date order -> train."""
    c = _cves_ordered(spark, sf_dir)
    r = SP.holdout_split(c, ["year_published", "published_date"], ["cve_id"])
    return r.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.max("published_date").alias("last_date"))


def _holdout_sql() -> str:
    return X.with_views("cves") + f""",
r AS (SELECT published_date, row_number() OVER (ORDER BY year(published_date), published_date, cve_id) - 1 AS rank,
  count(*) OVER () AS n FROM cves)
SELECT CASE WHEN rank < floor(n * {S.dbl(0.8)}) THEN 'train' ELSE 'test' END AS split, count(*) AS n,
  max(published_date) AS last_date FROM r GROUP BY 1"""


def score_history(spark, sf_dir):
    """E5: per id previous score, delta and latest flag."""
    h = X.epss_history(spark, sf_dir)
    r = SP.score_history(h, "cve_id", "snapshot_date", "score")
    return r.select("cve_id", "snapshot_date", "score", "prev_value", rnd("delta", R9).alias("delta"), "is_latest")


HISTORY_SQL = X.with_views("epss_history") + f"""
SELECT cve_id, snapshot_date, score, lag(score) OVER (PARTITION BY cve_id ORDER BY snapshot_date) AS prev_value,
  {S.round_dp("score - lag(score) OVER (PARTITION BY cve_id ORDER BY snapshot_date)", R9)} AS delta,
  row_number() OVER (PARTITION BY cve_id ORDER BY snapshot_date DESC) = 1 AS is_latest FROM epss_history"""


def score_trend(spark, sf_dir):
    """E5 trend: least-squares slope per id (partial aggregates)."""
    h = X.epss_history(spark, sf_dir)
    t = SP.trend(h, "cve_id", "snapshot_date", "score")
    # + 0.0 folds a negative zero into 0.0
    return t.select("cve_id", (rnd("slope_per_day", R9) + F.lit(0.0)).alias("slope_per_day"), "n", "latest",
                    "latest_date")


TREND_SQL = X.with_views("epss_history") + f""",
g AS (SELECT cve_id, CAST(count(*) AS HUGEINT) AS n,
  sum(CAST(date_diff('day', DATE '1970-01-01', snapshot_date) AS HUGEINT)) AS sx,
  sum(CAST(round(score * 1000000000.0, 0) AS HUGEINT)) AS sy,
  sum(CAST(date_diff('day', DATE '1970-01-01', snapshot_date) AS HUGEINT) * CAST(round(score * 1000000000.0, 0) AS HUGEINT)) AS sxy,
  sum(CAST(date_diff('day', DATE '1970-01-01', snapshot_date) AS HUGEINT) * CAST(date_diff('day', DATE '1970-01-01', snapshot_date) AS HUGEINT)) AS sxx,
  max_by(score, snapshot_date) AS latest, max(snapshot_date) AS latest_date FROM epss_history GROUP BY cve_id),
s AS (SELECT *, CAST(n * sxy - sx * sy AS DOUBLE) AS num, CAST(n * sxx - sx * sx AS DOUBLE) AS den FROM g)
SELECT cve_id, {S.round_dp("CASE WHEN den <> 0 THEN num / den / 1000000000.0 END", R9)} + 0.0 AS slope_per_day,
  CAST(n AS BIGINT) AS n, latest, latest_date FROM s"""


def temporal_features(spark, sf_dir):
    """Lenient parse of the ISO publication text, elapsed days (floor), quarter, year, recency."""
    c = X.cves(spark, sf_dir)
    iso = F.concat(F.date_format("published_date", "yyyy-MM-dd"), F.lit("T12:30:00.000Z"))
    f = DT.temporal_features(iso, REF_TS)
    return c.select("cve_id", *[v.alias(k) for k, v in f.items()])


TEMPORAL_SQL = X.with_views("cves") + f""",
p AS (SELECT cve_id, try_cast(replace(split_part(strftime(published_date, '%Y-%m-%d') || 'T12:30:00.000Z', '.', 1), 'Z', '') AS TIMESTAMP) AS pub FROM cves),
d AS (SELECT cve_id, pub, CAST(floor((epoch_us(TIMESTAMP '{REF_TS}') - epoch_us(pub)) / 86400000000.0) AS BIGINT) AS dd FROM p)
SELECT cve_id, CASE WHEN pub IS NULL THEN 0 ELSE greatest(0, dd) END AS days_since_published,
  coalesce(CAST(quarter(pub) AS INTEGER), 1) AS quarter_published, coalesce(CAST(year(pub) AS INTEGER), 2024) AS year_published,
  CASE WHEN pub IS NULL THEN 0 ELSE CAST(dd < 90 AS INTEGER) END AS is_recent FROM d"""


QUERIES = {
    "temporal_split": (temporal_split, _split_sql()),
    "walk_forward_folds": (walk_forward_folds, _folds_sql()),
    "holdout_split": (holdout_split, _holdout_sql()),
    "score_history": (score_history, HISTORY_SQL),
    "score_trend": (score_trend, TREND_SQL),
    "temporal_features": (temporal_features, TEMPORAL_SQL),
}
