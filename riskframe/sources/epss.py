"""Exploit-probability feeds: bulk CSV, API items, ordered and filtered scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_SCHEMA = T.StructType([T.StructField("c0", T.StringType()), T.StructField("c1", T.StringType()),
                           T.StructField("c2", T.StringType())])


def _clean(df: DataFrame, snapshot_date) -> DataFrame:
    """Shared rules: skip header ('cve'), need three fields, trim, skip non-numeric rows, stamp date."""
    d = df.where(F.col("c0").isNotNull() & (F.col("c0") != "cve") & F.col("c2").isNotNull())
    cve = F.trim(F.col("c0"))
    score = F.trim(F.col("c1")).try_cast("double")
    pct = F.trim(F.col("c2")).try_cast("double")
    stamp = snapshot_date if not isinstance(snapshot_date, str) else F.lit(snapshot_date).cast("date")
    return d.select(cve.alias("cve_id"), score.alias("score"), pct.alias("percentile"),
                    stamp.alias("snapshot_date")).where(F.col("score").isNotNull() & F.col("percentile").isNotNull())


def read_bulk_csv(spark: SparkSession, path: str, snapshot_date: str, min_partitions: int | None = None) -> DataFrame:
    """Bulk CSV (gz allowed): '#' comment lines and blank lines skipped, header row dropped,
    rows with fewer than 3 fields or non-numeric values skipped. A .gz file is not splittable,
    so the scan is repartitioned when ``min_partitions`` is given."""
    raw = spark.read.schema(RAW_SCHEMA).option("comment", "#").option("header", False) \
        .option("mode", "PERMISSIVE").csv(path)
    if min_partitions:
        raw = raw.repartition(min_partitions)
    return _clean(raw, snapshot_date)


def parse_lines(df: DataFrame, line_col: str, snapshot_date) -> DataFrame:
    """A9 on a column of CSV text lines (same rules; blank and '#' lines skipped)."""
    s = F.col(line_col)
    d = df.where(s.isNotNull() & (F.trim(s) != "") & ~s.startswith("#"))
    parts = F.split(s, ",", -1)
    stamp = snapshot_date if not isinstance(snapshot_date, str) else F.lit(snapshot_date).cast("date")
    d = d.select(F.try_element_at(parts, F.lit(1)).alias("c0"), F.try_element_at(parts, F.lit(2)).alias("c1"),
                 F.try_element_at(parts, F.lit(3)).alias("c2"), stamp.alias("__d"))
    return _clean(d, F.col("__d"))


API_ITEM_SCHEMA = T.StructType([T.StructField("cve", T.StringType()), T.StructField("epss", T.StringType()),
                                T.StructField("percentile", T.StringType()), T.StructField("date", T.StringType())])


def normalise_api_items(df: DataFrame, today: str) -> DataFrame:
    """A10: missing id -> '', date -> ``today`` (an argument), score/percentile -> 0.0."""
    return df.select(F.coalesce(F.col("cve"), F.lit("")).alias("cve_id"),
                     F.coalesce(F.col("date"), F.lit(today)).alias("score_date"),
                     F.coalesce(F.col("epss").try_cast("double"), F.lit(0.0)).alias("epss_score"),
                     F.coalesce(F.col("percentile").try_cast("double"), F.lit(0.0)).alias("percentile"))


def scores_on(df: DataFrame, snapshot_date: str) -> DataFrame:
    """One snapshot (partition-pruned when the table is partitioned by date)."""
    return df.where(F.col("snapshot_date") == F.lit(snapshot_date).cast("date"))


def high_risk(df: DataFrame, min_score: float = 0.1, order: bool = True) -> DataFrame:
    """Strictly above ``min_score`` (pushed to the Parquet scan), highest first."""
    d = df.where(F.col("score") > F.lit(min_score))
    return d.orderBy(F.col("score").desc(), F.col("cve_id")) if order else d


def lookup(df: DataFrame, ids: DataFrame, snapshot_date: str | None = None, key: str = "cve_id") -> DataFrame:
    """Scores for an id list, optionally on one date (left semi join)."""
    d = scores_on(df, snapshot_date) if snapshot_date else df
    return d.join(ids.select(key), key, "left_semi")
