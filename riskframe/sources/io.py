"""Readers and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scalars import attach


def read_any(spark: SparkSession, path: str, csv_schema=None) -> DataFrame:
    """Parquet by extension (a file, or a folder holding such files at any depth), else CSV with header.

    A declared ``csv_schema`` avoids inference; without one every column is a string.
    """
    if path.rstrip("/").endswith(".parquet") or _holds(spark, path, ".parquet"):
        return spark.read.parquet(path)
    r = spark.read.option("header", True)
    return (r.schema(csv_schema) if csv_schema is not None else r).csv(path)


def _file_system(spark: SparkSession, path: str):
    """The path and its file system, local or remote, as Spark itself opens it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _holds(spark: SparkSession, path: str, ext: str) -> bool:
    """Whether a file below ``path`` has the extension; looks no further than the first data file."""
    p, fs = _file_system(spark, path)
    files = fs.listFiles(p, True) if fs.exists(p) else None
    while files is not None and files.hasNext():
        name = files.next().getPath().getName()
        if not name.startswith(("_", ".")):
            return name.endswith(ext)
    return False


def first_existing(spark: SparkSession, candidates: list[str], csv_schema=None) -> DataFrame | None:
    """A15 fallback: the first candidate that exists and has at least one row."""
    for c in candidates:
        p, fs = _file_system(spark, c)
        if fs.exists(p):
            df = read_any(spark, c, csv_schema)
            if not df.isEmpty():
                return df
    return None


def id_column(df: DataFrame, preferred: str = "cve_id") -> str:
    """Id column name, falling back to the first column."""
    return preferred if preferred in df.columns else df.columns[0]


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite",
                fmt: str = "parquet") -> None:
    """Parquet (default) or csv sink, optionally partitioned (date/year partitions prune reads)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)


def report_json(df: DataFrame) -> DataFrame:
    """Report rows as JSON text (one object per row)."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def prediction_log_rows(scored: DataFrame, key: str, version: str, prediction: str, confidence: str,
                        features: list[str], predicted_at) -> DataFrame:
    """Rows to append to the prediction log: confidence rounded to 4 dp, payload JSON."""
    return scored.select(F.col(key).alias("cve_id"), F.lit(version).alias("model_version"),
                         predicted_at.alias("predicted_at"), F.col(prediction).alias("prediction"),
                         F.round(F.col(confidence), 4).alias("confidence"),
                         F.to_json(F.struct(*features)).alias("features_snapshot"))


def feedback_rows(df: DataFrame, submitted_at) -> DataFrame:
    """Feedback rows: labels upper-cased, rating restricted to 1..5 (others rejected), unused."""
    return df.select("cve_id", "analyst_id", F.upper("predicted_severity").alias("predicted_severity"),
                     F.upper("corrected_severity").alias("corrected_severity"), "feedback_notes",
                     F.col("confidence_rating").cast("int").alias("confidence_rating"),
                     F.lit(False).alias("used_for_retraining"), submitted_at.alias("submitted_at")) \
             .where(F.col("confidence_rating").between(1, 5))


def mark_used(ids: DataFrame, used_at) -> DataFrame:
    """Ledger rows appended instead of an in-place update."""
    return ids.select("id").distinct().withColumn("used_at", used_at)


def ingestion_accounting(batch: DataFrame, inserted: DataFrame, source: str, key: str = "cve_id") -> DataFrame:
    """One accounting row per batch (fetched, inserted, updated, status)."""
    f = batch.agg(F.count(F.lit(1)).alias("records_fetched"))
    i = inserted.agg(F.count(F.lit(1)).alias("records_inserted"))
    return attach(f, i).select(F.lit(source).alias("source"), "records_fetched", "records_inserted",
                                 (F.col("records_fetched") - F.col("records_inserted")).alias("records_updated"),
                                 F.lit("success").alias("status"))
