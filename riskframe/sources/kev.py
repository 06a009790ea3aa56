"""Known-exploited catalog: scan, normalise with defaults, digest, id set."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTRY_FIELDS = ["cveID", "vendorProject", "product", "vulnerabilityName", "dateAdded", "shortDescription",
                "requiredAction", "dueDate", "knownRansomwareCampaignUse", "notes"]
ENTRY_SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in ENTRY_FIELDS])
CATALOG_SCHEMA = T.StructType([
    T.StructField("catalogVersion", T.StringType()),
    T.StructField("dateReleased", T.StringType()),
    T.StructField("count", T.LongType()),
    T.StructField("vulnerabilities", T.ArrayType(ENTRY_SCHEMA)),
])
# output name, source field, default when missing
RENAMES = [("cve_id", "cveID", ""), ("vendor_project", "vendorProject", ""), ("product", "product", ""),
           ("vulnerability_name", "vulnerabilityName", ""), ("date_added", "dateAdded", ""),
           ("short_description", "shortDescription", ""), ("required_action", "requiredAction", ""),
           ("due_date", "dueDate", ""), ("known_ransomware_campaign_use", "knownRansomwareCampaignUse", "Unknown"),
           ("notes", "notes", "")]


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Catalog document(s) -> one row per entry (``inline`` of the vulnerabilities array).

    The published catalog is one JSON document (multiLine, a single task per
    file); landing zones with one entry per line should use :func:`read_entries`.
    """
    doc = spark.read.schema(CATALOG_SCHEMA).option("multiLine", True).json(path)
    return doc.select(F.inline("vulnerabilities"))


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entry-per-line catalog files (splittable)."""
    return spark.read.schema(ENTRY_SCHEMA).json(path)


def parse_entries(df: DataFrame, col: str) -> DataFrame:
    return df.select(F.from_json(F.col(col), ENTRY_SCHEMA).alias("e")).select("e.*")


def normalise(df: DataFrame) -> DataFrame:
    """A5: snake_case names, '' for missing fields, ransomware use 'Unknown' when missing."""
    return df.select(*[F.coalesce(F.col(src), F.lit(dflt)).alias(out) for out, src, dflt in RENAMES])


def digest(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Order-independent content digest (sum of 64-bit row hashes, and row count).

    Equal digests mean unchanged content: callers skip re-processing, the
    HTTP ETag equivalent for landed snapshots."""
    cols = cols or df.columns
    h = F.xxhash64(*[F.col(c) for c in cols]).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(h).cast("string").alias("digest"))


def id_set(df: DataFrame, key: str = "cve_id") -> DataFrame:
    """Distinct ids."""
    return df.select(key).distinct()


def fetch_if_changed(spark: SparkSession, snapshot: DataFrame, state: str, name: str) -> tuple[DataFrame, bool]:
    """(rows, changed) of a fetch of the catalog ``name`` against the state kept in the folder ``state``.

    The state holds the rows of the last changed fetch and, written after them, its digest. An equal
    digest returns the kept rows and writes nothing; else the rows are kept under their digest, so a
    run that stops between the two writes leaves the old state whole. One digest row reaches the driver.
    """
    new = digest(snapshot).first()
    folder, schema = f"{state}/{name}", "n_rows long, digest string, at timestamp"
    try:
        old = spark.read.schema(schema).json(f"{folder}/digests").orderBy(F.col("at").desc()).first()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = None
    rows = f"{folder}/rows-{new['n_rows']}-{new['digest']}"
    changed = old is None or (old["n_rows"], old["digest"]) != (new["n_rows"], new["digest"])
    if changed:
        snapshot.write.mode("overwrite").parquet(rows)
        spark.range(1).select(F.lit(new["n_rows"]).cast("long").alias("n_rows"), F.lit(new["digest"]).alias("digest"), F.current_timestamp().alias("at")) \
            .write.mode("append").json(f"{folder}/digests")
    return spark.read.schema(snapshot.schema).parquet(rows), changed
