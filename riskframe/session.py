"""Spark session defaults and the few session-level helpers operators share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Defaults suitable for any cluster size; callers override per deployment.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

#: Rows that a task sorts or aggregates at once, about, where ``by_rows`` deals them out.
TASK_ROWS = 300_000


def get_spark(master: str | None = None, app: str = "riskframe",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the engine defaults.

    ``master`` is only set when given (tests use ``local[N]``); on a cluster the
    launcher decides.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting must point at shared storage and is only read
    here. Only a local-mode session with the setting unset (tests, benches)
    gets a fresh scratch folder.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or \
        spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        spark.sparkContext.setCheckpointDir(conf_dir)
        return conf_dir
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    d = tempfile.mkdtemp(prefix="riskframe-ckpt-", dir=os.environ.get("RISKFRAME_SCRATCH", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss).

    The input is persisted first so the checkpoint write does not recompute
    the lineage a second time; the cache is released once the files exist.
    """
    from pyspark import StorageLevel
    checkpoint_dir(df.sparkSession)
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = cached.checkpoint(eager=True)
    cached.unpersist()
    return out


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as a table under the shared checkpoint folder and read back from there.

    For wide rows that are read many times, a few columns at a time: the files are columnar and
    compressed, and nothing is held in executor memory.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition ``df`` by unique-ish ``keys`` when its scan has fewer splits than the
    cluster has cores, so per-row CPU work (regex over whole texts, JSON build and parse) runs
    on every core.

    A file stored as one large row group scans in a single task however big it is; a table
    at scale has many splits and is returned unchanged (no shuffle is added). The target is
    twice the cores, a fixed number, so AQE does not coalesce the spread back into one task.
    A later aggregation or window keyed on a superset of ``keys`` reuses this partitioning.
    ``df`` must be a scan with filters/projections only: counting its splits then only plans
    the scan (a plan holding an exchange would run its shuffle stages to answer).
    """
    cores = cluster_cores(df.sparkSession)
    try:
        splits = df.rdd.getNumPartitions()          # planning only, no job
    except Exception:                               # noqa: BLE001 -- no RDD API (Spark Connect): leave as is
        return df
    if splits >= cores:
        return df
    return df.repartition(2 * cores, *keys)


def by_rows(df: DataFrame, rows: int, *keys: str, per_task: int | None = None) -> DataFrame:
    """Hash-partition ``df`` by ``keys`` so that a task gets about ``per_task`` (``TASK_ROWS``) of ``rows`` rows.

    The exchanges of a plan are merged to partitions of a fixed number of compressed bytes (or to as many
    as there are cores), whose sorts and hash tables take many times that in a task. From twice the cores'
    share on, the number of partitions follows the rows instead; smaller inputs are returned unchanged.
    """
    n = -(-rows // (per_task or TASK_ROWS))
    return df.repartition(n, *keys) if n > 2 * cluster_cores(df.sparkSession) else df


def cluster_cores(spark: SparkSession) -> int:
    """Task slots of the cluster (default parallelism); the shuffle partition count where the
    context is not reachable (Spark Connect)."""
    try:
        return int(spark.sparkContext.defaultParallelism)
    except Exception:                               # noqa: BLE001
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
