"""Set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_ids(*frames: DataFrame, key: str = "cve_id") -> DataFrame:
    """G1: union-distinct of id lists."""
    out = None
    for f in frames:
        s = f.select(key)
        out = s if out is None else out.unionByName(s)
    return out.distinct()


def id_set(df: DataFrame, key: str = "cve_id") -> DataFrame:
    """Distinct ids."""
    return df.select(key).distinct()


def snapshot_diff(prev: DataFrame, cur: DataFrame, key: str = "cve_id", compare: list[str] | None = None) -> DataFrame:
    """(key, change) with change in added / removed / changed (compared columns differ)."""
    compare = compare or [c for c in cur.columns if c != key]
    p = prev.select(key, F.struct(*compare).alias("__p"))
    c = cur.select(key, F.struct(*compare).alias("__c"))
    j = p.join(c, key, "full_outer")
    change = (F.when(F.col("__p").isNull(), "added").when(F.col("__c").isNull(), "removed")
              .when(~F.col("__p").eqNullSafe(F.col("__c")), "changed"))
    return j.select(key, change.alias("change")).where(F.col("change").isNotNull())


def append_new(history: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``batch`` to append to an append-only history unique on ``keys``:
    de-duplicated within the batch (the least of the other columns, in their order) and anti-joined
    against history."""
    rest = [c for c in batch.columns if c not in keys]
    b = batch.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__row")).select(*keys, "__row.*").select(*batch.columns) \
        if rest else batch.select(*keys).distinct()
    return b.join(history.select(*keys), keys, "left_anti")


def unused(items: DataFrame, ledger: DataFrame, key: str = "id") -> DataFrame:
    """Rows not yet recorded in the ``used`` ledger (anti join)."""
    return items.join(ledger.select(key).distinct(), key, "left_anti")


def shared_columns(a: DataFrame, b: DataFrame) -> list[str]:
    """Column intersection in ``a``'s order."""
    bs = set(b.columns)
    return [c for c in a.columns if c in bs]
