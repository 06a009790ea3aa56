"""Running totals and exact percentiles over an ordered value column without a single-partition window.

Two levels: approximate quantile edges split each group's distinct values into ranges; range totals
form a small table whose prefix sums give each range an offset; a window inside (group, range) adds
the local running sum. The number of ranges follows from the counted rows, so a task holds about
``ROWS_PER_BUCKET`` values however many there are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

DEFAULT_BUCKETS = 64
ROWS_PER_BUCKET = 500_000
#: Edges are searched in two steps of about this many each.
STEP = 32


def value_counts(df: DataFrame, value: str, by: list[str] | None = None, counts: dict[str, Column] | None = None) -> DataFrame:
    """(*by, value, counts) once per distinct value, written once: every later statistic reads these
    rows, not the data again. Nulls are left out."""
    counts = counts or {"n": F.count(F.lit(1))}
    return cut_lineage(df.where(F.col(value).isNotNull()).groupBy(*(by or []), value).agg(*[c.alias(k) for k, c in counts.items()]))


def bucket_count(counts: DataFrame) -> int:
    """Ranges for the rows of a written table (one number reaches the driver)."""
    return max(DEFAULT_BUCKETS, math.ceil(counts.count() / ROWS_PER_BUCKET))


def running_totals(counts: DataFrame, value: str, sums: list[str], by: list[str] | None = None,
                   n_buckets: int | None = None, descending: bool = False,
                   prefix: str = "cum_") -> DataFrame:
    """Add ``cum_<s>`` = sum of ``s`` over rows of the same group with value <= this value
    (>= when ``descending``), inclusive. ``counts`` should be pre-aggregated to one row
    per (group, value) so ties are handled by construction. Without ``n_buckets`` the counts
    are written once and sized.
    """
    by = list(by or [])
    if n_buckets is None:
        counts = cut_lineage(counts)
        n_buckets = bucket_count(counts)
    probs = [i / n_buckets for i in range(1, n_buckets)]
    g = by if by else [F.lit(0).alias("__g0")]
    edges = counts.groupBy(*g).agg(F.percentile_approx(value, probs, max(1000, 10 * n_buckets)).alias("__edges"))
    coarse = F.transform(F.sequence(F.lit(STEP), F.size("__edges"), F.lit(STEP)), lambda i: F.element_at("__edges", i))
    edges = edges.withColumn("__coarse", F.when(F.size("__edges") >= STEP, coarse).otherwise(F.slice("__edges", 1, 0)))
    keys = by if by else ["__g0"]
    c = counts if by else counts.withColumn("__g0", F.lit(0))
    # edge table is O(groups x buckets): AQE broadcasts it at run time
    c = c.join(edges, keys)
    v = F.col(value)
    c = c.withColumn("__step", F.size(F.filter("__coarse", lambda e: e < v)) * STEP)
    c = c.withColumn("__b", F.col("__step") + F.size(F.filter(F.slice("__edges", F.col("__step") + 1, F.lit(STEP)), lambda e: e < v)))
    c = c.drop("__edges", "__coarse", "__step")
    tot = c.groupBy(*keys, "__b").agg(*[F.sum(s).alias(f"__t_{s}") for s in sums])
    bo = F.col("__b").desc() if descending else F.col("__b").asc()
    w1 = Window.partitionBy(*keys).orderBy(bo).rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*keys, "__b", *[F.coalesce(F.sum(f"__t_{s}").over(w1), F.lit(0)).alias(f"__o_{s}")
                                     for s in sums])
    c = c.join(off, keys + ["__b"])
    vo = v.desc() if descending else v.asc()
    w2 = Window.partitionBy(*keys, "__b").orderBy(vo).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for s in sums:
        c = c.withColumn(f"{prefix}{s}", F.col(f"__o_{s}") + F.sum(s).over(w2))
    drop = ["__b"] + [f"__o_{s}" for s in sums] + ([] if by else ["__g0"])
    return c.drop(*drop)


def percentiles_of_counts(counts: DataFrame, value: str, count: str, probs: list[float], by: list[str] | None = None,
                          n_buckets: int | None = None) -> DataFrame:
    """(*by, percentiles): exact percentiles with linear interpolation of values that occur ``count``
    times each, by distributed selection: a running total finds the rows that hold the two ranks
    around each position, and only those rows are gathered. Groups without values have no row.
    """
    by = list(by or [])
    keys = by or ["__g"]
    c = counts.where(F.col(count) > 0).select(*by, value, count) if by else \
        counts.where(F.col(count) > 0).select(F.lit(0).alias("__g"), value, count)
    total = c.groupBy(*keys).agg(F.sum(count).alias("__n"))
    ranked = running_totals(c, value, [count], keys, n_buckets).join(total, keys)
    upto, first = F.col(f"cum_{count}"), F.col(f"cum_{count}") - F.col(count)
    place = [(F.col("__n") - 1) * F.lit(float(p)) for p in probs]
    ranks = [f(p) for p in place for f in (F.floor, F.ceil)]
    holds = [(first <= r) & (r < upto) for r in ranks]
    picked = ranked.where(F.exists(F.array(*holds), lambda h: h)).groupBy(*keys, "__n").agg(
        *[F.max(F.when(h, F.col(value))).cast("double").alias(f"__v{i}") for i, h in enumerate(holds)])
    exact = [F.col(f"__v{2 * i}") + (F.col(f"__v{2 * i + 1}") - F.col(f"__v{2 * i}")) * (p - F.floor(p)) for i, p in enumerate(place)]
    return picked.select(*by, F.array(*exact).alias("percentiles"))


def exact_percentiles(df: DataFrame, value: str, probs: list[float], by: list[str] | None = None) -> DataFrame:
    """(*by, percentiles) of a value column; nulls are left out."""
    counts = value_counts(df, value, by)
    return percentiles_of_counts(counts, value, "n", probs, by, bucket_count(counts))
