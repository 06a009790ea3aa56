"""Drift statistics (D18-D25) in long format.

Both sides are unpivoted once to (feature, value, side); every statistic is a
grouped aggregate keyed by feature, so one shuffle serves all columns. The
driver never sees data; p-values come from small vectorised helpers applied
to the per-feature result rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .. import constants as K
from ..session import cut_lineage
from .cumulative import bucket_count, percentiles_of_counts, running_totals, value_counts
from .scalars import attach

DECILES = [i / 10 for i in range(11)]


def unpivot(ref: DataFrame, cur: DataFrame, columns: list[str], kind: str = "double") -> DataFrame:
    """(feature, value, side) with side 0 = reference, 1 = current; nulls and NaN dropped."""
    def one(df, side):
        st = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast(kind).alias("value"))
                                 for c in columns]))
        return df.select(st.alias("__s")).select("__s.*").withColumn("side", F.lit(side))
    u = one(ref, 0).unionByName(one(cur, 1)).where(F.col("value").isNotNull())
    if kind == "double":
        u = u.where(~F.isnan("value"))
    return u


def value_psi(long: DataFrame, zero_fill: float = K.PSI_ZERO_FILL) -> DataFrame:
    """PSI per feature over the counts of each distinct value (for flags): one aggregate per value, then per feature."""
    c = long.groupBy("feature", "value").agg(*[F.count_if(F.col("side") == i).cast("double").alias(f"c{i}") for i in (0, 1)])
    n = c.groupBy("feature").agg(F.sum("c0").alias("n0"), F.sum("c1").alias("n1"))
    r, q = (F.when(F.col(f"c{i}") == 0, F.lit(zero_fill)).otherwise(F.col(f"c{i}")) / F.nullif(F.col(f"n{i}"), F.lit(0.0)) for i in (0, 1))
    return c.join(n, "feature").groupBy("feature").agg(F.sum((q - r) * F.log(q / r)).alias("psi")) \
        .select("feature", F.coalesce("psi", F.lit(0.0)).alias("psi"))


def psi(long: DataFrame, bins: int = 10, exact: bool = True, zero_fill: float = K.PSI_ZERO_FILL,
        categorical_flags: bool = False) -> DataFrame:
    """D18 per feature: decile edges of the reference (linear percentile), de-duplicated,
    outer edges -inf/+inf, counts per [lo, hi), zero count -> ``zero_fill`` (a count,
    divided by n), PSI = sum (c - r) ln(c / r). Fewer than two edges -> 0.

    The data is counted once per (feature, value) and read no more: exact edges are selected by
    rank from those counts, ``exact=False`` takes ``percentile_approx`` of the reference rows.
    Deciles of a 0/1 flag fall into one bin, so its PSI is 0; with ``categorical_flags``
    features that hold only 0 and 1 are compared by value counts instead.
    """
    if categorical_flags:
        kind = long.groupBy("feature").agg(F.bool_and(F.col("value").isin(0.0, 1.0)).alias("__flag"))
        marked = long.join(kind, "feature")
        other = psi(marked.where(~F.col("__flag")).drop("__flag"), bins, exact, zero_fill)
        return value_psi(marked.where("__flag").drop("__flag"), zero_fill).unionByName(other)
    return _psi(side_counts(long), bins, exact, zero_fill, long)


def side_counts(long: DataFrame) -> DataFrame:
    """(feature, value, r, q): how often each value occurs in the reference and in the current side,
    counted once and written; KS and PSI read nothing else."""
    return value_counts(long, "value", ["feature"], {"r": F.count_if(F.col("side") == 0), "q": F.count_if(F.col("side") == 1)})


def _psi(values: DataFrame, bins: int, exact: bool, zero_fill: float, long: DataFrame | None) -> DataFrame:
    probs = [i / bins for i in range(bins + 1)]
    if exact:
        edges = percentiles_of_counts(values, "value", "r", probs, ["feature"], bucket_count(values)) \
            .select("feature", F.array_distinct("percentiles").alias("edges"))
    else:
        edges = long.where(F.col("side") == 0).groupBy("feature").agg(F.array_distinct(F.percentile_approx("value", probs, 10000)).alias("edges"))
    edges = edges.select("feature", "edges",
                         F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0))).alias("inner"),
                         (F.size("edges") - 1).alias("n_bins"))
    j = values.join(edges, "feature")      # edges: one row per feature, broadcast by AQE
    v = F.col("value")
    j = j.withColumn("bin", F.size(F.filter("inner", lambda e: e <= v)))
    both = F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.col(c).alias("c")) for i, c in enumerate(("r", "q"))]))
    counts = j.groupBy("feature", "bin").agg(F.sum("r").alias("r"), F.sum("q").alias("q")).select("feature", "bin", both.alias("s")) \
        .select("feature", "s.side", "bin", "s.c")
    n = values.groupBy("feature").agg(F.sum("r").alias("r"), F.sum("q").alias("q")).select("feature", both.alias("s")) \
        .select("feature", "s.side", F.nullif(F.col("s.c"), F.lit(0)).alias("n"))
    grid = edges.where(F.col("n_bins") >= 1).select(
        "feature", F.explode(F.sequence(F.lit(0), F.col("n_bins") - 1)).alias("bin"))
    sides = grid.select("feature", "bin", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    full = sides.join(counts, ["feature", "side", "bin"], "left").join(n, ["feature", "side"], "left")
    pcts = full.withColumn("p", F.when(F.coalesce("c", F.lit(0)) == 0, F.lit(zero_fill))
                           .otherwise(F.col("c").cast("double")) / F.col("n"))
    wide = pcts.groupBy("feature", "bin").agg(F.max(F.when(F.col("side") == 0, F.col("p"))).alias("r"),
                                              F.max(F.when(F.col("side") == 1, F.col("p"))).alias("c"))
    per = wide.groupBy("feature").agg(F.sum((F.col("c") - F.col("r")) * F.log(F.col("c") / F.col("r"))).alias("psi"))
    feats = values.select("feature").distinct()
    return feats.join(per, "feature", "left").select(
        "feature", F.coalesce(F.col("psi"), F.lit(0.0)).alias("psi"))


def ks(long: DataFrame) -> DataFrame:
    """D19 per feature: two-sample KS statistic D = max |F_ref - F_cur| over the pooled values,
    plus n_ref, n_cur. One row per feature."""
    return _ks(side_counts(long))


def _ks(c: DataFrame) -> DataFrame:
    n = c.groupBy("feature").agg(F.sum("r").alias("n_ref"), F.sum("q").alias("n_cur"))
    r = running_totals(c, "value", ["r", "q"], ["feature"], bucket_count(c)).join(n, "feature")
    d = F.abs(F.col("cum_r") / F.col("n_ref") - F.col("cum_q") / F.col("n_cur"))
    return r.groupBy("feature", "n_ref", "n_cur").agg(F.max(d).alias("ks_statistic"))


def drift_of_counts(both: DataFrame) -> DataFrame:
    """(feature, psi, n_ref, n_cur, ks_statistic) from counts (feature, value, r, q), in any number of
    parts: counts of days or batches add up here."""
    values = value_counts(both, "value", ["feature"], {"r": F.sum("r"), "q": F.sum("q")})
    return _ks(values).join(_psi(values, 10, True, K.PSI_ZERO_FILL, None), "feature").select("feature", "psi", "n_ref", "n_cur", "ks_statistic")


def moments(long: DataFrame) -> DataFrame:
    """Mean and population std per side."""
    return long.groupBy("feature").agg(
        F.avg(F.when(F.col("side") == 0, F.col("value"))).alias("ref_mean"),
        F.avg(F.when(F.col("side") == 1, F.col("value"))).alias("curr_mean"),
        F.stddev_pop(F.when(F.col("side") == 0, F.col("value"))).alias("ref_std"),
        F.stddev_pop(F.when(F.col("side") == 1, F.col("value"))).alias("curr_std"),
    )


@F.pandas_udf(DoubleType())
def ks_pvalue(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    """Asymptotic two-sided p for the KS statistic (Kolmogorov series with en = n m / (n + m))."""
    en = (n * m / (n + m)).to_numpy(dtype=float)
    lam = (np.sqrt(en) + 0.12 + 0.11 / np.sqrt(en)) * d.to_numpy(dtype=float)
    k = np.arange(1, 101)[:, None]
    terms = 2.0 * ((-1.0) ** (k - 1)) * np.exp(-2.0 * (k ** 2) * lam[None, :] ** 2)
    p = np.clip(terms.sum(axis=0), 0.0, 1.0)
    p = np.where(lam < 1e-3, 1.0, p)
    return pd.Series(p)


def _gammaincc(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x) (series / continued fraction)."""
    if x <= 0:
        return 1.0
    gln = math.lgamma(a)
    if x < a + 1.0:
        ap, s, de = a, 1.0 / a, 1.0 / a
        for _ in range(1000):
            ap += 1.0
            de *= x / ap
            s += de
            if abs(de) < abs(s) * 1e-15:
                break
        return max(0.0, 1.0 - s * math.exp(-x + a * math.log(x) - gln))
    b, c, d = x + 1.0 - a, 1.0 / 1e-300, 1.0 / (x + 1.0 - a)
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = 1e-300 if abs(d) < 1e-300 else d
        c = b + an / c
        c = 1e-300 if abs(c) < 1e-300 else c
        d = 1.0 / d
        de = d * c
        h *= de
        if abs(de - 1.0) < 1e-15:
            break
    return math.exp(-x + a * math.log(x) - gln) * h


@F.pandas_udf(DoubleType())
def chi2_pvalue(stat: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([_gammaincc(k / 2.0, s / 2.0) if k > 0 else 1.0
                      for s, k in zip(stat.astype(float), dof.astype(float))])


def chi_square(long_cat: DataFrame) -> DataFrame:
    """D21 per feature on the category union: +1 smoothing both sides, expected = ref scaled to the
    current total, statistic = sum (obs - exp)^2 / exp, dof = k - 1 (k <= 1 -> insufficient)."""
    c = long_cat.groupBy("feature", "value").agg(
        (F.count_if(F.col("side") == 0) + 1).alias("r"), (F.count_if(F.col("side") == 1) + 1).alias("q"))
    tot = c.groupBy("feature").agg(F.sum("r").alias("ref_total"), F.sum("q").alias("cur_total"),
                                   F.count(F.lit(1)).alias("k"))
    j = c.join(tot, "feature")
    exp_ = F.col("r") * F.col("cur_total") / F.col("ref_total")
    s = j.groupBy("feature", "k").agg(F.sum((F.col("q") - exp_) * (F.col("q") - exp_) / exp_).alias("chi2_statistic"))
    return s.select("feature", "k", F.when(F.col("k") > 1, F.col("chi2_statistic")).alias("chi2_statistic"),
                    (F.col("k") - 1).alias("dof"))


def centroid_distance(ref: DataFrame, cur: DataFrame, vec: str, threshold: float = K.CENTROID_COSINE_THRESHOLD) -> DataFrame:
    """1 - cosine of the mean vectors of both sides (zero norm -> 0), null elements -> 0."""
    def mean(df, side):
        e = df.select(F.posexplode(vec).alias("i", "x"))
        return e.groupBy("i").agg(F.sum(F.coalesce(F.col("x").cast("double"), F.lit(0.0))).alias(f"s{side}"))
    n0 = ref.agg(F.count(F.lit(1)).alias("n0"))
    n1 = cur.agg(F.count(F.lit(1)).alias("n1"))
    m = attach(attach(mean(ref, 0).join(mean(cur, 1), "i", "full_outer"), n0), n1)
    m = m.select((F.coalesce("s0", F.lit(0.0)) / F.col("n0")).alias("a"),
                 (F.coalesce("s1", F.lit(0.0)) / F.col("n1")).alias("b"))
    r = m.agg(F.sum(F.col("a") * F.col("b")).alias("dot"), F.sqrt(F.sum(F.col("a") * F.col("a"))).alias("na"),
              F.sqrt(F.sum(F.col("b") * F.col("b"))).alias("nb"))
    dist = F.when((F.col("na") == 0) | (F.col("nb") == 0), F.lit(0.0)).otherwise(
        F.lit(1.0) - F.col("dot") / (F.col("na") * F.col("nb")))
    return r.select(dist.alias("cosine_distance_raw")).select(
        "cosine_distance_raw",
        (F.round(F.col("cosine_distance_raw") * 10000.0, 0) / 10000.0).alias("cosine_distance"),
        (F.col("cosine_distance_raw") > threshold).alias("drift_detected"))


def numeric_report(long: DataFrame, significance: float = K.DRIFT_SIGNIFICANCE,
                   psi_threshold: float = K.PSI_THRESHOLD, exact: bool = True) -> DataFrame:
    """D18-D20 combined per numeric feature; < 10 rows a side -> insufficient_data, no drift."""
    long = cut_lineage(long)
    values = side_counts(long)
    k = _ks(values)
    p = _psi(values, 10, exact, K.PSI_ZERO_FILL, long)
    mo = moments(long)
    j = k.join(p, "feature").join(mo, "feature")
    enough = (F.col("n_ref") >= K.KS_MIN_ROWS) & (F.col("n_cur") >= K.KS_MIN_ROWS)
    j = j.withColumn("p_value", F.when(enough, ks_pvalue("ks_statistic", "n_ref", "n_cur")).otherwise(1.0))
    return j.select(
        "feature", F.lit("ks_test_and_psi").alias("test"),
        F.when(enough, F.col("ks_statistic")).otherwise(0.0).alias("statistic"),
        "p_value", F.when(enough, F.col("psi")).otherwise(0.0).alias("psi"),
        "ref_mean", "curr_mean", "ref_std", "curr_std",
        (enough & ((F.col("p_value") < significance) | (F.col("psi") > psi_threshold))).alias("drift_detected"),
        F.when(enough, "ok").otherwise("insufficient_data").alias("status"))


def categorical_report(long_cat: DataFrame, significance: float = K.DRIFT_SIGNIFICANCE) -> DataFrame:
    c = chi_square(long_cat)
    ok = F.col("k") > 1
    c = c.withColumn("p_value", F.when(ok, chi2_pvalue(F.coalesce("chi2_statistic", F.lit(0.0)), "dof"))
                     .otherwise(1.0))
    return c.select("feature", F.lit("chi2").alias("test"),
                    F.coalesce("chi2_statistic", F.lit(0.0)).alias("statistic"), "p_value",
                    (ok & (F.col("p_value") < significance)).alias("drift_detected"),
                    F.when(ok, "ok").otherwise("insufficient_categories").alias("status"))


def drift_summary(report: DataFrame, share_threshold: float = K.DRIFT_SHARE_THRESHOLD) -> DataFrame:
    """Tested, drifted, share (divisor >= 1), dataset drift, recommendation."""
    s = report.agg(F.count(F.lit(1)).alias("n_tested"), F.count_if("drift_detected").alias("n_drifted"))
    s = s.withColumn("drift_share", F.col("n_drifted") / F.greatest(F.col("n_tested"), F.lit(1)))
    return s.withColumn("dataset_drift", F.col("drift_share") >= share_threshold) \
            .withColumn("recommendation", F.when(F.col("dataset_drift"), "TRIGGER_RETRAINING")
                        .otherwise("SYSTEM_STABLE"))


def key_feature_psi(report: DataFrame, features: list[str], alert: float = K.PSI_KEY_ALERT) -> DataFrame:
    """Mean PSI over the key features and the alert flag."""
    r = report.where(F.col("feature").isin(*features)).agg(F.avg("psi").alias("mean_psi"))
    return r.withColumn("alert", F.coalesce(F.col("mean_psi") > alert, F.lit(False)))


def drift_alerts(report: DataFrame, p95_latency: DataFrame | None = None,
                 latency_ms: float = K.LATENCY_P95_ALERT_MS) -> DataFrame:
    """Alert rows: drifted features -> HIGH; p95 latency over the limit -> MEDIUM."""
    a = report.where("drift_detected").select(F.lit("HIGH").alias("severity"),
                                              F.concat(F.lit("drift:"), F.col("feature")).alias("alert"))
    if p95_latency is not None:
        b = p95_latency.where(F.col("p95") > latency_ms).select(
            F.lit("MEDIUM").alias("severity"), F.lit("latency_p95").alias("alert"))
        a = a.unionByName(b)
    return a
