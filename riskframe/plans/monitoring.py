"""Drift monitoring plans.

Reference window = events before 2024-01-16, current = from that day on;
numeric features: ``value`` and ``k`` expanded from the JSON payload;
categorical feature: ``event_type``; centroid: ``embeddings`` split by id parity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from .. import fixtures as X
from ..functions._util import round_half_away as rnd
from ..operators import drift as D
from ..session import read_table
from . import sqlfrag as S

CUT = "2024-01-16"
NUMERIC = ["value", "k"]
CATEGORICAL = ["event_type"]
PAYLOAD_SCHEMA = "k INT"
R9 = 9


def _sides(spark: SparkSession, sf_dir: str):
    """Events split at the cut, payload keys parsed with a declared schema."""
    e = read_table(spark, sf_dir, "events")
    # Payload keys merged in as columns with a declared schema (never inferred)
    e = e.withColumn("k", F.from_json("props", PAYLOAD_SCHEMA)["k"])
    cut = F.lit(CUT).cast("timestamp_ntz")
    return e.where(F.col("ts") < cut), e.where(F.col("ts") >= cut)


def numeric_long(spark, sf_dir) -> DataFrame:
    ref, cur = _sides(spark, sf_dir)
    return D.unpivot(ref, cur, NUMERIC)


def categorical_long(spark, sf_dir) -> DataFrame:
    ref, cur = _sides(spark, sf_dir)
    return D.unpivot(ref, cur, CATEGORICAL, kind="string")


def psi_events(spark, sf_dir):
    return D.psi(numeric_long(spark, sf_dir)).select("feature", rnd("psi", R9).alias("psi"))


def psi_flags(spark, sf_dir):
    """D18 with ``categorical_flags``: 0/1 features by value counts."""
    flags = [F.when(F.col("value") >= 50, 1.0).otherwise(0.0).alias("is_large"), (F.col("user_id") % 2).cast("double").alias("is_odd_user"),
             F.when(F.col("ts") >= F.lit("2024-01-02").cast("timestamp_ntz"), 1.0).otherwise(0.0).alias("after_first_day")]
    ref, cur = (s.select(*flags) for s in _sides(spark, sf_dir))
    r = D.psi(D.unpivot(ref, cur, ["is_large", "is_odd_user", "after_first_day"]), categorical_flags=True)
    return r.select("feature", rnd("psi", R9).alias("psi"))


PSI_FLAGS_SQL = f"""WITH l AS (SELECT ts >= TIMESTAMP '{CUT}' AS cur, unnest(['is_large', 'is_odd_user', 'after_first_day']) AS feature,
  unnest([CASE WHEN value >= 50 THEN 1 ELSE 0 END, CAST(user_id % 2 AS INTEGER), CASE WHEN ts >= TIMESTAMP '2024-01-02' THEN 1 ELSE 0 END]) AS v FROM events),
c AS (SELECT feature, v, count(*) FILTER (WHERE NOT cur) AS c0, count(*) FILTER (WHERE cur) AS c1 FROM l GROUP BY ALL),
n AS (SELECT feature, sum(c0) AS n0, sum(c1) AS n1 FROM c GROUP BY ALL),
p AS (SELECT feature, CASE WHEN c0 = 0 THEN {K.PSI_ZERO_FILL}::DOUBLE ELSE c0 END / n0 AS r, CASE WHEN c1 = 0 THEN {K.PSI_ZERO_FILL}::DOUBLE ELSE c1 END / n1 AS q
  FROM c JOIN n USING (feature))
SELECT feature, {S.round_dp("sum((q - r) * ln(q / r))", R9)} AS psi FROM p GROUP BY feature"""


def ks_events(spark, sf_dir):
    k = D.ks(numeric_long(spark, sf_dir))
    return k.select("feature", "n_ref", "n_cur", rnd("ks_statistic", R9).alias("ks_statistic"))


def moments_events(spark, sf_dir):
    m = D.moments(numeric_long(spark, sf_dir))
    return m.select("feature", *[rnd(c, R9).alias(c) for c in ("ref_mean", "curr_mean", "ref_std", "curr_std")])


def chi2_events(spark, sf_dir):
    c = D.chi_square(categorical_long(spark, sf_dir))
    return c.select("feature", "k", "dof", rnd("chi2_statistic", R9).alias("chi2_statistic"))


def centroid_embeddings(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    r = D.centroid_distance(e.where(F.col("vec_id") % 2 == 0), e.where(F.col("vec_id") % 2 == 1), "embedding")
    return r.select(rnd("cosine_distance_raw", R9).alias("cosine_distance_raw"), "cosine_distance", "drift_detected")


def drift_report(spark, sf_dir):
    """Full report with p-values (numeric KS and PSI, categorical chi-square)."""
    num = D.numeric_report(numeric_long(spark, sf_dir))
    cat = D.categorical_report(categorical_long(spark, sf_dir))
    numbers = ["statistic", "p_value", "psi", "ref_mean", "curr_mean", "ref_std", "curr_std"]
    return num.unionByName(cat, allowMissingColumns=True).withColumns({c: rnd(c, R9) for c in numbers})


def drift_summary(spark, sf_dir):
    return D.drift_summary(drift_report(spark, sf_dir))


def drift_alerts(spark, sf_dir):
    from ..operators import aggregates as A
    lat = A.latency_stats(X.predictions_log(spark, sf_dir), "latency_ms").select("p95")
    return D.drift_alerts(drift_report(spark, sf_dir), lat)


SIDES_SQL = f"""WITH ev AS (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events),
long AS (
  SELECT 'value' AS feature, CAST(value AS DOUBLE) AS value, CASE WHEN ts < TIMESTAMP '{CUT}' THEN 0 ELSE 1 END AS side FROM ev WHERE value IS NOT NULL AND NOT isnan(value)
  UNION ALL
  SELECT 'k', CAST(k AS DOUBLE), CASE WHEN ts < TIMESTAMP '{CUT}' THEN 0 ELSE 1 END FROM ev WHERE k IS NOT NULL)
"""

_PROBS = "[" + ", ".join(repr(i / 10) for i in range(11)) + "]"

PSI_SQL = SIDES_SQL + f""",
e AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, {_PROBS}))) AS edges FROM long WHERE side = 0 GROUP BY feature),
e2 AS (SELECT feature, list_slice(edges, 2, greatest(len(edges) - 1, 1)) AS inner_e, len(edges) - 1 AS n_bins FROM e),
bn AS (SELECT l.feature, l.side, len(list_filter(CASE WHEN n_bins >= 2 THEN inner_e ELSE [] END, lambda x: x <= l.value)) AS bin
  FROM long l JOIN e2 USING (feature)),
cnt AS (SELECT feature, side, bin, count(*) AS c FROM bn GROUP BY ALL),
n AS (SELECT feature, side, count(*) AS n FROM long GROUP BY ALL),
grid AS (SELECT feature, unnest(range(n_bins)) AS bin FROM e2 WHERE n_bins >= 1),
full_ AS (SELECT g.feature, s.side, g.bin, CASE WHEN coalesce(c.c, 0) = 0 THEN 0.0001 ELSE CAST(c.c AS DOUBLE) END / n.n AS p
  FROM grid g CROSS JOIN (SELECT unnest([0, 1]) AS side) s
  LEFT JOIN cnt c ON c.feature = g.feature AND c.side = s.side AND c.bin = g.bin
  LEFT JOIN n ON n.feature = g.feature AND n.side = s.side),
w AS (SELECT feature, bin, max(p) FILTER (WHERE side = 0) AS r, max(p) FILTER (WHERE side = 1) AS c FROM full_ GROUP BY ALL),
per AS (SELECT feature, sum((c - r) * ln(c / r)) AS psi FROM w GROUP BY feature)
SELECT f.feature, {S.round_dp("coalesce(per.psi, 0.0)", R9)} AS psi
FROM (SELECT DISTINCT feature FROM long) f LEFT JOIN per USING (feature)
"""

def _ks_sql(statistic: str) -> str:
    return SIDES_SQL + f""",
c AS (SELECT feature, value, count(*) FILTER (WHERE side = 0) AS r, count(*) FILTER (WHERE side = 1) AS q FROM long GROUP BY ALL),
cum AS (SELECT feature, value, sum(r) OVER (PARTITION BY feature ORDER BY value) AS cr,
  sum(q) OVER (PARTITION BY feature ORDER BY value) AS cq,
  sum(r) OVER (PARTITION BY feature) AS nr, sum(q) OVER (PARTITION BY feature) AS nq FROM c)
SELECT feature, CAST(nr AS BIGINT) AS n_ref, CAST(nq AS BIGINT) AS n_cur,
  {statistic} AS ks_statistic FROM cum GROUP BY feature, nr, nq
"""


KS_D = "max(abs(cr / nr - cq / nq))"
KS_SQL = _ks_sql(S.round_dp(KS_D, R9))

MOMENTS_SQL = SIDES_SQL + f"""
SELECT feature, {S.round_dp("avg(value) FILTER (WHERE side = 0)", R9)} AS ref_mean,
  {S.round_dp("avg(value) FILTER (WHERE side = 1)", R9)} AS curr_mean,
  {S.round_dp("stddev_pop(value) FILTER (WHERE side = 0)", R9)} AS ref_std,
  {S.round_dp("stddev_pop(value) FILTER (WHERE side = 1)", R9)} AS curr_std
FROM long GROUP BY feature
"""


def _chi2_sql(statistic: str) -> str:
    return f"""WITH long AS (SELECT 'event_type' AS feature, event_type AS value,
  CASE WHEN ts < TIMESTAMP '{CUT}' THEN 0 ELSE 1 END AS side FROM events WHERE event_type IS NOT NULL),
c AS (SELECT feature, value, count(*) FILTER (WHERE side = 0) + 1 AS r, count(*) FILTER (WHERE side = 1) + 1 AS q FROM long GROUP BY ALL),
t AS (SELECT feature, sum(r) AS rr, sum(q) AS qq, count(*) AS k FROM c GROUP BY feature),
s AS (SELECT feature, k, sum((q - r * qq / rr) * (q - r * qq / rr) / (r * qq / rr)) AS chi2 FROM c JOIN t USING (feature) GROUP BY feature, k)
SELECT feature, k, k - 1 AS dof, {statistic} AS chi2_statistic FROM s
"""


CHI2 = "CASE WHEN k > 1 THEN chi2 END"
CHI2_SQL = _chi2_sql(S.round_dp(CHI2, R9))

# p-values as sums of series: Kolmogorov's, and the regularised lower incomplete gamma function
_KS_P = """CASE WHEN lam < 1e-3 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, list_sum(list_transform(range(1, 101),
  lambda i: CASE WHEN i % 2 = 1 THEN 2.0::DOUBLE ELSE -2.0::DOUBLE END * exp(-2.0::DOUBLE * i * i * lam * lam))))) END"""
_CHI2_P = """CASE WHEN x <= 0 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - list_sum(list_transform(range(0, 4000),
  lambda i: exp((a + i) * ln(x) - x - lgamma(a + i + 1))))) END"""

REPORT_SQL = f"""WITH ks AS ({_ks_sql(KS_D)}), ps AS ({PSI_SQL}), mo AS ({MOMENTS_SQL}), ch AS ({_chi2_sql(CHI2)}),
n0 AS (SELECT *, n_ref >= {K.KS_MIN_ROWS} AND n_cur >= {K.KS_MIN_ROWS} AS enough, sqrt(n_ref * n_cur / (n_ref + n_cur)) AS root
  FROM ks JOIN ps USING (feature) JOIN mo USING (feature)),
n1 AS (SELECT *, (root + 0.12::DOUBLE + 0.11::DOUBLE / root) * ks_statistic AS lam FROM n0),
n2 AS (SELECT *, CASE WHEN enough THEN {_KS_P} ELSE 1.0::DOUBLE END AS p FROM n1),
c1 AS (SELECT *, dof / 2.0::DOUBLE AS a, coalesce(chi2_statistic, 0.0::DOUBLE) / 2.0::DOUBLE AS x FROM ch),
c2 AS (SELECT *, CASE WHEN k > 1 THEN {_CHI2_P} ELSE 1.0::DOUBLE END AS p FROM c1)
SELECT feature, 'ks_test_and_psi' AS test, {S.round_dp("CASE WHEN enough THEN ks_statistic ELSE 0.0::DOUBLE END", R9)} AS statistic,
  {S.round_dp("p", R9)} AS p_value, CASE WHEN enough THEN psi ELSE 0.0::DOUBLE END AS psi, ref_mean, curr_mean, ref_std, curr_std,
  enough AND (p < {K.DRIFT_SIGNIFICANCE!r}::DOUBLE OR psi > {K.PSI_THRESHOLD!r}::DOUBLE) AS drift_detected,
  CASE WHEN enough THEN 'ok' ELSE 'insufficient_data' END AS status FROM n2
UNION ALL
SELECT feature, 'chi2', {S.round_dp("coalesce(chi2_statistic, 0.0::DOUBLE)", R9)}, {S.round_dp("p", R9)}, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE),
  CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), k > 1 AND p < {K.DRIFT_SIGNIFICANCE!r}::DOUBLE,
  CASE WHEN k > 1 THEN 'ok' ELSE 'insufficient_categories' END FROM c2
"""

SUMMARY_SQL = f"""WITH s AS (SELECT count(*) AS n_tested, count(*) FILTER (WHERE drift_detected) AS n_drifted FROM ({REPORT_SQL})),
d AS (SELECT *, n_drifted / greatest(n_tested, 1) AS drift_share FROM s)
SELECT *, drift_share >= {K.DRIFT_SHARE_THRESHOLD!r}::DOUBLE AS dataset_drift,
  CASE WHEN drift_share >= {K.DRIFT_SHARE_THRESHOLD!r}::DOUBLE THEN 'TRIGGER_RETRAINING' ELSE 'SYSTEM_STABLE' END AS recommendation FROM d
"""

ALERTS_SQL = f"""SELECT 'HIGH' AS severity, 'drift:' || feature AS alert FROM ({REPORT_SQL}) WHERE drift_detected
UNION ALL SELECT 'MEDIUM', 'latency_p95' FROM ({X.with_views("predictions_log")} SELECT quantile_cont(latency_ms, 0.95) AS p95 FROM predictions_log)
WHERE p95 > {K.LATENCY_P95_ALERT_MS!r}
"""

CENTROID_SQL = f"""WITH x AS (SELECT vec_id % 2 AS side, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
n AS (SELECT sum(CASE WHEN vec_id % 2 = 0 THEN 1 ELSE 0 END) AS n0, sum(CASE WHEN vec_id % 2 = 1 THEN 1 ELSE 0 END) AS n1 FROM embeddings),
m AS (SELECT i, sum(CASE WHEN side = 0 THEN coalesce(CAST(x AS DOUBLE), 0.0) END) AS s0,
  sum(CASE WHEN side = 1 THEN coalesce(CAST(x AS DOUBLE), 0.0) END) AS s1 FROM x GROUP BY i),
ab AS (SELECT coalesce(s0, 0.0) / n0 AS a, coalesce(s1, 0.0) / n1 AS b FROM m, n),
r AS (SELECT sum(a * b) AS dot, sqrt(sum(a * a)) AS na, sqrt(sum(b * b)) AS nb FROM ab),
d AS (SELECT CASE WHEN na = 0 OR nb = 0 THEN 0.0 ELSE 1.0 - dot / (na * nb) END AS dist FROM r)
SELECT {S.round_dp("dist", R9)} AS cosine_distance_raw, {S.round_dp("dist", 4)} AS cosine_distance, dist > 0.15 AS drift_detected FROM d
"""

QUERIES = {
    "psi_flags": (psi_flags, PSI_FLAGS_SQL),
    "psi_events": (psi_events, PSI_SQL),
    "ks_events": (ks_events, KS_SQL),
    "moments_events": (moments_events, MOMENTS_SQL),
    "chi2_events": (chi2_events, CHI2_SQL),
    "centroid_embeddings": (centroid_embeddings, CENTROID_SQL),
    "drift_report": (drift_report, REPORT_SQL),
    "drift_summary": (drift_summary, SUMMARY_SQL),
    "drift_alerts": (drift_alerts, ALERTS_SQL),
}
