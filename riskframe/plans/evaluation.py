"""Evaluation plans: late labels, confusion matrices, reports, AUC, ECE, latency,
traffic, quality gate and champion/challenger (C7, C9, D9-D17, D26-D29, J11, J12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from .. import fixtures as X
from ..functions._util import round_half_away as rnd
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import metrics as M
from ..operators.scalars import attach
from ..session import read_table
from . import scoring
from . import sqlfrag as S

LABELS_SQL = ", ".join(f"'{x}'" for x in K.LABELS_ORDER)
R9 = 9


def labeled_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction log joined to late ground truth (the CVE's label) on the scored id."""
    preds = X.predictions_log(spark, sf_dir)
    truth = X.cves(spark, sf_dir).select(F.col("o_orderkey").alias("event_id"), "base_severity")
    return J.late_label_join(preds, truth, key="event_id", pred_col="prediction", truth_col="base_severity")


LABELED_SQL = X.with_views("cves", "predictions_log") + f""",
lab AS (SELECT p.*, upper(p.prediction) AS predicted, upper(c.base_severity) AS truth
  FROM predictions_log p JOIN cves c ON p.event_id = c.o_orderkey
  WHERE upper(c.base_severity) IN ({LABELS_SQL}) AND upper(p.prediction) IN ({LABELS_SQL}))
"""

CM_SQL = LABELED_SQL + f""",
labels AS (SELECT unnest([{LABELS_SQL}]) AS l),
grid AS (SELECT v.model_version, t.l AS truth, p.l AS predicted
  FROM (SELECT DISTINCT model_version FROM lab) v, labels t, labels p),
cnt AS (SELECT model_version, truth, predicted, count(*) AS n FROM lab GROUP BY ALL),
cm AS (SELECT g.model_version, g.truth, g.predicted, CAST(coalesce(c.n, 0) AS BIGINT) AS n
  FROM grid g LEFT JOIN cnt c USING (model_version, truth, predicted))
"""

PER_CLASS_SQL = CM_SQL + """,
sup AS (SELECT model_version, truth AS label, CAST(sum(n) AS BIGINT) AS support FROM cm GROUP BY ALL),
prd AS (SELECT model_version, predicted AS label, CAST(sum(n) AS BIGINT) AS n_predicted FROM cm GROUP BY ALL),
tp AS (SELECT model_version, truth AS label, n AS tp FROM cm WHERE truth = predicted),
pc AS (SELECT model_version, label, support, n_predicted, tp,
  CASE WHEN n_predicted > 0 THEN CAST(tp AS DOUBLE) / n_predicted ELSE 0.0 END AS precision,
  CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support ELSE 0.0 END AS recall,
  CASE WHEN support + n_predicted > 0 THEN 2.0 * CAST(tp AS DOUBLE) / (support + n_predicted) ELSE 0.0 END AS f1
  FROM sup JOIN prd USING (model_version, label) JOIN tp USING (model_version, label))
"""

SUMMARY_SQL = PER_CLASS_SQL + f""",
summ AS (SELECT model_version, CAST(sum(support) AS BIGINT) AS n, CAST(sum(tp) AS BIGINT) AS n_correct,
  sum(CASE WHEN support + n_predicted > 0 THEN f1 ELSE 0.0 END) / greatest(count(*) FILTER (WHERE support + n_predicted > 0), 1) AS macro_f1,
  avg(f1) AS macro_f1_all,
  sum(f1 * support) / greatest(sum(support), 1) AS weighted_f1,
  sum(CASE WHEN support > 0 THEN recall ELSE 0.0 END) / greatest(count(*) FILTER (WHERE support > 0), 1) AS balanced_accuracy,
  max(CASE WHEN label = 'CRITICAL' THEN recall END) AS critical_recall,
  max(CASE WHEN label = 'HIGH' THEN recall END) AS high_recall
  FROM pc GROUP BY model_version)
"""

SUMMARY_COLS = ["macro_f1", "macro_f1_all", "weighted_f1", "balanced_accuracy", "critical_recall", "high_recall",
                "accuracy", "error_rate"]


def confusion_by_version(spark, sf_dir):
    lab = labeled_predictions(spark, sf_dir)
    return M.confusion_matrix(lab, "truth", "predicted", by=["model_version"])


def class_report(spark, sf_dir):
    cm = confusion_by_version(spark, sf_dir)
    pc = M.per_class(cm, ["model_version"])
    return pc.select("model_version", "label", "support", "n_predicted", "tp",
                     *[rnd(c, R9).alias(c) for c in ("precision", "recall", "f1")])


def eval_summary(spark, sf_dir):
    cm = confusion_by_version(spark, sf_dir)
    s = M.summary(cm, ["model_version"])
    return s.select("model_version", "n", "n_correct", *[rnd(c, R9).alias(c) for c in SUMMARY_COLS])


def _summary_out_sql(src: str = "summ") -> str:
    acc = "CAST(n_correct AS DOUBLE) / greatest(n, 1)"
    cols = {"macro_f1": "macro_f1", "macro_f1_all": "macro_f1_all", "weighted_f1": "weighted_f1",
            "balanced_accuracy": "balanced_accuracy", "critical_recall": "critical_recall",
            "high_recall": "high_recall", "accuracy": acc, "error_rate": f"1.0 - ({acc})"}
    return ("SELECT model_version, n, n_correct, " +
            ", ".join(f"{S.round_dp(e, R9)} AS {k}" for k, e in cols.items()) + f" FROM {src}")


def ece_by_version(spark, sf_dir):
    lab = labeled_predictions(spark, sf_dir).withColumn("correct", F.col("predicted") == F.col("truth"))
    e = M.ece(lab, "confidence", "correct", by=["model_version"])
    return e.select("model_version", rnd("ece", R9).alias("ece"))


def _ece_bin_sql(c: str) -> str:
    edges = M.ECE_EDGES
    whens = " ".join(f"WHEN {c} >= {S.dbl(edges[i])} THEN {i}" for i in range(9, -1, -1))
    return f"CASE WHEN {c} IS NULL OR {c} >= {S.dbl(edges[-1])} OR {c} < {S.dbl(edges[0])} THEN NULL {whens} END"


ECE_SQL = LABELED_SQL + f""",
b AS (SELECT model_version, {_ece_bin_sql('confidence')} AS bin, confidence,
  CASE WHEN predicted = truth THEN 1.0 ELSE 0.0 END AS acc FROM lab),
bins AS (SELECT model_version, bin, count(*) AS nb, avg(acc) AS a, avg(confidence) AS c FROM b GROUP BY ALL),
tot AS (SELECT model_version, sum(nb) AS nt FROM bins GROUP BY ALL)
SELECT model_version, {S.round_dp("coalesce(sum(CASE WHEN bin IS NOT NULL THEN nb / nt * abs(a - c) END), 0.0)", R9)} AS ece
FROM bins JOIN tot USING (model_version) GROUP BY model_version
"""


def auc_exploited(spark, sf_dir):
    """D15 binary: latest exploit probability as a score for catalog membership."""
    s = scoring.scored_cves(spark, sf_dir)
    return M.auc(s, "epss_score", "in_kev").select(rnd("roc_auc", R9).alias("roc_auc"))


AUC_SQL = scoring._scored_sql() + f""",
c AS (SELECT epss_score AS s, count(*) FILTER (WHERE in_kev) AS pos, count(*) FILTER (WHERE NOT in_kev) AS neg
  FROM scored GROUP BY epss_score),
r AS (SELECT s, pos, neg, sum(pos) OVER (ORDER BY s DESC) - pos AS above FROM c),
t AS (SELECT sum(neg * (above + pos / 2.0)) AS u, sum(pos) AS p, sum(neg) AS n FROM r)
SELECT {S.round_dp("CASE WHEN p > 0 AND n > 0 THEN u / (p * n) ELSE 0.5 END", R9)} AS roc_auc FROM t
"""


def _probs(conf_col, idx_col, n=4):
    """Probability vector: confidence on the predicted class, the rest shared evenly."""
    other = (F.lit(1.0) - F.col(conf_col)) / F.lit(float(n - 1))
    return F.array(*[F.when(F.col(idx_col) == i, F.col(conf_col)).otherwise(other) for i in range(n)])


def auc_ovr(spark, sf_dir):
    """D15 one-vs-rest macro AUC per version from the logged class probabilities."""
    lab = labeled_predictions(spark, sf_dir)
    idx = {k: v for k, v in K.SEVERITY_0_3.items()}
    from ..functions._util import case_map
    lab = lab.withColumn("pidx", case_map(F.col("predicted"), idx)).withColumn("tidx", case_map(F.col("truth"), idx))
    lab = lab.withColumn("probs", _probs("confidence", "pidx"))
    r = M.auc_ovr_macro(lab, "probs", "tidx", by=["model_version"])
    return r.select("model_version", rnd("roc_auc_ovr_macro", R9).alias("roc_auc_ovr_macro"))


AUC_OVR_SQL = LABELED_SQL + f""",
ix AS (SELECT model_version, confidence, {S.case_map('predicted', K.SEVERITY_0_3)} AS pidx,
  {S.case_map('truth', K.SEVERITY_0_3)} AS tidx FROM lab),
lg AS (SELECT model_version, k, CASE WHEN pidx = k THEN confidence ELSE (1.0 - confidence) / 3.0 END AS p,
  CASE WHEN tidx = k THEN 1 ELSE 0 END AS y FROM ix, (SELECT unnest(range(4)) AS k)),
c AS (SELECT model_version, k, p, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y <> 1) AS neg
  FROM lg GROUP BY ALL),
r AS (SELECT *, sum(pos) OVER (PARTITION BY model_version, k ORDER BY p DESC) - pos AS above FROM c),
t AS (SELECT model_version, k, sum(neg * (above + pos / 2.0)) AS u, sum(pos) AS np, sum(neg) AS nn FROM r GROUP BY ALL),
a AS (SELECT model_version, CASE WHEN np > 0 AND nn > 0 THEN u / (np * nn) ELSE 0.0 END AS auc FROM t)
SELECT model_version, {S.round_dp("sum(auc) / 4.0", R9)} AS roc_auc_ovr_macro FROM a GROUP BY model_version
"""


def latency_percentiles(spark, sf_dir):
    log = X.predictions_log(spark, sf_dir)
    r = A.latency_stats(log, "latency_ms", by=["model_version"])
    return r.select("model_version", *[rnd(c, R9).alias(c) for c in ("p50", "p90", "p95", "p99", "mean")],
                    "min", "max", "n")


LATENCY_SQL = X.with_views("predictions_log") + f"""
SELECT model_version, {", ".join(S.round_dp(f"quantile_cont(latency_ms, {q})", R9) + f" AS p{int(round(q * 100))}" for q in A.LATENCY_PROBS)},
 {S.round_dp("avg(latency_ms)", R9)} AS mean, min(latency_ms) AS min, max(latency_ms) AS max, count(latency_ms) AS n
FROM predictions_log GROUP BY model_version
"""


def traffic(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    r = A.traffic_stats(e, "ts", F.col("event_type") != "error", by=["event_type"])
    return r.select("event_type", "n", rnd("success_rate", R9).alias("success_rate"),
                    rnd("throughput_per_sec", R9).alias("throughput_per_sec"))


TRAFFIC_SQL = f"""
SELECT event_type, count(*) AS n,
 {S.round_dp("count(*) FILTER (WHERE event_type <> 'error') / count(*)", R9)} AS success_rate,
 {S.round_dp("CASE WHEN (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 > 0 THEN count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) END", R9)} AS throughput_per_sec
FROM events GROUP BY event_type
"""


def prediction_share(spark, sf_dir):
    log = X.predictions_log(spark, sf_dir)
    d = A.class_distribution(log, "prediction", by=["model_version"])
    return d.select("model_version", "prediction", "n", rnd("share", 4).alias("share"), "rare")


SHARE_SQL = X.with_views("predictions_log") + f""",
c AS (SELECT model_version, prediction, count(*) AS n FROM predictions_log GROUP BY ALL),
t AS (SELECT model_version, sum(n) AS tot FROM c GROUP BY ALL)
SELECT model_version, prediction, n, {S.round_dp("n / tot", 4)} AS share, n / tot < 0.01 AS rare
FROM c JOIN t USING (model_version)
"""


def gate_metrics(spark, sf_dir) -> DataFrame:
    """Metric row per version: macro_f1, critical_recall, ece, latency_p99_ms, n_test_samples (+ others)."""
    cm = confusion_by_version(spark, sf_dir)
    s = M.summary(cm, ["model_version"])
    lab = labeled_predictions(spark, sf_dir).withColumn("correct", F.col("predicted") == F.col("truth"))
    e = M.ece(lab, "confidence", "correct", by=["model_version"])
    lat = A.latency_stats(X.predictions_log(spark, sf_dir), "latency_ms", by=["model_version"])
    return s.join(e, "model_version").join(lat.select("model_version", F.col("p99").alias("latency_p99_ms")),
                                           "model_version") \
            .withColumnRenamed("n", "n_test_samples")


def gate_checks(spark, sf_dir, thresholds: dict | None = None):
    """Long (model_version, check, value, threshold, passed)."""
    from ..ml import gate
    m = gate_metrics(spark, sf_dir)
    return gate.quality_gate(m, ["model_version"], thresholds).select(
        "model_version", "check", rnd("value", R9).alias("value"), "threshold", "passed")


def champion_challenger(spark, sf_dir):
    """v0 (champion) vs v1 (challenger) over the eight comparison metrics."""
    from ..ml import gate
    m = gate_metrics(spark, sf_dir)
    au = auc_ovr(spark, sf_dir).withColumnRenamed("roc_auc_ovr_macro", "roc_auc")
    m = m.join(au, "model_version")
    r = gate.compare(m.where(F.col("model_version") == "v0"), m.where(F.col("model_version") == "v1"))
    return r.select("metric", *[rnd(c, R9).alias(c) for c in ("champion", "challenger", "delta")],
                    "challenger_better", "significant", "challenger_wins", "recommendation")


GATE_METRICS_SQL = SUMMARY_SQL + f""",
b AS (SELECT model_version, {_ece_bin_sql('confidence')} AS bin, confidence,
  CASE WHEN predicted = truth THEN 1.0 ELSE 0.0 END AS acc FROM lab),
bins AS (SELECT model_version, bin, count(*) AS nb, avg(acc) AS a, avg(confidence) AS c FROM b GROUP BY ALL),
tot AS (SELECT model_version, sum(nb) AS nt FROM bins GROUP BY ALL),
ec AS (SELECT model_version, coalesce(sum(CASE WHEN bin IS NOT NULL THEN nb / nt * abs(a - c) END), 0.0) AS ece
  FROM bins JOIN tot USING (model_version) GROUP BY model_version),
lat AS (SELECT model_version, quantile_cont(latency_ms, 0.99) AS latency_p99_ms FROM predictions_log GROUP BY ALL),
gm AS (SELECT s.*, CAST(n_correct AS DOUBLE) / greatest(n, 1) AS accuracy, e.ece, l.latency_p99_ms,
  n AS n_test_samples FROM summ s JOIN ec e USING (model_version) JOIN lat l USING (model_version))
"""


def _gate_sql(th=None) -> str:
    t = dict(K.GATE_THRESHOLDS, **(th or {}))
    rows = [("macro_f1_threshold", "macro_f1", t["min_macro_f1"], ">="),
            ("critical_recall", "critical_recall", t["min_critical_recall"], ">="),
            ("calibration_ece", "ece", t["max_ece"], "<="),
            ("latency_p99", "latency_p99_ms", t["max_latency_p99_ms"], "<="),
            ("min_test_samples", "n_test_samples", float(t["min_n_test_samples"]), ">=")]
    parts = []
    for check, metric, thr, op in rows:
        dflt = K.GATE_MISSING_DEFAULTS[metric]
        v = f"coalesce(CAST({metric} AS DOUBLE), {S.dbl(dflt)})"
        parts.append(f"SELECT model_version, '{check}' AS check, {S.round_dp(v, R9)} AS value, "
                     f"{S.dbl(thr)} AS threshold, {v} {op} {S.dbl(thr)} AS passed FROM gm")
    return GATE_METRICS_SQL + "\n" + "\nUNION ALL\n".join(parts)


def _champion_sql() -> str:
    values = ", ".join(f"coalesce(CAST({m} AS DOUBLE), 0.0)" for m in K.CHAMPION_METRICS)
    lower = ", ".join(f"'{m}'" for m in K.LOWER_IS_BETTER)
    wins = "(SELECT count(*) FROM j WHERE delta > 0)"
    return GATE_METRICS_SQL + f""",
au AS ({AUC_OVR_SQL}),
m AS (SELECT gm.*, au.roc_auc_ovr_macro AS roc_auc FROM gm JOIN au USING (model_version)),
mm AS (SELECT model_version, unnest([{", ".join(f"'{m}'" for m in K.CHAMPION_METRICS)}]) AS metric, unnest([{values}]) AS v FROM m),
j AS (SELECT a.metric, a.v AS champion, b.v AS challenger, CASE WHEN a.metric IN ({lower}) THEN a.v - b.v ELSE b.v - a.v END AS delta
  FROM mm a JOIN mm b USING (metric) WHERE a.model_version = 'v0' AND b.model_version = 'v1')
SELECT metric, {", ".join(S.round_dp(c, R9) + f" AS {c}" for c in ("champion", "challenger", "delta"))}, delta > 0 AS challenger_better,
  abs(delta) >= 0.01 AS significant, {wins} AS challenger_wins,
  CASE WHEN {wins} > {len(K.CHAMPION_METRICS) // 2} THEN 'PROMOTE' ELSE 'KEEP_CHAMPION' END AS recommendation FROM j
"""


def version_disagreement(spark, sf_dir):
    """Last prediction of each version for the same scored id (eight log rows an id): pair matrix and rate."""
    log = X.predictions_log(spark, sf_dir).withColumn("scored_id", F.floor(F.col("event_id") / 8))
    d = J.disagreement(log, "scored_id", "model_version", "prediction", "v0", "v1", order=("predicted_at", "event_id"))
    m = d.groupBy("champion_prediction", "challenger_prediction").agg(F.count(F.lit(1)).alias("n"), F.count_if("disagree").alias("nd"))
    return attach(m, m.agg(F.sum("n").alias("total"), F.sum("nd").alias("bad"))).select(
        "champion_prediction", "challenger_prediction", "n", rnd(F.col("bad") / F.col("total"), R9).alias("disagreement_rate"))


DISAGREEMENT_SQL = X.with_views("predictions_log") + f""",
l AS (SELECT floor(event_id / 8) AS scored_id, model_version, prediction,
  row_number() OVER (PARTITION BY floor(event_id / 8), model_version ORDER BY predicted_at DESC, event_id DESC) AS at FROM predictions_log),
d AS (SELECT a.prediction AS champion_prediction, b.prediction AS challenger_prediction FROM l a JOIN l b USING (scored_id)
  WHERE a.at = 1 AND b.at = 1 AND a.model_version = 'v0' AND b.model_version = 'v1')
SELECT champion_prediction, challenger_prediction, count(*) AS n,
  {S.round_dp("(SELECT count(*) FILTER (WHERE champion_prediction <> challenger_prediction) / count(*) FROM d)", R9)} AS disagreement_rate
FROM d GROUP BY ALL"""


QUERIES = {
    "champion_challenger": (champion_challenger, _champion_sql()),
    "version_disagreement": (version_disagreement, DISAGREEMENT_SQL),
    "confusion_by_version": (confusion_by_version,
                             CM_SQL + "SELECT model_version, truth, predicted, n FROM cm"),
    "class_report": (class_report, PER_CLASS_SQL + "SELECT model_version, label, support, n_predicted, tp, " +
                     ", ".join(f"{S.round_dp(c, R9)} AS {c}" for c in ("precision", "recall", "f1")) + " FROM pc"),
    "eval_summary": (eval_summary, SUMMARY_SQL + _summary_out_sql()),
    "ece_by_version": (ece_by_version, ECE_SQL),
    "auc_exploited": (auc_exploited, AUC_SQL),
    "auc_ovr": (auc_ovr, AUC_OVR_SQL),
    "latency_percentiles": (latency_percentiles, LATENCY_SQL),
    "traffic": (traffic, TRAFFIC_SQL),
    "prediction_share": (prediction_share, SHARE_SQL),
    "gate_checks": (gate_checks, _gate_sql()),
}
