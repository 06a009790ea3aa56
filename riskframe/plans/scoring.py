"""Scoring plans: CVE records -> parsed CVSS -> severity -> exploited flag and
latest exploit probability -> weighted risk score and tier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from .. import fixtures as X
from ..functions import cvss as CV
from ..functions import risk as R
from ..operators import joins as J
from ..session import read_table
from . import sqlfrag as S

RISK_OUT = ["cve_id", "published_date", "severity", "attack_vector", "in_kev", "epss_score",
            "risk_score_raw", "risk_score", "risk_tier"]


def scored_cves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every CVE with parsed vector, severity, exploited flag, latest score, risk."""
    c = CV.with_cvss(X.cves(spark, sf_dir))
    c = c.withColumn("severity", CV.severity_from_label_or_score("base_severity", "base_score"))
    c = J.flag_membership(c, X.kev_history(spark, sf_dir), out="in_kev")
    latest = J.latest_value(X.epss_history(spark, sf_dir), out="latest_score")
    c = c.join(latest.select("cve_id", "latest_score"), "cve_id", "left") \
         .withColumn("epss_score", F.coalesce("latest_score", F.lit(0.0)))
    return R.with_risk_score(c, severity_label="severity", kev="in_kev", epss="epss_score")


def risk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity from label or score ladder, clipped components, weighted
    0-100 score and tier for every CVE."""
    return scored_cves(spark, sf_dir).select(*RISK_OUT)


def risk_top_k(spark: SparkSession, sf_dir: str, k: int = 100) -> DataFrame:
    """Top-k report (the limit is the feature); total order by raw score then id."""
    return (scored_cves(spark, sf_dir).orderBy(F.col("risk_score_raw").desc(), F.col("cve_id"))
            .limit(k).select(*RISK_OUT))


def _scored_sql() -> str:
    f = S.cvss_fields("cvss_vector")
    comps = {
        "cvss": S.severity_component("severity"),
        "kev": "CASE WHEN in_kev THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END",
        "epss": S.clip01("epss_score"),
        "asset_criticality": "0.5::DOUBLE",
        "exposure": "0.5::DOUBLE",
        "model_confidence": "0.5::DOUBLE",
    }
    risk = S.risk_select(comps)
    return X.with_views("cves", "epss_history", "kev_history") + f""",
parsed AS (SELECT cve_id, published_date, {f['attack_vector']} AS attack_vector,
  {S.severity_from_label_or_score('base_severity', 'base_score')} AS severity FROM cves),
latest AS (SELECT cve_id, max_by(score, snapshot_date) AS latest_score FROM epss_history GROUP BY cve_id),
kev AS (SELECT DISTINCT cve_id FROM kev_history),
joined AS (SELECT p.*, k.cve_id IS NOT NULL AS in_kev, coalesce(l.latest_score, 0.0::DOUBLE) AS epss_score
  FROM parsed p LEFT JOIN kev k ON p.cve_id = k.cve_id LEFT JOIN latest l ON p.cve_id = l.cve_id),
scored AS (SELECT *, {S.select_list(risk)} FROM joined)
"""


def risk_scores_sql() -> str:
    return _scored_sql() + "SELECT " + ", ".join(RISK_OUT) + " FROM scored"


def risk_top_k_sql(k: int = 100) -> str:
    return (_scored_sql() + "SELECT " + ", ".join(RISK_OUT) +
            f" FROM scored ORDER BY risk_score_raw DESC, cve_id LIMIT {k}")


def cvss_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1-H3: parsed vector fields, one-hot flags and severity ordinal for every CVE."""
    c = CV.with_cvss(X.cves(spark, sf_dir), onehot=True)
    flags = [n for n, _, _ in K.CVSS_ONEHOT] + ["has_cvss_v3"]
    return c.select("cve_id", "version", *K.CVSS_FIELDS.values(),
                    F.aggregate(F.array(*[F.col(n).cast("int") for n in flags]), F.lit(0),
                                lambda a, b: a + b).alias("n_flags"),
                    CV.severity_ordinal("base_severity").alias("severity_ordinal"))


def cvss_parse_sql() -> str:
    f = S.cvss_fields("cvss_vector")
    flag_terms = []
    for name, field, val in K.CVSS_ONEHOT:
        flag_terms.append(f"CAST(coalesce(({f[field]}) = '{val}', false) AS INTEGER)")
    flag_terms.append(f"CAST(({f['attack_vector']}) IS NOT NULL AS INTEGER)")
    ordinal = f"coalesce({S.case_map('upper(base_severity)', K.SEVERITY_0_4)}, -1)"
    cols = {"cve_id": "cve_id", **f, "n_flags": " + ".join(flag_terms), "severity_ordinal": ordinal}
    return X.with_views("cves") + "SELECT " + S.select_list(cols) + " FROM cves"


def batch_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed risk inputs (logged class and confidence, latest score, catalog, asset and exposure maps, H34)
    with the batch defaults, scored."""
    c = X.cves(spark, sf_dir).select("cve_id", "o_orderkey")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    known = c.join(o, "o_orderkey")
    log = X.predictions_log(spark, sf_dir).groupBy(F.col("event_id").alias("o_orderkey")).agg(
        F.max_by("prediction", "predicted_at").alias("predicted_label"), F.max_by("confidence", "predicted_at").alias("confidence"))
    preds = c.join(log, "o_orderkey").select("cve_id", "predicted_label", "confidence")
    latest = J.latest_value(X.epss_history(spark, sf_dir), out="epss_score").select("cve_id", "epss_score")
    assets = known.where(F.col("o_custkey") % 3 == 0).select("cve_id", ((F.col("o_custkey") % 10) / F.lit(10.0)).alias("asset_criticality"))
    category = F.when(F.col("o_orderstatus") == "F", "INTERNET_FACING").when(F.col("o_orderstatus") == "O", "INTERNAL_RESTRICTED")
    exposure = known.where(F.col("o_custkey") % 7 != 0).select("cve_id", R.exposure_from_category(category).alias("exposure_score"))
    x = J.batch_risk_inputs(c.select("cve_id"), preds, latest, X.kev_history(spark, sf_dir), assets, exposure)
    x = R.with_risk_score(x, severity_label="predicted_label", kev="in_kev", epss="epss_score", asset="asset_criticality",
                          exposure="exposure_score", confidence="confidence")
    return x.select("cve_id", "predicted_label", "confidence", "epss_score", "in_kev", "asset_criticality", "exposure_score",
                    "risk_score_raw", "risk_score", "risk_tier")


def _batch_risk_sql() -> str:
    comps = {"cvss": S.severity_component("predicted_label"), "kev": "CASE WHEN in_kev THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END",
             "epss": S.clip01("epss_score"), "asset_criticality": S.clip01("asset_criticality"), "exposure": S.clip01("exposure_score"),
             "model_confidence": S.clip01("confidence")}
    risk = {k: v for k, v in S.risk_select(comps).items() if not k.startswith("contribution")}
    return X.with_views("cves", "epss_history", "kev_history", "predictions_log") + f""",
latest AS (SELECT cve_id, max_by(score, snapshot_date) AS s FROM epss_history GROUP BY cve_id),
kev AS (SELECT DISTINCT cve_id FROM kev_history),
x AS (SELECT c.cve_id, coalesce(p.prediction, 'MEDIUM') AS predicted_label, coalesce(p.confidence, 0.5) AS confidence,
  coalesce(l.s, 0.0) AS epss_score, k.cve_id IS NOT NULL AS in_kev,
  CASE WHEN o_custkey % 3 = 0 THEN (o_custkey % 10) / 10.0E0 ELSE 0.5E0 END AS asset_criticality,
  CASE WHEN o_custkey % 7 = 0 THEN 0.5E0 WHEN o_orderstatus = 'F' THEN 1.0E0 WHEN o_orderstatus = 'O' THEN 0.5E0 ELSE 0.2E0 END AS exposure_score
  FROM cves c JOIN orders o USING (o_orderkey) LEFT JOIN predictions_log p ON p.event_id = c.o_orderkey
  LEFT JOIN latest l ON l.cve_id = c.cve_id LEFT JOIN kev k ON k.cve_id = c.cve_id)
SELECT *, {S.select_list(risk)} FROM x"""


def risk_four_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four-weight preset (severity, exploitability subscore, exploited, score)."""
    x = scored_cves(spark, sf_dir).select("cve_id", "severity", "in_kev", "epss_score", ((F.col("o_orderkey") % 40) / F.lit(10.0)).alias("subscore"))
    x = R.with_risk_score(x, weights=K.RISK_WEIGHT_PRESETS["four_factor"], severity_label="severity", kev="in_kev",
                          epss="epss_score", exploitability="subscore")
    return x.select("cve_id", "subscore", "risk_score_raw", "risk_score", "risk_tier")


def _four_factor_sql() -> str:
    comps = {"cvss": S.severity_component("severity"), "exploitability": S.clip01(f"subscore / {K.EXPLOITABILITY_MAX}::DOUBLE"),
             "kev": "CASE WHEN in_kev THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END", "epss": S.clip01("epss_score")}
    risk = {k: v for k, v in S.risk_select(comps, K.RISK_WEIGHT_PRESETS["four_factor"]).items() if not k.startswith("contribution")}
    return _scored_sql() + f""",
f AS (SELECT s.cve_id, s.severity, s.in_kev, s.epss_score, (c.o_orderkey % 40) / 10.0E0 AS subscore FROM scored s JOIN cves c USING (cve_id))
SELECT cve_id, subscore, {S.select_list(risk)} FROM f"""


def risk_five_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five-weight preset (severity, score, exploited, asset criticality on a 1-5 scale, exposure class)."""
    x = scored_cves(spark, sf_dir).select("cve_id", "severity", "in_kev", "epss_score", F.col("o_orderkey").alias("k"))
    category = F.when(F.col("k") % 3 == 0, "INTERNET_FACING").when(F.col("k") % 3 == 1, "INTERNAL_RESTRICTED")
    x = x.withColumn("asset", R.scale_to_unit(F.nullif(F.col("k") % 6, F.lit(0)))).withColumn("exposure_score", R.exposure_from_category(category))
    x = R.with_risk_score(x, weights=K.RISK_WEIGHT_PRESETS["five_factor"], severity_label="severity", kev="in_kev", epss="epss_score",
                          asset="asset", exposure="exposure_score")
    return x.select("cve_id", "asset", "exposure_score", "risk_score_raw", "risk_score", "risk_tier")


def _five_factor_sql() -> str:
    comps = {"cvss": S.severity_component("severity"), "epss": S.clip01("epss_score"),
             "kev": "CASE WHEN in_kev THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END", "asset_criticality": S.clip01("coalesce(asset, 0.5)"),
             "exposure": S.clip01("exposure_score")}
    risk = {k: v for k, v in S.risk_select(comps, K.RISK_WEIGHT_PRESETS["five_factor"]).items() if not k.startswith("contribution")}
    return _scored_sql() + f""",
f AS (SELECT s.cve_id, s.severity, s.in_kev, s.epss_score,
  CASE c.o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 1.0E0 ELSE least(1.0E0, (c.o_orderkey % 6) / 5.0E0) END AS asset,
  CASE c.o_orderkey % 3 WHEN 0 THEN 1.0E0 WHEN 1 THEN 0.5E0 ELSE 0.2E0 END AS exposure_score FROM scored s JOIN cves c USING (cve_id))
SELECT cve_id, asset, exposure_score, {S.select_list(risk)} FROM f"""


def default_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score given as text (null, junk or NaN -> 5.0), its default exploit score and exploited flag."""
    c = J.flag_membership(X.cves(spark, sf_dir), X.kev_history(spark, sf_dir), out="in_kev")
    kind = F.col("o_orderkey") % 9
    text = F.when(kind == 0, "NaN").when(kind == 1, "n/a").when(kind == 2, F.lit(None)).otherwise(F.col("base_score").cast("string"))
    c = c.withColumn("score", R.safe_double(text, 5.0))
    return c.select("cve_id", "score", R.default_score_from_cvss("score").alias("default_epss"), R.exploited_flag("score", "in_kev").alias("exploited"))


DEFAULT_SCORES_SQL = X.with_views("cves", "kev_history") + f""",
t AS (SELECT cve_id, CASE o_orderkey % 9 WHEN 0 THEN 'NaN' WHEN 1 THEN 'n/a' WHEN 2 THEN NULL ELSE CAST(base_score AS VARCHAR) END AS txt,
  cve_id IN (SELECT cve_id FROM kev_history) AS in_kev FROM cves),
s AS (SELECT cve_id, in_kev, coalesce(CASE WHEN isfinite(try_cast(txt AS DOUBLE)) THEN try_cast(txt AS DOUBLE) END, 5.0) AS score FROM t)
SELECT cve_id, score, {S.round_dp("least(0.95E0, greatest(0.02E0, (score / 10.0E0) * (score / 10.0E0) * 0.45E0))", 3)} AS default_epss,
  in_kev OR score >= 9.4 AS exploited FROM s"""


QUERIES = {
    "batch_risk": (batch_risk, _batch_risk_sql()),
    "risk_four_factor": (risk_four_factor, _four_factor_sql()),
    "risk_five_factor": (risk_five_factor, _five_factor_sql()),
    "default_scores": (default_scores, DEFAULT_SCORES_SQL),
    "risk_top_k": (risk_top_k, risk_top_k_sql()),
    "risk_scores": (risk_scores, risk_scores_sql()),
    "cvss_parse": (cvss_parse, cvss_parse_sql()),
}
