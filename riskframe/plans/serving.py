"""Request-time style operators run as batch jobs over whole tables (B2, F3, H11, H12, H25, H30,
H31, H33, H34, H36, H37, A11, A21, D3, D22, D25, D29, C10, A22, A25-A27, E6, B8, B11-B14, G5)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..operators.scalars import attach
from .. import fixtures as X
from ..functions import display as DS
from ..functions import risk as R
from ..functions import text as T
from ..functions._util import round_half_away as rnd
from ..operators import drift as D
from ..operators import expectations as E
from ..operators import joins as J
from ..operators import metrics as M
from ..operators import sets as G
from ..operators import topk as TK
from ..sources import epss as EP
from ..sources import io as IO
from ..session import read_table, spread, written
from . import evaluation as EV
from . import ingest, scoring
from . import sqlfrag as S

R9 = 9
NOW = "2024-01-31 00:00:00"


def _lookup_data(spark, sf_dir):
    s = scoring.scored_cves(spark, sf_dir)
    return s.select("cve_id", F.concat(F.lit("Record "), F.col("cve_id")).alias("description"),
                    F.col("severity"), F.col("base_score").alias("cvss_score"), F.col("in_kev").alias("cisa_kev"),
                    "epss_score", F.lit("Vendor").alias("vendor"), F.lit("CWE-79").alias("cwe"))


def point_lookup(spark: SparkSession, sf_dir: str):
    """B2: catalog ids requested in lower case, plus the same ids moved to year 1900 (unknown)."""
    k = X.kev_history(spark, sf_dir)
    ids = k.select(F.lower("cve_id").alias("cve_id")).unionByName(
        k.select(F.regexp_replace("cve_id", r"^CVE-\d{4}", "CVE-1900").alias("cve_id")))
    return DS.point_lookup(ids, _lookup_data(spark, sf_dir))


def _point_lookup_sql() -> str:
    d = K.LOOKUP_DEFAULTS
    base = scoring._scored_sql().replace("parsed AS (SELECT cve_id, published_date,",
                                         "parsed AS (SELECT cve_id, base_score, published_date,")
    return base + f""",
data AS (SELECT upper(cve_id) AS id, 'Record ' || cve_id AS description, severity, base_score AS cvss_score,
  in_kev AS cisa_kev, epss_score, 'Vendor' AS vendor, 'CWE-79' AS cwe FROM scored),
req AS (SELECT DISTINCT upper(x) AS id FROM (SELECT lower(cve_id) AS x FROM kev_history
  UNION ALL SELECT regexp_replace(cve_id, '^CVE-[0-9]{{4}}', 'CVE-1900') FROM kev_history))
SELECT r.id AS cve_id, d.id IS NOT NULL AS found,
  CASE WHEN d.id IS NOT NULL THEN d.description ELSE '{d['description']}' END AS description,
  CASE WHEN d.id IS NOT NULL THEN d.severity ELSE '{d['severity']}' END AS severity,
  CASE WHEN d.id IS NOT NULL THEN d.cvss_score ELSE {S.dbl(d['cvss_score'])} END AS cvss_score,
  CASE WHEN d.id IS NOT NULL THEN d.cisa_kev ELSE false END AS cisa_kev,
  CASE WHEN d.id IS NOT NULL THEN d.epss_score ELSE {S.dbl(d['epss_score'])} END AS epss_score,
  CASE WHEN d.id IS NOT NULL THEN d.vendor ELSE '{d['vendor']}' END AS vendor,
  CASE WHEN d.id IS NOT NULL THEN d.cwe ELSE '{d['cwe']}' END AS cwe
FROM req r LEFT JOIN data d USING (id)"""


def display_fields(spark, sf_dir):
    """H11/H12 on the flattened feed: vendor from the first CPE (no vendor field), CWE display."""
    f = ingest.flat_feed(spark, sf_dir, ["cve_id", "cpe_list", "cwe_ids"])
    return f.select("cve_id", DS.display_vendor(F.lit(None).cast("string"), F.col("cpe_list")).alias("vendor"),
                    DS.display_cwe(F.lit(None).cast("string"), F.col("cwe_ids")).alias("cwe"))


def _display_sql() -> str:
    part = "split_part(cpe_list[1], ':', 4)"
    # initcap twin: upper first letter of each space-separated word, rest lower
    title = (f"array_to_string(list_transform(string_split(replace({part}, '_', ' '), ' '), "
             "lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')")
    return ingest._flat_sql() + f"""SELECT cve_id,
  CASE WHEN len(cpe_list) > 0 AND {part} <> '' AND {part} <> '*' THEN {title} ELSE 'Enterprise Vendor' END AS vendor,
  coalesce(list_filter(cwe_ids, lambda x: starts_with(x, 'CWE-') AND x NOT IN ('CWE-noinfo', 'CWE-Other'))[1],
           cwe_ids[1], 'CWE-20') AS cwe FROM flat"""


def alert_scores(spark, sf_dir):
    """Top-8 alerts with the fixed-context score (1 dp, capped) and SLA text."""
    s = scoring.scored_cves(spark, sf_dir)
    from ..operators.topk import alert_priority, top_k
    s = s.withColumn("priority", alert_priority("in_kev", "base_score", "epss_score"))
    t = top_k(s, "priority", 8, "cve_id")
    a = DS.alert_risk(F.col("base_score"), F.col("in_kev"), F.col("epss_score"))
    return t.select("cve_id", a["alert_score"].alias("alert_score"), a["sla"].alias("sla"))


def _alert_sql() -> str:
    base = scoring._scored_sql().replace("parsed AS (SELECT cve_id, published_date,",
                                         "parsed AS (SELECT cve_id, base_score, published_date,")
    raw = ("100.0 * (0.30 * (base_score / 10.0) + 0.25 * CASE WHEN in_kev THEN 1.0 ELSE 0.0 END + 0.20 * epss_score "
           "+ 0.15 * 0.9 + 0.07 * 1.0 + 0.03 * 0.95)")
    sc = S.round_dp(f"least(100.0, {raw})", 1)
    pr = "(40.0 * CAST(in_kev AS DOUBLE) + 4.0 * CAST(base_score AS DOUBLE) + 20.0 * CAST(epss_score AS DOUBLE))"
    return base + f""", t AS (SELECT * FROM scored ORDER BY {pr} DESC, cve_id LIMIT 8)
SELECT cve_id, {sc} AS alert_score, CASE WHEN {sc} >= 80 THEN '24 Hours (URGENT)' WHEN {sc} >= 60 THEN '72 Hours'
  ELSE '14 Days' END AS sla FROM t"""


def fallback_predictions(spark, sf_dir):
    """Class probabilities without a model -- from text for documents, from the exploited
    flag and score for CVEs -- with argmax class, label and confidence."""
    d = spread(read_table(spark, sf_dir, "documents"), "doc_id").select(F.col("doc_id").cast("string").alias("id"),
                                                    DS.text_fallback_probs(F.col("text")).alias("p"))
    s = scoring.scored_cves(spark, sf_dir).select(F.col("cve_id").alias("id"),
                                                  DS.score_fallback_probs(F.col("in_kev"), F.col("epss_score")).alias("p"))
    u = d.unionByName(s)
    cols = R.prediction_columns("p")
    return u.select("id", cols["predicted_class"].alias("predicted_class"),
                    cols["predicted_label"].alias("predicted_label"), cols["confidence"].alias("confidence"))


def _fallback_sql() -> str:
    def lst(p):
        return "[" + ", ".join(S.dbl(x) for x in p) + "]"
    t = "lower(coalesce(text, ''))"
    parts = []
    for words, probs in K.TEXT_FALLBACK_PROBS:
        cond = " OR ".join(f"position('{w}' IN {t}) > 0" for w in words)
        parts.append(f"WHEN {cond} THEN {lst(probs)}")
    tp = f"CASE {' '.join(parts)} ELSE {lst(K.TEXT_FALLBACK_DEFAULT)} END"
    sp = K.SCORE_FALLBACK_PROBS
    spx = (f"CASE WHEN coalesce(in_kev, false) OR coalesce(epss_score, 0.0) > 0.8 THEN {lst(sp['exploited_or_above_0_8'])} "
           f"WHEN coalesce(epss_score, 0.0) > 0.4 THEN {lst(sp['above_0_4'])} ELSE {lst(sp['other'])} END")
    labels = "[" + ", ".join(f"'{x}'" for x in K.LABELS_ORDER) + "]"
    return scoring._scored_sql() + f""",
u AS (SELECT CAST(doc_id AS VARCHAR) AS id, {tp} AS p FROM documents UNION ALL SELECT cve_id, {spx} FROM scored)
SELECT id, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS predicted_class,
  {labels}[list_position(p, list_max(p))] AS predicted_label, list_max(p) AS confidence FROM u"""


def contextual_risk(spark, sf_dir):
    """Criticality on a 1-5 scale normalised, tier multipliers by customer segment and
    exposure class by attack vector, applied to the risk score (capped at 100)."""
    s = scoring.scored_cves(spark, sf_dir)
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    j = s.join(o, "o_orderkey").join(c, "o_custkey", "left")
    tier = (F.when(F.col("c_mktsegment") == "BUILDING", "tier_1_mission_critical")
            .when(F.col("c_mktsegment") == "AUTOMOBILE", "tier_2_business_operational").otherwise("tier_3_internal_low"))
    expo = (F.when(F.col("attack_vector") == "NETWORK", "internet_facing")
            .when(F.col("attack_vector") == "ADJACENT", "internal_network").otherwise("air_gapped"))
    crit = R.scale_to_unit((F.col("o_custkey") % 5 + 1).cast("double"))
    m = R.contextual_multiplier(tier, expo)
    return j.select("cve_id", crit.alias("asset_criticality"), rnd(m, R9).alias("multiplier"),
                    rnd(F.least(F.lit(100.0), F.col("risk_score_raw") * m), R9).alias("contextual_risk"))


def _contextual_sql() -> str:
    base = scoring._scored_sql().replace("parsed AS (SELECT cve_id, published_date,",
                                         "parsed AS (SELECT cve_id, o_orderkey, published_date,")
    am = " ".join(f"WHEN '{k}' THEN {S.dbl(v)}" for k, v in K.ASSET_MULTIPLIERS.items())
    em = " ".join(f"WHEN '{k}' THEN {S.dbl(v)}" for k, v in K.EXPOSURE_MULTIPLIERS.items())
    return base + f""",
j AS (SELECT s.*, o.o_custkey, c.c_mktsegment FROM scored s JOIN orders o USING (o_orderkey)
  LEFT JOIN customer c ON c.c_custkey = o.o_custkey),
k AS (SELECT *, CASE WHEN c_mktsegment = 'BUILDING' THEN 'tier_1_mission_critical' WHEN c_mktsegment = 'AUTOMOBILE'
  THEN 'tier_2_business_operational' ELSE 'tier_3_internal_low' END AS tier,
  CASE WHEN attack_vector = 'NETWORK' THEN 'internet_facing' WHEN attack_vector = 'ADJACENT' THEN 'internal_network'
  ELSE 'air_gapped' END AS expo, CAST(o_custkey % 5 + 1 AS DOUBLE) AS cr FROM j),
m AS (SELECT *, coalesce(CASE tier {am} END, 1.0) * coalesce(CASE expo {em} END, 1.0) AS mult FROM k)
SELECT cve_id, CASE WHEN cr > 1.0 THEN least(1.0, cr / 5.0) ELSE cr END AS asset_criticality,
  {S.round_dp('mult', R9)} AS multiplier, {S.round_dp('least(100.0, risk_score_raw * mult)', R9)} AS contextual_risk FROM m"""


def feature_validation(spark, sf_dir):
    """Engineered-feature statistics and rule counts (severity, scores, days, length)."""
    f = ingest.flat_feed(spark, sf_dir, ["cve_id", "description", "published_date", "base_severity", "base_score"])
    from ..functions import cvss as CV
    from ..functions import dates as DT
    latest = J.latest_value(X.epss_history(spark, sf_dir), out="epss_score").select("cve_id", "epss_score")
    t = f.select("cve_id", "description", "published_date", "base_severity", "base_score")
    t = J.lookup_with_default(t, latest, "cve_id", "epss_score", 0.0)
    t = J.flag_membership(t, X.kev_history(spark, sf_dir), out="in_cisa_kev")
    t = t.select("cve_id", "epss_score", "in_cisa_kev", F.col("epss_score").alias("epss_percentile"),
                 CV.label_encode(CV.severity_from_label_or_score("base_severity", "base_score")).alias("severity_numeric"),
                 DT.temporal_features("published_date", "2002-01-01 00:00:00")["days_since_published"]
                 .alias("days_since_published"), T.char_length("description").alias("description_length"))
    stats = t.agg(F.lit(len(t.columns)).alias("total_features"), F.count(F.lit(1)).alias("total_records"),
                  F.count_if(F.col("severity_numeric") == -1).alias("missing_severity"),
                  F.count_if("in_cisa_kev").alias("in_kev_count"),
                  F.count_if(F.col("epss_score") > 0.1).alias("high_epss_count"))
    rules = E.evaluate(t, E.feature_rules())
    return attach(rules, stats)


def _feature_validation_sql() -> str:
    sev = S.severity_from_label_or_score("base_severity", "base_score")
    lab = f"coalesce({S.case_map(sev, K.SEVERITY_0_3)}, -1)"
    rules = {
        "severity_numeric_range": f"{lab} NOT IN (-1, 0, 1, 2, 3, 4)",
        "epss_score_range": "epss_score IS NULL OR epss_score < 0 OR epss_score > 1",
        "epss_percentile_range": "epss_score IS NULL OR epss_score < 0 OR epss_score > 1",
        "days_since_published_nonneg": "false",
        "description_length_not_null": "false",
    }
    anyb = " OR ".join(f"coalesce({p}, false)" for p in rules.values())
    parts = [f"SELECT '{n}' AS rule, count(*) FILTER (WHERE coalesce({p}, false)) AS n_failed, count(*) AS n_rows FROM t"
             for n, p in rules.items()]
    parts.append(f"SELECT '__any__', count(*) FILTER (WHERE {anyb}), count(*) FROM t")
    flat = ingest._flat_sql().replace("WITH cves AS", "WITH epss_history AS (" + X.EPSS_HISTORY_SQL + "),\n"
                                      "kev_history AS (" + X.KEV_HISTORY_SQL + "),\ncves AS", 1)
    return flat + f""",
latest AS (SELECT cve_id, max_by(score, snapshot_date) AS s FROM epss_history GROUP BY cve_id),
t AS (SELECT f.*, coalesce(l.s, 0.0) AS epss_score, f.cve_id IN (SELECT cve_id FROM kev_history) AS in_cisa_kev
  FROM flat f LEFT JOIN latest l USING (cve_id)),
r AS ({' UNION ALL '.join(parts)}),
st AS (SELECT 7 AS total_features, count(*) AS total_records, count(*) FILTER (WHERE {lab} = -1) AS missing_severity,
  count(*) FILTER (WHERE in_cisa_kev) AS in_kev_count, count(*) FILTER (WHERE epss_score > 0.1) AS high_epss_count FROM t)
SELECT rule, n_failed, n_rows, CASE WHEN rule = '__any__' THEN n_failed / greatest(n_rows, 1) <= 0.05 ELSE n_failed = 0 END
  AS passed, st.* FROM r, st"""


def cwe_drift(spark, sf_dir):
    """Chi-square on the first-CWE category, records published before 1998 vs from 1998."""
    f = ingest.flat_feed(spark, sf_dir, ["published_date", "cwe_ids"])
    cw = T.first_cwe_number(T.cwe_list("cwe_ids", True)).cast("string")
    f = f.withColumn("cwe_category_id", cw)
    early = F.substring("published_date", 1, 4) < "1998"
    long = D.unpivot(f.where(early), f.where(~early), ["cwe_category_id"], kind="string")
    c = D.chi_square(long)
    return c.select("feature", "k", "dof", rnd("chi2_statistic", R9).alias("chi2_statistic"))


def _cwe_drift_sql() -> str:
    return ingest._flat_sql() + f""",
long AS (SELECT 'cwe_category_id' AS feature, CAST(coalesce(CAST(nullif(regexp_extract(cwe_ids[1], '(\\d+)', 1), '') AS INTEGER), 0) AS VARCHAR) AS value,
  CASE WHEN substr(published_date, 1, 4) < '1998' THEN 0 ELSE 1 END AS side FROM flat),
c AS (SELECT feature, value, count(*) FILTER (WHERE side = 0) + 1 AS r, count(*) FILTER (WHERE side = 1) + 1 AS q FROM long GROUP BY ALL),
t AS (SELECT feature, sum(r) AS rr, sum(q) AS qq, count(*) AS k FROM c GROUP BY feature),
s AS (SELECT feature, k, sum((q - r * qq / rr) * (q - r * qq / rr) / (r * qq / rr)) AS chi2 FROM c JOIN t USING (feature) GROUP BY feature, k)
SELECT feature, k, k - 1 AS dof, {S.round_dp("CASE WHEN k > 1 THEN chi2 END", R9)} AS chi2_statistic FROM s"""


def key_feature_psi(spark, sf_dir):
    """Mean PSI over the key features and the alert flag."""
    from . import monitoring as MO
    p = D.psi(MO.numeric_long(spark, sf_dir))
    r = D.key_feature_psi(p, ["value", "k"])
    return r.select(rnd("mean_psi", R9).alias("mean_psi"), "alert")


def _key_psi_sql() -> str:
    from . import monitoring as MO
    body = MO.PSI_SQL.rsplit("SELECT f.feature", 1)[0]
    return body + f"""SELECT {S.round_dp("avg(coalesce(per.psi, 0.0))", R9)} AS mean_psi,
  coalesce(avg(coalesce(per.psi, 0.0)) > 0.2, false) AS alert
FROM (SELECT DISTINCT feature FROM long) f LEFT JOIN per USING (feature) WHERE f.feature IN ('value', 'k')"""


def _feedback(spark, sf_dir):
    """A22 rows: an analyst correction for every logged prediction that disagrees with the CVE label."""
    lab = EV.labeled_predictions(spark, sf_dir).where(F.col("predicted") != F.col("truth"))
    fb = lab.select(F.col("event_id").alias("id"), F.col("event_id").cast("string").alias("cve_id"),
                    F.concat(F.lit("analyst"), (F.col("event_id") % 7).cast("string")).alias("analyst_id"),
                    F.lower("predicted").alias("predicted_severity"), F.lower("truth").alias("corrected_severity"),
                    F.lit("").alias("feedback_notes"), (F.col("event_id") % 7).alias("confidence_rating"),
                    "predicted_at")
    return IO.feedback_rows(fb.withColumnRenamed("predicted_at", "__ts"), F.col("__ts") + F.expr("INTERVAL 1 DAY")) \
        .withColumn("id", F.col("cve_id").cast("long"))


def feedback_override(spark, sf_dir):
    """Latest accepted correction per id overrides the logged label; label counts after."""
    log = X.predictions_log(spark, sf_dir).select(F.col("event_id").cast("string").alias("cve_id"),
                                                  F.col("prediction").alias("severity_label"))
    out = J.apply_feedback(log, _feedback(spark, sf_dir))
    return out.groupBy("severity_label").agg(F.count(F.lit(1)).alias("n"))


def _feedback_base_sql() -> str:
    return EV.LABELED_SQL + """,
fb AS (SELECT CAST(event_id AS VARCHAR) AS cve_id, upper(truth) AS corrected, predicted_at + INTERVAL 1 DAY AS submitted_at,
  event_id % 7 AS rating FROM lab WHERE predicted <> truth AND event_id % 7 BETWEEN 1 AND 5)
"""


def _feedback_override_sql() -> str:
    return _feedback_base_sql() + """,
c AS (SELECT cve_id, max_by(corrected, submitted_at) AS corr FROM fb GROUP BY cve_id),
o AS (SELECT coalesce(c.corr, p.prediction) AS severity_label FROM predictions_log p
  LEFT JOIN c ON c.cve_id = CAST(p.event_id AS VARCHAR))
SELECT severity_label, count(*) AS n FROM o GROUP BY severity_label"""


def unused_feedback(spark, sf_dir):
    """Corrections not yet in the used ledger (ledger = ids submitted before the 20th)."""
    fb = _feedback(spark, sf_dir)
    ledger = IO.mark_used(fb.where(F.col("submitted_at") < F.lit("2024-01-20").cast("timestamp")),
                          F.lit(NOW).cast("timestamp"))
    return G.unused(fb, ledger, "id").select("id", "corrected_severity", "confidence_rating")


def _unused_sql() -> str:
    return _feedback_base_sql() + """
SELECT CAST(cve_id AS BIGINT) AS id, upper(corrected) AS corrected_severity, CAST(rating AS INTEGER) AS confidence_rating
FROM fb WHERE submitted_at >= TIMESTAMP '2024-01-20'"""


def ingestion_accounting(spark, sf_dir):
    """Fetched / inserted / updated counts for a score batch appended to the history."""
    h = X.epss_history(spark, sf_dir)
    stored = h.where(F.col("snapshot_date") < F.lit("1998-01-01").cast("date"))
    batch = h.where(F.col("snapshot_date") >= F.lit("1997-12-01").cast("date"))
    return IO.ingestion_accounting(batch, G.append_new(stored, batch, ["cve_id", "snapshot_date"]), "epss")


def _accounting_sql() -> str:
    return X.with_views("epss_history") + """,
s AS (SELECT * FROM epss_history WHERE snapshot_date < DATE '1998-01-01'),
b AS (SELECT * FROM epss_history WHERE snapshot_date >= DATE '1997-12-01'),
i AS (SELECT * FROM b ANTI JOIN s USING (cve_id, snapshot_date))
SELECT 'epss' AS source, (SELECT count(*) FROM b) AS records_fetched, (SELECT count(*) FROM i) AS records_inserted,
  (SELECT count(*) FROM b) - (SELECT count(*) FROM i) AS records_updated, 'success' AS status"""


def recent_or_latest(spark, sf_dir):
    """Log rows newer than NOW - 7 days; the fallback branch (most recent 200) only fires when empty."""
    log = X.predictions_log(spark, sf_dir)
    a = R.recent_or_latest(log, "predicted_at", "2024-01-24 00:00:00", 200, ("event_id",)).select("event_id")
    b = R.recent_or_latest(log, "predicted_at", "2030-01-01 00:00:00", 200, ("event_id",)).select("event_id")
    return a.withColumn("branch", F.lit("recent")).unionByName(b.withColumn("branch", F.lit("fallback")))


RECENT_FB_SQL = X.with_views("predictions_log") + """
SELECT event_id, 'recent' AS branch FROM predictions_log WHERE predicted_at >= TIMESTAMP '2024-01-24 00:00:00'
UNION ALL SELECT event_id, 'fallback' FROM (SELECT event_id FROM predictions_log ORDER BY predicted_at DESC, event_id LIMIT 200)"""


def first_scored(spark, sf_dir, n: int = 300):
    """The first 300 records with a score (null scores dropped, id order), as the list view does."""
    s = scoring.scored_cves(spark, sf_dir).where(F.col("base_score").isNotNull())
    return s.orderBy("cve_id").limit(n).select("cve_id", "base_score", "severity")


def _first_scored_sql() -> str:
    base = scoring._scored_sql().replace("parsed AS (SELECT cve_id, published_date,",
                                         "parsed AS (SELECT cve_id, base_score, published_date,")
    return base + "SELECT cve_id, base_score, severity FROM scored WHERE base_score IS NOT NULL ORDER BY cve_id LIMIT 300"


def score_snapshot(spark, sf_dir):
    """One snapshot date, highest score first (the whole date)."""
    return EP.scores_on(X.epss_history(spark, sf_dir), "1996-06-01").orderBy(F.col("score").desc(), "cve_id")


SNAPSHOT_SQL = X.with_views("epss_history") + \
    "SELECT * FROM epss_history WHERE snapshot_date = DATE '1996-06-01' ORDER BY score DESC, cve_id"


def live_accuracy(spark, sf_dir):
    """Live accuracy per version with the >= 5 matches rule."""
    cm = EV.confusion_by_version(spark, sf_dir)
    s = M.live_accuracy(cm, ["model_version"])
    return s.select("model_version", "status", "n", rnd("macro_f1", R9).alias("macro_f1"),
                    rnd("critical_recall", R9).alias("critical_recall"), rnd("high_recall", R9).alias("high_recall"))


def _live_sql() -> str:
    return EV.SUMMARY_SQL + f"""SELECT model_version, CASE WHEN n >= 5 THEN 'success' ELSE 'awaiting_late_labels' END AS status,
  n, {S.round_dp('macro_f1', R9)} AS macro_f1, {S.round_dp('critical_recall', R9)} AS critical_recall,
  {S.round_dp('high_recall', R9)} AS high_recall FROM summ"""


def cve_list_page(spark, sf_dir):
    """Second page (50 rows) of exploited CVEs with CVSS >= 7, riskiest first."""
    s = scoring.scored_cves(spark, sf_dir)
    p = TK.cve_page(s, kev_only=True, min_cvss=7.0, page=2, page_size=50,
                    order=("risk_score_raw", "cve_id", "o_orderkey"), descending=(True, False, False))
    return p.select("cve_id", "base_score", "in_kev", "epss_score", "risk_score", "risk_tier")


def _cve_list_sql() -> str:
    base = scoring._scored_sql().replace("parsed AS (SELECT cve_id, published_date,",
                                         "parsed AS (SELECT cve_id, o_orderkey, base_score, published_date,")
    return base + """SELECT cve_id, base_score, in_kev, epss_score, risk_score, risk_tier FROM scored
WHERE in_kev AND base_score >= 7.0 ORDER BY risk_score_raw DESC, cve_id, o_orderkey LIMIT 50 OFFSET 50"""


def cve_list_seek(spark, sf_dir):
    """The first three pages (50 rows each) of exploited CVEs, riskiest first, each sought behind the
    last row of the page before it. The scored rows are written once; pages and tokens read them there."""
    s = written(scoring.scored_cves(spark, sf_dir).where("in_kev")
                .select("cve_id", "o_orderkey", "risk_score_raw", "risk_score", "risk_tier"))
    order, down, token, out = ("risk_score_raw", "cve_id", "o_orderkey"), (True, False, False), None, None
    for number in range(1, 4):
        page = TK.seek_page(s, order, down, 50, token)
        token = TK.page_token(page, order)
        page = page.select(F.lit(number).alias("page"), "cve_id", "risk_score", "risk_tier")
        out = page if out is None else out.unionByName(page)
        if token is None:
            break
    return out


def _seek_sql() -> str:
    base = scoring._scored_sql().replace("parsed AS (SELECT cve_id, published_date,",
                                         "parsed AS (SELECT cve_id, o_orderkey, base_score, published_date,")
    return base + """SELECT CAST((r - 1) // 50 + 1 AS INTEGER) AS page, cve_id, risk_score, risk_tier FROM (
  SELECT *, row_number() OVER (ORDER BY risk_score_raw DESC, cve_id, o_orderkey) AS r FROM scored WHERE in_kev) WHERE r <= 150"""


def realised_accuracy(spark, sf_dir):
    """Realised accuracy per version once >= 20 predictions have a paired label."""
    cm = EV.confusion_by_version(spark, sf_dir)
    r = M.realised_accuracy(cm, ["model_version"], min_rows=20)
    return r.select("model_version", "evaluated_samples", rnd("macro_f1", R9).alias("macro_f1"),
                    rnd("critical_recall", R9).alias("critical_recall"))


def _realised_sql() -> str:
    return EV.SUMMARY_SQL + f"""SELECT model_version, n AS evaluated_samples, {S.round_dp('macro_f1', R9)} AS macro_f1,
  {S.round_dp('coalesce(critical_recall, 0.0)', R9)} AS critical_recall FROM summ WHERE n >= 20"""


def prediction_log_rows(spark, sf_dir):
    """Rows appended to the prediction log for every scored CVE (confidence 4 dp, JSON payload)."""
    s = scoring.scored_cves(spark, sf_dir)
    return IO.prediction_log_rows(s.withColumn("conf", F.col("risk_score_raw") / 100.0), "cve_id", "risk-v1",
                                  "risk_tier", "conf", ["epss_score", "in_kev", "severity"],
                                  F.lit(NOW).cast("timestamp"))


REQUIRED = ["base_score", "vector_length", "reference_count"]


def _halves(spark, sf_dir):
    """Two frames of records, before 1996 and since, that share some of their columns."""
    c = X.cves(spark, sf_dir).withColumn("vector_length", F.nullif(F.length("cvss_vector") - 40, F.lit(0)).cast("int")).withColumn(
        "access", F.nullif(F.substring("cvss_vector", 13, 1), F.lit("P")))
    early = F.col("published_date") < F.lit("1996-01-01").cast("date")
    ref = c.where(early).select("cve_id", "base_score", "base_severity", "vector_length", "access", F.lit("").alias("note"))
    return ref, c.where(~early).select("cve_id", "base_score", "base_severity", "vector_length", "access", (F.col("o_orderkey") % 3).alias("order_class"))


def schema_checks(spark, sf_dir):
    """Leakage, projection, completion and drift candidates of every column, with the
    figures of both frames that they act on."""
    return E.column_checks(*_halves(spark, sf_dir), REQUIRED)


def _schema_checks_sql() -> str:
    frames = X.with_views("cves") + """,
c AS (SELECT *, CAST(nullif(len(cvss_vector) - 40, 0) AS INTEGER) AS vector_length, nullif(substr(cvss_vector, 13, 1), 'P') AS access FROM cves),
ref AS (SELECT cve_id, base_score, base_severity, vector_length, access, '' AS note FROM c WHERE published_date < DATE '1996-01-01'),
cur AS (SELECT cve_id, base_score, base_severity, vector_length, access, o_orderkey % 3 AS order_class FROM c WHERE NOT published_date < DATE '1996-01-01')
"""
    text, ref, cur = {"cve_id", "base_severity", "access", "note"}, ["note"], ["order_class"]
    both = ["cve_id", "base_score", "base_severity", "vector_length", "access"]
    parts = []
    for c in [*both, *ref, *cur, "reference_count"]:
        numeric, categorical = c in ("base_score", "vector_length"), c in ("base_severity", "access")
        cols = [f"'{c}' AS \"column\"", f"{c in E.FORBIDDEN_FEATURES} AS forbidden", f"{c not in K.LEAKAGE_COLUMNS} AS kept", f"{c in both} AS shared",
                f"{numeric} AS numeric_candidate", f"{categorical} AS categorical_candidate"]
        for side, own in (("ref", ref), ("cur", cur)):
            there, blank = c in both + own, "''" if c in text else "0"
            cols += [f"(SELECT count(*) FROM {side}) AS {side}_rows",
                     f"(SELECT count(*) FROM {side} WHERE {c} IS NULL) AS {side}_nulls" if there else f"NULL AS {side}_nulls",
                     f"(SELECT count(*) FROM {side} WHERE {c} <> {blank}) AS {side}_full" if there else f"NULL AS {side}_full",
                     f"(SELECT count(*) FROM {side}{f' WHERE {c} IS NULL' if there else ''}) AS {side}_filled" if c in REQUIRED else f"0 AS {side}_filled"]
        found = [f"(SELECT count(DISTINCT {c}) FROM {t})" if categorical else "NULL" for t in ("ref", "cur", f"(SELECT {c} FROM ref WHERE {c} IN (SELECT {c} FROM cur))")]
        parts.append("SELECT " + ", ".join(cols + [f"{x} AS {n}" for x, n in zip(found, ("ref_values", "cur_values", "shared_values"), strict=True)]))
    return frames + " UNION ALL ".join(parts)


def report_rows(spark, sf_dir):
    """The drift report as JSON text rows."""
    from . import monitoring as MO
    return IO.report_json(MO.drift_report(spark, sf_dir))


QUERIES = {
    "point_lookup": (point_lookup, _point_lookup_sql()),
    "display_fields": (display_fields, _display_sql()),
    "alert_scores": (alert_scores, _alert_sql()),
    "fallback_predictions": (fallback_predictions, _fallback_sql()),
    "contextual_risk": (contextual_risk, _contextual_sql()),
    "feature_validation": (feature_validation, _feature_validation_sql()),
    "cwe_drift": (cwe_drift, _cwe_drift_sql()),
    "key_feature_psi": (key_feature_psi, _key_psi_sql()),
    "feedback_override": (feedback_override, _feedback_override_sql()),
    "unused_feedback": (unused_feedback, _unused_sql()),
    "ingestion_accounting": (ingestion_accounting, _accounting_sql()),
    "recent_or_latest": (recent_or_latest, RECENT_FB_SQL),
    "first_scored": (first_scored, _first_scored_sql()),
    "score_snapshot": (score_snapshot, SNAPSHOT_SQL),
    "live_accuracy": (live_accuracy, _live_sql()),
    "realised_accuracy": (realised_accuracy, _realised_sql()),
    "cve_list_seek": (cve_list_seek, _seek_sql()),
    "cve_list_page": (cve_list_page, _cve_list_sql()),
    "prediction_log_rows": (prediction_log_rows, None),
    "schema_checks": (schema_checks, _schema_checks_sql()),
    "report_rows": (report_rows, None),
}
