"""Data-quality, set-operation, KPI and top-k plans (A7, A18, A19, A23, B1, B5-B9, D1, D2, D5,
D6, D8, D26-D28, D31, E4, F1, F2, G1)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from .. import fixtures as X
from ..functions._util import round_half_away as rnd
from ..functions import text as T
from ..operators import aggregates as A
from ..operators import constraints as CN
from ..operators import expectations as E
from ..operators import metrics as M
from ..operators import sets as G
from ..operators import topk as TK
from ..session import read_table, spread
from . import scoring
from . import sqlfrag as S

R9 = 9
NOW = "2024-01-31 00:00:00"      # reference instant for look-backs (an argument, never the clock)
LATENCY_BUCKETS = [5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0]


AS_OF = "1998-07-15"


def raw_expectations(spark: SparkSession, sf_dir: str):
    """Every raw rule counted in one pass + the bad-row threshold row."""
    c = X.cves(spark, sf_dir)
    return E.evaluate(c, E.raw_rules())


def dated_expectations(spark: SparkSession, sf_dir: str):
    """The raw rules and the rule on future dates together, as of a given day."""
    return E.evaluate(X.cves(spark, sf_dir), E.raw_rules() | E.future_date_rule(as_of=AS_OF))


def _raw_exp_sql(extra: dict[str, str] | None = None) -> str:
    sev = ", ".join(f"'{x}'" for x in E.SEVERITY_VALUES)
    rules = {
        "cve_id_format": f"NOT coalesce(regexp_full_match(cve_id, '{E.CVE_ID_REGEX[1:-1]}'), false)",
        "published_date_not_null": "published_date IS NULL",
        "severity_label_valid": f"base_severity IS NOT NULL AND base_severity NOT IN ({sev})",
        "base_score_range": "base_score IS NOT NULL AND (base_score < 0.0 OR base_score > 10.0)",
    } | (extra or {})
    anyb = " OR ".join(f"coalesce({p}, false)" for p in rules.values())
    parts = [f"SELECT '{n}' AS rule, CAST(count(*) FILTER (WHERE coalesce({p}, false)) AS BIGINT) AS n_failed, "
             f"CAST(count(*) AS BIGINT) AS n_rows FROM cves" for n, p in rules.items()]
    parts.append(f"SELECT '__any__', CAST(count(*) FILTER (WHERE {anyb}) AS BIGINT), CAST(count(*) AS BIGINT) FROM cves")
    body = "\nUNION ALL\n".join(parts)
    return X.with_views("cves") + f""", r AS ({body})
SELECT rule, n_failed, n_rows, CASE WHEN rule = '__any__' THEN n_failed / greatest(n_rows, 1) <= 0.05 ELSE n_failed = 0 END AS passed FROM r"""


def raw_stats(spark, sf_dir):
    """D2 on the CVE table."""
    return A.raw_stats(X.cves(spark, sf_dir), desc_col=None)


RAW_STATS_SQL = X.with_views("cves") + """
SELECT count(*) AS total_records, count(*) FILTER (WHERE coalesce(cvss_vector, '') <> '') AS with_cvss_vector,
  min(substr(cve_id, 5, 4)) AS year_min, max(substr(cve_id, 5, 4)) AS year_max FROM cves"""


def null_profile(spark, sf_dir):
    """Null counts of the critical columns."""
    cols = ["cve_id", "published_date", "base_score", "base_severity", "cvss_vector"]
    return A.null_profile(X.cves(spark, sf_dir), cols)


NULL_PROFILE_SQL = X.with_views("cves") + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, count(*) FILTER (WHERE {c} IS NULL) AS n_null, count(*) AS n FROM cves"
    for c in ["cve_id", "published_date", "base_score", "base_severity", "cvss_vector"])


def severity_distribution(spark, sf_dir):
    """Class counts, shares and the rare-class flag of the target label."""
    s = scoring.scored_cves(spark, sf_dir)
    d = A.class_distribution(s, "severity")
    return d.select("severity", "n", rnd("share", R9).alias("share"), "rare")


def _sev_dist_sql() -> str:
    return scoring._scored_sql() + f""",
c AS (SELECT severity, count(*) AS n FROM scored GROUP BY severity), t AS (SELECT sum(n) AS tot FROM c)
SELECT severity, n, {S.round_dp("n / tot", R9)} AS share, n / tot < 0.01 AS rare FROM c, t"""


def platform_kpis(spark, sf_dir):
    return A.platform_kpis(scoring.scored_cves(spark, sf_dir))


def _kpi_sql() -> str:
    counts = ", ".join(f"count(*) FILTER (WHERE severity = '{lab}') AS n_{lab.lower()}"
                       for lab in reversed(K.LABELS_ORDER))
    return scoring._scored_sql() + f"""
SELECT count(*) AS total, {counts}, count(*) FILTER (WHERE in_kev) AS n_exploited,
  round(avg(epss_score) * 100.0 * 10.0, 0) / 10.0 AS mean_score_pct,
  count(*) FILTER (WHERE severity IN ('CRITICAL', 'HIGH')) AS n_critical_high FROM scored"""


def top_alerts(spark, sf_dir, k: int = 8):
    """F1: top 8 by 40*exploited + 4*cvss + 20*score (ties by id)."""
    s = scoring.scored_cves(spark, sf_dir)
    s = s.withColumn("priority", TK.alert_priority("in_kev", "base_score", "epss_score"))
    return TK.top_k(s, "priority", k, "cve_id").select("cve_id", "priority", "in_kev", "base_score", "epss_score")


def _top_alerts_sql(k: int = 8) -> str:
    base = scoring._scored_sql().replace("parsed AS (SELECT cve_id, published_date,",
                                         "parsed AS (SELECT cve_id, base_score, published_date,")
    pr = "(40.0 * CAST(in_kev AS DOUBLE) + 4.0 * CAST(base_score AS DOUBLE) + 20.0 * CAST(epss_score AS DOUBLE))"
    return base + f"SELECT cve_id, {pr} AS priority, in_kev, base_score, epss_score FROM scored ORDER BY priority DESC, cve_id LIMIT {k}"


def severity_filter(spark, sf_dir):
    """B1: case-insensitive severity filter with the default page size (50), ordered by id."""
    s = scoring.scored_cves(spark, sf_dir).select("cve_id", "severity", "risk_score")
    return TK.severity_filter(s, "high", col="severity", limit=50)


def _sev_filter_sql() -> str:
    return scoring._scored_sql() + \
        "SELECT cve_id, severity, risk_score FROM scored WHERE upper(severity) = 'HIGH' ORDER BY cve_id LIMIT 50"


def exploited_top_recall(spark, sf_dir):
    """Exploited rows landing in the top two risk tiers."""
    s = scoring.scored_cves(spark, sf_dir)
    return M.exploited_top_tier_recall(s, "in_kev", "risk_tier").select(
        "n_exploited", "n_exploited_top", rnd("exploited_top_recall", R9).alias("exploited_top_recall"))


def _exploited_top_sql() -> str:
    return scoring._scored_sql() + f""", a AS (SELECT count(*) FILTER (WHERE in_kev) AS n_exploited,
  count(*) FILTER (WHERE in_kev AND risk_tier IN ('CRITICAL_RISK', 'HIGH_RISK')) AS n_exploited_top FROM scored)
SELECT n_exploited, n_exploited_top, {S.round_dp("CASE WHEN n_exploited > 0 THEN n_exploited_top / n_exploited ELSE 1.0 END", R9)} AS exploited_top_recall FROM a"""


def majority_class(spark, sf_dir):
    """Most common target label (ties -> smallest)."""
    s = scoring.scored_cves(spark, sf_dir)
    return M.majority_class(s, "severity")


def _majority_sql() -> str:
    return scoring._scored_sql() + \
        "SELECT severity, count(*) AS n FROM scored WHERE severity IS NOT NULL GROUP BY severity ORDER BY n DESC, severity LIMIT 1"


def class_weights(spark, sf_dir):
    """Balanced class weights n / (k * n_c) (one row per class)."""
    s = scoring.scored_cves(spark, sf_dir).where(F.col("severity").isNotNull())
    w = M.class_weights(s, "severity")
    return w.groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.first("weight").alias("weight")) \
            .select("severity", "n", rnd("weight", R9).alias("weight"))


def _class_weights_sql() -> str:
    return scoring._scored_sql() + f""",
c AS (SELECT severity, count(*) AS n FROM scored WHERE severity IS NOT NULL GROUP BY severity),
t AS (SELECT sum(n) AS tot, count(*) AS k FROM c)
SELECT severity, n, {S.round_dp("tot / (k * n)", R9)} AS weight FROM c, t"""


def dedup_keep_last(spark, sf_dir):
    """One row per user, the latest event (ties by event id)."""
    e = read_table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return A.dedup_keep_last(e, "user_id", ["ts", "event_id"])


DEDUP_SQL = """SELECT user_id, ts, event_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"""


def duplicate_keys(spark, sf_dir):
    """Uniqueness violations of (cve_id) in the score history (ids with several snapshots)."""
    return E.unique_violations(X.epss_history(spark, sf_dir), ["cve_id"])


DUP_SQL = X.with_views("epss_history") + "SELECT cve_id, count(*) AS n FROM epss_history GROUP BY cve_id HAVING count(*) > 1"


FEEDBACK_RULES = [
    CN.NotNull("cve_id"), CN.NotNull("analyst_id"), CN.Check("rating_1_to_5", "confidence_rating BETWEEN 1 AND 5"),
    CN.Check("label_known", "corrected IN ('LOW', 'MEDIUM', 'HIGH', 'CRITICAL')"), CN.Unique(("cve_id", "analyst_id")),
    CN.ForeignKey(("cve_id",), "cves", ("cve_id",)), CN.Default("source", "'analyst'"), CN.Default("used", "false")]


def _feedback(spark, sf_dir):
    """Feedback rows with faults of every kind, from the orders table."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = X.cves(spark, sf_dir).select("cve_id", "o_orderkey", "base_severity").join(o, "o_orderkey")
    k = F.col("o_orderkey")
    return c.select(F.when(k % 23 == 0, None).when(k % 19 == 0, F.concat("cve_id", F.lit("0"))).otherwise(F.col("cve_id")).alias("cve_id"),
                    F.when(k % 29 != 0, F.col("o_custkey") % 40).alias("analyst_id"), F.when(k % 31 != 0, (k % 7).cast("int")).alias("confidence_rating"),
                    F.when(k % 37 == 0, "SEVERE").otherwise(F.col("base_severity")).alias("corrected"), F.when(k % 2 == 0, "import").alias("source"))


def feedback_constraints(spark, sf_dir):
    """Violations of the feedback table's NOT NULL, CHECK, UNIQUE and foreign-key rules; one
    analyst's rows are there twice."""
    f = _feedback(spark, sf_dir)
    twice = f.unionByName(f.where(F.col("analyst_id") == 7))
    return CN.constraint_violations(twice, FEEDBACK_RULES, {"cves": X.cves(spark, sf_dir)})


def feedback_accepted(spark, sf_dir):
    """The feedback rows that the constraints accept, defaults filled in."""
    return CN.conforming(_feedback(spark, sf_dir), FEEDBACK_RULES, {"cves": X.cves(spark, sf_dir)})


_FEEDBACK_SQL = X.with_views("cves") + """,
f AS (SELECT CASE WHEN c.o_orderkey % 23 = 0 THEN NULL WHEN c.o_orderkey % 19 = 0 THEN cve_id || '0' ELSE cve_id END AS cve_id,
  CASE WHEN c.o_orderkey % 29 <> 0 THEN o_custkey % 40 END AS analyst_id, CASE WHEN c.o_orderkey % 31 <> 0 THEN CAST(c.o_orderkey % 7 AS INTEGER) END AS confidence_rating,
  CASE WHEN c.o_orderkey % 37 = 0 THEN 'SEVERE' ELSE base_severity END AS corrected, CASE WHEN c.o_orderkey % 2 = 0 THEN 'import' END AS source
  FROM cves c JOIN orders o USING (o_orderkey))
"""
CONSTRAINTS_SQL = _FEEDBACK_SQL + """, t AS (SELECT * FROM f UNION ALL SELECT * FROM f WHERE analyst_id = 7)
SELECT 'not_null' AS kind, 'cve_id' AS rule, count(*) AS n_violations FROM t WHERE cve_id IS NULL
UNION ALL SELECT 'not_null', 'analyst_id', count(*) FROM t WHERE analyst_id IS NULL
UNION ALL SELECT 'check', 'rating_1_to_5', count(*) FROM t WHERE confidence_rating NOT BETWEEN 1 AND 5
UNION ALL SELECT 'check', 'label_known', count(*) FROM t WHERE corrected NOT IN ('LOW', 'MEDIUM', 'HIGH', 'CRITICAL')
UNION ALL SELECT 'unique', 'cve_id,analyst_id', count(*) FROM (SELECT 1 FROM t WHERE cve_id IS NOT NULL AND analyst_id IS NOT NULL GROUP BY cve_id, analyst_id HAVING count(*) > 1)
UNION ALL SELECT 'foreign_key', 'cve_id->cves', count(*) FROM t WHERE cve_id IS NOT NULL AND cve_id NOT IN (SELECT cve_id FROM cves)"""
ACCEPTED_SQL = _FEEDBACK_SQL + """SELECT cve_id, analyst_id, confidence_rating, corrected, coalesce(source, 'analyst') AS source, false AS used FROM f
WHERE cve_id IS NOT NULL AND analyst_id IS NOT NULL AND coalesce(confidence_rating BETWEEN 1 AND 5, true)
  AND coalesce(corrected IN ('LOW', 'MEDIUM', 'HIGH', 'CRITICAL'), true) AND cve_id IN (SELECT cve_id FROM cves)"""


def catalog_diff(spark, sf_dir):
    """Catalog snapshot as of 1998-07-31 vs 1998-06-30: added ids."""
    k = X.kev_history(spark, sf_dir)
    prev = k.where(F.col("added_date") <= F.lit("1998-06-30").cast("date"))
    cur = k.where(F.col("added_date") <= F.lit("1998-07-31").cast("date"))
    return G.snapshot_diff(prev, cur)


CATALOG_DIFF_SQL = X.with_views("kev_history") + """,
p AS (SELECT * FROM kev_history WHERE added_date <= DATE '1998-06-30'),
c AS (SELECT * FROM kev_history WHERE added_date <= DATE '1998-07-31')
SELECT coalesce(p.cve_id, c.cve_id) AS cve_id,
  CASE WHEN p.cve_id IS NULL THEN 'added' WHEN c.cve_id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM p FULL OUTER JOIN c ON p.cve_id = c.cve_id
WHERE p.cve_id IS NULL OR c.cve_id IS NULL OR p.added_date IS DISTINCT FROM c.added_date"""


def union_ids(spark, sf_dir):
    """G1: ids from the catalog and the score history, union-distinct."""
    return G.union_ids(X.kev_history(spark, sf_dir), X.epss_history(spark, sf_dir))


UNION_IDS_SQL = X.with_views("kev_history", "epss_history") + \
    "SELECT cve_id FROM kev_history UNION SELECT cve_id FROM epss_history"


def history_append(spark, sf_dir):
    """A batch overlapping the stored history keeps only new (id, date) rows."""
    h = X.epss_history(spark, sf_dir)
    stored = h.where(F.col("snapshot_date") < F.lit("1998-01-01").cast("date"))
    batch = h.where(F.col("snapshot_date") >= F.lit("1997-12-01").cast("date"))
    return G.append_new(stored, batch, ["cve_id", "snapshot_date"])


HISTORY_APPEND_SQL = X.with_views("epss_history") + """,
s AS (SELECT * FROM epss_history WHERE snapshot_date < DATE '1998-01-01'),
b AS (SELECT * FROM epss_history WHERE snapshot_date >= DATE '1997-12-01')
SELECT b.* FROM b ANTI JOIN s USING (cve_id, snapshot_date)"""


def latency_histogram(spark, sf_dir):
    """Cumulative latency buckets per model version."""
    log = X.predictions_log(spark, sf_dir)
    h = A.histogram(log, "latency_ms", LATENCY_BUCKETS, by=["model_version"])
    return h.select("model_version", "le", "count", rnd("sum", R9).alias("sum"))


def _hist_sql() -> str:
    parts = [f"SELECT model_version, {S.dbl(b)} AS le, count(*) FILTER (WHERE latency_ms <= {S.dbl(b)}) AS count, "
             f"{S.round_dp('sum(latency_ms)', R9)} AS sum FROM predictions_log GROUP BY model_version" for b in LATENCY_BUCKETS]
    parts.append(f"SELECT model_version, CAST('inf' AS DOUBLE), count(*), {S.round_dp('sum(latency_ms)', R9)} "
                 "FROM predictions_log GROUP BY model_version")
    return X.with_views("predictions_log") + "\n" + "\nUNION ALL\n".join(parts)


def recent_log(spark, sf_dir, days: int = 7, limit: int = 5000):
    """Log rows of the last ``days`` before NOW, newest first, capped at ``limit`` (the report)."""
    log = X.predictions_log(spark, sf_dir)
    since = F.lit(NOW).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS")
    r = log.where(F.col("predicted_at") >= since)
    return r.orderBy(F.col("predicted_at").desc(), F.col("event_id").desc()).limit(limit) \
            .select("event_id", "predicted_at", "model_version", "prediction")


RECENT_SQL = X.with_views("predictions_log") + f"""
SELECT event_id, predicted_at, model_version, prediction FROM predictions_log
WHERE predicted_at >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY ORDER BY predicted_at DESC, event_id DESC LIMIT 5000"""


def last_n_per_version(spark, sf_dir, n: int = 2000):
    """E4 batch form: the last ``n`` predictions of each model version, with their accuracy window stats."""
    log = X.predictions_log(spark, sf_dir)
    w = A.count_based_window(log, "predicted_at", n, by=["model_version"], tie=["event_id"])
    return w.groupBy("model_version").agg(F.count(F.lit(1)).alias("n"), F.min("predicted_at").alias("window_start"),
                                          rnd(F.avg("latency_ms"), R9).alias("mean_latency_ms"))


LAST_N_SQL = X.with_views("predictions_log") + f""",
r AS (SELECT *, row_number() OVER (PARTITION BY model_version ORDER BY predicted_at DESC) AS rn FROM predictions_log)
SELECT model_version, count(*) AS n, min(predicted_at) AS window_start, {S.round_dp("avg(latency_ms)", R9)} AS mean_latency_ms
FROM r WHERE rn <= 2000 GROUP BY model_version"""


def document_search(spark, sf_dir):
    """Free-text search ('apache', lower-cased substring over text or source) within English docs."""
    d = spread(read_table(spark, sf_dir, "documents").where(F.col("lang") == "en"), "doc_id")
    return d.where((F.col("lang") == "en") & T.search_match("apache", "text", "source")).select("doc_id", "source")


SEARCH_SQL = """SELECT doc_id, source FROM documents WHERE lang = 'en'
AND (coalesce(position('apache' IN lower(text)) > 0, false) OR coalesce(position('apache' IN lower(source)) > 0, false))"""


QUERIES = {
    "feedback_constraints": (feedback_constraints, CONSTRAINTS_SQL),
    "feedback_accepted": (feedback_accepted, ACCEPTED_SQL),
    "raw_expectations": (raw_expectations, _raw_exp_sql()),
    "dated_expectations": (dated_expectations, _raw_exp_sql({"published_not_in_future": f"published_date > DATE '{AS_OF}'"})),
    "raw_stats": (raw_stats, RAW_STATS_SQL),
    "null_profile": (null_profile, NULL_PROFILE_SQL),
    "severity_distribution": (severity_distribution, _sev_dist_sql()),
    "platform_kpis": (platform_kpis, _kpi_sql()),
    "top_alerts": (top_alerts, _top_alerts_sql()),
    "severity_filter": (severity_filter, _sev_filter_sql()),
    "exploited_top_recall": (exploited_top_recall, _exploited_top_sql()),
    "majority_class": (majority_class, _majority_sql()),
    "class_weights": (class_weights, _class_weights_sql()),
    "dedup_keep_last": (dedup_keep_last, DEDUP_SQL),
    "duplicate_keys": (duplicate_keys, DUP_SQL),
    "catalog_diff": (catalog_diff, CATALOG_DIFF_SQL),
    "union_ids": (union_ids, UNION_IDS_SQL),
    "history_append": (history_append, HISTORY_APPEND_SQL),
    "latency_histogram": (latency_histogram, _hist_sql()),
    "recent_log": (recent_log, RECENT_SQL),
    "last_n_per_version": (last_n_per_version, LAST_N_SQL),
    "document_search": (document_search, SEARCH_SQL),
}
