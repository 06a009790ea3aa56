"""Join plans: latest and as-of scores, exploitation label, substring asset match,
backfill merge, side-by-side tiers, remediation ranking (A14, C1-C6, C9, C11, F6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..operators.scalars import attach
from .. import fixtures as X
from ..functions import cvss as CV
from ..functions import risk as R
from ..functions._util import round_half_away as rnd
from ..operators import joins as J
from ..session import by_rows, read_table, spread
from . import scoring
from . import sqlfrag as S

R9 = 9

#: Texts that a task of the gram join takes apart, about.
TEXT_ROWS = 50_000


def latest_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.latest_value(X.epss_history(spark, sf_dir), out="latest_score")


LATEST_SQL = X.with_views("epss_history") + """
SELECT cve_id, max_by(score, snapshot_date) AS latest_score, max(snapshot_date) AS latest_score_date
FROM epss_history GROUP BY cve_id"""


def asof_score_at_listing(spark, sf_dir):
    """C4 as-of: score of each catalog entry as of its listing date (latest snapshot <= date)."""
    kev = X.kev_history(spark, sf_dir)
    return J.asof_join(kev, X.epss_history(spark, sf_dir), "cve_id", "added_date", "snapshot_date",
                       "score", "score_at_listing")


ASOF_SQL = X.with_views("kev_history", "epss_history") + """
SELECT k.cve_id, k.added_date, e.score AS score_at_listing
FROM kev_history k ASOF LEFT JOIN epss_history e ON k.cve_id = e.cve_id AND k.added_date >= e.snapshot_date"""


def kev_label_window(spark, sf_dir):
    """Documented 90-day window label and the listing lag for every CVE."""
    c = X.cves(spark, sf_dir).select("cve_id", "published_date")
    r = J.exploitation_label(c, X.kev_history(spark, sf_dir), window_days=90, mode="window")
    # the any-listing label follows from the same join: it is whether a listing was found
    return r.select("cve_id", "kev_added_date", rnd("days_to_kev_listing", R9).alias("days_to_kev_listing"),
                    "kev_label", F.col("kev_added_date").isNotNull().cast("int").alias("kev_label_any"))


KEV_LABEL_SQL = X.with_views("cves", "kev_history") + f""",
f AS (SELECT cve_id, min(added_date) AS added FROM kev_history GROUP BY cve_id),
j AS (SELECT c.cve_id, c.published_date, f.added,
  (epoch_us(CAST(f.added AS TIMESTAMP)) - epoch_us(CAST(c.published_date AS TIMESTAMP))) / 86400000000.0 AS lag
  FROM cves c LEFT JOIN f USING (cve_id))
SELECT cve_id, added AS kev_added_date, {S.round_dp("lag", R9)} AS days_to_kev_listing,
  CASE WHEN added IS NULL THEN 0 WHEN published_date IS NULL THEN 1 WHEN lag <= 90 THEN 1 ELSE 0 END AS kev_label,
  CASE WHEN added IS NULL THEN 0 ELSE 1 END AS kev_label_any
FROM j"""


def asset_match(spark, sf_dir):
    """Asset products (distinct second words of part names) matched as substrings of part names."""
    part = read_table(spark, sf_dir, "part")
    assets = part.select(F.try_element_at(F.split("p_name", " "), F.lit(2)).alias("product")) \
                 .where(F.col("product").isNotNull() & (F.col("product") != "")).distinct() \
                 .withColumn("asset_id", F.col("product"))
    texts = part.select("p_partkey", F.col("p_name").alias("product"))
    return J.match_assets(texts, assets, product_col="product", asset_key="asset_id",
                          cve_key="p_partkey", text_cols=("product",), cpe_col=None)


ASSET_SQL = """WITH a AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS product FROM part WHERE split_part(p_name, ' ', 2) <> '')
SELECT DISTINCT a.product AS asset_id, p.p_partkey FROM a JOIN part p ON position(lower(a.product) IN lower(p.p_name)) > 0"""


def asset_match_gram(spark, sf_dir, broadcast_patterns: bool = False):
    """C1 through gram blocking (shuffled, or with the pattern table broadcast) -- same result as the
    nested-loop path."""
    part = read_table(spark, sf_dir, "part")
    assets = part.select(F.try_element_at(F.split("p_name", " "), F.lit(2)).alias("product")) \
                 .where(F.col("product").isNotNull() & (F.col("product") != "")).distinct() \
                 .withColumn("asset_id", F.col("product"))
    # a text has many grams: texts are dealt out by key, few to a task
    texts = by_rows(spread(part.select("p_partkey", "p_name"), "p_partkey"), part.count(), "p_partkey", per_task=TEXT_ROWS) \
        .select("p_partkey", F.col("p_name").alias("product"))
    return J.match_assets(texts, assets, product_col="product", asset_key="asset_id",
                          cve_key="p_partkey", text_cols=("product",), cpe_col=None,
                          max_broadcast=J.MAX_BROADCAST_PATTERNS if broadcast_patterns else 0, nlj_max=0)


def asset_match_gram_broadcast(spark, sf_dir):
    return asset_match_gram(spark, sf_dir, broadcast_patterns=True)


def backfill_merge(spark, sf_dir):
    """CVE + exploited flag + latest score (default 0.01 when absent) + parsed CVSS."""
    c = CV.with_cvss(X.cves(spark, sf_dir))
    c = J.flag_membership(c, X.kev_history(spark, sf_dir), out="in_cisa_kev")
    latest = J.latest_value(X.epss_history(spark, sf_dir), out="epss_score").select("cve_id", "epss_score")
    c = J.lookup_with_default(c, latest, "cve_id", "epss_score", 0.01)
    return c.select("cve_id", "published_date", "base_score", "base_severity", "version", "attack_vector",
                    "attack_complexity", "privileges_required", "user_interaction", "scope",
                    "confidentiality_impact", "integrity_impact", "availability_impact", "in_cisa_kev", "epss_score")


def _backfill_sql() -> str:
    f = S.cvss_fields("cvss_vector")
    sel = ", ".join(f"{f[k]} AS {k}" for k in ["version"] + list(K.CVSS_FIELDS.values()))
    return X.with_views("cves", "epss_history", "kev_history") + f""",
latest AS (SELECT cve_id, max_by(score, snapshot_date) AS s FROM epss_history GROUP BY cve_id),
kev AS (SELECT DISTINCT cve_id FROM kev_history)
SELECT c.cve_id, c.published_date, c.base_score, c.base_severity, {sel},
  k.cve_id IS NOT NULL AS in_cisa_kev, coalesce(l.s, 0.01) AS epss_score
FROM cves c LEFT JOIN kev k USING (cve_id) LEFT JOIN latest l USING (cve_id)"""


def tier_disagreement(spark, sf_dir):
    """Side-by-side scoring of the same rows by a champion (code tiers) and a challenger
    (config tiers): pair matrix with counts and the disagreement share."""
    s = scoring.scored_cves(spark, sf_dir)
    s = s.select(R.tier("risk_score", K.RISK_TIER_PRESETS["code"]).alias("champion_tier"),
                 R.tier("risk_score", K.RISK_TIER_PRESETS["config"]).alias("challenger_tier"))
    m = s.groupBy("champion_tier", "challenger_tier").agg(F.count(F.lit(1)).alias("n"))
    tot = m.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("champion_tier") != F.col("challenger_tier"),
                                                        F.col("n")).otherwise(0)).alias("n_disagree"))
    return attach(m, tot).select("champion_tier", "challenger_tier", "n",
                                   rnd(F.col("n_disagree") / F.col("total"), R9).alias("disagreement_rate"))


def _tier_disagreement_sql() -> str:
    return scoring._scored_sql() + f""",
t AS (SELECT {S.tier('risk_score', K.RISK_TIER_PRESETS['code'])} AS champion_tier,
  {S.tier('risk_score', K.RISK_TIER_PRESETS['config'])} AS challenger_tier FROM scored),
m AS (SELECT champion_tier, challenger_tier, count(*) AS n FROM t GROUP BY ALL),
tot AS (SELECT sum(n) AS total, sum(CASE WHEN champion_tier <> challenger_tier THEN n ELSE 0 END) AS nd FROM m)
SELECT champion_tier, challenger_tier, n, {S.round_dp("nd / total", R9)} AS disagreement_rate FROM m, tot"""


def remediation(spark, sf_dir, k: int = 3):
    """Each customer's CVEs (asset -> CVE map via orders) ranked by risk, top k per asset."""
    o = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("asset_id"), "o_orderkey")
    risk = scoring.scored_cves(spark, sf_dir).select("cve_id", "o_orderkey", "risk_score_raw", "risk_score")
    # the unique order key joins map and risk once; ids are not joined a second time
    r = J.remediation_list(o, risk, k=k, key="o_orderkey", score="risk_score_raw", tie="cve_id")
    return r.select("asset_id", "cve_id", "risk_score", "rank")


def _remediation_sql(k: int = 3) -> str:
    return scoring._scored_sql().replace(
        "parsed AS (SELECT cve_id, published_date,", "parsed AS (SELECT cve_id, o_orderkey, published_date,") + f""",
m AS (SELECT o.o_custkey AS asset_id, s.cve_id, s.risk_score, s.risk_score_raw FROM orders o JOIN scored s ON o.o_orderkey = s.o_orderkey),
r AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY risk_score_raw DESC, cve_id) AS rank FROM m)
SELECT asset_id, cve_id, risk_score, rank FROM r WHERE rank <= {k}"""


QUERIES = {
    "latest_score": (latest_score, LATEST_SQL),
    "asof_score_at_listing": (asof_score_at_listing, ASOF_SQL),
    "kev_label_window": (kev_label_window, KEV_LABEL_SQL),
    "asset_match": (asset_match, ASSET_SQL),
    "asset_match_gram": (asset_match_gram, ASSET_SQL),
    "asset_match_gram_broadcast": (asset_match_gram_broadcast, ASSET_SQL),
    "backfill_merge": (backfill_merge, _backfill_sql()),
    "tier_disagreement": (tier_disagreement, _tier_disagreement_sql()),
    "remediation": (remediation, _remediation_sql()),
}
