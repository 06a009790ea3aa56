"""Display helpers (H11, H12, H14, H33, H36, B2) as Column expressions / operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ._util import as_col, round_half_away, strip_ws


def display_vendor(vendor, cpes) -> Column:
    """Vendor unless blank or a placeholder; else the 4th ':' field of the first CPE with
    '_' -> ' '; else 'Enterprise Vendor'. Title-casing uses ``initcap`` (it differs from Python's
    ``title`` after digits and hyphens)."""
    v = strip_ws(F.coalesce(as_col(vendor).cast("string"), F.lit("")))
    ok = (v != "") & ~F.lower(v).isin(*K.VENDOR_PLACEHOLDERS)
    first = F.try_element_at(as_col(cpes), F.lit(1))
    part = F.try_element_at(F.split(first, ":", -1), F.lit(4))
    cpe_ok = part.isNotNull() & (part != "") & (part != "*")
    return (F.when(ok, F.initcap(v)).when(cpe_ok, F.initcap(F.regexp_replace(part, "_", " ")))
            .otherwise(F.lit(K.DEFAULT_VENDOR)))


def display_cwe(cwe, cwe_ids) -> Column:
    """Cwe unless blank/placeholder; else the first 'CWE-' id that is not noinfo/Other;
    else the first id; else CWE-20."""
    c = strip_ws(F.coalesce(as_col(cwe).cast("string"), F.lit("")))
    ok = (c != "") & ~F.lower(c).isin(*K.CWE_PLACEHOLDERS)
    ids = F.transform(F.coalesce(as_col(cwe_ids), F.array().cast("array<string>")), lambda x: strip_ws(x))
    good = F.try_element_at(F.filter(ids, lambda x: x.startswith("CWE-") & ~x.isin(*K.CWE_NOT_SPECIFIC)), F.lit(1))
    return F.when(ok, c).otherwise(F.coalesce(good, F.try_element_at(ids, F.lit(1)), F.lit(K.DEFAULT_CWE)))


def alert_risk(cvss_score, exploited, epss) -> dict[str, Column]:
    """Alert score with fixed asset/exposure/confidence, capped at 100, 1 dp, and SLA text."""
    raw = F.lit(100.0) * (F.lit(0.30) * (as_col(cvss_score) / F.lit(10.0)) +
                          F.lit(0.25) * F.when(as_col(exploited), 1.0).otherwise(0.0) +
                          F.lit(0.20) * as_col(epss) + F.lit(0.15) * F.lit(K.ALERT_ASSET) +
                          F.lit(0.07) * F.lit(K.ALERT_EXPOSURE) + F.lit(0.03) * F.lit(K.ALERT_CONFIDENCE))
    score = round_half_away(F.least(F.lit(100.0), raw), 1)
    sla = None
    for cut, text in K.ALERT_SLA:
        sla = F.when(score >= cut, text) if sla is None else sla.when(score >= cut, text)
    return {"alert_score_raw": raw, "alert_score": score, "sla": sla.otherwise(K.ALERT_SLA_OTHER)}


def _lit_probs(p):
    return F.array(*[F.lit(float(x)) for x in p])


def text_fallback_probs(text) -> Column:
    """Class probabilities from description words when no model is loaded."""
    t = F.lower(F.coalesce(as_col(text), F.lit("")))
    expr = None
    for words, probs in K.TEXT_FALLBACK_PROBS:
        hit = F.greatest(*[F.instr(t, w) > 0 for w in words])
        expr = F.when(hit, _lit_probs(probs)) if expr is None else expr.when(hit, _lit_probs(probs))
    return expr.otherwise(_lit_probs(K.TEXT_FALLBACK_DEFAULT))


def score_fallback_probs(exploited, epss) -> Column:
    """Class probabilities from the exploited flag and the exploit probability."""
    p = K.SCORE_FALLBACK_PROBS
    e = F.coalesce(as_col(epss), F.lit(0.0))
    return (F.when(F.coalesce(as_col(exploited), F.lit(False)) | (e > 0.8), _lit_probs(p["exploited_or_above_0_8"]))
            .when(e > 0.4, _lit_probs(p["above_0_4"])).otherwise(_lit_probs(p["other"])))


def point_lookup(ids: DataFrame, data: DataFrame, id_col: str = "cve_id") -> DataFrame:
    """B2: case-insensitive lookup of requested ids; unknown ids get the default row."""
    d = K.LOOKUP_DEFAULTS
    req = ids.select(F.upper(F.col(id_col)).alias("__id")).distinct()
    src = data.withColumn("__id", F.upper(F.col(id_col))).drop(id_col).withColumn("__hit", F.lit(True))
    j = req.join(src, "__id", "left")
    hit = F.coalesce(F.col("__hit"), F.lit(False))
    return j.select(
        F.col("__id").alias(id_col), hit.alias("found"),
        F.when(hit, F.col("description")).otherwise(F.lit(d["description"])).alias("description"),
        F.when(hit, F.col("severity")).otherwise(F.lit(d["severity"])).alias("severity"),
        F.when(hit, F.col("cvss_score")).otherwise(F.lit(d["cvss_score"])).alias("cvss_score"),
        F.when(hit, F.col("cisa_kev")).otherwise(F.lit(d["cisa_kev"])).alias("cisa_kev"),
        F.when(hit, F.col("epss_score")).otherwise(F.lit(d["epss_score"])).alias("epss_score"),
        F.when(hit, F.col("vendor")).otherwise(F.lit(d["vendor"])).alias("vendor"),
        F.when(hit, F.col("cwe")).otherwise(F.lit(d["cwe"])).alias("cwe"))
