"""Risk scoring, tiers, baselines and probability helpers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..operators.scalars import attach
from ._util import as_col, case_map, clip01, round_half_away


def normalise_weights(weights: dict[str, float]) -> dict[str, float]:
    """Rescale when |sum - 1| > 0.001 (fitted constants, driver side)."""
    total = sum(weights.values())
    if abs(total - 1.0) > 0.001:
        return {k: v / total for k, v in weights.items()}
    return dict(weights)


def severity_component(label) -> Column:
    """Severity label -> normalised component; unknown -> 0.5. Keyed on the label (TRAP 1)."""
    return F.coalesce(case_map(F.upper(as_col(label)), K.SEVERITY_NORM), F.lit(K.SEVERITY_NORM_UNKNOWN))


def severity_component_from_int(ordinal, scale: str = "0-4") -> Column:
    """Integer class -> component on the stated scale (the 0-3 scale is shifted to labels first)."""
    m = K.SEVERITY_0_4 if scale == "0-4" else K.SEVERITY_0_3
    inv = {v: k for k, v in m.items()}
    return severity_component(case_map(as_col(ordinal), inv))


def tier(score, tiers=None) -> Column:
    """Risk tier by descending cut-offs."""
    tiers = tiers or K.RISK_TIER_PRESETS["code"]
    s = as_col(score)
    expr = None
    for cut, name in tiers:
        expr = F.when(s >= cut, name) if expr is None else expr.when(s >= cut, name)
    return expr.otherwise(tiers[-1][1])


def risk_columns(components: dict[str, Column], weights: dict[str, float] | None = None,
                 tiers=None) -> dict[str, Column]:
    """Weighted 0-100 score from named [0,1] components.

    Returns contribution_<k> (unrounded weight*component*100), risk_score_raw
    (unrounded), risk_score (2 dp) and risk_tier (on the rounded score).
    Summation order follows the weight order.
    """
    w = normalise_weights(weights or K.RISK_WEIGHTS)
    contrib = {k: F.lit(w[k]) * components[k] for k in w}
    raw = None
    for k in w:
        raw = contrib[k] if raw is None else raw + contrib[k]
    score_raw = raw * F.lit(100.0)
    score = round_half_away(score_raw, 2)
    out = {f"contribution_{k}": c * F.lit(100.0) for k, c in contrib.items()}
    out["risk_score_raw"] = score_raw
    out["risk_score"] = score
    out["risk_tier"] = tier(score, tiers)
    return out


def risk_components(severity_label=None, kev=None, epss=None, asset=None, exposure=None,
                    confidence=None, severity_ordinal=None, scale: str = "0-4", exploitability=None) -> dict[str, Column]:
    """Clipped components with the batch defaults (asset/exposure/confidence 0.5, epss and exploitability 0);
    ``exploitability`` is the CVSS subscore, divided by its largest value."""
    if severity_label is not None:
        sev = severity_component(severity_label)
    elif severity_ordinal is not None:
        sev = severity_component_from_int(severity_ordinal, scale)
    else:
        sev = F.lit(K.SEVERITY_NORM_UNKNOWN)
    return {
        "cvss": sev,
        "kev": F.when(F.coalesce(as_col(kev), F.lit(False)), F.lit(1.0)).otherwise(F.lit(0.0))
        if kev is not None else F.lit(0.0),
        "epss": clip01(F.coalesce(as_col(epss), F.lit(0.0))) if epss is not None else F.lit(0.0),
        "asset_criticality": clip01(F.coalesce(as_col(asset), F.lit(0.5))) if asset is not None else F.lit(0.5),
        "exposure": clip01(F.coalesce(as_col(exposure), F.lit(0.5))) if exposure is not None else F.lit(0.5),
        "model_confidence": clip01(F.coalesce(as_col(confidence), F.lit(0.5)))
        if confidence is not None else F.lit(0.5),
        "exploitability": clip01(F.coalesce(as_col(exploitability), F.lit(0.0)) / F.lit(K.EXPLOITABILITY_MAX))
        if exploitability is not None else F.lit(0.0),
    }


def with_risk_score(df: DataFrame, weights=None, tiers=None, **component_args) -> DataFrame:
    """H26-H29 (weights: constants.RISK_WEIGHT_PRESETS, incl. the four- and five-factor variants H31/H32): df -> df: add the weighted components, contributions, score and tier."""
    comps = risk_components(**component_args)
    w = normalise_weights(weights or K.RISK_WEIGHTS)
    comps = {k: comps[k] for k in w}
    df = df.select("*", *[c.alias(f"{k}_component") for k, c in comps.items()])
    named = {k: F.col(f"{k}_component") for k in comps}
    return df.select("*", *[c.alias(n) for n, c in risk_columns(named, w, tiers).items()])


def scale_to_unit(c) -> Column:
    """Criticality/exposure given on a 1-5 scale: values > 1 are divided by 5, capped at 1."""
    x = as_col(c).cast("double")
    return F.when(x > 1.0, F.least(F.lit(1.0), x / 5.0)).otherwise(x)


def exposure_from_category(c) -> Column:
    """Exposure class -> score (unknown -> the 'other' value)."""
    return F.coalesce(case_map(as_col(c), K.EXPOSURE_SCORES), F.lit(K.EXPOSURE_SCORE_OTHER))


def default_score_from_cvss(score) -> Column:
    """clamp((s/10)^2 * 0.45, .02, .95) rounded to 3 dp."""
    s = as_col(score).cast("double")
    return round_half_away(F.least(F.lit(0.95), F.greatest(F.lit(0.02), (s / 10.0) * (s / 10.0) * 0.45)), 3)


def exploited_flag(score, *flags) -> Column:
    """Any given flag is true, or the score is at least 9.4."""
    out = F.coalesce(as_col(score).cast("double") >= 9.4, F.lit(False))
    for f in flags:
        out = out | F.coalesce(as_col(f), F.lit(False))
    return out


def safe_double(c, default: float) -> Column:
    """Null / unparsable / NaN / infinite -> default."""
    x = as_col(c).cast("string").try_cast("double") if not isinstance(c, (int, float)) else F.lit(float(c))
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf))
    return F.when(bad, F.lit(default)).otherwise(x)


def exploit_tier(p) -> Column:
    x = as_col(p)
    expr = None
    for cut, name in K.EXPLOIT_TIERS:
        expr = F.when(x >= cut, name) if expr is None else expr.when(x >= cut, name)
    return expr.otherwise(K.EXPLOIT_TIER_OTHER)


def exploit_forecast_columns(p) -> dict[str, Column]:
    x = as_col(p)
    return {
        "exploitation_risk_tier": exploit_tier(x),
        "predicted_kev_30d": x >= K.EXPLOIT_FLAG_30D,
        "predicted_kev_90d": x >= K.EXPLOIT_FLAG_90D,
    }


def keyword_rule_class(flags: dict[str, Column] | None = None) -> Column:
    """Keyword-rule baseline class on the 0-3 scale (3 CRITICAL ... 0 LOW)."""
    def any_of(names):
        cols = [F.coalesce(flags[n] if flags else F.col(n), F.lit(0)).cast("int") for n in names]
        return F.greatest(*cols) > 0
    return (F.when(any_of(K.RULE_CRITICAL_FLAGS), 3).when(any_of(K.RULE_HIGH_FLAGS), 2)
            .when(any_of(K.RULE_MEDIUM_FLAGS), 1).otherwise(0))


def one_hot_probabilities(cls, n_classes: int = 4, hit: float = 1.0, miss: float = 0.0) -> Column:
    """Array of class probabilities with ``hit`` at ``cls`` and ``miss`` elsewhere, normalised."""
    total = hit + miss * (n_classes - 1)
    c = as_col(cls)
    return F.array(*[F.when(c == i, F.lit(hit / total)).otherwise(F.lit(miss / total)) for i in range(n_classes)])


def argmax(probs) -> Column:
    """0-based index of the first maximum."""
    p = as_col(probs)
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def prediction_columns(probs, labels=K.LABELS_ORDER) -> dict[str, Column]:
    """predicted_class, confidence, predicted_label, probability map."""
    p = as_col(probs)
    idx = argmax(p)
    return {
        "predicted_class": idx,
        "confidence": F.array_max(p),
        "predicted_label": F.element_at(F.array(*[F.lit(x) for x in labels]), idx + 1),
        "probabilities": F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), p),
    }


def contextual_multiplier(asset_tier, exposure_class) -> Column:
    """Product of the asset-tier and exposure multipliers (1.0 when a class is unknown)."""
    a = F.coalesce(case_map(as_col(asset_tier), K.ASSET_MULTIPLIERS), F.lit(1.0))
    e = F.coalesce(case_map(as_col(exposure_class), K.EXPOSURE_MULTIPLIERS), F.lit(1.0))
    return a * e


def recent_or_latest(df: DataFrame, ts: str, since: str, n: int = 200, tie: tuple[str, ...] = ()) -> DataFrame:
    """Rows at or after ``since``; when there are none, the ``n`` most recent rows instead.
    ``tie`` names columns that order rows of one instant. Declarative: one aggregate (latest instant) decides which branch returns rows."""
    t = F.col(ts).cast("timestamp")
    s = F.lit(since).cast("timestamp")
    latest = df.agg(F.max(t).alias("__latest"))
    recent = df.where(t >= s)
    fallback = attach(df.orderBy(t.desc(), *tie).limit(n), latest).where(F.col("__latest") < s).drop("__latest")
    return recent.unionByName(fallback)
