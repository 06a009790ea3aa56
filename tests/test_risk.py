import pytest
from pyspark.sql import functions as F

from riskframe import constants as K
from riskframe.functions import risk as R


def _score(spark, rows, **kw):
    df = spark.createDataFrame(rows, "sev string, kev boolean, epss double, asset double, expo double, conf double")
    out = R.with_risk_score(df, severity_label="sev", kev="kev", epss="epss", asset="asset", exposure="expo",
                            confidence="conf", **kw)
    return out.select("risk_score", "risk_tier", "risk_score_raw").collect()


def test_worked_example_and_tiers(spark):
    r = _score(spark, [("CRITICAL", True, 0.975, 0.9, 1.0, 0.97), ("LOW", False, 0.01, 0.1, 0.2, 0.5),
                       ("HIGH", False, 0.5, 0.5, 0.5, 0.5)])
    expected = 100 * (0.30 * 1.0 + 0.25 + 0.20 * 0.975 + 0.15 * 0.9 + 0.07 * 1.0 + 0.03 * 0.97)
    assert r[0].risk_score == pytest.approx(round(expected, 2)) and r[0].risk_tier == "CRITICAL_RISK"
    assert r[1].risk_tier == "LOW_RISK"
    assert r[2].risk_score == pytest.approx(100 * (0.30 * 0.78 + 0.20 * 0.5 + 0.15 * 0.5 + 0.07 * 0.5 + 0.03 * 0.5))


def test_label_keyed_severity_trap1(spark):
    # CRITICAL must map to 1.0 (not HIGH's 0.78 as a 0-3 integer would under the 0-4 map)
    df = spark.createDataFrame([(3,), (4,)], "c int")
    v = df.select(R.severity_component_from_int("c", "0-3").alias("a"),
                  R.severity_component_from_int("c", "0-4").alias("b")).collect()
    assert (v[0].a, v[0].b) == (1.0, 0.78) and v[1].b == 1.0 and v[1].a == 0.5


def test_clipping_and_defaults(spark):
    r = _score(spark, [("UNKNOWN", None, 7.0, -3.0, None, 2.0)])[0]
    assert r.risk_score == pytest.approx(100 * (0.30 * 0.5 + 0.20 * 1.0 + 0.0 + 0.07 * 0.5 + 0.03 * 1.0))


def test_five_factor_worked_number(spark):
    df = spark.createDataFrame([(0.72, 0.55, 1.0, 0.8, 1.0)], "ml double, ep double, kev double, a double, e double")
    cols = R.risk_columns({"cvss": F.col("ml"), "epss": F.col("ep"), "kev": F.col("kev"),
                           "asset_criticality": F.col("a"), "exposure": F.col("e")},
                          K.RISK_WEIGHT_PRESETS["five_factor"], K.RISK_TIER_PRESETS["config"])
    r = df.select(cols["risk_score"].alias("s"), cols["risk_tier"].alias("t")).first()
    assert r.s == pytest.approx(77.35) and r.t == "HIGH_RISK"


def test_weight_normalisation():
    w = R.normalise_weights({"a": 2.0, "b": 2.0})
    assert w == {"a": 0.5, "b": 0.5}
    assert R.normalise_weights({"a": 0.5, "b": 0.5005}) == {"a": 0.5, "b": 0.5005}


def test_rounding_half_away_matches_sql_form(spark):
    # 2.675 * 100 is exactly 267.5 in binary, so both engines give 2.68 (Python's round gives 2.67:
    # the unrounded risk_score_raw is always emitted next to the rounded score)
    import duckdb
    vals = [2.675, 0.125, -1.5, 79.145, 1.005]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    from riskframe.functions._util import round_half_away, round_sql
    got = [r[0] for r in df.select(round_half_away("x", 2)).collect()]
    ref = [duckdb.sql(f"SELECT {round_sql(repr(v) + '::DOUBLE', 2)}").fetchall()[0][0] for v in vals]
    assert got == ref and got[0] == 2.68


def test_exploit_tiers_keyword_rule_argmax(spark):
    df = spark.createDataFrame([(0.7, 1, 0, 0), (0.39, 0, 1, 0), (0.1, 0, 0, 1)], "p double, has_rce_keyword int, "
                               "has_sqli_keyword int, has_xss_keyword int")
    cols = R.exploit_forecast_columns(F.col("p"))
    r = df.select(cols["exploitation_risk_tier"], cols["predicted_kev_30d"], cols["predicted_kev_90d"]).collect()
    assert [tuple(x) for x in r] == [("IMMINENT_EXPLOITATION", True, True), ("MODERATE_EXPLOITATION_RISK", False, True),
                                     ("LOW_EXPLOITATION_RISK", False, False)]
    full = df.withColumn("has_overflow_keyword", F.lit(0)).withColumn("has_auth_bypass_keyword", F.lit(0)) \
        .withColumn("has_priv_esc_keyword", F.lit(0)).withColumn("is_injection_cwe", F.lit(0)) \
        .withColumn("has_traversal_keyword", F.lit(0)).withColumn("has_info_leak_keyword", F.lit(0))
    assert [r[0] for r in full.select(R.keyword_rule_class()).collect()] == [3, 2, 1]
    p = spark.createDataFrame([([0.2, 0.4, 0.4, 0.0],)], "p array<double>")
    assert p.select(R.argmax("p")).first()[0] == 1
    probs = p.select(R.one_hot_probabilities(F.lit(2), hit=0.85, miss=0.05)).first()[0]
    assert probs == pytest.approx([0.05, 0.05, 0.85, 0.05])
