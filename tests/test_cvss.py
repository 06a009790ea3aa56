from pyspark.sql import functions as F

from riskframe.functions import cvss as CV


def _parse(spark, vectors):
    df = spark.createDataFrame([(v,) for v in vectors], "v string")
    f = CV.cvss_fields("v")
    return [r.asDict() for r in df.select(*[c.alias(k) for k, c in f.items()]).collect()]


def test_parse_full_vector(spark):
    r = _parse(spark, ["CVSS:3.1/AV:N/AC:L/PR:H/UI:N/S:U/C:L/I:L/A:N"])[0]
    assert r == {"version": "3.1", "attack_vector": "NETWORK", "attack_complexity": "LOW",
                 "privileges_required": "HIGH", "user_interaction": "NONE", "scope": "UNCHANGED",
                 "confidentiality_impact": "LOW", "integrity_impact": "LOW", "availability_impact": "NONE"}


def test_short_blank_null_vectors_give_nulls(spark):
    rows = _parse(spark, ["CVSS:3.1/AV:N/AC:L/PR:H/UI:N/S:U/C:L/I:L", "", "   ", None])
    for r in rows:
        assert all(v is None for v in r.values())


def test_last_duplicate_wins_unknown_codes_and_case(spark):
    r = _parse(spark, ["CVSS:3.0/AV:N/AC:L/PR:H/UI:N/S:U/C:L/I:L/A:N/AV:P/ac:H/E:X"])[0]
    assert r["attack_vector"] == "PHYSICAL"          # last AV wins
    assert r["attack_complexity"] == "LOW"            # keys are case-sensitive: 'ac' ignored
    assert r["version"] == "3.0"
    r = _parse(spark, ["CVSS:3.1/AV:Z/AC:L/PR:H/UI:N/S:U/C:L/I:L/A:N"])[0]
    assert r["attack_vector"] is None                 # unknown code -> null


def test_first_segment_is_never_a_metric(spark):
    r = _parse(spark, ["AV:N/AC:L/PR:H/UI:N/S:U/C:L/I:L/A:N/X:1"])[0]
    assert r["attack_vector"] is None and r["version"] == "N"


def test_whitespace_is_stripped(spark):
    r = _parse(spark, ["  CVSS:3.1/AV:A/AC:L/PR:H/UI:N/S:C/C:L/I:L/A:H \n"])[0]
    assert r["attack_vector"] == "ADJACENT" and r["availability_impact"] == "HIGH" and r["scope"] == "CHANGED"


def test_onehot_and_ordinals(spark):
    df = spark.createDataFrame([("CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:C/C:H/I:H/A:H", "critical"), (None, "bogus")],
                               "cvss_vector string, s string")
    out = CV.with_cvss(df, onehot=True).select("av_network", "ui_required", "scope_changed", "has_cvss_v3",
                                                CV.severity_ordinal("s").alias("o"),
                                                CV.severity_ordinal("s", "0-3").alias("o3")).collect()
    assert tuple(out[0]) == (True, True, True, True, 4, 3)
    assert tuple(out[1]) == (False, False, False, False, -1, -1)


def test_severity_label_or_score(spark):
    df = spark.createDataFrame([("high", 1.0), ("", 9.0), (None, 6.9), ("NONE", 8.0), (None, None), (" low ", 9.9)],
                               "l string, s double")
    feat = [r[0] for r in df.select(CV.severity_from_label_or_score("l", "s")).collect()]
    assert feat == ["HIGH", "CRITICAL", "MEDIUM", None, None, "LOW"]
    disp = [r[0] for r in df.select(CV.severity_from_label_or_score("l", "s", True)).collect()]
    assert disp == ["HIGH", "CRITICAL", "MEDIUM", "HIGH", None, "LOW"]
