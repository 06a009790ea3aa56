import math
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskframe.functions import display as DS
from riskframe.functions import risk as R
from riskframe.functions import text as T
from riskframe.operators import sets as G
from riskframe.streaming import pipeline as P


def test_safe_double_default_score_text_component(spark):
    df = spark.createDataFrame([("7.5",), ("nan",), ("inf",), ("abc",), (None,)], "s string")
    assert [r[0] for r in df.select(R.safe_double(F.col("s"), 1.0)).collect()] == [7.5, 1.0, 1.0, 1.0, 1.0]
    sc = spark.createDataFrame([(10.0,), (0.0,), (9.8,)], "s double")
    got = [r[0] for r in sc.select(R.default_score_from_cvss("s")).collect()]
    assert got == [0.45, 0.02, round(min(0.95, max(0.02, (9.8 / 10) ** 2 * 0.45)), 3)]
    tx = spark.createDataFrame([("Remote Code flaw",), ("SQL issue",), ("other",), (None,)], "t string")
    assert [r[0] for r in tx.select(T.text_severity_component("t")).collect()] == [1.0, 0.8, 0.5, 0.5]
    lab = spark.createDataFrame([("  high ",)], "l string")
    assert lab.select(T.normalise_label("l")).first()[0] == "HIGH"


def test_display_and_alert(spark):
    df = spark.createDataFrame([("microsoft", None, "CWE-79", None),
                                ("N/A", ["cpe:2.3:a:red_hat:linux:1"], None, ["NVD-CWE-noinfo", "CWE-89"]),
                                (None, ["cpe:2.3:a:*:x"], "none", ["CWE-Other"]), (None, None, None, None)],
                               "v string, c array<string>, w string, ids array<string>")
    r = df.select(DS.display_vendor("v", "c").alias("v"), DS.display_cwe("w", "ids").alias("w")).collect()
    assert [tuple(x) for x in r] == [("Microsoft", "CWE-79"), ("Red Hat", "CWE-89"),
                                     ("Enterprise Vendor", "CWE-Other"), ("Enterprise Vendor", "CWE-20")]
    a = spark.createDataFrame([(9.8, True, 0.97), (2.0, False, 0.01)], "s double, k boolean, e double")
    cols = DS.alert_risk(F.col("s"), F.col("k"), F.col("e"))
    rows = a.select(cols["alert_score"], cols["sla"]).collect()
    raw = 100 * (0.30 * 0.98 + 0.25 + 0.20 * 0.97 + 0.15 * 0.9 + 0.07 + 0.03 * 0.95)
    assert rows[0][0] == pytest.approx(round(min(100.0, raw), 1)) and rows[0][1] == "24 Hours (URGENT)"
    assert rows[1][1] == "14 Days"


def test_shared_columns_and_fallback_probs(spark):
    a = spark.createDataFrame([(1, 2, 3)], "x int, y int, z int")
    b = spark.createDataFrame([(1, 2)], "z int, x int")
    assert G.shared_columns(a, b) == ["x", "z"]
    d = spark.createDataFrame([("buffer overflow here", True, 0.1), ("xss", False, 0.5), ("", False, 0.1)],
                              "t string, k boolean, e double")
    r = d.select(DS.text_fallback_probs(F.col("t")).alias("p"), DS.score_fallback_probs(F.col("k"), F.col("e"))
                 .alias("q")).collect()
    assert r[0].p == [0.02, 0.08, 0.25, 0.65] and r[1].p == [0.10, 0.65, 0.20, 0.05]
    assert r[0].q == [0.02, 0.08, 0.25, 0.65] and r[1].q == [0.05, 0.15, 0.65, 0.15]
    assert r[2].q == [0.25, 0.45, 0.25, 0.05]


def test_prediction_log_stream_append(spark, tmpdir_fresh):
    src = os.path.join(tmpdir_fresh, "src")
    pdf = pd.DataFrame({"cve_id": [f"CVE-{i}" for i in range(20)],
                        "predicted_at": pd.to_datetime(["2024-01-01", "2024-01-02"] * 10),
                        "prediction": ["HIGH"] * 20})
    spark.createDataFrame(pdf).write.parquet(src)
    s = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    out = os.path.join(tmpdir_fresh, "log")
    # stream checkpoints are stable per name in the shared folder (a restart resumes), so each run
    # of this test starts a new stream name
    q = P.append_log(s, out, f"t_log_{os.path.basename(tmpdir_fresh)}")
    q.awaitTermination()
    back = spark.read.parquet(out)
    assert back.count() == 20 and sorted(r[0] for r in back.select("log_date").distinct().collect())[0] is not None


def test_prediction_log_resumes_and_replayed_batch_is_idempotent(spark, tmpdir_fresh):
    import uuid
    src = os.path.join(tmpdir_fresh, "src")
    mk = lambda lo, hi: pd.DataFrame({"cve_id": [f"CVE-{i}" for i in range(lo, hi)],
                                      "predicted_at": pd.to_datetime(["2024-01-01"] * (hi - lo)),
                                      "prediction": ["HIGH"] * (hi - lo)})
    spark.createDataFrame(mk(0, 20)).write.parquet(os.path.join(src, "a"))
    schema = spark.read.parquet(os.path.join(src, "a")).schema
    out, name = os.path.join(tmpdir_fresh, "log"), f"t_log_{uuid.uuid4().hex[:6]}"
    P.append_log(spark.readStream.schema(schema).parquet(os.path.join(src, "*")), out, name).awaitTermination()
    spark.createDataFrame(mk(20, 30)).write.parquet(os.path.join(src, "b"))
    # a restart with the same name resumes after the committed batch: only the new file is read
    P.append_log(spark.readStream.schema(schema).parquet(os.path.join(src, "*")), out, name).awaitTermination()
    back = spark.read.parquet(out)
    assert back.count() == 30 and back.select("cve_id").distinct().count() == 30
    # re-delivering batch 0 (failure between write and commit) does not duplicate it
    batch0 = back.where("batch_id = 0").drop("batch_id", "log_date") \
                 .withColumn("log_date", F.to_date("predicted_at"))
    P.write_log_batch(spark.createDataFrame(batch0.toPandas()), 0, out)     # 20 test rows, detached from `out`
    assert spark.read.parquet(out).count() == 30


def test_drop_incomplete_b3_keeps_empty_strings_drops_null_and_nan(spark):
    from riskframe.operators import expectations as E
    df = spark.createDataFrame([("a", "HIGH", 1.0), ("b", None, 2.0), ("c", "", 3.0), ("d", "LOW", float("nan")),
                                (None, "LOW", 4.0), ("f", "LOW", None)], "description string, sev string, s double")
    assert sorted(r.description for r in E.drop_incomplete(df, ["description", "sev"]).collect()) == ["a", "c", "d", "f"]
    kept = [r.description for r in E.drop_incomplete(df, ["s"]).collect()]
    assert sorted(kept, key=str) == sorted([None, "a", "b", "c"], key=str)
