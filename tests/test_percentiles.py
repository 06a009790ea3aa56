import numpy as np
from pyspark.sql import functions as F

from riskframe.operators import aggregates as A
from riskframe.operators import cumulative as C
from riskframe.operators import drift as D

PROBS = [0.0, 0.1, 0.25, 0.5, 0.9, 0.95, 0.99, 1.0]


def test_percentiles_equal_numpy(spark):
    rng = np.random.default_rng(1)
    groups = {"a": rng.normal(size=501).tolist(), "b": rng.integers(0, 4, 1000).astype(float).tolist(), "c": [3.5], "d": [1.0, 2.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("e", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r["percentiles"] for r in C.exact_percentiles(df, "v", PROBS, ["g"]).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert np.allclose(got[g], np.percentile(vs, [100 * p for p in PROBS]), rtol=1e-12, atol=1e-12)


def test_running_totals_over_many_ranges(spark):
    rng = np.random.default_rng(2)
    values = np.unique(rng.integers(0, 50_000, 6000)).tolist()
    df = spark.createDataFrame([(g, int(v), int(v % 3)) for g in "xy" for v in values], "g string, v int, n int")
    for buckets in (None, 2, 33, 500):
        got = {(r["g"], r["v"]): r["cum_n"] for r in C.running_totals(df, "v", ["n"], ["g"], buckets).collect()}
        total = 0
        for v in values:
            total += v % 3
            assert got["x", v] == got["y", v] == total


def test_ranges_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(C, "ROWS_PER_BUCKET", 10)
    assert C.bucket_count(spark.range(5000)) == 500 and C.bucket_count(spark.range(3)) == C.DEFAULT_BUCKETS


def test_latency_stats_keep_null_groups_and_empty_tables(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), (None, 5.0), ("b", None)], "k string, v double")
    got = {r["k"]: r for r in A.latency_stats(df, "v", ["k"]).collect()}
    assert got["a"]["p50"] == 1.5 and got[None]["p99"] == 5.0 and got["b"]["p50"] is None and got["b"]["n"] == 0
    empty = A.latency_stats(df.limit(0), "v").collect()
    assert len(empty) == 1 and empty[0]["p50"] is None and empty[0]["n"] == 0
    one = A.latency_stats(df, "v").first()
    assert one["p50"] == 2.0 and one["max"] == 5.0


def test_no_percentile_buffer_in_the_plans(spark):
    df = spark.range(1000).select((F.col("id") % 7).cast("string").alias("k"), F.col("id").cast("double").alias("v"))
    long = df.select(F.lit("f").alias("feature"), F.col("v").alias("value"), (F.col("v") % 2).cast("int").alias("side"))
    for out in (A.latency_stats(df, "v", ["k"]), D.psi(long)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "percentile(" not in plan
    assert abs(D.psi(long).first()["psi"]) < 0.01


def test_drift_report_counts_the_data_once(spark):
    rng = np.random.default_rng(4)
    rows = [("f", float(v), 0) for v in rng.normal(size=400)] + [("f", float(v), 1) for v in rng.normal(1, 1, 300)]
    long = spark.createDataFrame(rows, "feature string, value double, side int")
    r = D.numeric_report(long).first()
    assert r["drift_detected"] and r["psi"] > 0.2 and r["status"] == "ok"
    values = np.array([x[1] for x in rows[:400]]), np.array([x[1] for x in rows[400:]])
    edges = np.percentile(values[0], range(0, 101, 10))
    share = [np.histogram(v, [-np.inf, *edges[1:-1], np.inf])[0] / len(v) for v in values]
    assert np.isclose(r["psi"], ((share[1] - share[0]) * np.log(share[1] / share[0])).sum())
