"""Literal rows for instants within a day, flag drift, the four-weight preset, tie-breaks and the one-pass gate."""

import datetime as dt
import math

from pyspark.sql import functions as F

from riskframe import constants as K
from riskframe.functions import risk as R
from riskframe.ml import gate
from riskframe.operators import drift, joins, sets, splits


def _at(h, m=0):
    return dt.datetime(2024, 5, 1, h, m)


def test_asof_orders_snapshots_within_a_day(spark):
    hist = spark.createDataFrame([("a", _at(8), 0.1), ("a", _at(20), 0.9)], "id string, at timestamp, v double")
    left = spark.createDataFrame([("a", _at(7)), ("a", _at(12)), ("a", _at(20)), ("b", _at(9))], "id string, t timestamp")
    got = {(r.id, r.t.hour): r.out for r in joins.asof_join(left, hist, "id", "t", "at", "v", "out").collect()}
    assert got == {("a", 7): None, ("a", 12): 0.1, ("a", 20): 0.9, ("b", 9): None}
    strict = {(r.id, r.t.hour): r.out for r in joins.asof_join(left, hist, "id", "t", "at", "v", "out", strict=True).collect()}
    assert strict[("a", 20)] == 0.1


def test_trend_keeps_nine_decimals(spark):
    rows = [("a", dt.date(2024, 1, 1), 0.000000001), ("a", dt.date(2024, 1, 2), 0.000000004)]
    r = splits.trend(spark.createDataFrame(rows, "id string, d date, v double"), "id", "d", "v").first()
    assert math.isclose(r.slope_per_day, 3e-9, rel_tol=1e-9)


def test_psi_of_flags_counts_values(spark):
    # eleven reference rows: no decile falls between 0 and 1
    rows = [("f", float(i % 2 == 0), 0) for i in range(11)] + [("f", float(i % 5 == 0), 1) for i in range(10)]
    rows += [("x", float(i), s) for i in range(10) for s in (0, 1)]
    long = spark.createDataFrame(rows, "feature string, value double, side int")
    got = {r.feature: r.psi for r in drift.psi(long, categorical_flags=True).collect()}
    assert math.isclose(got["f"], (0.8 - 5 / 11) * math.log(0.8 / (5 / 11)) + (0.2 - 6 / 11) * math.log(0.2 / (6 / 11))) and got["x"] == 0.0
    assert {r.feature: r.psi for r in drift.psi(long).collect()}["f"] == 0.0


def test_psi_of_a_flag_without_current_rows_is_zero(spark):
    long = spark.createDataFrame([("f", 1.0, 0), ("f", 0.0, 0)], "feature string, value double, side int")
    assert drift.value_psi(long).first().psi == 0.0


def test_four_weight_preset(spark):
    df = spark.createDataFrame([("HIGH", 1.95, True, 0.4), ("LOW", None, None, None)], "sev string, sub double, kev boolean, epss double")
    out = R.with_risk_score(df, weights=K.RISK_WEIGHT_PRESETS["four_factor"], severity_label="sev", kev="kev", epss="epss", exploitability="sub")
    got = [r.risk_score for r in out.collect()]
    assert got == [round(100 * (0.35 * 0.78 + 0.25 * 0.5 + 0.25 + 0.15 * 0.4), 2), 7.0]


def test_exploited_flag(spark):
    df = spark.createDataFrame([(9.4, None), (9.3, None), (None, True), (None, None)], "s double, k boolean")
    assert [r[0] for r in df.select(R.exploited_flag("s", "k")).collect()] == [True, False, True, False]


def test_append_new_takes_the_least_row_of_a_key(spark):
    hist = spark.createDataFrame([(1, 5)], "id int, v int")
    batch = spark.createDataFrame([(2, 9), (2, 3), (1, 1)], "id int, v int")
    assert [tuple(r) for r in sets.append_new(hist, batch, ["id"]).collect()] == [(2, 3)]


def test_fallback_rows_of_one_instant_have_an_order(spark):
    df = spark.createDataFrame([(i, _at(1)) for i in (5, 3, 4)], "id int, t timestamp")
    got = R.recent_or_latest(df, "t", "2030-01-01 00:00:00", 2, tie=("id",))
    assert sorted(r.id for r in got.collect()) == [3, 4]


def test_gate_reads_its_metrics_once(spark, tmp_path):
    spark.range(4).select(F.col("id").cast("string").alias("m"), (F.col("id") / 4).alias("macro_f1")).write.parquet(str(tmp_path / "m"))
    metrics = spark.read.parquet(str(tmp_path / "m")).groupBy("m").agg(F.max("macro_f1").alias("macro_f1"))
    checks = gate.quality_gate(metrics, ["m"])
    plan = checks._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1 and checks.count() == 4 * len(gate.GATE_CHECKS)
    best = spark.createDataFrame([(0.5,)], "macro_f1 double")
    won = gate.quality_gate(metrics, ["m"], champion=best).where("check = 'beats_champion' and passed").collect()
    assert [r.m for r in won] == ["3"]
