import os

from pyspark.sql import functions as F

from riskframe.operators import expectations as E
from riskframe.operators import sets as G
from riskframe.sources import io as IO


def test_read_any_and_id_column(spark, tmpdir_fresh):
    df = spark.createDataFrame([("CVE-1", 1.0), ("CVE-2", 2.0)], "cve_id string, s double")
    pq = os.path.join(tmpdir_fresh, "t.parquet")
    csv = os.path.join(tmpdir_fresh, "t_csv")
    IO.write_table(df, pq)
    IO.write_table(df, csv, fmt="csv")
    assert IO.read_any(spark, pq).count() == 2
    c = IO.read_any(spark, csv)
    assert c.count() == 2 and IO.id_column(c) == "cve_id"
    assert IO.id_column(c.select(F.col("s").alias("x"), "cve_id"), "missing") == "x"
    assert IO.first_existing(spark, [os.path.join(tmpdir_fresh, "nope"), pq]).count() == 2


def test_partitioned_sink_prunes(spark, tmpdir_fresh):
    df = spark.range(100).withColumn("year", (F.col("id") % 4 + 2020).cast("int"))
    path = os.path.join(tmpdir_fresh, "p")
    IO.write_table(df, path, partition_by=["year"])
    back = spark.read.parquet(path).where("year = 2021")
    assert back.count() == 25
    assert "PartitionFilters: [isnotnull(year" in back._jdf.queryExecution().executedPlan().toString()


def test_partitioned_parquet_is_known_by_its_files(spark, tmpdir_fresh):
    df = spark.range(20).withColumn("year", (F.col("id") % 2 + 2020).cast("int"))
    path = os.path.join(tmpdir_fresh, "by_year")
    IO.write_table(df, path, partition_by=["year"])
    assert sorted(map(tuple, IO.read_any(spark, "file://" + path).select("id", "year").collect())) == sorted(map(tuple, df.collect()))
    empty = os.path.join(tmpdir_fresh, "empty")
    IO.write_table(df.where("false"), empty)
    assert IO.first_existing(spark, [empty, os.path.join(tmpdir_fresh, "missing")]) is None
    assert IO.first_existing(spark, [empty, path]).count() == 20


def test_report_feedback_ledger_accounting(spark):
    rep = spark.createDataFrame([("value", 0.1, False)], "feature string, psi double, drift_detected boolean")
    assert IO.report_json(rep).first()[0] == '{"feature":"value","psi":0.1,"drift_detected":false}'
    fb = spark.createDataFrame([("CVE-1", "a", "high", "critical", "", 5), ("CVE-2", "b", "low", "low", "", 9)],
                               "cve_id string, analyst_id string, predicted_severity string, corrected_severity string,"
                               " feedback_notes string, confidence_rating int")
    rows = IO.feedback_rows(fb, F.current_timestamp()).collect()
    assert len(rows) == 1 and rows[0].corrected_severity == "CRITICAL" and rows[0].used_for_retraining is False
    items = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    ledger = IO.mark_used(spark.createDataFrame([(2,), (2,)], "id long"), F.current_timestamp())
    assert sorted(r.id for r in G.unused(items, ledger, "id").collect()) == [1, 3]
    acc = IO.ingestion_accounting(items, items.limit(1), "src").first()
    assert (acc.records_fetched, acc.records_inserted, acc.records_updated) == (3, 1, 2)


def test_prediction_log_rows(spark):
    s = spark.createDataFrame([("CVE-1", "HIGH", 0.123456, 0.5)], "cve_id string, p string, c double, f double")
    r = IO.prediction_log_rows(s, "cve_id", "v1", "p", "c", ["f"], F.lit("2024-01-01").cast("timestamp")).first()
    assert r.confidence == 0.1235 and r.features_snapshot == '{"f":0.5}' and r.model_version == "v1"


def test_expectations_and_schema_rules(spark):
    df = spark.createDataFrame([("CVE-2024-1234", "2024-01-01", "HIGH", 7.5), ("bad", None, "WEIRD", 11.0),
                                (None, "2024-01-01", "", None)],
                               "cve_id string, published_date string, base_severity string, base_score double")
    r = {x.rule: (x.n_failed, x.passed) for x in E.evaluate(df, {**E.raw_rules(), **E.future_date_rule(
        as_of="2024-06-01")}).collect()}
    assert r["cve_id_format"] == (2, False) and r["published_date_not_null"] == (1, False)
    assert r["severity_label_valid"] == (1, False) and r["base_score_range"] == (1, False)
    assert r["__any__"] == (2, False) and r["published_not_in_future"] == (0, True)
    assert E.leakage_columns(["base_score", "x", "Severity_Label"]) == ["base_score", "Severity_Label"]
    assert "base_score" not in E.leakage_free(df).columns
    comp = E.complete_schema(df.select("base_score"), ["base_score", "extra"])
    assert comp.columns == ["base_score", "extra"] and comp.where("base_score IS NULL").count() == 0
    num, cat = E.drift_candidates(df, df, exclude_keys=("cve_id",))
    assert num == ["base_score"] and cat == ["published_date", "base_severity"]
    dup = E.unique_violations(df.union(df), ["cve_id"]).count()
    assert dup == 3
