"""Streams that keep state across runs: look-back log, late labels, incremental sync."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riskframe.plans import streams as ST
from riskframe.streaming import lookback as LB
from riskframe.streaming import pipeline as P
from riskframe.streaming import sync as SY
from sample_tables import SF_SMALL


def name():
    return f"t-{uuid.uuid4().hex[:8]}"


EVENTS = "id long, at timestamp, v double"


def write_events(spark, path, rows):
    spark.createDataFrame(rows, "id long, at string, v double").withColumn("at", F.col("at").cast("timestamp")) \
        .coalesce(1).write.mode("append").parquet(path)


def counts(spark, path):
    return {(str(r["log_date"]), r["value"]): r["n"] for r in spark.read.parquet(f"{path}/counts").groupBy("log_date", "value").agg(F.sum("n").alias("n")).collect()}


def test_log_counts_add_up_over_restarts_and_rerun_batches(spark, tmpdir_fresh):
    src, out, run = f"{tmpdir_fresh}/src", f"{tmpdir_fresh}/out", name()
    write_events(spark, src, [(1, "2024-01-01 10:00:00", 5.0), (2, "2024-01-01 11:00:00", 5.0), (3, "2024-01-02 00:00:00", float("nan"))])
    start = lambda: LB.log_and_count(spark.readStream.schema(EVENTS).parquet(src), "at", ["v"], out, run).awaitTermination()
    start()
    start()
    assert counts(spark, out) == {("2024-01-01", 5.0): 2}
    write_events(spark, src, [(4, "2024-01-01 12:00:00", 5.0), (5, "2024-01-03 00:00:00", 7.0)])
    start()
    want = {("2024-01-01", 5.0): 3, ("2024-01-03", 7.0): 1}
    assert counts(spark, out) == want and spark.read.parquet(f"{out}/log").count() == 5
    # the last batch once more, as after a failure before its commit
    again = spark.read.parquet(f"{out}/log").where("batch_id = 1").drop("batch_id")
    rows = spark.createDataFrame(again.collect(), again.schema)
    P.write_log_batch(LB.day_counts(rows, ["v"]), 1, f"{out}/counts")
    assert counts(spark, out) == want


def test_lookback_reads_only_its_days_and_never_the_log(spark, tmpdir_fresh):
    src, out = f"{tmpdir_fresh}/src", f"{tmpdir_fresh}/out"
    write_events(spark, src, [(i, f"2024-01-{1 + i % 20:02d} 00:00:00", float(i % 7 + (i % 20 >= 10))) for i in range(400)])
    LB.log_and_count(spark.readStream.schema(EVENTS).parquet(src), "at", ["v"], out, name()).awaitTermination()
    cur = LB.counts_between(spark, out, "2024-01-11", "2024-01-18")
    plan = cur._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "log_date" in plan.split("PartitionFilters")[1] and "/log" not in plan.replace("/log_date", "")
    assert cur.agg(F.sum("n")).first()[0] == 7 * 20
    files = {f for f in cur.inputFiles()}
    assert files and all("/counts/" in f for f in files)
    r = LB.lookback_drift(spark, out, "2024-01-18", 7).first()
    assert (r["n_ref"], r["n_cur"]) == (200, 140) and r["ks_statistic"] > 0.1


PRED = "id long, at timestamp, p string"
LABEL = "id long, seen timestamp, truth string"


def test_late_labels_over_a_restart_equal_the_batch_join(spark, tmpdir_fresh):
    d, run = tmpdir_fresh, name()

    def add(day_rows, label_rows):
        for rows, schema, ts, where in ((day_rows, "id long, at string, p string", "at", "preds"), (label_rows, "id long, seen string, truth string", "seen", "labels")):
            spark.createDataFrame(rows, schema).withColumn(ts, F.col(ts).cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{d}/{where}")

    def start():
        preds = spark.readStream.schema(PRED).parquet(f"{d}/preds")
        labels = spark.readStream.schema(LABEL).parquet(f"{d}/labels")
        P.append_stream(P.late_labels(preds, labels, "id", "at", "seen", "truth", "3 days", "1 day"), f"{d}/out", run).awaitTermination()

    preds = [(i, f"2024-01-{1 + i:02d} 00:00:00", "HIGH") for i in range(10)]
    labels = [(i, f"2024-01-{1 + i + i % 5:02d} 00:00:00", "LOW") for i in range(10) if i != 2]
    add(preds[:5], [x for x in labels if x[1] < "2024-01-06"])
    start()
    first = {(r["id"], r["truth"]) for r in spark.read.parquet(f"{d}/out").collect()}
    assert {(0, "LOW"), (1, "LOW")} <= first and (3, None) not in first  # label 3 may still come
    add(preds[5:], [x for x in labels if x[1] >= "2024-01-06"])
    add([(99, "2024-02-01 00:00:00", "HIGH")], [(98, "2024-02-01 00:00:00", "LOW")])  # moves both watermarks
    start()
    got = sorted((r["id"], r["truth"]) for r in spark.read.parquet(f"{d}/out").collect() if r["id"] < 90)
    assert got == [(i, None if i in (2, 4, 9) else "LOW") for i in range(10)]


ROWS = "k string, modified date, v int, landed timestamp"


def test_two_runs_over_redelivered_pages_equal_one(spark, tmpdir_fresh):
    def page(path, day, rows):
        spark.createDataFrame(rows, "k string, modified string, v int").select("k", F.col("modified").cast("date").alias("modified"), "v",
                              F.lit(f"2024-01-0{day}").cast("timestamp").alias("landed")).coalesce(1).write.mode("append").parquet(path)

    def run(path, table, stream):
        SY.sync(spark.readStream.schema(ROWS).parquet(path), table, stream, "k", "modified", "landed", buckets=4).awaitTermination()

    first = [(f"k{i}", f"2023-03-{1 + i % 28:02d}", i) for i in range(60)] + [(None, "2023-01-01", 5)]
    second = first[::3] + [(f"k{i}", "2023-05-01", 1000 + i) for i in range(0, 60, 7)] + [("k1", "2020-01-01", -1), ("new", "2023-02-02", 9)] * 2
    two, stream = f"{tmpdir_fresh}/two", name()
    page(f"{two}/pages", 1, first)
    run(f"{two}/pages", f"{two}/table", stream)
    page(f"{two}/pages", 2, second)
    run(f"{two}/pages", f"{two}/table", stream)
    run(f"{two}/pages", f"{two}/table", stream)
    one = f"{tmpdir_fresh}/one"
    page(f"{one}/pages", 1, first)
    page(f"{one}/pages", 2, second)
    run(f"{one}/pages", f"{one}/table", name())
    table = lambda p: sorted((str(r["k"]), str(r["modified"]), r["v"]) for r in spark.read.parquet(f"{p}/table").collect())
    want = {}
    for k, m, v in first + second:
        want[k] = max(want.get(k, ("", 0)), (m, v))
    assert table(two) == table(one) == sorted((str(k), m, v) for k, (m, v) in want.items())
    # a batch that runs twice changes nothing
    SY.upsert_batch(spark.createDataFrame(second, "k string, modified string, v int").withColumn("modified", F.col("modified").cast("date")), 7, f"{two}/table", "k", "modified", 4)
    assert table(two) == table(one)


def test_resume_at_the_mark(spark):
    rows = spark.createDataFrame([(i, i // 2) for i in range(10)], "k int, m int")
    assert sorted(r["k"] for r in SY.since_mark(rows, rows.where("m <= 3"), "m").collect()) == [6, 7, 8, 9]
    assert SY.since_mark(rows, rows.limit(0), "m").count() == 10


def test_registered_stream_queries_return_rows(spark):
    assert ST.lookback_drift(spark, SF_SMALL).count() == 2
    assert ST.incremental_sync(spark, SF_SMALL).count() == spark.read.parquet(f"{SF_SMALL}/orders.parquet").count()
