import datetime as dt

from pyspark.sql import functions as F

from riskframe import fixtures as X
from riskframe import session
from riskframe.operators import joins as J
from riskframe.operators import splits as SP
from riskframe.plans import linking, ordering

DAY = dt.datetime(1996, 1, 1)


def _tables(spark, folder, orders=40):
    """Orders and line items with repeated keys and days, and orders without a date or a key."""
    o = [(k, k % 5, DAY + dt.timedelta(days=20 * k) if k % 9 else None) for k in range(orders)] + [(7, 3, DAY), (None, 1, DAY)]
    li = [(k if k != 11 else None, 13 * k + n if n else None, DAY + dt.timedelta(days=25 * k + 30 * (n // 2))) for k in range(orders) for n in range(6)]
    spark.createDataFrame(o, "o_orderkey long, o_custkey long, o_orderdate timestamp").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame(li, "l_orderkey long, l_partkey long, l_shipdate timestamp").write.parquet(f"{folder}/lineitem.parquet")
    return folder


def _rows(df):
    return sorted(map(str, df.collect()))


def _most_rows_of_a_partition(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def _sizes_of_two_histories(spark, folder, monkeypatch):
    """Largest exchange partitions at one and at four times the rows, with few rows to a task."""
    monkeypatch.setattr(session, "TASK_ROWS", 20)
    return [_most_rows_of_a_partition(X.epss_history(spark, _tables(spark, f"{folder}/{n}", n)).where("cve_id is not null")) for n in (100, 400)]


def test_history_by_id_is_the_same_however_it_is_dealt_out(spark, tmpdir_fresh, monkeypatch):
    at = _tables(spark, f"{tmpdir_fresh}/t")
    queries = (X.epss_history, ordering.score_history, ordering.score_trend, linking.latest_score)
    before = [_rows(q(spark, at)) for q in queries]
    monkeypatch.setattr(session, "TASK_ROWS", 5)
    assert [_rows(q(spark, at)) for q in queries] == before
    assert any("cve_id=None" in r for r in before[0])


def test_a_task_of_score_history_has_no_more_rows_of_a_larger_table(spark, tmpdir_fresh, monkeypatch):
    one, four = _sizes_of_two_histories(spark, tmpdir_fresh, monkeypatch)
    assert four < 2 * one


def test_score_trend_groups_where_the_history_was_dealt_out(spark, tmpdir_fresh, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 5)
    at = _tables(spark, f"{tmpdir_fresh}/t")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan(ordering.score_trend(spark, at)).count("Exchange") == plan(X.epss_history(spark, at)).count("Exchange")


def test_score_history_reads_its_rows_for_itself_and_one_summary(spark):
    df = spark.createDataFrame([("a", dt.date(2020, 1, d), float(d)) for d in (1, 2, 9)], "k string, d date, v double")
    plan = SP.score_history(df, "k", "d", "v")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 2 and "Union" not in plan


def test_score_history_with_nulls_and_repeated_instants(spark):
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=n)
    data = [("a", day(0), 1.0), ("a", day(1), None), ("a", day(2), 3.0), ("a", day(2), 3.0), ("a", day(70), 5.0), ("a", None, 9.0), (None, day(1), 2.0), ("b", None, 4.0)]
    df = spark.createDataFrame(data, "k string, d date, v double")
    old = J.asof_join(df, df, "k", "d", "d", "v", "prev_value", strict=True).join(df.groupBy("k").agg(F.max("d").alias("m")), "k") \
        .select("k", "d", "v", "prev_value", (F.col("v") - F.col("prev_value")).alias("delta"), (F.col("d") == F.col("m")).alias("is_latest"))
    assert _rows(SP.score_history(df, "k", "d", "v")) == _rows(old)
