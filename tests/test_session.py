from pyspark.sql import functions as F

from riskframe.session import read_table, spread

from sample_tables import SF_SMALL


def test_spread_single_split_scan_keeps_rows(spark):
    d = read_table(spark, SF_SMALL, "documents")
    s = spread(d, "doc_id")
    cores = spark.sparkContext.defaultParallelism
    assert s.rdd.getNumPartitions() == 2 * cores
    a = sorted((r.doc_id, r.text) for r in d.select("doc_id", "text").collect())
    b = sorted((r.doc_id, r.text) for r in s.select("doc_id", "text").collect())
    assert a == b


def test_spread_leaves_many_split_input_alone(spark):
    cores = spark.sparkContext.defaultParallelism
    d = spark.range(0, 1000, numPartitions=cores + 1)
    assert spread(d, "id") is d


def test_spread_partitioning_reused_by_keyed_aggregate(spark):
    d = spread(read_table(spark, SF_SMALL, "documents"), "doc_id")
    agg = d.select("doc_id", F.explode(F.split("text", " ")).alias("w")).groupBy("doc_id", "w").count()
    plan = agg._jdf.queryExecution().executedPlan().toString()
    # one exchange: the spread itself; the (doc_id, w) aggregate reuses its partitioning
    assert plan.count("Exchange") == 1
