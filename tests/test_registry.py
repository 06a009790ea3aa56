"""The registry must import and list its queries without any jar, file or JVM."""

import subprocess
import sys

ROOT = __file__.rsplit("/", 2)[0]


def test_registry_needs_no_jar_or_jvm():
    code = ("import glob; glob.glob = lambda *a, **k: []\n"
            "import __spark_entry__ as e\n"
            "from pyspark import SparkContext\n"
            "assert len(e.queries()) > 80 and len(e.oracle_sql()) > 80\n"
            "assert SparkContext._active_spark_context is None\n")
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_ids_stay_distinct_beyond_five_digits(spark):
    from riskframe.fixtures import _CVE_ID_SQL, _cve_id
    from pyspark.sql import functions as F
    keys = [1, 7, 79_999, 89_999, 90_000, 90_001, 900_000, 123_456_789]
    df = spark.createDataFrame([(k,) for k in keys], "o_orderkey long").withColumn("o_orderdate", F.lit("2020-01-01").cast("date"))
    ids = [r[0] for r in df.select(_cve_id(F.col("o_orderdate"), F.col("o_orderkey"))).collect()]
    assert len(set(ids)) == len(keys) and ids[-1] == "CVE-2020-123466789"
    assert ids == [r[0] for r in df.select(F.expr(_CVE_ID_SQL)).collect()]
