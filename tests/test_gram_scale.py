from pyspark.sql import functions as F

from riskframe.operators import joins as J
from riskframe.plans import linking


def _rows(df):
    return sorted(map(str, df.collect()))


def test_gram_join_ships_neither_grams_nor_texts_whole(spark, tmpdir_fresh):
    texts = spark.range(200).select("id", F.concat(F.lit("amber lacquer "), F.col("id")).alias("text"))
    texts.write.parquet(f"{tmpdir_fresh}/texts")
    patterns = spark.createDataFrame([("lacquer",), ("amber",), ("am",)], "p string")
    got = J.substring_join(spark.read.parquet(f"{tmpdir_fresh}/texts"), ["text"], patterns, "p", "id", nlj_max=0, max_broadcast=0)
    assert got.count() == 600
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("SortMergeJoin") == 2 and "BroadcastHashJoin" not in plan


def test_asset_texts_are_dealt_out_by_their_number(spark, tmpdir_fresh, monkeypatch):
    names = spark.range(300).select(F.col("id").alias("p_partkey"), F.concat_ws(" ", F.lit("red"), F.concat(F.lit("pump"), F.col("id") % 7)).alias("p_name"))
    names.write.parquet(f"{tmpdir_fresh}/part.parquet")
    before = _rows(linking.asset_match_gram(spark, tmpdir_fresh))
    monkeypatch.setattr(linking, "TEXT_ROWS", 10)
    got = linking.asset_match_gram(spark, tmpdir_fresh)
    assert _rows(got) == before and len(before) == 300
    assert "RepartitionByExpression [p_partkey" in got._jdf.queryExecution().optimizedPlan().toString()
    assert ", 30" in got._jdf.queryExecution().optimizedPlan().toString()
