import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from riskframe.ml import models as ML
from riskframe.operators import expectations as E


@pytest.fixture(scope="module")
def classes(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(240):
        k = int(rng.choice(4, p=[.6, .2, .15, .05]))
        rows.append((f"c{i}", k, [float(v) for v in rng.normal([k, (k - 1.5) ** 2, 0], .6)]))
    df = spark.createDataFrame(rows, "cve_id string, label int, x array<double>").select("cve_id", "label", array_to_vector("x").alias("features"))
    return df.where("cast(substr(cve_id, 2) as int) < 160"), df.where("cast(substr(cve_id, 2) as int) >= 160")


def test_boosted_classes_add_up_agree_and_beat_the_majority(classes):
    train, test = classes
    runs = [ML.boosted_predictions(ML.boosted(train, iterations=4, depth=3), test, "boosted").orderBy("cve_id") for _ in range(2)]
    first, second = ([(r["cve_id"], list(r["probs"])) for r in run.collect()] for run in runs)
    assert first == second and len(first) == test.count()
    assert all(abs(sum(p) - 1) < 1e-9 and min(p) >= 0 for _, p in first)
    f1 = {r["model"]: r["macro_f1"] for r in ML.evaluate(runs[0].unionByName(ML.majority_baseline(train, test))).collect()}
    assert f1["boosted"] > f1["majority"] + 0.2


def test_boosting_one_class_only(classes):
    train, test = classes
    p = ML.boosted_predictions(ML.boosted(train.where("label = 2")), test, "b").select("probs").distinct().collect()
    assert [list(r["probs"]) for r in p] == [[0.0, 0.0, 1.0, 0.0]]


def test_search_is_reproducible_and_halves(classes):
    train, val = classes
    one, two = (sorted(map(tuple, ML.search(train, val, settings=5, rungs=(1, 4)).collect())) for _ in range(2))
    assert one == two and len(one) == 5
    rung, pruned = [r[2] for r in one], [r[5] for r in one]
    assert rung.count(1) == 2 and pruned.count(True) == 3 and all(p == (r == 0) for r, p in zip(rung, pruned, strict=True))


def test_column_checks_follow_the_data(spark):
    ref = spark.createDataFrame([("a", 0, "x", 1.0), ("b", 2, None, None)], "cve_id string, n int, kind string, base_score double")
    cur = spark.createDataFrame([("c", 5, "y", "t"), ("d", None, "x", "")], "cve_id string, n int, kind string, extra string")
    got = {r["column"]: r for r in E.column_checks(ref, cur, ["n", "missing"]).collect()}
    assert set(got) == {"cve_id", "n", "kind", "base_score", "extra", "missing"}
    n, kind = got["n"], got["kind"]
    assert (n["ref_full"], n["cur_full"], n["cur_nulls"], n["cur_filled"], n["ref_filled"], n["numeric_candidate"]) == (1, 1, 1, 1, 0, True)
    assert (kind["ref_values"], kind["cur_values"], kind["shared_values"], kind["categorical_candidate"]) == (1, 2, 1, True)
    assert got["base_score"]["forbidden"] and not got["base_score"]["kept"] and not got["base_score"]["shared"]
    assert (got["missing"]["ref_filled"], got["missing"]["cur_filled"], got["missing"]["ref_nulls"]) == (2, 2, None)
    assert got["extra"]["cur_full"] == 1 and not got["cve_id"]["categorical_candidate"]
    changed = cur.withColumn("kind", F.lit("z"))
    assert {r["column"]: r["shared_values"] for r in E.column_checks(ref, changed, []).collect()}["kind"] == 0
    assert {r["ref_rows"] for r in E.column_checks(ref.limit(0), cur, []).collect()} == {0}
