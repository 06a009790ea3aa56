import datetime

import pytest
from pyspark.sql import functions as F

from riskframe.operators import constraints as CN
from riskframe.operators import topk as TK
from riskframe.sources import kev as KV

RULES = [CN.NotNull("id"), CN.Check("score", "score BETWEEN 0 AND 10"), CN.Unique(("id", "day")), CN.ForeignKey(("id",), "parents", ("key",)),
         CN.ForeignKey(("day", "id"), "pairs", ("d", "k")), CN.Default("state", "'new'"), CN.Default("day", "0")]
ROWS = [(1, 1, 5.0, None), (1, 1, None, "x"), (2, None, 11.0, "x"), (None, 3, -1.0, None), (9, 1, 5.0, None), (2, None, 1.0, None)]


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(ROWS, "id int, day int, score double, state string")


@pytest.fixture
def parents(spark):
    return {"parents": spark.createDataFrame([(1,), (1,), (2,), (None,)], "key int"), "pairs": spark.createDataFrame([(1, 1)], "d int, k int")}


def test_every_rule_reports_its_violations(rows, parents):
    got = {(r["kind"], r["rule"]): r["n_violations"] for r in CN.constraint_violations(rows, RULES, parents).collect()}
    assert got == {("not_null", "id"): 1, ("check", "score"): 2, ("unique", "id,day"): 1, ("foreign_key", "id->parents"): 1, ("foreign_key", "day,id->pairs"): 1}
    none = {r["n_violations"] for r in CN.constraint_violations(rows.limit(0), RULES, parents).collect()}
    assert none == {0}
    assert CN.constraint_violations(rows, [CN.Unique(("id",))]).first()["n_violations"] == 2


def test_conforming_rows_have_defaults_and_no_copies(rows, parents):
    got = CN.conforming(rows, RULES[:2] + RULES[3:4] + RULES[5:], parents)
    assert got.columns == rows.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 1, 5.0, "new"), (1, 1, None, "x"), (2, 0, 1.0, "new")], key=str)
    assert "level" in CN.with_defaults(rows, [CN.Default("level", "3")]).columns


def test_one_scan_for_all_row_rules(rows):
    many = [CN.NotNull(c) for c in rows.columns] + [CN.Check(f"c{i}", f"score < {i}") for i in range(20)]
    plan = CN.constraint_violations(rows, many)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") <= 1 and "Join" not in plan


def pages(df, order, down, size):
    token, out = None, []
    while True:
        page = TK.seek_page(df, order, down, size, token)
        got = page.collect()
        if not got:
            return out
        out.append(got)
        token = TK.page_token(page, order)


@pytest.mark.parametrize("size", [1, 3, 7, 500])
def test_pages_in_a_row_are_the_sorted_table(spark, size):
    rows = [(i, [0.1 + 0.2, 1.0, None, -5.5][i % 4], "ab"[i % 2]) for i in range(23)]
    df = spark.createDataFrame(rows, "id long, score double, name string")
    got = [r["id"] for p in pages(df, ("score", "name", "id"), (True, False, True), size) for r in p]
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[2], -r[0]))
    assert got == [r[0] for r in want]


def test_pages_of_dates_and_of_an_empty_table(spark):
    df = spark.createDataFrame([(i, datetime.date(2024, 1, 1 + i % 3)) for i in range(8)], "id int, day date")
    got = [(r["day"], r["id"]) for p in pages(df, ("day", "id"), (False, False), 3) for r in p]
    assert got == sorted((r["day"], r["id"]) for r in df.collect())
    assert pages(df.limit(0), ("day", "id"), (False, False), 3) == []


def test_rows_before_the_token_move_no_later_page(spark):
    df = spark.range(20).select(F.col("id").alias("id"))
    first = TK.seek_page(df, ("id",), (False,), 5)
    token = TK.page_token(first, ("id",))
    after = df.where("id <> 2").unionByName(spark.createDataFrame([(-1,)], "id long"))
    assert [r["id"] for r in TK.seek_page(after, ("id",), (False,), 5, token).collect()] == [5, 6, 7, 8, 9]
    plan = TK.seek_page(df, ("id",), (False,), 5, token)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_unchanged_snapshots_return_the_kept_rows(spark, tmpdir_fresh):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "id int, v string")
    rows, changed = KV.fetch_if_changed(spark, a, tmpdir_fresh, "c")
    assert changed and rows.count() == 3
    rows, changed = KV.fetch_if_changed(spark, a.repartition(3).orderBy("v"), tmpdir_fresh, "c")
    assert not changed and sorted(map(tuple, rows.collect())) == [(1, "x"), (2, "y"), (2, "y")]
    b = a.unionByName(spark.createDataFrame([(3, None)], "id int, v string"))
    rows, changed = KV.fetch_if_changed(spark, b, tmpdir_fresh, "c")
    assert changed and rows.count() == 4
    rows, changed = KV.fetch_if_changed(spark, a, tmpdir_fresh, "c")  # back again is a change too
    assert changed and rows.count() == 3
    assert KV.fetch_if_changed(spark, a.limit(0), tmpdir_fresh, "d")[1]
