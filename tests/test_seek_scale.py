from riskframe.plans import serving


def test_pages_are_sought_in_rows_scored_once(spark):
    plan = serving.cve_list_seek(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
