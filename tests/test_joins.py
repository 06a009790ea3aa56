import datetime as dt
import random

from pyspark.sql import functions as F

from riskframe.operators import joins as J


def test_asof_join_matches_brute_force(spark):
    rnd = random.Random(5)
    base = dt.date(2020, 1, 1)
    hist = [(f"k{rnd.randint(0, 5)}", base + dt.timedelta(days=rnd.randint(0, 400)), rnd.random()) for _ in range(400)]
    hist = list({(k, d): (k, d, v) for k, d, v in hist}.values())      # unique (key, date)
    left = [(f"k{rnd.randint(0, 6)}", base + dt.timedelta(days=rnd.randint(-20, 420)), i) for i in range(300)]
    h = spark.createDataFrame(hist, "k string, d date, v double")
    l = spark.createDataFrame(left, "k string, t date, i int")
    got = {r.i: r.v_asof for r in J.asof_join(l, h, "k", "t", "d", "v", "v_asof", bucket_days=30).collect()}
    for k, t, i in left:
        cands = [(d, v) for kk, d, v in hist if kk == k and d <= t]
        exp = max(cands)[1] if cands else None
        assert got[i] == exp, (k, t)
    assert len(got) == len(left)


def test_substring_join_paths_agree_with_python(spark):
    texts = [(1, "Apache HTTP Server", ["cpe:2.3:a:apache:http_server"]), (2, "pineapple", []),
             (3, "nothing", ["cpe:2.3:a:x:y"]), (4, None, None), (5, "the ssl lib", ["cpe:2.3:o:linux:kernel"])]
    pats = ["apache", "apple", "ssl", "kernel", "xyz", "a:y", "Y"]
    t = spark.createDataFrame(texts, "id int, product string, cpe_list array<string>")
    p = spark.createDataFrame([(x,) for x in pats], "product string")
    exp = set()
    for i, prod, cpes in texts:
        hay = [(prod or "").lower()] + [c.lower() for c in (cpes or [])]
        for x in pats:
            if any(x.lower() in h for h in hay):
                exp.add((i, x.lower()))
    for nlj, limit in ((100, 100), (0, 100), (0, 0)):          # nested loop, broadcast grams, shuffled grams
        got = {(r[0], r[1]) for r in J.substring_join(t, ["product"], p, "product", "id", ("cpe_list",),
                                                            max_broadcast=limit, nlj_max=nlj).collect()}
        assert got == exp, (nlj, limit)


def test_match_assets_maps_back_to_assets(spark):
    cves = spark.createDataFrame([("CVE-1", "Apache server", "x", ["cpe:2.3:a:apache:http"]),
                                  ("CVE-2", "other", "uses openssl", [])],
                                 "cve_id string, product string, description string, cpe_list array<string>")
    assets = spark.createDataFrame([("a1", "Apache"), ("a2", "apache"), ("a3", "OpenSSL"), ("a4", "nginx")],
                                   "asset_id string, product string")
    got = sorted(tuple(r) for r in J.match_assets(cves, assets).collect())
    assert got == [("a1", "CVE-1"), ("a2", "CVE-1"), ("a3", "CVE-2")]


def test_exploitation_label_modes_trap5(spark):
    c = spark.createDataFrame([("A", "2020-01-01"), ("B", "2020-01-01"), ("C", "2020-01-01"), ("D", None),
                               ("E", "2020-01-01")], "cve_id string, published_date string") \
        .withColumn("published_date", F.col("published_date").cast("date"))
    k = spark.createDataFrame([("A", "2020-02-01"), ("B", "2020-12-01"), ("C", "2019-12-01"), ("D", "2020-01-01"),
                               ("A", "2021-01-01")], "cve_id string, added_date string") \
        .withColumn("added_date", F.col("added_date").cast("date"))
    w = {r.cve_id: r.kev_label for r in J.exploitation_label(c, k, 90, "window").collect()}
    a = {r.cve_id: r.kev_label for r in J.exploitation_label(c, k, 90, "any_listing").collect()}
    assert w == {"A": 1, "B": 0, "C": 1, "D": 1, "E": 0}
    assert a == {"A": 1, "B": 1, "C": 1, "D": 1, "E": 0}


def test_late_label_join_trap6(spark):
    preds = spark.createDataFrame([("X", "high", "2024-01-01"), ("X", "LOW", "2024-01-02"), ("Y", "bogus", "2024-01-01"),
                                   ("Z", "MEDIUM", "2024-01-01")], "cve_id string, prediction string, predicted_at string")
    truth = spark.createDataFrame([("X", "medium", 1), ("X", "critical", 2), ("Y", "LOW", 1), ("Z", "none", 1)],
                                  "cve_id string, base_severity string, modified int")
    j = J.late_label_join(preds, truth, truth_order="modified")
    rows = sorted((r.cve_id, r.predicted, r.truth) for r in j.collect())
    assert rows == [("X", "HIGH", "CRITICAL"), ("X", "LOW", "CRITICAL")]
    latest = J.late_label_join(preds, truth, truth_order="modified", latest_only=True)
    assert [(r.cve_id, r.predicted) for r in latest.collect()] == [("X", "LOW")]


def test_membership_does_not_duplicate(spark):
    df = spark.createDataFrame([("a",), ("b",)], "cve_id string")
    ids = spark.createDataFrame([("a",), ("a",), ("c",)], "cve_id string")
    r = sorted(tuple(x) for x in J.flag_membership(df, ids).collect())
    assert r == [("a", True), ("b", False)]


def test_strict_asof_and_score_history(spark):
    import datetime as dt
    from riskframe.operators import splits as SP
    rnd = random.Random(11)
    base = dt.date(2021, 1, 1)
    rows = list({(f"k{rnd.randint(0, 3)}", base + dt.timedelta(days=rnd.randint(0, 200))): None
                 for _ in range(300)})
    data = [(k, d, round(rnd.random(), 3)) for k, d in rows]
    df = spark.createDataFrame(data, "k string, d date, v double")
    got = {(r.k, r.d): (r.prev_value, r.is_latest) for r in SP.score_history(df, "k", "d", "v", bucket_days=20).collect()}
    for k, d, v in data:
        earlier = sorted((dd, vv) for kk, dd, vv in data if kk == k and dd < d)
        prev = earlier[-1][1] if earlier else None
        last = max(dd for kk, dd, _ in data if kk == k)
        assert got[(k, d)] == (prev, d == last)


def test_gram_join_equals_nested_loop_on_repeated_and_null_keys(spark):
    texts = spark.createDataFrame([("a", "The Apache server"), ("a", "nothing here"), (None, "old apache, apachetop"), ("b", None), ("c", "")],
                                  "cve_id string, description string")
    patterns = spark.createDataFrame([("Apache",), ("apachetop",), ("server",), ("ap",), (None,), ("absent",)], "product string")
    ways = [{"nlj_max": 100}, {"nlj_max": 0}, {"nlj_max": 0, "max_broadcast": 0}]
    got = [sorted(map(tuple, J.substring_join(texts, ["description"], patterns, "product", "cve_id", **w).collect()), key=str) for w in ways]
    assert got[0] == got[1] == got[2]
    assert set(got[0]) == {("a", "apache"), ("a", "server"), ("a", "ap"), (None, "apache"), (None, "apachetop"), (None, "ap")}
