import json
import re

from pyspark.sql import functions as F

from riskframe import fixtures as X
from riskframe.functions import cvss as CV
from riskframe.ml import tfidf as TF
from riskframe.plans import ingest, learning
from riskframe.sources import nvd as NV

SF_SMALL = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _records(spark):
    v3 = lambda kind, score: {"source": "s", "type": kind, "cvssData": {"version": "3.1", "baseScore": score, "baseSeverity": "LOW"}, "impactScore": 1.5}
    rows = [{"id": "A", "published": "2020-01-01", "descriptions": [{"lang": "es", "value": "x"}, {"lang": "en", "value": "y"}],
             "metrics": {"cvssMetricV31": [v3("Secondary", 1.0), v3("Primary", 2.0)], "cvssMetricV2": [{"baseSeverity": "HIGH", "cvssData": {"baseScore": 9.0}}]},
             "weaknesses": [{"description": [{"lang": "en", "value": "CWE-5"}, {"lang": "es", "value": "CWE-6"}]}],
             "references": [{"url": "u"}, {"url": ""}], "configurations": [{"nodes": [{"cpeMatch": [{"criteria": "c"}]}]}]},
            {"id": "B", "metrics": {"cvssMetricV31": [], "cvssMetricV30": [v3("Secondary", 3.0)]}}, {"id": ""}, {"published": "2021"}, {"id": "C", "weaknesses": None}]
    return spark.createDataFrame([(json.dumps({"cve": r}),) for r in rows] + [("{broken",), (None,)], "json string")


def test_any_columns_of_the_flat_feed_equal_those_of_the_whole(spark):
    df = _records(spark)
    whole = NV.flatten(NV.parse_records(df, "json"))
    assert whole.columns == NV.FLAT_COLUMNS and whole.count() == 3
    for columns in [[c] for c in NV.FLAT_COLUMNS] + [["cve_id", "base_score"], ["vendor_count", "cwe_ids"], NV.FLAT_COLUMNS[::-1]]:
        got = NV.flatten(NV.parse_records(df, "json", NV.record_schema(columns)), columns=columns)
        assert got.columns == columns
        assert sorted(map(str, got.collect())) == sorted(map(str, whole.select(*columns).collect()))


def test_feed_queries_parse_only_the_fields_they_use(spark):
    for query, unused in ((ingest.nvd_id_lookup, "descriptions"), (ingest.nvd_by_year, "metrics"), (ingest.nvd_incremental, "weaknesses"), (ingest.feed_features, "metrics")):
        schema = re.search(r"from_json\((.*?), invoke", _plan(query(spark, SF_SMALL))).group(1)
        assert "StructField(id," in schema and f"StructField({unused}," not in schema


def test_line_items_are_shuffled_without_their_structs(spark):
    items = X._line_items(spark, SF_SMALL)
    collected = re.findall(r"collect_list\((.*?), 0, 0", _plan(items))
    assert collected and all("p_brand" in x and "cpe:2.3" not in x and "CWE-" not in x for x in collected)
    one = items.where(F.size("items") > 1).first()["items"]
    assert [(i["l_linenumber"], i["l_partkey"], i["l_suppkey"]) for i in one] == sorted((i["l_linenumber"], i["l_partkey"], i["l_suppkey"]) for i in one)
    assert one[0]["weak"]["description"][0]["value"] == f"CWE-{one[0]['l_partkey'] % 1000}"


def test_a_cvss_field_takes_one_regex(spark):
    f = CV.cvss_fields("v")
    assert str(spark.createDataFrame([("x",)], "v string").select(f["attack_vector"].alias("x"))._jdf.queryExecution().analyzed()).count("regexp_extract(") == 1


def test_terms_are_counted_before_the_shuffle_and_repeated_keys_are_one_document(spark):
    unique = spark.createDataFrame([(1, "aa bb aa"), (2, "bb cc"), (3, None)], "id long, t string")
    plan = TF._term_stats(unique, "t", "id", [])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1 and "hashpartitioning(term" in plan
    again = spark.createDataFrame([(1, "aa bb aa"), (1, "bb aa"), (2, "bb cc"), (None, "aa"), (None, "aa cc"), (None, "dd")], "id long, t string")
    for df in (unique, again, again.limit(0)):
        want = TF._per_document(df, "t", "id", []).groupBy("term").agg(F.sum("__c").alias("corpus_count"), F.count(F.lit(1)).alias("df"))
        got = TF._term_stats(df, "t", "id", [])
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_weights_count_vocabulary_terms_alone(spark):
    df = spark.createDataFrame([(1, "aa bb aa"), (1, "bb aa"), (2, "bb cc"), (None, "aa")], "id long, t string")
    vocab = TF.fit(df, "t", "id", max_features=3, stop_words=[])
    got = TF.transform(df, vocab, "t", "id", [])
    want = TF.weigh(TF._per_document(df, "t", "id", []), vocab, "id")
    rows = lambda x: sorted((r["id"], r["term"], round(r["tfidf"], 9)) for r in x.collect())
    assert rows(got) == rows(want)
    counted = _plan(got)
    assert counted.index("Join") < counted.rindex("explode")


def test_learning_queries_build_the_feed_once(spark, monkeypatch):
    seen, fit = [], TF.fit

    def spy(df, *args, **kwargs):
        seen.append(_plan(df))
        return fit(df, *args, **kwargs)

    monkeypatch.setattr(TF, "fit", spy)
    rows = learning._build(spark, SF_SMALL)
    assert len(seen) == 1 and "from_json" not in seen[0]
    assert {r["split"] for r in rows.select("split").distinct().collect()} == {"train", "val", "test"}
    assert rows.count() == rows.where("features is not null and label >= 0").count() > 0
