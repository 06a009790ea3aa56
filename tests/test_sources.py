import gzip
import json
import os

from pyspark.sql import functions as F

from riskframe.sources import epss as EP
from riskframe.sources import kev as KV
from riskframe.sources import nvd as NV


def _rec(**cve):
    return json.dumps({"cve": cve})


def test_flatten_rules(spark):
    v3 = lambda typ, score, vec=None: {"type": typ, "cvssData": {"version": "3.1", "baseScore": score,
                                                                   "vectorString": vec, "attackVector": "NETWORK"},
                                        "exploitabilityScore": 3.9, "impactScore": 1.0}
    recs = [
        _rec(id="CVE-2024-0001", published="2024-01-01T00:00:00.000", lastModified="2024-02-01T00:00:00.000",
             descriptions=[{"lang": "es", "value": "hola"}, {"lang": "en", "value": "first"},
                           {"lang": "en", "value": "second"}],
             metrics={"cvssMetricV31": [v3("Secondary", 1.0), v3("Primary", 9.8, "CVSS:3.1/AV:N")],
                      "cvssMetricV30": [v3("Primary", 5.0)],
                      "cvssMetricV2": [{"cvssData": {"baseScore": 7.5}, "baseSeverity": "HIGH"}]},
             weaknesses=[{"description": [{"lang": "en", "value": "CWE-79"}, {"lang": "fr", "value": "CWE-1"}]},
                         {"description": [{"lang": "en", "value": "NVD-CWE-noinfo"}]}],
             references=[{"url": "https://a"}, {"url": ""}, {}],
             configurations=[{"nodes": [{"cpeMatch": [{"criteria": "cpe:a"}, {"criteria": "cpe:b"}]},
                                        {"cpeMatch": [{"criteria": "cpe:c"}]}]}]),
        _rec(id="CVE-2024-0002", descriptions=[{"lang": "fr", "value": "x"}],
             metrics={"cvssMetricV31": [], "cvssMetricV30": [v3("Secondary", 4.0), v3("Secondary", 6.0)]}),
        _rec(id="", descriptions=[]),
        _rec(descriptions=[]),
    ]
    df = spark.createDataFrame([(r,) for r in recs], "json string")
    out = {r.cve_id: r for r in NV.flatten(NV.parse_records(df, "json")).collect()}
    assert set(out) == {"CVE-2024-0001", "CVE-2024-0002"}
    a = out["CVE-2024-0001"]
    assert a.description == "first" and a.base_score == 9.8 and a.cvss_vector_string == "CVSS:3.1/AV:N"
    assert a.cvss_v2_score == 7.5 and a.cwe_ids == ["CWE-79"] and a.reference_urls == ["https://a"]
    assert a.cpe_list == ["cpe:a", "cpe:b", "cpe:c"] and a.vendor_count == 3 and a.reference_count == 1
    b = out["CVE-2024-0002"]
    assert b.description == "" and b.base_score == 4.0 and b.cwe_ids == [] and b.vendor_count == 0


def test_page_scan_and_window(spark, tmpdir_fresh):
    page = {"totalResults": 2, "vulnerabilities": [
        {"cve": {"id": "CVE-1", "lastModified": "2024-01-05T10:00:00.000"}},
        {"cve": {"id": "CVE-2", "lastModified": "2024-03-05T10:00:00.000"}}]}
    with open(os.path.join(tmpdir_fresh, "page-0.json"), "w") as f:
        f.write(json.dumps(page) + "\n")
    flat = NV.flatten(NV.read_pages(spark, tmpdir_fresh))
    w = NV.modified_between(flat, "2024-01-01 00:00:00", "2024-01-31 23:59:59")
    assert [r.cve_id for r in w.collect()] == ["CVE-1"]
    assert str(NV.high_water_mark(flat).first()[0]).startswith("2024-03-05 10:00:00")


def test_catalog_defaults_and_digest(spark, tmpdir_fresh):
    doc = {"catalogVersion": "1", "vulnerabilities": [
        {"cveID": "CVE-1", "vendorProject": "v", "product": "p", "dateAdded": "2024-01-01"},
        {"cveID": "CVE-2", "knownRansomwareCampaignUse": "Known"}]}
    path = os.path.join(tmpdir_fresh, "kev.json")
    with open(path, "w") as f:
        json.dump(doc, f, indent=2)
    n = KV.normalise(KV.read_catalog(spark, path))
    r = {x.cve_id: x for x in n.collect()}
    assert r["CVE-1"].known_ransomware_campaign_use == "Unknown" and r["CVE-1"].notes == ""
    assert r["CVE-2"].vendor_project == "" and r["CVE-2"].known_ransomware_campaign_use == "Known"
    d1 = KV.digest(n).first()
    d2 = KV.digest(n.orderBy(F.col("cve_id").desc())).first()
    assert d1 == d2


def test_bulk_csv_gz(spark, tmpdir_fresh):
    path = os.path.join(tmpdir_fresh, "epss.csv.gz")
    with gzip.open(path, "wt") as f:
        f.write("#model_version:v2023.03.01,score_date:2024-01-01\ncve,epss,percentile\n"
                " CVE-1 , 0.5 ,0.9\nCVE-2,n/a,0.1\nCVE-3,0.2\n\nCVE-4,0.01,0.02\n")
    got = sorted(tuple(r)[:3] for r in EP.read_bulk_csv(spark, path, "2024-01-01", min_partitions=2).collect())
    assert got == [("CVE-1", 0.5, 0.9), ("CVE-4", 0.01, 0.02)]


def test_api_items_and_scans(spark):
    items = spark.createDataFrame([(None, "0.3", None, None), ("CVE-1", "x", "0.5", "2024-01-01")],
                                  "cve string, epss string, percentile string, date string")
    r = EP.normalise_api_items(items, "2024-02-02").collect()
    assert tuple(r[0]) == ("", "2024-02-02", 0.3, 0.0) and tuple(r[1]) == ("CVE-1", "2024-01-01", 0.0, 0.5)
    h = spark.createDataFrame([("a", 0.1), ("b", 0.5), ("c", 0.11)], "cve_id string, score double")
    assert [x.cve_id for x in EP.high_risk(h, 0.1).collect()] == ["b", "c"]
