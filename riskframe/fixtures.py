"""Derived vulnerability-shaped views over the driver tables.

Each view exists twice with the same meaning: a DataFrame builder (what the
engine runs) and a SQL text used inside oracle ``WITH`` clauses. The SQL texts
are also valid Spark SQL; tests check both forms agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import by_rows, read_table, spread


def _padded(number):
    """At least five digits, padded and never cut: ids stay distinct at any table size."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(5)), F.lit("0"))


def _cve_id(year_col, key_col):
    return F.concat(F.lit("CVE-"), F.year(year_col).cast("string"), F.lit("-"),
                    _padded(key_col + F.lit(10000)))


def _pick(chars: str, idx_expr: str):
    """One character of ``chars`` chosen by a small non-negative integer expression."""
    return F.expr(f"substring('{chars}', CAST({idx_expr} AS INT) + 1, 1)")


def cves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One synthetic CVE record per order (15k rows at sf0.01)."""
    o = spread(read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_orderkey")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    m = (k * 37) % 101
    sev = (F.when(k % 11 == 0, F.lit(None).cast("string"))
           .when(m >= 90, "CRITICAL").when(m >= 70, "HIGH").when(m >= 40, "MEDIUM")
           .otherwise("LOW"))
    vector = F.concat(
        F.lit("CVSS:3.1/AV:"), _pick("NALP", "o_orderkey % 4"),
        F.lit("/AC:"), _pick("LH", "o_custkey % 2"),
        F.lit("/PR:"), _pick("NLH", "o_orderkey % 3"),
        F.lit("/UI:"), _pick("NR", "o_orderkey % 2"),
        F.lit("/S:"), _pick("UC", "o_custkey % 2"),
        F.lit("/C:"), _pick("NLH", "o_custkey % 3"),
        F.lit("/I:"), _pick("NLH", "o_orderkey % 3"),
        F.when(k % 13 == 0, F.lit("")).otherwise(
            F.concat(F.lit("/A:"), _pick("NLH", "o_custkey % 3"))),
    )
    return o.select(
        _cve_id(F.col("o_orderdate"), k).alias("cve_id"),
        k.alias("o_orderkey"),
        F.col("o_orderdate").cast("date").alias("published_date"),
        (m.cast("double") / F.lit(10.0)).alias("base_score"),
        sev.alias("base_severity"),
        vector.alias("cvss_vector"),
    )


def epss_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily exploit-probability snapshots: several (cve_id, snapshot_date) per id."""
    # the large side is spread by the join key; orders is left to the planner's size-checked broadcast
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    rows = li.count()                               # from the file footers
    dealt = by_rows(li, rows, "l_orderkey")
    large = dealt is not li
    li, o = (dealt, by_rows(o, rows, "o_orderkey")) if large else (spread(li, "l_orderkey"), o)
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    day, score = F.col("l_shipdate").cast("date"), (F.col("l_partkey") % 1000) / F.lit(1000.0)
    cve_id = _cve_id(F.col("o_orderdate"), F.col("l_orderkey"))
    if not large:
        return j.groupBy(cve_id.alias("cve_id"), day.alias("snapshot_date")).agg(F.max(score).alias("score"))
    # rows of an order lie in one partition: one row a day is left of it before ids are made and dealt out by
    # id. Only the year of the date is part of an id. What groups by id afterwards needs no other exchange. (Orders
    # without a date have no id: their days meet in one task, which keeps one row a day.)
    days = j.groupBy("l_orderkey", F.trunc("o_orderdate", "year").alias("o_orderdate"), day.alias("snapshot_date")).agg(F.max(score).alias("score"))
    ids = by_rows(days.select(cve_id.alias("cve_id"), "snapshot_date", "score"), rows, "cve_id")
    return ids.groupBy("cve_id", "snapshot_date").agg(F.max("score").alias("score"))


def kev_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known-exploited catalog: (cve_id, added_date), lag -20..179 days from publication."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return (o.filter(F.col("o_orderkey") % 17 == 0)
            .select(_cve_id(F.col("o_orderdate"), F.col("o_orderkey")).alias("cve_id"),
                    F.date_add(F.col("o_orderdate").cast("date"),
                               (F.col("o_custkey") % 200 - 20).cast("int")).alias("added_date")))


def predictions_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction log: one row per event, two model versions, JSON payload."""
    e = read_table(spark, sf_dir, "events")
    v = F.col("value")
    return e.select(
        "event_id",
        F.col("ts").alias("predicted_at"),
        F.concat(F.lit("v"), (F.col("user_id") % 2).cast("string")).alias("model_version"),
        F.when(v >= 100, "CRITICAL").when(v >= 50, "HIGH").when(v >= 20, "MEDIUM")
         .otherwise("LOW").alias("prediction"),
        (F.lit(0.5) + (F.col("event_id") % 51) / F.lit(100.0)).alias("confidence"),
        v.alias("latency_ms"),
        F.col("props").alias("features_snapshot"),
    )


# ---- SQL forms (DuckDB and Spark SQL) -------------------------------------

_CVE_ID_SQL = ("concat('CVE-', CAST(year(o_orderdate) AS VARCHAR(4)), '-', "
               "lpad(CAST(o_orderkey + 10000 AS VARCHAR(20)), "
               "CAST(greatest(5, length(CAST(o_orderkey + 10000 AS VARCHAR(20)))) AS INTEGER), '0'))")

CVES_SQL = f"""SELECT {_CVE_ID_SQL} AS cve_id,
 o_orderkey, CAST(o_orderdate AS DATE) AS published_date,
 CAST((o_orderkey * 37) % 101 AS DOUBLE) / 10.0 AS base_score,
 CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN (o_orderkey*37)%101 >= 90 THEN 'CRITICAL' WHEN (o_orderkey*37)%101 >= 70 THEN 'HIGH' WHEN (o_orderkey*37)%101 >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS base_severity,
 concat('CVSS:3.1/AV:', substring('NALP', CAST(o_orderkey % 4 AS INT) + 1, 1), '/AC:', substring('LH', CAST(o_custkey % 2 AS INT) + 1, 1), '/PR:', substring('NLH', CAST(o_orderkey % 3 AS INT) + 1, 1), '/UI:', substring('NR', CAST(o_orderkey % 2 AS INT) + 1, 1), '/S:', substring('UC', CAST(o_custkey % 2 AS INT) + 1, 1), '/C:', substring('NLH', CAST(o_custkey % 3 AS INT) + 1, 1), '/I:', substring('NLH', CAST(o_orderkey % 3 AS INT) + 1, 1), CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE concat('/A:', substring('NLH', CAST(o_custkey % 3 AS INT) + 1, 1)) END) AS cvss_vector
FROM orders"""

EPSS_HISTORY_SQL = f"""SELECT {_CVE_ID_SQL} AS cve_id,
 CAST(l_shipdate AS DATE) AS snapshot_date, max((l_partkey % 1000) / 1000.0E0) AS score
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2"""

KEV_HISTORY_SQL = f"""SELECT {_CVE_ID_SQL} AS cve_id,
 CAST(o_orderdate AS DATE) + CAST(o_custkey % 200 - 20 AS INT) AS added_date
FROM orders WHERE o_orderkey % 17 = 0"""

PREDICTIONS_LOG_SQL = """SELECT event_id, ts AS predicted_at, concat('v', CAST(user_id % 2 AS VARCHAR(1))) AS model_version,
 CASE WHEN value >= 100 THEN 'CRITICAL' WHEN value >= 50 THEN 'HIGH' WHEN value >= 20 THEN 'MEDIUM' ELSE 'LOW' END AS prediction,
 0.5 + (event_id % 51) / 100.0E0 AS confidence, value AS latency_ms, props AS features_snapshot
FROM events"""

VIEW_SQL = {
    "cves": CVES_SQL,
    "epss_history": EPSS_HISTORY_SQL,
    "kev_history": KEV_HISTORY_SQL,
    "predictions_log": PREDICTIONS_LOG_SQL,
}


def with_views(*names: str) -> str:
    """``WITH`` prefix defining the named derived views for an oracle query."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEW_SQL[n]})" for n in names) + "\n"


# ---- landed-feed forms derived from the same tables ------------------------
# Rules (all deterministic in o_orderkey / o_custkey / line items):
#   id '' when o_orderkey % 97 = 0 (dropped by the flattener)
#   descriptions: es always; en "Flaw in <part names>" unless o_orderkey % 7 = 0
#   v3.1 list unless o_orderkey % 5 = 0 (then v3.0); entry order by o_orderkey % 3:
#     0 -> [Secondary(alt), Primary(main)], 1 -> [Secondary(main)], 2 -> [Primary(main), Secondary(alt)]
#   v2 entry unless o_orderkey % 4 = 0; one weakness per line item plus a noinfo entry;
#   one reference per line item (plus an empty url when o_orderkey is even); one CPE per line item.

def _line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order, its line items in (line number, part, supplier) order, each carrying the
    weakness / reference / CPE structs (extra sort-key fields are ignored by the parser). Only the
    plain fields are shuffled and sorted; the structs follow from them and are built per order."""
    # spread by the grouping key: the collect below reuses this partitioning (no second exchange)
    li = spread(read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
                "l_orderkey")
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    j = li.join(p, li.l_partkey == p.p_partkey)
    plain = F.struct("l_linenumber", "l_partkey", "l_suppkey", "p_name", "p_brand")
    lv = lambda lang, v: F.struct(F.lit(lang).alias("lang"), v.alias("value"))

    def full(i):
        ln, pk = i["l_linenumber"], i["l_partkey"]
        host = F.when(ln % 3 == 0, "advisories").when(ln % 3 == 1, "exploit-db").otherwise("vendor")
        return F.struct(
            *[i[c].alias(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "p_name", "p_brand")],
            F.struct(F.lit("nvd@example").alias("source"), F.lit("Primary").alias("type"),
                     F.array(lv("en", F.concat(F.lit("CWE-"), (pk % 1000).cast("string"))),
                             lv("es", F.lit("CWE-1"))).alias("description")).alias("weak"),
            F.struct(F.concat(F.lit("https://"), host, F.lit(".example/"), pk.cast("string")).alias("url"),
                     F.lit("nvd@example").alias("source")).alias("ref"),
            F.struct(F.lit(True).alias("vulnerable"),
                     F.concat(F.lit("cpe:2.3:a:"), F.lower(i["p_brand"]), F.lit(":"), F.replace(i["p_name"], F.lit(" "), F.lit("_")),
                              F.lit(":*:*")).alias("criteria")).alias("cpe"))

    return j.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(plain)).alias("items")) \
            .select("l_orderkey", F.transform("items", full).alias("items"))


def _empty_like(elem):
    """Empty array typed like ``elem`` (an array literal filtered to nothing)."""
    return F.slice(F.array(elem), 1, 0)


def nvd_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON record per CVE (``{"cve": {...}}``) in the shape of the public CVE API."""
    from .functions.cvss import with_cvss
    c = with_cvss(cves(spark, sf_dir))
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    items = _line_items(spark, sf_dir)
    d = c.join(o, "o_orderkey").join(items, c.o_orderkey == items.l_orderkey, "left")
    d = d.withColumn("items", F.coalesce("items", F.array().cast(items.schema["items"].dataType)))
    k, cust = F.col("o_orderkey"), F.col("o_custkey")
    fmt = "yyyy-MM-dd'T'HH:mm:ss.SSS"
    parsed = {f: F.col(f) for f in ("attack_vector", "attack_complexity", "privileges_required", "user_interaction",
                                     "scope", "confidentiality_impact", "integrity_impact", "availability_impact")}

    def data(version, main: bool):
        return F.struct(
            F.lit(version).alias("version"),
            (F.col("cvss_vector") if main else F.lit(None).cast("string")).alias("vectorString"),
            parsed["attack_vector"].alias("attackVector"), parsed["attack_complexity"].alias("attackComplexity"),
            parsed["privileges_required"].alias("privilegesRequired"),
            parsed["user_interaction"].alias("userInteraction"), parsed["scope"].alias("scope"),
            parsed["confidentiality_impact"].alias("confidentialityImpact"),
            parsed["integrity_impact"].alias("integrityImpact"),
            parsed["availability_impact"].alias("availabilityImpact"),
            (F.col("base_score") if main else F.lit(0.0)).alias("baseScore"),
            (F.col("base_severity") if main else F.lit("NONE")).alias("baseSeverity"))

    def entry(version, typ, main: bool):
        return F.struct(F.lit("nvd@example").alias("source"), F.lit(typ).alias("type"),
                        data(version, main).alias("cvssData"),
                        ((cust % 40) / F.lit(10.0) if main else F.lit(0.0)).alias("exploitabilityScore"),
                        ((cust % 60) / F.lit(10.0) if main else F.lit(0.0)).alias("impactScore"))

    sec_alt, prim = entry("3.1", "Secondary", False), entry("3.1", "Primary", True)
    sec_main, prim_alt = entry("3.1", "Secondary", True), entry("3.1", "Secondary", False)
    v31 = (F.when(k % 5 == 0, _empty_like(sec_alt))
           .when(k % 3 == 0, F.array(sec_alt, prim))
           .when(k % 3 == 1, F.array(sec_main))
           .otherwise(F.array(prim, prim_alt)))
    v30 = F.when(k % 5 == 0, F.array(entry("3.0", "Primary", True))).otherwise(
        _empty_like(entry("3.0", "Primary", True)))
    v2e = F.struct(F.lit("nvd@example").alias("source"), F.lit("Primary").alias("type"),
                   F.struct(F.greatest(F.col("base_score") - F.lit(0.5), F.lit(0.0)).alias("baseScore"),
                            F.lit(None).cast("string").alias("vectorString")).alias("cvssData"),
                   F.col("base_severity").alias("baseSeverity"))
    v2 = F.when(k % 4 != 0, F.array(v2e)).otherwise(_empty_like(v2e))
    items = F.col("items")
    names = items["p_name"]
    es = F.struct(F.lit("es").alias("lang"), F.concat(F.lit("Vulnerabilidad "), F.col("cve_id")).alias("value"))
    en = F.struct(F.lit("en").alias("lang"), F.concat(F.lit("Flaw in "), F.array_join(names, ", ")).alias("value"))
    descs = F.concat(F.array(es), F.when(k % 7 != 0, F.array(en)).otherwise(_empty_like(en)))
    lv = lambda lang, v: F.struct(F.lit(lang).alias("lang"), v.alias("value"))
    weak = F.concat(items["weak"], F.array(F.struct(
        F.lit("nvd@example").alias("source"), F.lit("Secondary").alias("type"),
        F.array(lv("en", F.lit("NVD-CWE-noinfo"))).alias("description"))))
    empty_ref = F.struct(F.lit("").alias("url"), F.lit("nvd@example").alias("source"))
    refs = F.concat(items["ref"], F.when(k % 2 == 0, F.array(empty_ref)).otherwise(_empty_like(empty_ref)))
    cpe = items["cpe"]
    conf = F.array(F.struct(F.array(F.struct(F.lit("OR").alias("operator"), cpe.alias("cpeMatch"))).alias("nodes")))
    status = (F.when(F.col("o_orderstatus") == "F", "Analyzed").when(F.col("o_orderstatus") == "O", "Modified")
              .otherwise("Awaiting Analysis"))
    rec = F.struct(
        F.when(k % 97 == 0, F.lit("")).otherwise(F.col("cve_id")).alias("id"),
        F.date_format("o_orderdate", fmt).alias("published"),
        F.date_format(F.date_add(F.col("o_orderdate").cast("date"), (cust % 30).cast("int")).cast("timestamp"),
                      fmt).alias("lastModified"),
        status.alias("vulnStatus"), descs.alias("descriptions"),
        F.struct(v31.alias("cvssMetricV31"), v30.alias("cvssMetricV30"), v2.alias("cvssMetricV2")).alias("metrics"),
        weak.alias("weaknesses"), refs.alias("references"), conf.alias("configurations"))
    return d.select(F.col("o_orderkey"), F.to_json(F.struct(rec.alias("cve"))).alias("json"))


def kev_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog entries as JSON text (one per line); optional fields omitted by rule:
    vendorProject when o_custkey % 3 = 0, shortDescription when o_orderkey is even,
    knownRansomwareCampaignUse unless o_custkey % 4 = 0, notes always."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate") \
        .where(F.col("o_orderkey") % 17 == 0)
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    added = F.date_add(F.col("o_orderdate").cast("date"), (c % 200 - 20).cast("int"))
    cid = _cve_id(F.col("o_orderdate"), k)
    e = F.struct(
        cid.alias("cveID"),
        F.when(c % 3 != 0, F.concat(F.lit("vendor"), (c % 50).cast("string"))).alias("vendorProject"),
        F.concat(F.lit("product"), (k % 100).cast("string")).alias("product"),
        F.concat(F.lit("Flaw "), cid).alias("vulnerabilityName"),
        added.cast("string").alias("dateAdded"),
        F.when(k % 2 != 0, F.lit("Exploited flaw")).alias("shortDescription"),
        F.lit("Apply updates per vendor instructions.").alias("requiredAction"),
        F.date_add(added, 21).cast("string").alias("dueDate"),
        F.when(c % 4 == 0, F.lit("Known")).alias("knownRansomwareCampaignUse"))
    return o.select(F.to_json(e).alias("json"))


def epss_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulk-CSV text lines per snapshot date: a '#' comment, the header, a blank line, one padded
    data line per score, and junk lines (non-numeric, two fields) for every tenth score."""
    h = epss_history(spark, sf_dir)
    s = F.col("score").cast("string")
    data = h.select("snapshot_date", F.concat(F.lit(" "), F.col("cve_id"), F.lit(" ,"), s, F.lit(","), s).alias("line"))
    junk_rows = h.where((F.col("score") * 1000).cast("long") % 10 == 0)
    junk = junk_rows.select("snapshot_date", F.explode(F.array(
        F.concat(F.col("cve_id"), F.lit(",n/a,n/a")), F.concat(F.col("cve_id"), F.lit(",0.5")))).alias("line"))
    dates = h.select("snapshot_date").distinct()
    meta = dates.select("snapshot_date", F.explode(F.array(
        F.concat(F.lit("#model_version:v2023.03.01,score_date:"), F.col("snapshot_date").cast("string")),
        F.lit("cve,epss,percentile"), F.lit(""))).alias("line"))
    return data.unionByName(junk).unionByName(meta)
