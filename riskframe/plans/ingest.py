"""Ingestion plans: nested feed flatten, incremental window, year partitions, id lookup,
catalog scan, score CSV and API items (A1-A5, A9-A13, H6-H10 on the flattened feed)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from .. import fixtures as X
from ..functions import text as T
from ..sources import epss as EP
from ..sources import io as IO
from ..sources import kev as KV
from ..sources import nvd as NV
from ..streaming.pipeline import checkpoint_for
from . import sqlfrag as S


def flat_feed(spark: SparkSession, sf_dir: str, columns=None):
    """Every record of the feed, flattened; with ``columns`` only their fields are parsed."""
    return NV.flatten(NV.parse_records(X.nvd_feed(spark, sf_dir), "json", NV.record_schema(columns)), columns=columns)


def nvd_flatten(spark, sf_dir):
    """A4: nested records -> 26 flat columns."""
    return flat_feed(spark, sf_dir).select(*NV.FLAT_COLUMNS)


def _flat_sql() -> str:
    f = S.cvss_fields("cvss_vector")
    parsed = ", ".join(f"{f[k]} AS {k}" for k in K.CVSS_FIELDS.values())
    return X.with_views("cves") + f""",
items AS (SELECT l_orderkey, list({{'ln': l_linenumber, 'pk': l_partkey, 'nm': p_name, 'br': p_brand}}
  ORDER BY l_linenumber, l_partkey, l_suppkey) AS items FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey),
base AS (SELECT c.*, o.o_custkey, o.o_orderstatus, o.o_orderdate, coalesce(i.items, []) AS items
  FROM cves c JOIN orders o USING (o_orderkey) LEFT JOIN items i ON i.l_orderkey = c.o_orderkey),
flat AS (SELECT cve_id, o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%g') AS published_date,
  strftime(CAST(o_orderdate AS DATE) + CAST(o_custkey % 30 AS INTEGER), '%Y-%m-%dT%H:%M:%S.%g') AS last_modified_date,
  CASE o_orderstatus WHEN 'F' THEN 'Analyzed' WHEN 'O' THEN 'Modified' ELSE 'Awaiting Analysis' END AS vuln_status,
  CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'Flaw in ' || array_to_string(list_transform(items, lambda i: i.nm), ', ') END AS description,
  CASE WHEN o_orderkey % 5 = 0 THEN '3.0' ELSE '3.1' END AS cvss_version,
  cvss_vector AS cvss_vector_string, {parsed}, base_score, base_severity,
  CAST(o_custkey % 40 AS DOUBLE) / 10.0::DOUBLE AS exploitability_score,
  CAST(o_custkey % 60 AS DOUBLE) / 10.0::DOUBLE AS impact_score,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE greatest(base_score - 0.5::DOUBLE, 0.0::DOUBLE) END AS cvss_v2_score,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE base_severity END AS cvss_v2_severity,
  list_transform(items, lambda i: 'CWE-' || CAST(i.pk % 1000 AS VARCHAR)) AS cwe_ids,
  list_transform(items, lambda i: 'https://' || CASE i.ln % 3 WHEN 0 THEN 'advisories' WHEN 1 THEN 'exploit-db' ELSE 'vendor' END
    || '.example/' || CAST(i.pk AS VARCHAR)) AS reference_urls,
  list_transform(items, lambda i: 'cpe:2.3:a:' || lower(i.br) || ':' || replace(i.nm, ' ', '_') || ':*:*') AS cpe_list,
  CAST(len(items) AS INTEGER) AS vendor_count, CAST(len(items) AS INTEGER) AS reference_count
  FROM base WHERE o_orderkey % 97 <> 0)
"""


def usable_labeled(spark, sf_dir):
    """B3 + D1: flattened records with both a description and a severity (null-row drop on the
    subset; '' counts as present), and their class distribution."""
    from ..operators import expectations as E
    u = E.drop_incomplete(flat_feed(spark, sf_dir, ["description", "base_severity"]), ["description", "base_severity"])
    return u.groupBy("base_severity").agg(F.count(F.lit(1)).alias("n"))


def nvd_incremental(spark, sf_dir):
    """A1: records modified inside the window [start, end]."""
    f = NV.modified_between(flat_feed(spark, sf_dir, ["cve_id", "last_modified_date"]), "1998-01-01 00:00:00", "1998-03-31 23:59:59")
    return f.select("cve_id", "last_modified_date")


def nvd_by_year(spark, sf_dir):
    """A2: backfill partitions (publication year) with their record counts."""
    return NV.with_year(flat_feed(spark, sf_dir, ["published_date"])).groupBy("year").agg(F.count(F.lit(1)).alias("n"))


def nvd_id_lookup(spark, sf_dir):
    """A3: records for an id list (the catalog ids), left semi join."""
    return NV.by_ids(flat_feed(spark, sf_dir, ["cve_id", "base_score"]), X.kev_history(spark, sf_dir)).select("cve_id", "base_score")


def feed_features(spark, sf_dir):
    """H6-H10 on the flattened feed: CWE list/groups/first number, vendor flags, reference flags."""
    f = flat_feed(spark, sf_dir, ["cve_id", "description", "cwe_ids", "reference_urls", "cpe_list", "vendor_count", "reference_count"])
    cw = T.cwe_list("cwe_ids", is_array=True)
    groups = T.cwe_group_flags(cw)
    vt = T.vendor_text(F.lit(""), F.lit(""), F.col("cpe_list"), F.col("description"))
    vend = T.vendor_flags(vt, F.col("vendor_count"), ["apache", "oracle", "brand#1"])
    refs = T.reference_features("reference_urls", F.col("reference_count"))
    return f.select("cve_id", *[c.alias(n) for n, c in groups.items()],
                    T.first_cwe_number(cw).alias("cwe_category_id"),
                    *[c.alias(n) for n, c in vend.items()], *[c.alias(n) for n, c in refs.items()])


def _feed_features_sql() -> str:
    groups = ", ".join(
        f"CAST(len(list_intersect(cwe_ids, [{', '.join(repr(x) for x in ids)}])) > 0 AS INTEGER) AS {n}"
        for n, ids in K.CWE_GROUPS.items())
    vt = "lower(concat_ws(' ', '', '', array_to_string(cpe_list, ' '), description))"
    vnames = ["apache", "oracle", "brand#1"]
    vflags = ", ".join(f"CAST(position('{v}' IN {vt}) > 0 AS INTEGER) AS \"vendor_{v}\"" for v in vnames)
    anyv = "greatest(" + ", ".join(f"CAST(position('{v}' IN {vt}) > 0 AS INTEGER)" for v in vnames) + ")"
    joined = "lower(array_to_string(reference_urls, ' '))"
    patch = "greatest(" + ", ".join(f"CAST(position('{w}' IN {joined}) > 0 AS INTEGER)" for w in K.PATCH_WORDS) + ")"
    expl = "greatest(" + ", ".join(f"CAST(position('{w}' IN {joined}) > 0 AS INTEGER)" for w in K.EXPLOIT_WORDS) + ")"
    return _flat_sql() + f"""SELECT cve_id, {groups},
  coalesce(CAST(nullif(regexp_extract(cwe_ids[1], '(\\d+)', 1), '') AS INTEGER), 0) AS cwe_category_id,
  {vflags}, 1 - {anyv} AS vendor_other, CASE WHEN vendor_count <> 0 THEN vendor_count ELSE {anyv} END AS vendor_count,
  CASE WHEN reference_count <> 0 THEN reference_count ELSE CAST(len(reference_urls) AS INTEGER) END AS reference_count,
  {patch} AS has_patch_reference, {expl} AS has_exploit_reference FROM flat"""


def kev_catalog(spark, sf_dir):
    """A5: parsed, renamed catalog with defaults."""
    return KV.normalise(KV.parse_entries(X.kev_feed(spark, sf_dir), "json"))


KEV_CATALOG_SQL = X.with_views("cves") + """,
o AS (SELECT o.*, c.cve_id, CAST(o.o_orderdate AS DATE) + CAST(o.o_custkey % 200 - 20 AS INTEGER) AS added
  FROM orders o JOIN cves c USING (o_orderkey) WHERE o.o_orderkey % 17 = 0)
SELECT cve_id, CASE WHEN o_custkey % 3 <> 0 THEN 'vendor' || CAST(o_custkey % 50 AS VARCHAR) ELSE '' END AS vendor_project,
  'product' || CAST(o_orderkey % 100 AS VARCHAR) AS product, 'Flaw ' || cve_id AS vulnerability_name,
  CAST(added AS VARCHAR) AS date_added, CASE WHEN o_orderkey % 2 <> 0 THEN 'Exploited flaw' ELSE '' END AS short_description,
  'Apply updates per vendor instructions.' AS required_action, CAST(added + 21 AS VARCHAR) AS due_date,
  CASE WHEN o_custkey % 4 = 0 THEN 'Known' ELSE 'Unknown' END AS known_ransomware_campaign_use, '' AS notes FROM o"""


def exploited_ids(spark, sf_dir):
    """Distinct ids of two deliveries of the catalog, the second one of entries added since 1995."""
    first = kev_catalog(spark, sf_dir)
    return KV.id_set(first.unionByName(first.where("date_added >= '1995-01-01'")))


EXPLOITED_IDS_SQL = X.with_views("kev_history") + "SELECT DISTINCT cve_id FROM kev_history"


def kev_digest(spark, sf_dir):
    """Content digest of the normalised catalog (compare with the stored one to skip work)."""
    return KV.digest(kev_catalog(spark, sf_dir))


SNAPSHOTS = ("1998-06-30", "1998-06-30", "1998-07-31")


def catalog_fetches(spark, sf_dir):
    """Three fetches of the catalog, the second unchanged: per fetch whether it changed, and the
    rows that the caller gets, new or kept."""
    k, state, out = X.kev_history(spark, sf_dir), checkpoint_for(spark, "catalog", fresh=True), None
    for i, day in enumerate(SNAPSHOTS, 1):
        rows, changed = KV.fetch_if_changed(spark, k.where(F.col("added_date") <= F.lit(day).cast("date")), state, "kev")
        one = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.min("cve_id").alias("first_id"), F.max("added_date").alias("last_added")) \
            .select(F.lit(i).alias("fetch"), F.lit(changed).alias("changed"), "n_rows", "first_id", "last_added")
        out = one if out is None else out.unionByName(one)
    return out


FETCHES_SQL = X.with_views("kev_history") + " UNION ALL ".join(
    f"SELECT {i} AS fetch, {str(i == 1 or day != SNAPSHOTS[i - 2]).lower()} AS changed, count(*) AS n_rows, min(cve_id) AS first_id, max(added_date) AS last_added "
    f"FROM kev_history WHERE added_date <= DATE '{day}'" for i, day in enumerate(SNAPSHOTS, 1))


def epss_bulk_parse(spark, sf_dir):
    """Bulk CSV lines -> (cve_id, score, percentile, snapshot_date); comments, header, blanks,
    short and non-numeric rows skipped."""
    lines = X.epss_lines(spark, sf_dir)
    return EP.parse_lines(lines, "line", F.col("snapshot_date"))


EPSS_BULK_SQL = X.with_views("epss_history") + "SELECT cve_id, score, score AS percentile, snapshot_date FROM epss_history"


def epss_api_items(spark, sf_dir):
    """A10: API items with missing fields normalised (id '', date = today argument, scores 0.0)."""
    h = X.epss_history(spark, sf_dir)
    items = h.select(F.to_json(F.struct(
        F.when(F.col("score") * 1000 % 7 != 0, F.col("cve_id")).alias("cve"),
        F.when(F.col("score") * 1000 % 5 != 0, F.col("score").cast("string")).alias("epss"),
        F.col("score").cast("string").alias("percentile"),
        F.when(F.col("score") * 1000 % 3 != 0, F.col("snapshot_date").cast("string")).alias("date"))).alias("j"))
    parsed = items.select(F.from_json("j", EP.API_ITEM_SCHEMA).alias("i")).select("i.*")
    return EP.normalise_api_items(parsed, "2024-01-31")


EPSS_API_SQL = X.with_views("epss_history") + """
SELECT CASE WHEN score * 1000 % 7 <> 0 THEN cve_id ELSE '' END AS cve_id,
  CASE WHEN score * 1000 % 3 <> 0 THEN CAST(snapshot_date AS VARCHAR) ELSE '2024-01-31' END AS score_date,
  CASE WHEN score * 1000 % 5 <> 0 THEN score ELSE 0.0 END AS epss_score, score AS percentile FROM epss_history"""


def epss_high_risk(spark, sf_dir):
    """Scores strictly above 0.1, highest first (whole history)."""
    return EP.high_risk(X.epss_history(spark, sf_dir), 0.1)


EPSS_HIGH_SQL = X.with_views("epss_history") + \
    "SELECT cve_id, snapshot_date, score FROM epss_history WHERE score > 0.1 ORDER BY score DESC, cve_id"


def epss_lookup(spark, sf_dir):
    """Scores of the catalog ids (left semi join)."""
    return EP.lookup(X.epss_history(spark, sf_dir), X.kev_history(spark, sf_dir))


EPSS_LOOKUP_SQL = X.with_views("epss_history", "kev_history") + \
    "SELECT * FROM epss_history WHERE cve_id IN (SELECT cve_id FROM kev_history)"


def sink_round_trip(spark, sf_dir):
    """Records written as parquet by year and as CSV under the catalog's id name, each found
    behind a missing path, read by its extension, and summed up per year by its id column."""
    folder = checkpoint_for(spark, "round_trip", fresh=True)
    rows = X.cves(spark, sf_dir).select("cve_id", "base_score", F.year("published_date").alias("year"))
    IO.write_table(rows, f"{folder}/by_year", partition_by=["year"])
    IO.write_table(rows.withColumnRenamed("cve_id", "cveID"), f"{folder}/plain", fmt="csv")
    out = None
    for fmt, leaf in (("parquet", "by_year"), ("csv", "plain")):
        back = IO.first_existing(spark, [f"{folder}/missing", f"{folder}/{leaf}"], "cveID string, base_score double, year int")
        if back is None:    # an empty table has no rows to sum up
            back = rows
        key = IO.id_column(back)
        one = back.groupBy("year").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("n_ids"), F.min(key).alias("first_id"),
                                       F.sum(F.round(F.col("base_score") * 10).cast("long")).alias("score_tenths")) \
            .select(F.lit(fmt).alias("fmt"), F.lit(key).alias("id_column"), "year", "n_rows", "n_ids", "first_id", "score_tenths")
        out = one if out is None else out.unionByName(one)
    return out


ROUND_TRIP_SQL = X.with_views("cves") + " UNION ALL ".join(
    f"""SELECT '{fmt}' AS fmt, '{key}' AS id_column, CAST(year(published_date) AS INTEGER) AS year, count(*) AS n_rows,
  count(DISTINCT cve_id) AS n_ids, min(cve_id) AS first_id, CAST(sum(CAST(round(base_score * 10) AS BIGINT)) AS BIGINT) AS score_tenths
  FROM cves GROUP BY year(published_date)""" for fmt, key in (("parquet", "cve_id"), ("csv", "cveID")))


QUERIES = {
    "sink_round_trip": (sink_round_trip, ROUND_TRIP_SQL),
    "catalog_fetches": (catalog_fetches, FETCHES_SQL),
    "nvd_flatten": (nvd_flatten, _flat_sql() + "SELECT " + ", ".join(NV.FLAT_COLUMNS) + " FROM flat"),
    "usable_labeled": (usable_labeled, _flat_sql() + "SELECT base_severity, count(*) AS n FROM flat "
                       "WHERE description IS NOT NULL AND base_severity IS NOT NULL GROUP BY base_severity"),
    "nvd_incremental": (nvd_incremental, _flat_sql() + "SELECT cve_id, last_modified_date FROM flat WHERE "
                        "CAST(last_modified_date AS TIMESTAMP) BETWEEN TIMESTAMP '1998-01-01 00:00:00' AND "
                        "TIMESTAMP '1998-03-31 23:59:59'"),
    "nvd_by_year": (nvd_by_year, _flat_sql() + "SELECT CAST(substr(published_date, 1, 4) AS INTEGER) AS year, "
                    "count(*) AS n FROM flat GROUP BY 1"),
    "nvd_id_lookup": (nvd_id_lookup, X.with_views("kev_history").replace("WITH ", ", ", 1).join(
        [_flat_sql().rstrip() + "\n", "SELECT cve_id, base_score FROM flat WHERE cve_id IN (SELECT cve_id FROM kev_history)"])),
    "feed_features": (feed_features, _feed_features_sql()),
    "kev_catalog": (kev_catalog, KEV_CATALOG_SQL),
    "exploited_ids": (exploited_ids, EXPLOITED_IDS_SQL),
    "kev_digest": (kev_digest, None),
    "epss_bulk_parse": (epss_bulk_parse, EPSS_BULK_SQL),
    "epss_api_items": (epss_api_items, EPSS_API_SQL),
    "epss_high_risk": (epss_high_risk, EPSS_HIGH_SQL),
    "epss_lookup": (epss_lookup, EPSS_LOOKUP_SQL),
}
