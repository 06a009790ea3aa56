"""Nested CVE feed: declared schema, scan, incremental window, flatten (A1-A4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CVSS_DATA = T.StructType([
    T.StructField("version", T.StringType()),
    T.StructField("vectorString", T.StringType()),
    T.StructField("attackVector", T.StringType()),
    T.StructField("attackComplexity", T.StringType()),
    T.StructField("privilegesRequired", T.StringType()),
    T.StructField("userInteraction", T.StringType()),
    T.StructField("scope", T.StringType()),
    T.StructField("confidentialityImpact", T.StringType()),
    T.StructField("integrityImpact", T.StringType()),
    T.StructField("availabilityImpact", T.StringType()),
    T.StructField("baseScore", T.DoubleType()),
    T.StructField("baseSeverity", T.StringType()),
])
_V3_ENTRY = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("cvssData", _CVSS_DATA),
    T.StructField("exploitabilityScore", T.DoubleType()),
    T.StructField("impactScore", T.DoubleType()),
])
_V2_ENTRY = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("cvssData", T.StructType([T.StructField("baseScore", T.DoubleType()),
                                            T.StructField("vectorString", T.StringType())])),
    T.StructField("baseSeverity", T.StringType()),
])
_LANG_VALUE = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()),
                                        T.StructField("value", T.StringType())]))

CVE_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("published", T.StringType()),
    T.StructField("lastModified", T.StringType()),
    T.StructField("vulnStatus", T.StringType()),
    T.StructField("descriptions", _LANG_VALUE),
    T.StructField("metrics", T.StructType([
        T.StructField("cvssMetricV31", T.ArrayType(_V3_ENTRY)),
        T.StructField("cvssMetricV30", T.ArrayType(_V3_ENTRY)),
        T.StructField("cvssMetricV2", T.ArrayType(_V2_ENTRY)),
    ])),
    T.StructField("weaknesses", T.ArrayType(T.StructType([
        T.StructField("source", T.StringType()), T.StructField("type", T.StringType()),
        T.StructField("description", _LANG_VALUE)]))),
    T.StructField("references", T.ArrayType(T.StructType([T.StructField("url", T.StringType()),
                                                          T.StructField("source", T.StringType())]))),
    T.StructField("configurations", T.ArrayType(T.StructType([
        T.StructField("nodes", T.ArrayType(T.StructType([
            T.StructField("operator", T.StringType()),
            T.StructField("cpeMatch", T.ArrayType(T.StructType([
                T.StructField("vulnerable", T.BooleanType()),
                T.StructField("criteria", T.StringType())]))),
        ]))),
    ]))),
])
# One record of the feed: {"cve": {...}}
RECORD_SCHEMA = T.StructType([T.StructField("cve", CVE_SCHEMA)])
# A page of the feed: {"totalResults": n, "vulnerabilities": [{"cve": ...}, ...]}
PAGE_SCHEMA = T.StructType([T.StructField("totalResults", T.LongType()),
                            T.StructField("vulnerabilities", T.ArrayType(RECORD_SCHEMA))])

FLAT_COLUMNS = ["cve_id", "published_date", "last_modified_date", "vuln_status", "description", "cvss_version",
                "cvss_vector_string", "attack_vector", "attack_complexity", "privileges_required",
                "user_interaction", "scope", "confidentiality_impact", "integrity_impact", "availability_impact",
                "base_score", "base_severity", "exploitability_score", "impact_score", "cvss_v2_score",
                "cvss_v2_severity", "cwe_ids", "reference_urls", "cpe_list", "vendor_count", "reference_count"]

# Feed fields that a flat column is made of, besides the id that every record needs; a CVSS v3 column
# also needs the type, by which the entry is picked.
_V3_TYPES = ("metrics.cvssMetricV31.type", "metrics.cvssMetricV30.type")
_READS = {"cve_id": ("id",), "published_date": ("published",), "last_modified_date": ("lastModified",), "vuln_status": ("vulnStatus",),
          "description": ("descriptions.lang", "descriptions.value"),
          "cvss_v2_score": ("metrics.cvssMetricV2.cvssData.baseScore",), "cvss_v2_severity": ("metrics.cvssMetricV2.baseSeverity",),
          "cwe_ids": ("weaknesses.description.lang", "weaknesses.description.value"), "reference_urls": ("references.url",),
          "reference_count": ("references.url",), "cpe_list": ("configurations.nodes.cpeMatch.criteria",),
          "vendor_count": ("configurations.nodes.cpeMatch.criteria",)}
_V3 = {"cvss_version": "version", "cvss_vector_string": "vectorString", "attack_vector": "attackVector",
       "attack_complexity": "attackComplexity", "privileges_required": "privilegesRequired", "user_interaction": "userInteraction",
       "scope": "scope", "confidentiality_impact": "confidentialityImpact", "integrity_impact": "integrityImpact",
       "availability_impact": "availabilityImpact", "base_score": "baseScore", "base_severity": "baseSeverity"}
_V3_OWN = {"exploitability_score": "exploitabilityScore", "impact_score": "impactScore"}
for _column, _field in (_V3 | _V3_OWN).items():
    _READS[_column] = _V3_TYPES + tuple(f"metrics.{v}.{'cvssData.' * (_column in _V3)}{_field}" for v in ("cvssMetricV31", "cvssMetricV30"))


def _only(kind: T.DataType, paths: set[tuple[str, ...]]) -> T.DataType:
    """``kind`` without the fields that no path leads to."""
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_only(kind.elementType, paths), kind.containsNull)
    if not isinstance(kind, T.StructType):
        return kind
    return T.StructType([T.StructField(f.name, _only(f.dataType, {p[1:] for p in paths if p[0] == f.name}), f.nullable)
                         for f in kind.fields if any(p[0] == f.name for p in paths)])


def record_schema(columns=None) -> T.StructType:
    """The declared record schema, narrowed to the fields that ``flatten`` reads for ``columns`` (all of
    its columns when none are given): from_json skips the others instead of building them."""
    paths = {("cve", *p.split(".")) for c in ["cve_id", *(columns or FLAT_COLUMNS)] for p in _READS[c]}
    return _only(RECORD_SCHEMA, paths)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """A1 landing scan: page files (one JSON page per line) -> one row per record, schema declared."""
    pages = spark.read.schema(PAGE_SCHEMA).json(path)
    return pages.select(F.explode("vulnerabilities").alias("r")).select("r.cve")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Record-per-line landing files (``{"cve": ...}``)."""
    return spark.read.schema(RECORD_SCHEMA).json(path).select("cve")


def parse_records(df: DataFrame, col: str, schema: T.StructType = RECORD_SCHEMA) -> DataFrame:
    """JSON text column -> ``cve`` struct with the declared schema (never inferred)."""
    return df.select(F.from_json(F.col(col), schema)["cve"].alias("cve"))


def _first_where(arr: Column, field: str, value: str) -> Column:
    """First element whose ``field`` equals ``value`` else the first element (null when empty);
    native ``array_position`` on the field array, no lambda."""
    pos = F.coalesce(F.array_position(arr[field], value), F.lit(0))
    return F.when(pos > 0, F.element_at(arr, pos.cast("int"))).otherwise(F.try_element_at(arr, F.lit(1)))


def flatten(df: DataFrame, cve: str = "cve", columns=None) -> DataFrame:
    """A4: 26 flat columns, or those of them named in ``columns``; records with a null/empty id are dropped.

    description: first 'en' entry else ''; CVSS v3: v3.1 list when non-empty
    else v3.0, inside it the first 'Primary' entry else the first; v2: first
    entry; CWE ids: 'en' descriptions starting 'CWE-' across all weaknesses;
    reference urls: non-empty; CPE list: criteria of nodes one level deep;
    vendor_count = number of CPE strings. Field arrays of struct arrays
    (``arr.field``), ``array_position``, ``flatten`` and ``array_compact`` are
    native; only the CWE filter needs a lambda.
    """
    c, columns = F.col(cve), list(columns or FLAT_COLUMNS)
    none = F.array().cast("array<string>")

    def description():
        descs = c["descriptions"]
        en = F.coalesce(F.array_position(descs["lang"], "en"), F.lit(0))
        return F.coalesce(F.when(en > 0, F.element_at(descs["value"], en.cast("int"))), F.lit(""))

    def v3():
        v31, v30 = c["metrics"]["cvssMetricV31"], c["metrics"]["cvssMetricV30"]
        return _first_where(F.when(F.coalesce(F.size(v31), F.lit(0)) > 0, v31).otherwise(v30), "type", "Primary")

    def cwe_ids():
        wdesc = F.flatten(F.array_compact(c["weaknesses"]["description"]))
        cwes = F.filter(wdesc, lambda d: (d["lang"] == "en") & F.coalesce(d["value"], F.lit("")).startswith("CWE-"))
        return F.coalesce(cwes["value"], none)

    def cpes():
        nodes = F.flatten(F.array_compact(c["configurations"]["nodes"]))
        matches = F.flatten(F.array_compact(nodes["cpeMatch"]))
        return F.coalesce(F.array_remove(F.array_compact(matches["criteria"]), ""), none)

    # picked part -> (how it is picked, the columns made of it); a part without a wanted column is left out
    parts = {"published_date": (lambda: c["published"], ["published_date"]),
             "last_modified_date": (lambda: c["lastModified"], ["last_modified_date"]),
             "vuln_status": (lambda: c["vulnStatus"], ["vuln_status"]), "description": (description, ["description"]),
             "__v3": (v3, [*_V3, *_V3_OWN]),
             "__v2": (lambda: F.try_element_at(c["metrics"]["cvssMetricV2"], F.lit(1)), ["cvss_v2_score", "cvss_v2_severity"]),
             "cwe_ids": (cwe_ids, ["cwe_ids"]),
             "reference_urls": (lambda: F.coalesce(F.array_remove(F.array_compact(c["references"]["url"]), ""), none),
                                ["reference_urls", "reference_count"]),
             "cpe_list": (cpes, ["cpe_list", "vendor_count"])}
    # The id filter lives inside a generator (inline of a 0/1-element array): a plain filter would be
    # pushed below the projection and re-evaluate the JSON parse and every pick for the predicate.
    row = F.struct(c["id"].alias("cve_id"), *[pick().alias(part) for part, (pick, made) in parts.items() if set(made) & set(columns)])
    keep = F.when(c["id"].isNotNull() & (c["id"] != ""), F.array(row))     # null -> no output row
    st = df.select(F.inline(keep))
    out = {name: lambda name=name: F.col(name) for name in columns} | {
        name: lambda f=f: F.col("__v3.cvssData")[f] for name, f in _V3.items()} | {
        name: lambda f=f: F.col("__v3")[f] for name, f in _V3_OWN.items()} | {
        "cvss_v2_score": lambda: F.col("__v2.cvssData.baseScore"), "cvss_v2_severity": lambda: F.col("__v2.baseSeverity"),
        "vendor_count": lambda: F.size("cpe_list"), "reference_count": lambda: F.size("reference_urls")}
    return st.select(*[out[name]().alias(name) for name in columns])


def modified_between(df: DataFrame, start: str, end: str, col: str = "last_modified_date") -> DataFrame:
    """A1 window: records with lastModified in [start, end] (lenient ISO parse)."""
    from ..functions.dates import lenient_timestamp
    t = lenient_timestamp(F.col(col))
    return df.where((t >= F.lit(start).cast("timestamp")) & (t <= F.lit(end).cast("timestamp")))


def high_water_mark(sink: DataFrame, col: str = "last_modified_date") -> DataFrame:
    """Largest modification instant already stored (one row) -- the next incremental start."""
    from ..functions.dates import lenient_timestamp
    return sink.agg(F.max(lenient_timestamp(F.col(col))).alias("high_water_mark"))


def by_ids(df: DataFrame, ids: DataFrame, key: str = "cve_id") -> DataFrame:
    """Rows whose id is in ``ids`` (left semi join; no duplication)."""
    return df.join(ids.select(key), key, "left_semi")


def with_year(df: DataFrame, col: str = "published_date") -> DataFrame:
    """A2: publication year column used to partition the backfill (half-open year ranges)."""
    return df.withColumn("year", F.substring(F.col(col), 1, 4).cast("int"))
