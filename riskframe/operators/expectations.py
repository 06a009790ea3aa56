"""Expectations: every rule counted in one pass, all rules reported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K

TESTED = ("int", "bigint", "smallint", "tinyint", "double", "float", "string", "boolean")
CVE_ID_REGEX, SEVERITY_VALUES, FORBIDDEN_FEATURES = K.CVE_ID_REGEX, K.SEVERITY_VALUES, K.FORBIDDEN_FEATURES


def drop_incomplete(df: DataFrame, subset: list[str]) -> DataFrame:
    """Rows with a null (or NaN) in any ``subset`` column dropped; empty strings are values
    and stay. A per-row filter, pushed to the scan where the columns come from storage."""
    return df.dropna(how="any", subset=list(subset))


def valid_cve_id(c) -> Column:
    """Id format check; null -> invalid."""
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(col.rlike(CVE_ID_REGEX), F.lit(False))


def raw_rules(id_col="cve_id", published="published_date", severity="base_severity",
              score="base_score") -> dict[str, Column]:
    """Name -> violation predicate."""
    return {
        "cve_id_format": ~valid_cve_id(id_col),
        "published_date_not_null": F.col(published).isNull(),
        "severity_label_valid": F.col(severity).isNotNull() & ~F.col(severity).isin(*SEVERITY_VALUES),
        "base_score_range": F.col(score).isNotNull() & ((F.col(score) < 0.0) | (F.col(score) > 10.0)),
    }


def feature_rules() -> dict[str, Column]:
    """B8 on engineered features."""
    return {
        "severity_numeric_range": F.col("severity_numeric").isNotNull() &
        ~F.col("severity_numeric").isin(-1, 0, 1, 2, 3, 4),
        "epss_score_range": F.col("epss_score").isNull() | (F.col("epss_score") < 0) | (F.col("epss_score") > 1),
        "epss_percentile_range": F.col("epss_percentile").isNull() | (F.col("epss_percentile") < 0) |
        (F.col("epss_percentile") > 1),
        "days_since_published_nonneg": F.col("days_since_published") < 0,
        "description_length_not_null": F.col("description_length").isNull(),
    }


def future_date_rule(published="published_date", as_of: str = "2100-01-01") -> dict[str, Column]:
    """Date not after the reference instant (an argument, never the wall clock)."""
    return {"published_not_in_future": F.col(published).cast("date") > F.lit(as_of).cast("date")}


def evaluate(df: DataFrame, rules: dict[str, Column], bad_row_threshold: float = 0.05) -> DataFrame:
    """One aggregate: (rule, n_failed, n_rows, passed) plus an ``__any__`` row counting rows that
    break at least one rule; ``passed`` on it applies the bad-row threshold (B9)."""
    any_bad = F.greatest(*[F.coalesce(p, F.lit(False)).cast("int") for p in rules.values()]) > 0
    row = df.agg(F.count(F.lit(1)).alias("__n"),
                 *[F.count_if(F.coalesce(p, F.lit(False))).alias(n) for n, p in rules.items()],
                 F.count_if(any_bad).alias("__any__"))
    names = list(rules) + ["__any__"]
    st = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("n_failed")) for n in names]))
    r = row.select(F.col("__n").alias("n_rows"), st.alias("s")).select("s.rule", "s.n_failed", "n_rows")
    ratio = F.col("n_failed") / F.greatest(F.col("n_rows"), F.lit(1))
    return r.withColumn("passed", F.when(F.col("rule") == "__any__", ratio <= bad_row_threshold)
                        .otherwise(F.col("n_failed") == 0))


def unique_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """A18 PK/UNIQUE: key tuples appearing more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def leakage_columns(columns: list[str]) -> list[str]:
    """Forbidden names in a feature list (schema-level, no data touched)."""
    return [c for c in columns if c.lower() in FORBIDDEN_FEATURES]


def leakage_free(df: DataFrame) -> DataFrame:
    """Drop label and post-publication columns."""
    return df.drop(*[c for c in K.LEAKAGE_COLUMNS if c in df.columns])


def complete_schema(df: DataFrame, columns: list[str], fill=0) -> DataFrame:
    """Add missing feature columns as ``fill`` and fill nulls in the listed columns."""
    for c in columns:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(fill))
    return df.fillna(fill, subset=columns)


def drift_candidates(ref: DataFrame, cur: DataFrame, exclude_keys=("cve_id", "event_id", "id")) -> tuple:
    """(numeric, categorical) column names shared by both frames; tfidf_* and keys excluded."""
    num_types = ("int", "bigint", "double", "float", "smallint", "tinyint", "decimal")
    rt, ct = dict(ref.dtypes), dict(cur.dtypes)
    shared = [c for c in ref.columns if c in ct and c not in exclude_keys]
    num = [c for c in shared if rt[c].startswith(num_types) and not c.startswith("tfidf_")]
    cat = [c for c in shared if not rt[c].startswith(num_types) and not c.startswith("tfidf_")
           and rt[c] in ("string", "boolean")]
    return num, cat


def column_checks(ref: DataFrame, cur: DataFrame, required: list[str], exclude_keys=("cve_id", "event_id", "id")) -> DataFrame:
    """B11-B14, G5 on data: one row per column of either frame or of ``required``.

    Verdicts: forbidden (leaks the label), kept (by the leakage-free projection), shared, numeric or
    categorical drift candidate. Figures of each frame, from one aggregation over it: rows, nulls,
    values that are neither null, zero nor empty, and the values that completing the required columns
    fills in. Categorical candidates have the number of distinct values on each side and of shared ones.
    """
    numeric, categorical = drift_candidates(ref, cur, exclude_keys)
    every = [*dict.fromkeys([*ref.columns, *cur.columns, *required])]

    def figures(df: DataFrame, side: str) -> DataFrame:
        empty = {c: F.col(c).cast("double") == 0 if dict(df.dtypes)[c] != "string" else F.col(c) == "" for c, t in df.dtypes if t in TESTED or t.startswith("decimal")}
        row = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col(c).isNull()).alias(f"__null_{c}") for c in df.columns],
                     *[F.count_if(F.col(c).isNotNull() & ~empty.get(c, F.lit(False))).alias(f"__full_{c}") for c in df.columns])
        fill = lambda c: (F.col(f"__null_{c}") if c in df.columns else F.col("__n")) if c in required else F.lit(0).cast("long")
        one = [F.struct(F.lit(c).alias("column"), F.col("__n").alias(f"{side}_rows"),
                        (F.col(f"__null_{c}") if c in df.columns else F.lit(None).cast("long")).alias(f"{side}_nulls"),
                        (F.col(f"__full_{c}") if c in df.columns else F.lit(None).cast("long")).alias(f"{side}_full"),
                        fill(c).alias(f"{side}_filled")) for c in every]
        return row.select(F.inline(F.array(*one)))

    verdicts = [F.struct(F.lit(c).alias("column"), F.lit(c.lower() in FORBIDDEN_FEATURES).alias("forbidden"), F.lit(c not in K.LEAKAGE_COLUMNS).alias("kept"),
                         F.lit(c in ref.columns and c in cur.columns).alias("shared"), F.lit(c in numeric).alias("numeric_candidate"),
                         F.lit(c in categorical).alias("categorical_candidate")) for c in every]
    rules = ref.sparkSession.range(1).select(F.inline(F.array(*verdicts)))
    out = rules.join(figures(ref, "ref"), "column").join(figures(cur, "cur"), "column")

    def values(df: DataFrame, side: str) -> DataFrame:
        pair = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in categorical]
        return df.select(F.inline(F.array(*pair)), F.lit(side == "ref").alias("r")).where("v is not null")

    if categorical:
        sides = values(ref, "ref").unionByName(values(cur, "cur")).groupBy("column", "v").agg(F.bool_or("r").alias("r"), F.bool_or(~F.col("r")).alias("q"))
        found = sides.groupBy("column").agg(F.count_if("r").alias("ref_values"), F.count_if("q").alias("cur_values"), F.count_if(F.col("r") & F.col("q")).alias("shared_values"))
        return out.join(found, "column", "left")
    return out.selectExpr("*", *[f"cast(null as bigint) as {c}" for c in ("ref_values", "cur_values", "shared_values")])
