"""CVSS vector parsing and severity encodings as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from ._util import as_col, case_map, strip_ws


def cvss_fields(vector) -> dict[str, Column]:
    """Parse ``CVSS:3.x/AV:N/...`` into version + 8 named fields.

    Null/blank or fewer than 9 '/'-separated parts -> every field null.
    Keys are case-sensitive, the last duplicate key wins, unknown codes give
    null, extra segments are ignored, the first segment is never a metric.
    Each field is one JVM regex (``/KEY:value`` not followed by another
    ``/KEY:``) -- no per-element lambdas.
    """
    v = strip_ws(as_col(vector))
    ok = v.isNotNull() & (v != "") & (F.size(F.split(v, "/", -1)) >= 9)
    head = F.substring_index(v, "/", 1)
    version = F.when(F.instr(head, ":") > 0, F.split(head, ":", -1).getItem(1))
    out = {"version": F.when(ok, version)}
    for key, field in K.CVSS_FIELDS.items():
        code = F.regexp_extract(v, f"(?s)/{key}:([^/]*)(?!.*/{key}:)", 1)
        names = F.create_map(*[F.lit(x) for pair in K.CVSS_CODE_MAPS[key].items() for x in pair])
        out[field] = F.when(ok, F.try_element_at(names, code))      # one regex a field, not one per code
    return out


def with_cvss(df, vector_col: str = "cvss_vector", onehot: bool = False):
    """df -> df: add parsed CVSS columns (and optionally the 22 one-hot flags)."""
    fields = cvss_fields(vector_col)
    df = df.select("*", *[c.alias(n) for n, c in fields.items()])
    return with_cvss_onehot(df) if onehot else df


def cvss_onehot_cols() -> dict[str, Column]:
    cols = {name: F.coalesce(F.col(field) == F.lit(val), F.lit(False))
            for name, field, val in K.CVSS_ONEHOT}
    cols["has_cvss_v3"] = F.col("attack_vector").isNotNull()
    return cols


def with_cvss_onehot(df):
    return df.select("*", *[c.alias(n) for n, c in cvss_onehot_cols().items()])


def severity_ordinal(label, scale: str = "0-4") -> Column:
    """Severity label -> ordinal; upper-cased; unknown/null -> -1."""
    m = K.SEVERITY_0_4 if scale == "0-4" else K.SEVERITY_0_3
    return F.coalesce(case_map(F.upper(as_col(label)), m), F.lit(-1))


def severity_label(ordinal, scale: str = "0-4") -> Column:
    """Inverse of :func:`severity_ordinal` (unknown -> null)."""
    m = K.SEVERITY_0_4 if scale == "0-4" else K.SEVERITY_0_3
    return case_map(as_col(ordinal), {v: k for k, v in m.items()})


def score_to_severity(score) -> Column:
    """CVSS base score -> label by the 9/7/4 cut-offs (null score -> null)."""
    s = as_col(score)
    expr = None
    for cut, lab in K.SCORE_SEVERITY_CUTS:
        expr = F.when(s >= cut, lab) if expr is None else expr.when(s >= cut, lab)
    return F.when(s.isNotNull(), expr.otherwise("LOW"))


def severity_from_label_or_score(label, score, invalid_label_falls_back: bool = False) -> Column:
    """Target label: cleaned label first, score ladder when the label is empty.

    Result is one of LOW/MEDIUM/HIGH/CRITICAL or null. With
    ``invalid_label_falls_back`` any label outside the four also takes the
    score ladder (display semantics) instead of becoming null (feature semantics).
    """
    lab = F.upper(strip_ws(F.coalesce(as_col(label), F.lit(""))))
    valid = lab.isin(*K.LABELS_ORDER)
    from_score = score_to_severity(score)
    if invalid_label_falls_back:
        return F.when(valid, lab).otherwise(from_score)
    return F.when(lab == "", from_score).when(valid, lab)


def label_encode(label) -> Column:
    """LOW..CRITICAL -> 0..3, anything else -> -1."""
    return severity_ordinal(label, scale="0-3")
