"""SQL fragments for oracle queries (DuckDB dialect), generated from the same
fixed values the DataFrame operators use."""

from __future__ import annotations

from .. import constants as K


def dbl(v: float) -> str:
    return f"CAST({float(v)!r} AS DOUBLE)"


def case_map(expr: str, mapping: dict, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {expr} = {_lit(k)} THEN {_lit(v)}" for k, v in mapping.items())
    return f"CASE {whens} ELSE {default} END"


def _lit(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, float):
        return dbl(v)
    return str(v)


def cvss_fields(v: str) -> dict[str, str]:
    """Parsed CVSS columns for vector expression ``v``."""
    parts = f"string_split(trim({v}), '/')"
    ok = f"({v} IS NOT NULL AND trim({v}) <> '' AND len({parts}) >= 9)"
    head = f"{parts}[1]"
    out = {"version": f"CASE WHEN {ok} AND position(':' IN {head}) > 0 "
                      f"THEN split_part({head}, ':', 2) END"}
    for key, field in K.CVSS_FIELDS.items():
        hits = (f"list_filter(list_slice({parts}, 2, len({parts})), "
                f"lambda x: position(':' IN x) > 0 AND split_part(x, ':', 1) = '{key}')")
        last = f"list_extract({hits}, -1)"
        code = f"substr({last}, position(':' IN {last}) + 1)"
        out[field] = f"CASE WHEN {ok} THEN {case_map(code, K.CVSS_CODE_MAPS[key])} END"
    return out


def score_to_severity(score: str) -> str:
    whens = " ".join(f"WHEN {score} >= {cut} THEN '{lab}'" for cut, lab in K.SCORE_SEVERITY_CUTS)
    return f"CASE WHEN {score} IS NULL THEN NULL {whens} ELSE 'LOW' END"


def severity_from_label_or_score(label: str, score: str) -> str:
    lab = f"upper(trim(coalesce({label}, '')))"
    labs = ", ".join(f"'{x}'" for x in K.LABELS_ORDER)
    return (f"CASE WHEN {lab} = '' THEN {score_to_severity(score)} "
            f"WHEN {lab} IN ({labs}) THEN {lab} END")


def severity_component(label: str) -> str:
    return f"coalesce({case_map(f'upper({label})', K.SEVERITY_NORM)}, {dbl(K.SEVERITY_NORM_UNKNOWN)})"


def clip01(x: str) -> str:
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, CAST({x} AS DOUBLE)))"


def round_dp(x: str, digits: int) -> str:
    p = f"{10 ** digits}.0"
    return f"(round(({x}) * {p}, 0) / {p})"


def tier(score: str, tiers=None) -> str:
    tiers = tiers or K.RISK_TIER_PRESETS["code"]
    whens = " ".join(f"WHEN {score} >= {cut} THEN '{name}'" for cut, name in tiers)
    return f"CASE {whens} ELSE '{tiers[-1][1]}' END"


def risk_select(components: dict[str, str], weights=None, tiers=None) -> dict[str, str]:
    """contribution_<k>, risk_score_raw, risk_score, risk_tier given component SQL expressions."""
    w = weights or K.RISK_WEIGHTS
    contrib = {k: f"({dbl(w[k])} * {components[k]})" for k in w}
    raw = "(" + " + ".join(contrib[k] for k in w) + f") * {dbl(100.0)}"
    out = {f"contribution_{k}": f"{c} * {dbl(100.0)}" for k, c in contrib.items()}
    out["risk_score_raw"] = raw
    out["risk_score"] = round_dp(raw, 2)
    out["risk_tier"] = tier(round_dp(raw, 2), tiers)
    return out


def select_list(cols: dict[str, str]) -> str:
    return ",\n ".join(f"{e} AS {n}" for n, e in cols.items())
