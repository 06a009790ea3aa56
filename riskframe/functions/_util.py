"""Small Column helpers shared by the expression library."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.isspace() set = Unicode White_Space plus the four ASCII
# information separators; Java's (?U)\s lacks the latter.
WS_CLASS = r"[\s\x{1c}-\x{1f}]"


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Trim leading/trailing Unicode whitespace (Python ``str.strip()``)."""
    return F.regexp_replace(as_col(c), rf"(?U)^{WS_CLASS}+|{WS_CLASS}+$", "")


def case_map(c, mapping: dict) -> Column:
    """Literal lookup as a CASE ladder; keys not present -> null."""
    c = as_col(c)
    expr = None
    for k, v in mapping.items():
        expr = F.when(c == F.lit(k), F.lit(v)) if expr is None else expr.when(c == F.lit(k), F.lit(v))
    return expr


def clip01(c) -> Column:
    """Clip to [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), as_col(c).cast("double")))


def round_half_away(c, digits: int) -> Column:
    """Round to ``digits`` decimals as round(x*10^d)/10^d, half away from zero.

    Same double result in Spark and DuckDB (both round the scaled binary value),
    and equal to Python's ``round`` except on exact decimal ties.
    """
    p = float(10 ** digits)
    return F.round(as_col(c) * F.lit(p), 0) / F.lit(p)


def round_sql(expr: str, digits: int) -> str:
    """SQL twin of :func:`round_half_away`."""
    p = f"{10 ** digits}.0"
    return f"(round(({expr}) * {p}, 0) / {p})"
