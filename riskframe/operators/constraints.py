"""Table constraints as data (A18): NOT NULL, CHECK, UNIQUE, foreign keys and defaults.

A list of rules is compiled to one scan for all NOT NULL and CHECK rules, one partial aggregation a
UNIQUE rule and one anti join a foreign key. As in SQL a CHECK or foreign key holds where it is null,
and a UNIQUE rule ignores keys that hold a null. Every rule returns a row, violated or not.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class NotNull:
    column: str


@dataclass(frozen=True)
class Check:
    name: str
    condition: str  # SQL expression that every row must not make false


@dataclass(frozen=True)
class Unique:
    columns: tuple[str, ...]


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]


@dataclass(frozen=True)
class Default:
    column: str
    expression: str


def with_defaults(df: DataFrame, rules: list) -> DataFrame:
    """``df`` with the defaults of its rules where the column is null or missing."""
    for r in rules:
        if isinstance(r, Default):
            value = F.expr(r.expression)
            df = df.withColumn(r.column, F.coalesce(r.column, value) if r.column in df.columns else value)
    return df


def _row_rules(rules: list) -> dict[tuple[str, str], object]:
    """(kind, rule) -> column that is true on a violating row."""
    out = {("not_null", r.column): F.col(r.column).isNull() for r in rules if isinstance(r, NotNull)}
    return out | {("check", r.name): ~F.coalesce(F.expr(r.condition), F.lit(True)) for r in rules if isinstance(r, Check)}


def _orphans(df: DataFrame, rule: ForeignKey, parents: dict[str, DataFrame]) -> DataFrame:
    known = parents[rule.parent].select(*[F.col(p).alias(c) for c, p in zip(rule.columns, rule.parent_columns, strict=True)])
    whole = df.dropna(subset=list(rule.columns))
    return whole.join(known, list(rule.columns), "left_anti")


def constraint_violations(df: DataFrame, rules: list, parents: dict[str, DataFrame] | None = None) -> DataFrame:
    """(kind, rule, n_violations): violating rows of NOT NULL, CHECK and foreign keys, keys that occur
    more than once of UNIQUE."""
    checks = _row_rules(rules)
    counted = df.agg(*[F.count_if(c).alias(f"r{i}") for i, c in enumerate(checks.values())], F.count(F.lit(1)).alias("rows"))
    out = counted.select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("rule"), F.col(f"r{i}").alias("n_violations"))
                                            for i, (k, n) in enumerate(checks)]))) if checks else None
    more = []
    for r in rules:
        if isinstance(r, Unique):
            twice = df.dropna(subset=list(r.columns)).groupBy(*r.columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            more.append(("unique", ",".join(r.columns), twice))
        elif isinstance(r, ForeignKey):
            more.append(("foreign_key", f"{','.join(r.columns)}->{r.parent}", _orphans(df, r, parents or {})))
    for kind, name, bad in more:
        one = bad.agg(F.count(F.lit(1)).alias("n_violations")).select(F.lit(kind).alias("kind"), F.lit(name).alias("rule"), "n_violations")
        out = one if out is None else out.unionByName(one)
    return out


def conforming(df: DataFrame, rules: list, parents: dict[str, DataFrame] | None = None) -> DataFrame:
    """The rows, defaults filled in, that an insert would accept: they violate no NOT NULL, CHECK or
    foreign key (UNIQUE needs an order between rows: see ``dedup_keep_last``)."""
    rows = with_defaults(df, rules)
    for bad in _row_rules(rules).values():
        rows = rows.where(~bad)
    for r in rules:
        if isinstance(r, ForeignKey):
            known = (parents or {})[r.parent].select(*[F.col(p).alias(f"__{c}") for c, p in zip(r.columns, r.parent_columns, strict=True)]).distinct()
            same = [F.col(c) == F.col(f"__{c}") for c in r.columns]
            missing = F.col(f"__{r.columns[0]}").isNull()
            for c in r.columns:
                missing = missing & F.col(c).isNotNull()
            rows = rows.join(known, same, "left").where(~missing).drop(*[f"__{c}" for c in r.columns])
    return rows
