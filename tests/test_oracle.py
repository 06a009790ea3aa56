"""Registered queries against their DuckDB oracles on the smallest scale (a representative subset
by default; RISKFRAME_ORACLE_ALL=1 runs every query with an oracle)."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from oracle_check import TABLES, digest  # noqa: E402

SF = "/root/testdata/sf0.001"
SUBSET = ["risk_top_k", "cvss_parse", "eval_summary", "ece_by_version", "psi_events", "ks_events", "chi2_events",
          "asof_score_at_listing", "asset_match", "nvd_flatten", "tfidf_vocabulary", "temporal_split",
          "error_ratio_5m", "held_error_alerts", "raw_expectations", "kev_label_window", "score_trend"]
NAMES = sorted(E.oracle_sql()) if os.environ.get("RISKFRAME_ORACLE_ALL") else SUBSET


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    srows = [tuple(r) for r in df.collect()]
    cur = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert digest(df.columns, srows)[0] == digest(dcols, drows)[0]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "risk_score" in df.columns


def test_every_query_has_a_callable():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q) and len(q) >= 80
