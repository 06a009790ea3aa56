"""Plan shape of headline queries: filters reach the parquet scan, scans read only the columns
the query uses, one-row attachments are broadcast."""

import re

import __spark_entry__ as E

from sample_tables import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _read_schemas(plan: str, table: str) -> list[set[str]]:
    out = []
    for m in re.finditer(r"FileScan parquet \[([^\]]*)\].*?Location: InMemoryFileIndex[^\n]*?" + table, plan):
        out.append({c.split("#")[0] for c in m.group(1).split(",")})
    return out


def test_document_search_pushes_language_filter_and_prunes(spark):
    p = _plan(E.queries()["document_search"](spark, SF_SMALL))
    assert "EqualTo(lang,en)" in p
    docs = _read_schemas(p, "documents.parquet")
    assert docs and all("n_chars" not in cols and cols <= {"doc_id", "text", "source", "lang"} for cols in docs)


def test_risk_top_k_reads_only_needed_columns(spark):
    p = _plan(E.queries()["risk_top_k"](spark, SF_SMALL))
    li = _read_schemas(p, "lineitem.parquet")
    assert li and all(cols <= {"l_orderkey", "l_partkey", "l_shipdate"} for cols in li)
    orders = _read_schemas(p, "orders.parquet")
    assert orders and all(cols <= {"o_orderkey", "o_custkey", "o_orderdate"} for cols in orders)
    assert "TakeOrderedAndProject" in p          # top-k, not a global sort


def test_tfidf_scan_prunes_and_reads_all_documents(spark):
    p = _plan(E.queries()["tfidf_vocabulary"](spark, SF_SMALL))
    docs = _read_schemas(p, "documents.parquet")
    assert docs and all(cols <= {"doc_id", "text"} for cols in docs)
