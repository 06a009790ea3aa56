from riskframe.llm import pii


def test_redaction_runs_one_python_worker_a_task_and_cuts_the_spans_found(spark):
    docs = spark.createDataFrame([(1, "mail a.b@example.com or +31 20 123 4567, host 10.0.0.1."), (2, "nothing here"), (3, None), (4, "")], "doc_id long, text string")
    cut = pii.redact(docs)
    assert cut._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    got = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert cut.columns == docs.columns and got[2] == "nothing here" and got[3] is None and got[4] == ""
    assert got[1].startswith("mail <email> or <phone>, host <ip>") and "@" not in got[1]
    for r in pii.find_personal_data(docs).collect():
        assert (got[r["doc_id"]] != r["text"]) == bool(r["spans"])
