"""The plans of ``answer_queries`` against their SQL on the smallest tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lexvane import answer_queries as A
from lexvane import queries as B
from lexvane.operators import retrieval as R
from lexvane.plans.engine import Engine, requests_of

SF = "/root/testdata/sf0.001"


def _plain(rows):
    return sorted([tuple(str(v) for v in r) for r in rows])


@pytest.mark.parametrize("name", ["corrective_lexical", "evaluated_cases", "grade_rules", "text_chunks"])
def test_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = B.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    wanted = con.execute(f"SELECT {', '.join(cols)} FROM ({B.ORACLES[name]})").fetchall()
    assert _plain(got.select(*cols).collect()) == _plain(wanted)


def test_grade_rules_reaches_every_rule():
    con = duckdb.connect()
    con.execute("CREATE VIEW labels AS SELECT * FROM '/root/testdata/sf0.01/labels.parquet'")
    sql = B.ORACLES["grade_rules"]
    rules = con.execute(sql[: sql.rindex("SELECT doc_id, CASE WHEN rule IN")] + "SELECT DISTINCT rule FROM r").fetchall()
    assert {r for (r,) in rules} == set(range(1, 13))


def test_no_second_pass_where_none_is_due(spark):
    chunks = B._chunks(spark, SF)
    asked = requests_of(spark, [{"query_id": "x", "query": "Artikel 12.5 lid 1", "role": "helpdesk", "method": "lexical"}, {"query_id": "y", "query": "ECLI:NL:HR:2003:53 after 2015", "role": "legal_counsel", "method": "lexical"}])
    out = {r["query_id"]: r for r in Engine(chunks).answer(asked).collect()}
    assert "retrying" not in out["x"]["states"] and "retrying" in out["y"]["states"]
    assert out["x"]["outcome"] == out["y"]["outcome"] == "answered"
    assert Engine(chunks).answer(asked.where("false")).count() == 0
    assert {q["query_id"] for q in A.QUESTIONS} >= {g["case_id"] for g in A.GOLD}


def test_searches_keep_no_copy_of_all_chunks(spark, monkeypatch):
    """Only the few rows of a pass are cached, so no task reads a whole partition of texts and vectors; texts are embedded once."""
    stored = lambda: {x.id(): x.memSize() + x.diskSize() for x in spark.sparkContext._jsc.sc().getRDDStorageInfo()}
    before = stored().keys()
    rows = B.QUERIES["corrective_two_pass"](spark, SF).collect()
    kept = [n for k, n in stored().items() if k not in before]
    texts = spark.read.parquet(f"{SF}/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0]
    assert kept and sum(kept) < texts / 4
    shown = B.QUERIES["hybrid_search"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" not in shown and shown.count("ArrowEvalPython [run(array_join") == 1
    chunks = R.indexed(B._chunks(spark, SF)).persist()
    monkeypatch.setattr(B, "_engine", lambda *_: Engine(chunks))
    assert _plain(B.QUERIES["corrective_two_pass"](spark, SF).collect()) == _plain(rows) and len(rows) == 7
    chunks.unpersist()
