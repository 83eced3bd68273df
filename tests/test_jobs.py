import datetime
import json

import pytest

from lexvane.functions import schemas as S
from lexvane.operators import cache as C
from lexvane.operators import retrieval as R
from lexvane.operators import security as SEC
from lexvane.plans import jobs
from lexvane.plans.engine import Engine, requests_of
from lexvane.sources import download, readers, sinks
from tests.test_engine import ROWS

STATUTE = b'<toestand bwb-id="B1"><wettekst><artikel label="Artikel 1"><al>a</al></artikel></wettekst></toestand>'
RULING = b"<open-rechtspraak><uitspraak/></open-rechtspraak>"


def test_downloads(spark, tmp_path):
    files = {"B1": (STATUTE, "text/xml"), "ECLI": (RULING, "application/xml"), "B2": (b"<html/>", "text/html"), "B3": (STATUTE, "text/plain")}
    get = lambda url: next(v for k, v in files.items() if k in url)
    law = lambda i, **kw: {"bwb_id": i, "version_date": "2024-01-01", "name": f"law {i}"} | kw
    config = {"laws": [law("B1"), law("B2"), law("B3"), law("B1", version_date=None), law(None)], "cases": [{"ecli": "ECLI:NL:HR:2001:1"}]}
    rows = download.download_all(config, f"{tmp_path}/raw", get)
    assert [r["status"] for r in rows] == ["ok", "error", "error", "error", "error", "ok"]
    assert rows[0]["saved_path"].endswith("/laws/law_B1.xml") and open(rows[0]["saved_path"], "rb").read() == STATUTE and rows[5]["url"].endswith("id=ECLI%3ANL%3AHR%3A2001%3A1")
    locked = download.download_all({"laws": [law("B1")]}, f"{tmp_path}/raw", get, {("law", "B1", "2024-01-01"): "0"})
    assert locked[0]["status"] == "mismatch" and download.download_all({"laws": [law("B1")]}, f"{tmp_path}/raw", get, {})[0]["note"] == "not in the lock"
    (tmp_path / "c.json").write_text(json.dumps({"laws": [law("B1")], "cases": config["cases"]}))
    assert jobs.fetch_corpus(spark, f"{tmp_path}/c.json", f"{tmp_path}/o", write_lock=True, get=get) == 0
    assert jobs.fetch_corpus(spark, f"{tmp_path}/c.json", f"{tmp_path}/p", lock=f"{tmp_path}/o/lock", get=get) == 0
    assert spark.read.json(f"{tmp_path}/o/manifest").count() == 2


def test_contract_clearance_and_stress(spark):
    assert SEC.checked_contract()[0] == "pre_retrieval"
    for bad in ({"stage": "post_retrieval"}, {"surfaces": ()}, {"surfaces": ("logs",)}):
        with pytest.raises(ValueError):
            SEC.checked_contract(**bad)
    chunks = SEC.with_rank(spark.createDataFrame(ROWS, S.CHUNK))
    asked = requests_of(spark, [{"query_id": "q", "query": "Artikel 10ec lid 1", "role": "helpdesk", "method": "lexical"}])
    assert Engine(chunks).retrieve(asked).count() > 0
    assert Engine(chunks, clearance={"inspector": "public"}).retrieve(asked).count() == 0
    rows = spark.createDataFrame([("a", "d", None), ("b", "d", "{}"), ("c", "d", '{"k": {"x": 1}} ')], "chunk_id string, doc_id string, metadata string")
    got = {r.chunk_id: json.loads(r.metadata) for r in readers.stress(rows, 2).collect()}
    marks = {"synthetic_stress": True, "stress_replica": 2, "stress_multiplier": 2}
    assert got["a::stress:2"] == got["b::stress:2"] == marks and got["c::stress:2"] == {"k": {"x": 1}} | marks


def test_hashed_probe(spark):
    """The hashed probe finds what comparing all entries finds, near the threshold and beyond it."""
    import numpy as np
    from pyspark.sql import functions as F

    rng = np.random.default_rng(8)
    base = rng.normal(size=(300, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.normal(size=base.shape)
    side -= (side * base).sum(1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cos = rng.uniform(0.97, 1.0, (300, 1))
    near = cos * base + np.sqrt(1 - cos**2) * side
    later = F.current_timestamp() + F.expr("INTERVAL 1 DAY")
    rows = [(f"n{k % 3}", k, f"q{k}", [float(x) for x in v], "{}") for k, v in enumerate(base)] + [("n0", 900, "none", None, "{}"), ("n0", 901, "zero", [0.0] * 64, "{}"), ("n0", 902, "short", [1.0], "{}")]
    cache = spark.createDataFrame(rows, "namespace string, seq long, query string, embedding array<double>, response string").withColumn("expires_at", later)
    asked = spark.createDataFrame([(str(k), f"n{k % 3}", [float(x) for x in v]) for k, v in enumerate(near)], "query_id string, namespace string, embedding array<double>")
    now = F.current_timestamp()
    want = {(r.query_id, r.seq) for r in C.probe(asked, cache, now, exact=True).collect()}
    got = {(r.query_id, r.seq) for r in C.probe(asked, cache, now).collect()}
    assert want == {(str(k), k) for k in range(300) if cos[k, 0] >= 0.985} and got <= want and len(got) >= 0.999 * len(want)
    plan = C.probe(asked, cache, now)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_concurrent_puts(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    cache, kind = C.TableCache(spark, f"{tmp_path}/cache"), "namespace string, query string, embedding array<double>, outcome string, grade string, security_ranks array<int>, response string"
    put = lambda k: cache.put(spark.createDataFrame([("n", f"q{k} {i}", [1.0, 0.0], "answered", "relevant", [0], f"r{k}.{i}") for i in range(5)], kind))
    put(0)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(put, range(1, 5)))
    rows = cache.entries().orderBy("seq").collect()
    assert len(rows) == 25 and [r.response for r in rows[:5]] == [f"r0.{i}" for i in range(5)]
    for k in range(5):  # those of one put keep their order
        assert [r.response for r in rows if r.response.startswith(f"r{k}.")] == [f"r{k}.{i}" for i in range(5)]
    asked = spark.createDataFrame([("a", "n", [1.0, 0.0])], "query_id string, namespace string, embedding array<double>")
    assert cache.get(asked).first().response == cache.get(asked, exact=True).first().response == "r0.0"


def test_shared_cache(spark, tmp_path):
    cache = C.TableCache(spark, f"{tmp_path}/cache")
    kind = "namespace string, query string, embedding array<double>, outcome string, grade string, security_ranks array<int>, response string"
    asked = spark.createDataFrame([("a", "n", [1.0, 0.0]), ("b", "m", [1.0, 0.0])], "query_id string, namespace string, embedding array<double>")
    assert cache.get(asked).count() == 0
    cache.put(spark.createDataFrame([("n", "how long", [1.0, 0.0], "answered", "relevant", [0], "r1"), ("n", "article 3", [1.0, 0.0], "answered", "relevant", [0], "r2")], kind))
    cache.put(spark.createDataFrame([("n", "how long", [1.0, 0.0], "answered", "relevant", [0], "r3"), ("m", "so", [1.0, 0.0], "answered", "ambiguous", [0], "r4")], kind))
    again = C.TableCache(spark, f"{tmp_path}/cache")
    assert [(r.query_id, r.response) for r in again.get(asked).collect()] == [("a", "r1")] and again.entries().count() == 2
    again.purge()
    assert again.entries().count() == 2
    again.purge(datetime.date.today() + datetime.timedelta(days=3))
    assert again.entries().count() == 0
    cache.put(spark.createDataFrame([("n", "q", [1.0, 0.0], "answered", "relevant", [0], "r5")], kind))
    cache.clear("n")
    assert cache.entries().count() == 0


def test_reports(spark, tmp_path):
    chunks = SEC.with_rank(spark.createDataFrame(ROWS, S.CHUNK))
    sinks.write_json_lines(spark.createDataFrame([("c1", "exact_lookup", "Artikel 10ec lid 1", "helpdesk", "answered")], "case_id string, category string, query string, role string, expected_outcome string"), f"{tmp_path}/g")
    gold = readers.read_gold(spark, f"{tmp_path}/g")
    cases, report = jobs.run_latency(spark, chunks, gold, out=f"{tmp_path}/r")
    one = cases.first()
    assert one.outcome == "answered" and one.total_ms >= one.retrieval_total_ms >= one.request_scoping_ms > 0 and report["avg_total_ms"] == one.total_ms
    _, _, passed = jobs.run_eval(spark, chunks, gold, f"{tmp_path}/r", label="x")
    checks = spark.read.json(f"{tmp_path}/r/decision-x").collect()
    assert len(checks) == 7 and all(c.passed for c in checks) == passed
    worse = spark.createDataFrame([(2.0,) * 7], ", ".join(f"{m} double" for m, _, _ in jobs.EV.THRESHOLDS))
    assert not jobs.run_eval(spark, chunks, gold, baseline=worse)[2]
    with pytest.raises(ValueError):
        R.reranker("other")
    assert callable(R.reranker("cross_encoder"))
