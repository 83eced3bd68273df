import datetime
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lexvane.functions import phrases as P
from lexvane.functions import text as T
from lexvane.functions import vectors as V
from lexvane.functions.vectors import hash_embedding, hash_embeddings
from lexvane.operators import evaluation as EV
from lexvane.operators import retrieval as R
from lexvane.operators.security import valid_at
from lexvane.plans.engine import requests_of
from lexvane.sources.readers import document_chunks

SF = "/root/testdata/sf0.01"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_interval_join_against_every_pair(spark):
    rng, base = random.Random(1), datetime.date(2020, 1, 1)
    day = lambda: rng.choice([None, base + datetime.timedelta(rng.randrange(-40, 400)), datetime.date(1, 1, 1), datetime.date(9999, 12, 31)])
    chunks = [(k, day(), day(), "x") for k in range(300)] + [(900, None, None, "open"), (901, base, base, "one"), (902, base, base - datetime.timedelta(1), "never")]
    days = [(k, day()) for k in range(60)] + [(100, base), (101, None)]
    c = spark.createDataFrame(chunks, "id int, valid_from date, valid_to date, _b string").withColumnRenamed("_b", "b")
    met = valid_at(spark.createDataFrame(days, "n int, day date"), c)
    want = sorted((n, k) for n, d in days if d is not None for k, a, z, _ in chunks if (a is None or a <= d) and (z is None or d <= z))
    assert sorted((r.n, r.id) for r in met.collect()) == want and len(want) > 1000
    assert "NestedLoop" not in plan_of(met) and "Cartesian" not in plan_of(met)
    assert valid_at(spark.createDataFrame(days, "n int, day date").where("false"), c).count() == 0


def test_lexical_search_against_every_pair(spark):
    chunks = document_chunks(spark.read.parquet(f"{SF}/documents.parquet")).where("CAST(doc_id AS int) < 400")
    rows = chunks.collect()
    queries = ["Artikel 12.5 lid 1", "artikel 12.5 lid 2", "ECLI:NL:HR:2001:101", "src1", "s", "1", "c1", "lid 3", "rc1 > Artikel 5", rows[7].citation_path, "", " ?! ", "no such thing at all", "artikel 3.3", "SRC2 artikel", "5 lid"]
    asked = requests_of(spark, [{"query_id": str(k), "query": q or "-", "role": "inspector", "top_k": 400, "jurisdiction": None} for k, q in enumerate(queries)])
    found = R.lexical(asked, chunks)
    assert "NestedLoop" not in plan_of(found) and "Cartesian" not in plan_of(found)
    norm = lambda x: " ".join(re.findall("[a-z0-9]+", (x or "").lower()))
    want = set()
    for k, q in enumerate(queries):
        q = q or "-"
        ecli = re.search(T.ECLI, q, re.I)
        art, lid = re.search(T.ARTICLE, q, re.I), re.search(T.PARAGRAPH, q, re.I)
        for r in rows:
            a, path, n = bool(art and art[1] == r.article), norm(r.citation_path), norm(q)
            if a and lid and lid[1] != r.paragraph:
                continue
            score = (300 if ecli and r.ecli and ecli[0].upper() == r.ecli.upper() else 0) + (120 + (20 if lid else 0) if a else 0) + (95 if n and n == path else 55 if n and n in path else 0)
            if score:
                want.add((str(k), r.chunk_id, float(score)))
    got = [(r.query_id, r.chunk.chunk_id, r.lexical_score) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len({w[0] for w in want}) >= 10


def test_batched_embedding_is_the_plain_one(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    texts += [None, "", "  ", "the of", "Change  employer 30% RULING nl", "ſaK İstanbul a b", "x" * 5000]
    for k in range(0, len(texts), 300):
        part = texts[k : k + 300]
        assert np.abs(hash_embeddings(part) - np.stack([hash_embedding(t or "") for t in part])).max() < 1e-12
    assert hash_embeddings([]).shape == (0, 256) and not hash_embeddings(["the", None]).any()


def test_phrases_in_batches_say_what_the_columns_say(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("text").unionAll(spark.createDataFrame([(None,), ("",), ("Dutch employer  in  aanmerking; NL",)], "text string"))
    rows = d.select(P.annotated(F.col("text")).alias("a"), P.profiled(F.col("text")).alias("p"), T.concepts(F.col("text")).alias("c"), T.lexical_terms(F.col("text")).alias("t")).collect()
    assert len(rows) == 1003
    for r in rows:
        assert r.a.concepts == r.p.concepts == r.c and r.a.n_terms == r.p.n_terms
        assert r.a.terms == r.t and (r.t is None or r.a.n_terms == len(r.t))


def test_repeated_beginnings_against_every_pair(spark):
    texts = ["The  first twenty-four letters of this", "the FIRST twenty-four letters of that", "four letters of another\u00a0item here", "too short for it", None, "x" * 30, "İstanbul and the letters after it"]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id int, text string")
    said = [None, "", "as in the first\ntwenty-FOUR letters and on", "nothing of it", *[f"({t}) and {u}" for t in texts for u in texts], "y" + "x" * 24, "x" * 23]
    answers = spark.createDataFrame(list(enumerate(said)), "doc_id int, text string")
    got = EV.repeated(answers, items)
    assert "NestedLoop" not in plan_of(got) and "Cartesian" not in plan_of(got)
    want = answers.join(items.withColumnRenamed("text", "t"), EV.faithful(F.col("text"), F.array("t"))).select("doc_id", "item_id")
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(map(tuple, want.collect())) and len(rows) > 50 and {i for _, i in rows} == {0, 1, 2, 5, 6}
    assert EV.repeated(answers, items.where("item_id = 3")).count() == 0


def test_tasks_keep_only_their_best_rows(spark):
    """A limit that differs by request still cuts each task's rows before they are shuffled."""
    chunks = R.indexed(document_chunks(spark.read.parquet(f"{SF}/documents.parquet")).where("CAST(doc_id AS int) < 200"))
    asked = requests_of(spark, [{"query_id": str(k), "query": "src1", "role": "inspector", "top_k": k} for k in (3, 7)])
    for found in (R.lexical(asked, chunks), R.dense(asked, chunks)):
        assert "WindowGroupLimit" in plan_of(found)
        ranks = sorted((r.query_id, r["rank"]) for r in found.select("query_id", "rank").collect())
        assert ranks == [("3", k + 1) for k in range(3)] + [("7", k + 1) for k in range(7)]
    assert R.lexical(asked, chunks, 12).groupBy("query_id").count().where("count = 12").count() == 2
    assert R.lexical(asked.where("false"), chunks).count() == R.dense(asked.where("false"), chunks).count() == 0


def test_batches_are_worked_on_in_slices(spark):
    """A worker makes Python's texts of a slice and keeps a bounded number of terms, however large a batch or a vocabulary is."""
    texts = pa.array(["a" * 10, None, "b" * 500, "c", "d", "", "é" * 10])
    parts = list(P.slices(texts, 2, 20))
    assert [x for p in parts for x in p] == texts.to_pylist() and [len(p) for p in parts] == [2, 1, 2, 2]
    assert [p for p in P.slices(texts.slice(2, 3), 9, 600)] == [texts.to_pylist()[2:5]] and list(P.slices(pa.array([], pa.string()))) == []
    assert max(sum(map(len, p)) for p in P.slices(pa.array(["x" * 1000] * 5000))) <= 1 << 20
    words = [" ".join(f"w{k}x{j}" for j in range(2000)) for k in range(130)]
    for k in range(0, len(words), 10):
        hash_embeddings(words[k : k + 10])
        assert len(V._TERMS[256].ids) <= V._Terms.most + 20_000 and V._run_bucket.cache_info().maxsize <= 50_000
    assert sum(len(set(w.split())) for w in words) > V._Terms.most and not isinstance(V._TERMS[256].places, list)
    rows = spark.createDataFrame([(k, w if k % 3 else None) for k, w in enumerate(words[:12])], "k int, w string")
    for r in rows.select("w", V.embed(F.col("w")).alias("e")).collect():
        assert np.abs(np.array(r.e) - hash_embedding(r.w or "")).max() < 1e-12
