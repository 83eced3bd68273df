"""End-to-end jobs: build chunks, index, evaluate, check for promotion, measure latency, answer from the command line or over HTTP."""

from __future__ import annotations

import argparse
import datetime
import hashlib
import json
import sys
import time
import warnings
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexvane.functions.schemas import CHUNK
from lexvane.operators import cache as C
from lexvane.operators import evaluation as EV
from lexvane.operators import evidence as E
from lexvane.operators import retrieval as R
from lexvane.operators.chunking import chunk_texts, read_xml
from lexvane.operators.security import request_counts
from lexvane.plans.engine import Engine, plan, requests_of, with_as_of
from lexvane.sources import download, readers, sinks


TARGET_MS = 1500.0
#: Name of the embedding in cache keys.
EMBEDDING = "hashed-terms-256"


def build_chunks(spark: SparkSession, raw: str, out: str | None = None) -> DataFrame:
    """Chunks of laws, cases, policies and lessons under ``raw``; written by source type where ``out`` is given.

    Broken files give what is sound of them; their paths and errors are written beside ``out``, in ``<out>-rejected``, or, without it,
    told in a warning.
    """
    read = [read_xml(spark, f"{raw}/{d}", k) for d, k in (("laws", "legislation"), ("cases", "case_law")) if _has(spark, f"{raw}/{d}")]
    parts = [x.where("error IS NULL").select(*CHUNK.fieldNames()) for x in read]
    parts += [chunk_texts(readers.read_fixtures(spark, f"{raw}/{d}", d)) for d in ("internal_policy", "e_learning") if _has(spark, f"{raw}/{d}")]
    if not parts:
        raise ValueError(f"nothing to read under {raw}")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    bad = [x.where("error IS NOT NULL").select("source_type", "source_path", "error") for x in read]
    rejected = bad[0].unionByName(bad[1]) if len(bad) == 2 else bad[0] if bad else None
    if out:
        sinks.write_chunks(every, out, "overwrite")
        if rejected is not None:
            sinks.write_json_lines(rejected, f"{out}-rejected", "overwrite")
    elif rejected is not None and (some := rejected.limit(20).collect()):
        warnings.warn("files that could not be read whole: " + "; ".join(f"{r['source_path']}: {r['error']}" for r in some), stacklevel=2)
    return every


def _has(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def run_eval(spark: SparkSession, chunks: DataFrame, gold: DataFrame, out: str | None = None, baseline: DataFrame | None = None, label: str = "candidate") -> tuple[DataFrame, DataFrame, bool]:
    """Cases, the report, and whether all checks pass. With ``out``: report, cases and the decision on ``label`` are written there."""
    indexed = R.indexed(chunks).persist()  # both passes read the embeddings
    engine = Engine(indexed)
    asked = requests_of(spark, [{"query_id": r["case_id"], "query": r["query"], "role": r["role"]} for r in gold.select("case_id", "query", "role").collect()])
    cases = EV.evaluate(gold, engine.answer(asked).withColumnRenamed("query_id", "case_id"), chunks).persist()
    report = EV.metrics(cases).persist()
    decision = EV.promotion(report, baseline).persist()
    checks = decision.collect()  # a row for each metric
    engine.release()
    indexed.unpersist()
    if out:
        stamp = datetime.datetime.now(datetime.UTC).strftime("%Y%m%dT%H%M%SZ")
        sinks.write_report(report, cases, f"{out}/eval-{stamp}")
        sinks.write_json_lines(decision.withColumn("label", F.lit(label)), f"{out}/decision-{label}", "overwrite")
    return cases, report, all(c["passed"] for c in checks)


def run_latency(spark: SparkSession, chunks: DataFrame, gold: DataFrame, times: int = 1, limit: int | None = None, out: str | None = None) -> tuple[DataFrame, dict]:
    """Stage timings of each case, retrieved on its own, and their report against 1500 ms; both written where ``out`` is given."""
    index = R.indexed(readers.stress(chunks, times)).persist()
    index.count()
    rows = []
    for case in gold.limit(limit).collect() if limit else gold.collect():
        asked = requests_of(spark, [{"query_id": case["case_id"], "query": case["query"], "role": case["role"], "method": "hybrid"}])
        marks, start = {}, time.perf_counter()

        def lap(name, marks=marks):
            marks[name] = (time.perf_counter() - start) * 1000 - sum(marks.values())

        plans = asked.select(plan(F.col("query"))["strategy"].alias("s")).first()["s"]
        lap("query_planning_ms")
        asked = with_as_of(asked).persist()
        asked.count()
        lap("request_scoping_ms")
        counts = request_counts(asked, index).persist()
        counts.count()
        lap("security_filter_ms")
        terms = R.lexical(asked, index, R.LEXICAL_LIMIT).persist()
        terms.count()
        lap("lexical_retrieval_ms")
        near = R.dense(asked, index, R.DENSE_LIMIT).persist()
        near.count()
        lap("dense_retrieval_ms")
        fused = R.fuse(asked, terms, near).persist()
        fused.count()
        lap("fusion_ms")
        ranked = R.deterministic(fused).drop("query", "top_k").persist()
        ranked.count()
        lap("reranking_ms")
        retrieval = sum(marks.values()) - marks["query_planning_ms"]
        graded = E.grade(asked, ranked, counts).persist()
        graded.count()
        lap("evidence_grading_ms")
        said = E.answer(graded).first()
        lap("answer_build_ms")
        total = sum(marks.values())
        for df in (asked, counts, terms, near, fused, ranked, graded):
            df.unpersist()
        marks |= {"retrieval_total_ms": retrieval, "total_ms": total}
        rows.append((case["case_id"], case["category"], said["outcome"], said["grade"], plans, said["n"], total <= TARGET_MS, *[round(marks[s], 3) for s in EV.STAGES]))
    index.unpersist()
    cases = spark.createDataFrame(rows, "case_id string, category string, outcome string, grade string, strategy string, result_count int, target_met boolean, " + ", ".join(f"{s} double" for s in EV.STAGES))
    report = EV.latency_report(cases, target=TARGET_MS).crossJoin(EV.stage_averages(cases).withColumnsRenamed({s: f"avg_{s}" for s in EV.STAGES}))  # one row each
    if out:
        stamp = datetime.datetime.now(datetime.UTC).strftime("%Y%m%dT%H%M%SZ")
        sinks.write_report(report, cases, f"{out}/latency-{stamp}")
    return cases, report.first().asDict()


def render(r, trace: bool = False, timings: dict[str, float] | None = None) -> str:
    """One answer as text: outcome, answer or reason, citations, states; with the events and the times of stages where wanted."""
    lines = [f"Outcome: {r['outcome']} ({r['grade']})", r["answer_text"] or f"Refused: {r['refusal_reason']}. {r['explanation']}"]
    lines += [f"  [{k}] {c['label']} - {c['citation_path']} ({c['chunk_id']})" for k, c in enumerate(r["citations"] or [], 1)]
    lines.append("States: " + " > ".join(r["states"]))
    lines += [f"  {t['sequence']}. {t['event']} ({t['state']}): {t['payload']}" for t in r["trace"] or []] if trace else []
    lines += [f"  {name}: {ms:.1f} ms" for name, ms in (timings or {}).items()]
    return "\n".join(lines)


class Service:
    """Answers over one chunk table, ``times`` each chunk for stress, with an optional cache of answers.

    With ``cache_path`` the answers are kept in that folder, for all services that name it; else in this session alone.
    """

    def __init__(self, spark: SparkSession, chunks_path: str, index_path: str | None = None, cache: str = "none", cache_path: str | None = None, times: int = 1, reranker: str = "deterministic") -> None:
        self.spark, self.cache, self.reranker = spark, None, reranker
        self.engine = Engine.from_chunks(readers.stress(readers.read_chunks(spark, chunks_path), times), index_path, rerank=reranker)
        if C.backend(cache):
            self.cache = C.TableCache(spark, cache_path) if cache_path else spark.createDataFrame([], C.CACHE)

    def versions(self) -> tuple[str, str, str]:
        """What names the corpus, the ways of search and the wording in a key: the indexed chunks' digest, the reranker and the embedding."""
        index = self.engine.index
        corpus = hashlib.sha256(index.meta.digest.encode()).hexdigest() if index else "corpus-1"
        return corpus, f"retrieval-2|{self.reranker}|{EMBEDDING}", "answer-2"

    def query(self, query: str, role: str = "helpdesk", method: str | None = None, top_k: int = R.FINAL, jurisdiction: str | None = "NL", as_of_date: str | None = None, source_types: list[str] | None = None) -> dict:
        day = datetime.date.fromisoformat(as_of_date) if as_of_date else None
        asked = requests_of(self.spark, [{"query": query, "role": role, "method": method, "top_k": top_k, "jurisdiction": jurisdiction, "as_of_date": day, "source_types": source_types or []}])
        now = F.current_timestamp()
        if self.cache is not None:
            from lexvane.functions.vectors import embed

            # The date that holds is the one given or the one named in the question; the way of retrieval counts as well.
            dated = with_as_of(asked)
            scope = F.array(F.concat(F.lit("as_of:"), F.coalesce(F.col("as_of_date").cast("string"), F.lit("current"))), F.concat(F.lit("method:"), F.coalesce("method", F.lit("hybrid"))), F.concat(F.lit("types:"), F.array_join(F.sort_array("source_types"), ",")))
            key = C.namespace(F.col("role"), F.col("jurisdiction"), *self.versions(), scope, F.col("top_k"))
            probe = dated.select("query_id", "query", key.alias("namespace"), embed(F.col("query")).alias("embedding")).persist()
            hit = (self.cache.get(probe) if isinstance(self.cache, C.TableCache) else C.probe(probe, self.cache, now)).first()
            if hit:
                probe.unpersist()
                return json.loads(hit["response"]) | {"cached": True}
        row = self.engine.answer(asked).first()
        self.engine.release()
        out = json.loads(json.dumps(row.asDict(recursive=True), default=str))
        if self.cache is not None:
            new = probe.withColumns({"outcome": F.lit(row["outcome"]), "grade": F.lit(row["grade"]), "security_ranks": F.array(*map(F.lit, row["security_ranks"] or [])).cast("array<int>"), "response": F.lit(json.dumps(out))})
            if isinstance(self.cache, C.TableCache):
                self.cache.put(new)
            elif new.where(C.cacheable(*map(F.col, ("outcome", "security_ranks", "grade", "query")))).first():
                # The service's own table of answers: entries live for a day, one for each answer that may be kept.
                self.cache = self.spark.createDataFrame(C.put(self.cache, new, now).collect(), C.CACHE)
            probe.unpersist()
        return out


def serve(service: Service, port: int = 8000) -> ThreadingHTTPServer:
    """GET /health and POST /query (JSON)."""

    class Handler(BaseHTTPRequestHandler):
        def _say(self, code: int, body: dict) -> None:
            raw = json.dumps(body).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self) -> None:
            self._say(200, {"status": "ok"}) if self.path == "/health" else self._say(404, {"error": "not found"})

        def do_POST(self) -> None:
            if self.path != "/query":
                return self._say(404, {"error": "not found"})
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))))
                self._say(200, service.query(**body))
            except (ValueError, TypeError) as e:
                self._say(422, {"error": str(e)})

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)


def fetch_corpus(spark: SparkSession, config: str, out: str, lock: str | None = None, write_lock: bool = False, get=download.fetch) -> int:
    """Fetches what a configuration lists, writes its manifest and, where asked for, its lock. 0 where every file is ok."""
    known = None
    if lock:
        known = {(r["source_type"], r["identifier"], r["version_date"] or ""): r["sha256"] for r in spark.read.schema(sinks.MANIFEST).json(lock).collect()}  # a row for each configured file
    with open(config, encoding="utf-8") as f:
        rows = download.download_all(json.load(f), out, get, known)
    manifest = sinks.write_manifest(rows, spark, f"{out}/manifest")
    good = all(r["status"] == "ok" for r in rows)
    if write_lock and good:
        sinks.write_lock(manifest, f"{out}/lock")
    return 0 if good else 1


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lexvane", description="Ask a question, build chunks, evaluate or measure.")
    sub = p.add_subparsers(dest="what", required=True)
    ask = sub.add_parser("ask")
    ask.add_argument("query")
    ask.add_argument("--chunks", required=True)
    ask.add_argument("--role", default="helpdesk")
    ask.add_argument("--method", choices=["lexical", "dense", "hybrid"])
    ask.add_argument("--top-k", type=int, default=R.FINAL)
    ask.add_argument("--jurisdiction", default="NL")
    ask.add_argument("--as-of")
    ask.add_argument("--index")
    ask.add_argument("--json", action="store_true")
    ask.add_argument("--trace", action="store_true", help="events and times too")
    build = sub.add_parser("chunks")
    build.add_argument("raw")
    build.add_argument("out")
    build = sub.add_parser("index")
    build.add_argument("chunks")
    build.add_argument("out")
    build.add_argument("--recreate", action="store_true")
    got = sub.add_parser("download")
    got.add_argument("config", help="JSON with laws (bwb_id, version_date) and cases (ecli)")
    got.add_argument("out")
    got.add_argument("--lock", help="JSON lines of a lock; files that it does not list are mismatches")
    got.add_argument("--write-lock", action="store_true")
    web = sub.add_parser("serve")
    web.add_argument("--chunks", required=True)
    web.add_argument("--index")
    web.add_argument("--port", type=int, default=8000)
    web.add_argument("--cache", default="none", choices=sorted(C.BACKENDS))
    web.add_argument("--cache-path")
    web.add_argument("--times", type=int, default=1)
    for name in ("eval", "latency"):
        q = sub.add_parser(name)
        q.add_argument("--chunks", required=True)
        q.add_argument("--gold", required=True)
        q.add_argument("--out")
        q.add_argument("--times", type=int, default=1)
        q.add_argument("--limit", type=int)
        if name == "eval":
            q.add_argument("--baseline", help="the summary of an earlier report")
            q.add_argument("--label", default="candidate")
            q.add_argument("--gate", action="store_true", help="exit with 1 where a check fails")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("lexvane").getOrCreate()
    if a.what == "ask":
        service, start = Service(spark, a.chunks, a.index), time.perf_counter()
        r = service.query(a.query, a.role, a.method, a.top_k, a.jurisdiction, a.as_of)
        print(json.dumps(r) if a.json else render(r, a.trace, {"answer": (time.perf_counter() - start) * 1000} if a.trace else None))
        return 0
    if a.what == "chunks":
        build_chunks(spark, a.raw, a.out)
        return 0
    if a.what == "index":
        print(sinks.ensure_index(readers.read_chunks(spark, a.chunks), a.out, a.recreate).count())
        return 0
    if a.what == "download":
        return fetch_corpus(spark, a.config, a.out, a.lock, a.write_lock)
    if a.what == "serve":
        serve(Service(spark, a.chunks, a.index, a.cache, a.cache_path, a.times), a.port).serve_forever()
        return 0
    chunks, gold = readers.read_chunks(spark, a.chunks), readers.read_gold(spark, a.gold)
    if a.what == "latency":
        print(json.dumps(run_latency(spark, chunks, gold, a.times, a.limit, a.out)[1]))
        return 0
    gold = gold.limit(a.limit) if a.limit else gold
    baseline = spark.read.json(a.baseline) if a.baseline else None
    _, report, passed = run_eval(spark, readers.stress(chunks, a.times), gold, a.out, baseline, a.label)
    print(report.toJSON().first())
    return 0 if passed or not a.gate else 1


if __name__ == "__main__":
    sys.exit(main())
