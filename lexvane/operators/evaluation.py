"""Evaluation of answers against expected ones, promotion checks and latency reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexvane.functions import text as T
from lexvane.functions.phrases import held
from lexvane.functions.vectors import ratio

# Least (or, for failures, most) value of each metric for promotion, and those that may not fall by more than the tolerance.
THRESHOLDS: list[tuple[str, str, float]] = [
    ("answerable_vs_refused_accuracy", "min", 0.55),
    ("citation_presence_rate", "min", 0.95),
    ("unauthorized_retrieval_failures", "max", 0.0),
    ("exact_lookup_success", "min", 0.35),
    ("semantic_retrieval_success", "min", 0.70),
    ("faithfulness_proxy", "min", 0.85),
    ("context_precision_proxy", "min", 0.70),
]
REGRESSIONS = ["answerable_vs_refused_accuracy", "exact_lookup_success", "semantic_retrieval_success", "context_precision_proxy"]
TOLERANCE = 0.05
STAGES = ["request_scoping_ms", "security_filter_ms", "lexical_retrieval_ms", "dense_retrieval_ms", "fusion_ms", "reranking_ms", "retrieval_total_ms", "evidence_grading_ms", "answer_build_ms", "query_planning_ms", "total_ms"]


#: Characters of a text's beginning that show it in an answer.
HEAD = 24
#: Beginnings go to every task; more than this are refused rather than sent.
MOST_HEADS = 200_000


def eval_norm(c: Column) -> Column:
    return T.squeeze(F.lower(c))


def _list(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>"))


def _found(wanted: Column, values: Column) -> Column:
    """How many wanted substrings some value has, by normalised text."""
    return F.size(F.filter(wanted, lambda w: F.exists(values, lambda v: F.contains(eval_norm(v), eval_norm(w)))))


def leaks(citation_paths: Column, chunk_ids: Column, answer: Column, bad_paths: Column, bad_ids: Column) -> Column:
    """Whether anything forbidden was cited, retrieved or said."""
    said = eval_norm(F.coalesce(answer, F.lit("")))
    return F.exists(bad_paths, lambda b: F.exists(citation_paths, lambda c: F.contains(eval_norm(c), eval_norm(b))) | F.contains(said, eval_norm(b))) | F.arrays_overlap(bad_ids, chunk_ids)


def faithful(answer: Column, texts: Column) -> Column:
    """Whether the answer has the first 24 characters of some cited chunk's normalised text. Shorter texts show nothing."""
    said = eval_norm(F.coalesce(answer, F.lit("")))
    return F.coalesce(F.exists(texts, lambda t: (F.length(eval_norm(t)) >= HEAD) & F.contains(said, F.substring(eval_norm(t), 1, HEAD))), F.lit(False))


def repeated(answers: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """Each row of ``answers`` with each row of ``items`` that ``faithful`` finds in its text; both have ``text_col``.

    Every text is normalised once and read once for the heads of all items, however many there are. Items are a small set: their
    heads go to every task. The text columns are left out.
    """
    head = F.substring(eval_norm(F.col(text_col)), 1, HEAD)
    told = items.withColumn("_head", F.when(F.length(head) == HEAD, head)).where(F.col("_head").isNotNull()).drop(text_col)
    heads = [r[0] for r in told.select("_head").distinct().orderBy("_head").collect()]
    if len(heads) > MOST_HEADS:
        raise ValueError(f"more than {MOST_HEADS} different beginnings of items")
    found = answers.withColumn("_k", F.explode(held(eval_norm(F.col(text_col)), heads))).drop(text_col)
    numbered = answers.sparkSession.createDataFrame(list(enumerate(heads)), "_k int, _head string").join(told, "_head").drop("_head")
    return found.join(F.broadcast(numbered), "_k").drop("_k")


def evaluate(gold: DataFrame, responses: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row per case. Responses: case_id, outcome, grade, refusal_reason, answer_text, citations, retrieved_chunk_ids."""
    cites = responses.select("case_id", F.explode("citations").alias("c")).select("case_id", F.col("c.chunk_id").alias("chunk_id"))
    texts = chunks.select("chunk_id", "text").join(F.broadcast(cites), "chunk_id").groupBy("case_id").agg(F.collect_list("text").alias("texts"))  # two citations a case
    r = responses.join(texts, "case_id", "left").withColumn("texts", F.coalesce("texts", F.array().cast("array<string>")))
    df = gold.join(r.select("case_id", "outcome", "grade", "refusal_reason", "answer_text", "citations", "retrieved_chunk_ids", "texts"), "case_id")
    paths = F.transform("citations", lambda c: c["citation_path"])
    ids = F.when(F.size("retrieved_chunk_ids") > 0, F.col("retrieved_chunk_ids")).otherwise(F.transform("citations", lambda c: c["chunk_id"]))
    df = df.withColumn("paths", paths).withColumn("ids", ids)
    wants = [("expected_citation", _list("expected_citation_substrings"), _found(_list("expected_citation_substrings"), F.col("paths")))]
    same = F.transform("paths", eval_norm)
    wants.append(("expected_exact_citation", _list("expected_citation_paths"), F.size(F.filter(_list("expected_citation_paths"), lambda w: F.array_contains(same, eval_norm(w))))))
    wants.append(("expected_chunk", _list("expected_chunk_ids"), F.size(F.filter(_list("expected_chunk_ids"), lambda w: F.array_contains(F.col("ids"), w)))))
    for name, want, found in wants:
        df = df.withColumn(f"{name}_match_count", found).withColumn(f"{name}_total", F.size(want))
    count = sum((F.col(f"{n}_match_count") for n, _, _ in wants), F.lit(0))
    total = sum((F.col(f"{n}_total") for n, _, _ in wants), F.lit(0))
    df = (
        df.withColumn("outcome_match", F.col("outcome") == F.col("expected_outcome"))
        .withColumn("grade_match", F.col("expected_grade").isNull() | (F.col("grade") == F.col("expected_grade")))
        .withColumn("refusal_reason_match", F.col("expected_refusal_reason").isNull() | F.coalesce(F.col("refusal_reason") == F.col("expected_refusal_reason"), F.lit(False)))
        .withColumn("citation_presence", F.size("citations") > 0)
        .withColumn("unauthorized_retrieval_failure", leaks(F.col("paths"), F.col("ids"), F.col("answer_text"), _list("forbidden_citation_substrings"), _list("forbidden_chunk_ids")))
        .withColumn("faithfulness_proxy_pass", faithful(F.col("answer_text"), F.col("texts")))
        .withColumn("context_precision_proxy", F.when(total > 0, ratio(count, total)).otherwise(1.0))
    )
    passed = F.col("outcome_match") & F.col("grade_match") & F.col("refusal_reason_match") & ~F.col("unauthorized_retrieval_failure")
    for n, _, _ in wants:
        passed = passed & (F.col(f"{n}_match_count") == F.col(f"{n}_total"))
    return df.withColumn("passed", passed).drop("texts", "ids")


def metrics(cases: DataFrame) -> DataFrame:
    """One row: the seven metrics, 0 where nothing counts towards one."""
    share = lambda flag, among: F.coalesce(F.avg(F.when(among, flag.cast("double"))), F.lit(0.0))
    every, answered, kind = F.lit(True), F.col("outcome") == "answered", F.col("category")
    return cases.agg(
        share(F.col("passed"), every).alias("answerable_vs_refused_accuracy"),
        share(F.col("citation_presence"), answered).alias("citation_presence_rate"),
        F.count_if((kind == "unauthorized_role") & F.col("unauthorized_retrieval_failure")).cast("double").alias("unauthorized_retrieval_failures"),
        share(F.col("passed"), kind == "exact_lookup").alias("exact_lookup_success"),
        share(F.col("passed"), kind == "semantic_lookup").alias("semantic_retrieval_success"),
        share(F.col("faithfulness_proxy_pass"), answered).alias("faithfulness_proxy"),
        F.coalesce(F.avg("context_precision_proxy"), F.lit(0.0)).alias("context_precision_proxy"),
    )


def long_form(report: DataFrame) -> DataFrame:
    names = [m for m, _, _ in THRESHOLDS]
    return report.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names])).alias("x")).select("x.*")


def promotion(candidate: DataFrame, baseline: DataFrame | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """A row per check (metric, kind, value, bound, passed): the absolute ones, and those against a baseline."""
    spark = candidate.sparkSession
    bounds = spark.createDataFrame(THRESHOLDS, "metric string, kind string, bound double")
    value = long_form(candidate)
    checks = value.join(F.broadcast(bounds), "metric")
    if baseline is not None:
        old = long_form(baseline).where(F.col("metric").isin(REGRESSIONS)).select("metric", F.lit("regression").alias("kind"), (F.col("value") - tolerance).alias("bound"))
        checks = checks.unionByName(value.join(old, "metric"))
    ok = F.when(F.col("kind") == "max", F.col("value") <= F.col("bound")).otherwise(F.col("value") >= F.col("bound") - 1e-12)
    return checks.select("metric", "kind", "value", "bound", ok.alias("passed"))


def percentile(values: Column, q: float) -> Column:
    """Nearest rank of sorted values, at (n - 1) * q rounded half to even; 0 for none."""
    at = F.bround((F.size(values) - 1) * F.lit(q), 0).cast("int")
    return F.when(F.size(values) > 0, F.try_element_at(values, at + 1)).otherwise(0.0)


def latency_report(cases: DataFrame, column: str = "total_ms", target: float = 1500.0) -> DataFrame:
    """Mean, p50, p95, maximum and the share within the target, to three places.

    Percentiles are exact: values are counted first, then ranked, so no group of all values is ever gathered.
    """
    from pyspark.sql import Window

    v = cases.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    blocks = v.withColumn("b", F.floor(F.log2(F.greatest(F.abs("v"), F.lit(1e-9))) * 64 * F.signum("v")))
    # Values fall into ordered blocks; the blocks' counts are few and give each block's offset.
    order = F.when(F.col("v") < 0, -1).when(F.col("v") > 0, 1).otherwise(0)
    blocks = blocks.withColumn("s", order)
    sizes = blocks.groupBy("s", "b").agg(F.sum("n").alias("m"))
    before = sizes.withColumn("before", F.sum("m").over(Window.orderBy("s", "b").rowsBetween(Window.unboundedPreceding, -1))).na.fill(0, ["before"])
    run = F.sum("n").over(Window.partitionBy("s", "b").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = blocks.withColumn("run", run).join(F.broadcast(before.select("s", "b", "before")), ["s", "b"]).withColumn("last", F.col("before") + F.col("run"))
    total = v.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    at = lambda q: F.bround((F.col("total") - 1) * F.lit(q), 0) + 1
    pick = lambda q: F.coalesce(F.min(F.when(F.col("last") >= at(q), F.col("v"))), F.lit(0.0))
    joined = ranked.join(F.broadcast(total), F.lit(True))
    out = joined.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("cases"),
        F.coalesce(F.try_divide(F.sum(F.col("v") * F.col("n")), F.sum("n")), F.lit(0.0)).alias("mean_ms"),
        pick(0.5).alias("p50_ms"),
        pick(0.95).alias("p95_ms"),
        F.coalesce(F.max("v"), F.lit(0.0)).alias("max_ms"),
        F.coalesce(F.try_divide(F.sum(F.when(F.col("v") <= target, F.col("n")).otherwise(0)), F.sum("n")), F.lit(0.0)).alias("target_met_rate"),
    )
    return out.select("cases", *[F.round(c, 3).alias(c) for c in out.columns[1:]])


def stage_averages(cases: DataFrame, stages: list[str] = STAGES) -> DataFrame:
    return cases.agg(*[F.round(F.coalesce(F.avg(s), F.lit(0.0)), 3).alias(s) for s in stages if s in cases.columns])
