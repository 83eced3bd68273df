"""Grading of retrieved evidence, and answers with citations or refusals with a reason: one row per request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexvane.functions import text as T
from lexvane.operators.retrieval import EXACT, LEXICAL

# Scores from which evidence is relevant or ambiguous, by kind of score.
RELEVANT = {"rerank": 0.20, "rrf": 0.02, "lexical": 55.0, "dense": 0.55}
AMBIGUOUS = {"rerank": 0.13, "rrf": 0.01, "lexical": 20.0, "dense": 0.30}
CONFLICT_MARGIN = 0.01
SCORES = [*LEXICAL, "dense_score", "rrf_score", "rerank_score", "rerank_concept_overlap", "rerank_lexical_overlap"]
# Explanations by outcome.
SAYS = {
    "none_allowed": "No authorized retrieval evidence was available for this role.",
    "none_valid": "Authorized evidence exists, but not for the requested validity date.",
    "none": "Retrieval returned no sufficiently relevant evidence.",
    "outside": "The requested legal identifier was found only outside the requested validity date.",
    "older": "Retrieved evidence appears older than the year referenced in the query.",
    "facts": "Retrieved evidence is fact-specific case law without a general statutory basis.",
    "good": "Retrieved evidence is sufficiently specific to support an answer.",
    "conflict": "Top retrieval candidates conflict because multiple sources rank nearly the same.",
    "partial": "Retrieved evidence is partially relevant but not strong enough for a safe answer.",
    "weak": "Retrieved evidence is too weak to support an answer.",
}


def _padded(results: DataFrame) -> DataFrame:
    return results.withColumns({s: F.lit(None).cast("double") for s in SCORES if s not in results.columns})


def primary_score(method: Column, r: Column) -> Column:
    fused = F.coalesce(r["rerank_score"], r["rrf_score"], F.lit(0.0))
    return F.when(method == "hybrid", fused).when(method == "lexical", F.coalesce(r["lexical_score"], F.lit(0.0))).otherwise(F.coalesce(r["dense_score"], F.lit(0.0)))


def _reaches(method: Column, r: Column, limits: dict[str, float]) -> Column:
    limit = (
        F.when((method == "hybrid") & r["rerank_score"].isNotNull(), limits["rerank"])
        .when(method == "hybrid", limits["rrf"])
        .when(method == "lexical", limits["lexical"])
        .otherwise(limits["dense"])
    )
    return primary_score(method, r) >= limit


def _is_exact(r: Column) -> Column:
    return F.coalesce(*[r[s] for s in EXACT]).isNotNull()


def heads(requests: DataFrame, results: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per request: its best results in order, and the counts of what was filtered."""
    r = _padded(results).withColumn("r", F.struct("rank", "chunk", *SCORES))
    got = r.groupBy("query_id").agg(
        F.array_sort(F.collect_list("r")).alias("rs"),  # top_k rows of a request at most
        F.bool_or(_is_exact(F.col("r"))).alias("any_exact"),
    )
    return requests.join(counts, "query_id", "left").join(got, "query_id", "left").withColumn("n", F.greatest(F.coalesce(F.size("rs"), F.lit(0)), F.lit(0)))


def grade(requests: DataFrame, results: DataFrame, counts: DataFrame) -> DataFrame:
    """Grade, refusal reason, explanation, top score and supporting chunks of each request. The first rule that holds decides."""
    df = heads(requests, results, counts)
    df = df.withColumns({"r1": F.try_element_at("rs", F.lit(1)), "r2": F.try_element_at("rs", F.lit(2))})
    q, m, r1, r2 = F.col("query"), F.coalesce("method", F.lit("hybrid")), F.col("r1"), F.col("r2")
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    s1, s2 = primary_score(m, r1), primary_score(m, r2)
    two = F.slice("rs", 1, 2)
    dated = F.filter(two, lambda r: r["chunk"]["decision_date"].isNotNull())
    year = T.latest_year(q)
    older = year.isNotNull() & (F.size(dated) > 0) & F.forall(dated, lambda r: F.substring(r["chunk"]["decision_date"].cast("string"), 1, 4).cast("int") < year)
    exact = F.coalesce(_is_exact(r1), F.lit(False))
    conflict = r2.isNotNull() & _reaches(m, r1, AMBIGUOUS) & _reaches(m, r2, AMBIGUOUS) & (r1["chunk"]["doc_id"] != r2["chunk"]["doc_id"]) & (F.abs(s1 - s2) <= CONFLICT_MARGIN)
    outside = F.col("as_of_date").isNotNull() & (count("validity_filtered_count") > 0) & T.is_identifier_query(q) & ~F.coalesce(F.col("any_exact"), F.lit(False))
    facts = T.matches(q, T.ELIGIBILITY) & ~exact & F.forall(two, lambda r: r["chunk"]["source_type"] == "case_law")
    unseen = (
        (count("denied_count") > 0)
        & (s1 < AMBIGUOUS["rerank"])
        & (F.size(T.tokens(q)) >= 3)
        & (F.coalesce(r1["rerank_concept_overlap"], F.lit(0.0)) == 0)
        & (F.coalesce(r1["rerank_lexical_overlap"], F.lit(0.0)) == 0)
    )
    nothing = count("authorized_candidate_count") == 0
    rules: list[tuple[Column, str, str | None, str]] = [
        ((F.col("n") == 0) & (count("denied_count") > 0) & nothing, "irrelevant", "no_authorized_source", "none_allowed"),
        ((F.col("n") == 0) & (count("validity_filtered_count") > 0) & nothing, "irrelevant", "outdated_evidence", "none_valid"),
        (F.col("n") == 0, "irrelevant", "insufficient_evidence", "none"),
        (outside, "ambiguous", "outdated_evidence", "outside"),
        (F.coalesce(older, F.lit(False)), "ambiguous", "outdated_evidence", "older"),
        (F.coalesce(facts, F.lit(False)), "ambiguous", "insufficient_evidence", "facts"),
        (exact, "relevant", None, "good"),
        (F.coalesce(conflict, F.lit(False)), "ambiguous", "conflicting_evidence", "conflict"),
        (_reaches(m, r1, RELEVANT), "relevant", None, "good"),
        (_reaches(m, r1, AMBIGUOUS), "ambiguous", "insufficient_evidence", "partial"),
        (F.coalesce(unseen, F.lit(False)), "irrelevant", "no_authorized_source", "weak"),
        (F.lit(True), "irrelevant", "insufficient_evidence", "weak"),
    ]
    verdict = None
    for cond, g, reason, says in rules:
        value = F.struct(F.lit(g).alias("grade"), F.lit(reason).cast("string").alias("refusal_reason"), F.lit(SAYS[says]).alias("explanation"), F.lit(says).alias("rule"))
        verdict = F.when(cond, value) if verdict is None else verdict.when(cond, value)
    ids = F.transform(two, lambda r: r["chunk"]["chunk_id"])
    weak = F.col("verdict.rule") == "weak"
    df = df.withColumn("verdict", verdict).withColumns(
        {
            "grade": F.col("verdict.grade"),
            "refusal_reason": F.col("verdict.refusal_reason"),
            "explanation": F.col("verdict.explanation"),
            "top_score": F.when(F.col("n") > 0, s1),
            "supporting_chunk_ids": F.when(F.col("n") == 0, F.array().cast("array<string>")).when(weak, F.slice(ids, 1, 1)).otherwise(ids),
            "conflicting_chunk_ids": F.when(F.col("verdict.rule") == "conflict", ids).otherwise(F.array().cast("array<string>")),
            "is_exact": exact,
        }
    )
    return df.drop("verdict", "r1", "r2")


def cited(rs: Column, is_exact: Column) -> Column:
    """The results an answer cites: one where it is exact, else two."""
    return F.when(is_exact, F.slice(rs, 1, 1)).otherwise(F.slice(rs, 1, 2))


def citations(rs: Column) -> Column:
    return F.coalesce(
        F.transform(
            rs,
            lambda r: F.struct(
                T.source_label(r["chunk"]["ecli"], r["chunk"]["citation_path"]).alias("label"),
                *[r["chunk"][c].alias(c) for c in ("source_type", "source_path", "citation_path", "doc_id", "chunk_id")],
            ),
        ),
        F.array(),
    )


def answer(graded: DataFrame) -> DataFrame:
    """Adds outcome, answer_text and citations. Refusals cite too."""
    some = cited(F.col("rs"), F.col("is_exact"))
    told = F.array_join(
        F.transform(some, lambda r, i: F.concat(F.when(i == 0, "Primary evidence").otherwise("Additional evidence"), F.lit(" from "), r["chunk"]["citation_path"], F.lit(": "), T.snippet(r["chunk"]["text"]))),
        " ",
    )
    good = F.col("grade") == "relevant"
    return graded.withColumns(
        {
            "outcome": F.when(good, "answered").otherwise("refused"),
            "answer_text": F.when(good, told),
            "citations": F.when(F.col("n") > 0, citations(some)).otherwise(citations(F.slice("rs", 1, 0))),
            "security_ranks": F.when(F.col("n") > 0, F.sort_array(F.array_distinct(F.transform(some, lambda r: r["chunk"]["security_rank"])))),
            "retrieved_chunk_ids": F.coalesce(F.transform("rs", lambda r: r["chunk"]["chunk_id"]), F.array().cast("array<string>")),
        }
    )
