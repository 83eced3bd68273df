"""Queries of whole plans - the corrective loop, its evaluation, graded hybrid retrieval, chunked texts - with their SQL.

The SQL plans, parses, scores, grades and answers by itself from the questions as written. Importing this module adds to the
queries of ``lexvane.queries``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lexvane.functions import text as T
from lexvane.operators import evaluation as EV
from lexvane.operators import evidence as E
from lexvane.operators.chunking import chunk_texts
from lexvane.plans.engine import Engine
from lexvane.queries import _CHUNKS, _NORM, _RULES, _chunks, _r, _requests, _table, query

# ---- the corrective loop -----------------------------------------------------------------------------------------------

QUESTIONS = [
    {"query_id": "a1", "query": "Artikel 12.5 lid 1", "role": "helpdesk"},
    {"query_id": "a2", "query": "ECLI:NL:HR:2001:101", "role": "legal_counsel"},
    {"query_id": "a3", "query": "artikel 8.1 lid 2", "role": "inspector", "as_of_date": "2024-06-15"},
    {"query_id": "a4", "query": "src0 > Artikel 0.0 > Lid 1", "role": "helpdesk"},
    {"query_id": "a5", "query": "Artikel 4.4", "role": "ghost"},
    {"query_id": "a6", "query": "ECLI:NL:HR:2003:53 after 2015", "role": "legal_counsel"},
    {"query_id": "a7", "query": "What does Artikel 12.5 lid 1 say; what does Artikel 8.1 lid 3 say?", "role": "inspector"},
    {"query_id": "a8", "query": "Tell me of Artikel 12.5 lid 1 and tell me of Artikel 98.9 lid 9", "role": "inspector"},
    {"query_id": "a9", "query": "What is the definition of an incoming employee for the 30% ruling?", "role": "helpdesk"},
    {"query_id": "b1", "query": "Artikel 4.4 lid 2 on 2025-01-01", "role": "helpdesk"},
    {"query_id": "b2", "query": "src1", "role": "inspector", "source_types": ["case_law", "internal_policy"]},
    {"query_id": "b3", "query": "the rule of Artikel 8.1 lid 3 in brief", "role": "legal_counsel"},
]


def _literal(v: object) -> str:
    if v is None:
        return "NULL"
    return "CAST([" + ", ".join(map(_literal, v)) + "] AS varchar[])" if isinstance(v, list) else "'" + str(v).replace("'", "''") + "'"


_QUESTIONS = "asked(query_id, query, role, given, types) AS (VALUES " + ", ".join(
    f"({_literal(r['query_id'])}, {_literal(r['query'])}, {_literal(r['role'])}, CAST({_literal(r.get('as_of_date'))} AS date), {_literal(r.get('source_types', []))})" for r in QUESTIONS
) + ")"

_PLANS = rf"""squeezed AS (SELECT *, coalesce(given, try_cast(nullif(regexp_extract(query, '{T.ISO_DATE}'), '') AS date)) AS as_of, trim(regexp_replace(query, '\s+', ' ', 'g')) AS q FROM asked),
  split_up AS (SELECT *, list_transform(list_filter(string_split_regex(q, '(?i){T.CLAUSE_SPLIT}'), lambda x: length(trim(x)) >= 12), lambda x: trim(x, ' .')) AS parts,
    list_filter(list_transform(list_concat(regexp_extract_all(q, '(?i){T.ECLI}'), regexp_extract_all(q, '(?i){T.ARTICLE_REF}')), lambda i: trim(i)), lambda i: lower(i) <> lower(q)) AS found,
    list_filter([{_RULES}], lambda r: r IS NOT NULL) AS rules FROM squeezed),
  plans AS (SELECT *, CASE WHEN len(parts) >= 2 THEN 'decomposition' WHEN len(found) + len(rules) > 0 THEN 'structured_identifier' ELSE 'none' END AS strategy,
    CASE WHEN len(parts) >= 2 THEN parts WHEN len(found) > 0 THEN [query] WHEN len(rules) > 0 THEN [rules[1]] ELSE [query] END AS first,
    coalesce(found[1], rules[1]) AS second FROM split_up)"""

_ACCESS = """CASE WHEN role NOT IN ('helpdesk', 'inspector', 'legal_counsel') OR source_type = 'internal_policy' AND role = 'helpdesk' OR security_rank > CASE role WHEN 'helpdesk' THEN 1 ELSE 3 END THEN 'denied'
  WHEN len(types) > 0 AND NOT list_contains(types, source_type) OR jurisdiction <> 'NL' THEN 'elsewhere' WHEN as_of IS NOT NULL AND NOT (valid_from <= as_of AND (valid_to IS NULL OR as_of <= valid_to)) THEN 'invalid' ELSE 'in' END"""


def _pass_sql(n: str, tries: str) -> str:
    """Graded lexical attempts ``{n}_graded`` and their best chunks ``{n}_lex``, of ``tries``: query_id, attempt, part, query, role, as_of, types."""
    return rf"""{n}_terms AS (SELECT *, nullif(upper(regexp_extract(query, '(?i){T.ECLI}', 0)), '') AS qe, nullif(regexp_extract(query, '(?i){T.ARTICLE}', 1), '') AS qa, nullif(regexp_extract(query, '(?i){T.PARAGRAPH}', 1), '') AS qp,
    nullif(lower(regexp_extract(query, '(?i){T.SUBPARAGRAPH}', 1)), '') AS qs, {_NORM.format('query')} AS norm, regexp_matches(query, '(?i){T.IDENTIFIER}') AS named, regexp_matches(query, '(?i){T.ELIGIBILITY}') AS general,
    list_max(list_transform(regexp_extract_all(query, '{T.YEAR}', 1), lambda y: CAST(y AS int))) AS asked_year FROM {tries}),
  {n}_met AS (SELECT t.*, c.chunk_id, c.doc_id, c.text, c.citation_path, c.source_type, c.ecli, c.article, c.paragraph, {_NORM.format('citation_path')} AS path, {_ACCESS} AS seen FROM {n}_terms t, chunks c),
  {n}_counts AS (SELECT query_id, attempt, part, count(*) FILTER (seen = 'denied') AS denied, count(*) FILTER (seen = 'invalid') AS invalid, count(*) FILTER (seen = 'in') AS cand FROM {n}_met GROUP BY ALL),
  {n}_flags AS (SELECT *, coalesce(qe = ecli, false)::int AS e, coalesce(qa = article, false)::int AS a, (norm <> '' AND norm = path)::int AS s, (norm <> '' AND norm <> path AND contains(path, norm))::int AS i FROM {n}_met WHERE seen = 'in'),
  {n}_scored AS (SELECT *, 300.0::double * e + (120 + 20 * (qp IS NOT NULL)::int + 10 * (qs IS NOT NULL)::int) * a + 95 * s + 55 * i AS score, e + a + s > 0 AS exact FROM {n}_flags
    WHERE e + a + s + i > 0 AND NOT (a = 1 AND (qp IS NOT NULL AND coalesce(paragraph <> qp, true) OR qs IS NOT NULL))),
  {n}_lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, attempt, part ORDER BY score DESC, chunk_id) AS rank FROM {n}_scored) WHERE rank <= 10),
  {n}_heads AS (SELECT query_id, attempt, part, count(*) AS n, max(score) FILTER (rank = 1) AS s1, max(score) FILTER (rank = 2) AS s2, bool_or(exact) AS any_exact, bool_or(exact) FILTER (rank = 1) AS exact1,
    max(CAST(split_part(ecli, ':', 4) AS int)) FILTER (rank <= 2) AS decided, bool_and(source_type = 'case_law') FILTER (rank <= 2) AS all_cases, list(chunk_id ORDER BY rank) AS ids FROM {n}_lex GROUP BY ALL),
  {n}_ruled AS (SELECT t.*, coalesce(h.n, 0) AS n, s1, coalesce(exact1, false) AS exact1, coalesce(ids, []) AS ids,
    CASE WHEN h.n IS NULL THEN CASE WHEN denied > 0 AND cand = 0 THEN 1 WHEN invalid > 0 AND cand = 0 THEN 2 ELSE 3 END WHEN as_of IS NOT NULL AND invalid > 0 AND named AND NOT any_exact THEN 4 WHEN decided < asked_year THEN 5
      WHEN general AND NOT exact1 AND all_cases THEN 6 WHEN exact1 THEN 7 WHEN s2 >= 20 AND abs(s1 - s2) <= 0.01 THEN 8 WHEN s1 >= 55 THEN 7 WHEN s1 >= 20 THEN 6 ELSE 3 END AS rule
    FROM {n}_terms t JOIN {n}_counts USING (query_id, attempt, part) LEFT JOIN {n}_heads h USING (query_id, attempt, part)),
  {n}_graded AS (SELECT query_id, attempt, part, query, n, s1, exact1, ids, CASE WHEN rule <= 3 THEN 'irrelevant' WHEN rule = 7 THEN 'relevant' ELSE 'ambiguous' END AS grade,
    CASE rule WHEN 1 THEN 'no_authorized_source' WHEN 2 THEN 'outdated_evidence' WHEN 3 THEN 'insufficient_evidence' WHEN 4 THEN 'outdated_evidence' WHEN 5 THEN 'outdated_evidence' WHEN 6 THEN 'insufficient_evidence' WHEN 8 THEN 'conflicting_evidence' END AS reason FROM {n}_ruled)"""


_LOOP = rf"""WITH {_CHUNKS}, {_QUESTIONS}, {_PLANS},
  tries1 AS (SELECT query_id, 0 AS attempt, k AS part, first[k] AS query, role, as_of, types FROM plans, generate_series(1, 9) g(k) WHERE k <= len(first)), {_pass_sql('p1', 'tries1')},
  tries2 AS (SELECT p.query_id, 1 AS attempt, 1 AS part, second AS query, role, as_of, types FROM plans p JOIN p1_graded g USING (query_id) WHERE strategy = 'structured_identifier' AND grade <> 'relevant'), {_pass_sql('p2', 'tries2')},
  every AS (SELECT * FROM p1_graded UNION ALL SELECT * FROM p2_graded),
  lex AS (SELECT query_id, attempt, part, rank, chunk_id, citation_path, text FROM p1_lex UNION ALL SELECT query_id, attempt, part, rank, chunk_id, citation_path, text FROM p2_lex),
  told AS (SELECT *, CASE WHEN length(flat) <= 240 THEN flat ELSE rtrim(substring(flat, 1, 237)) || '...' END AS snippet FROM (SELECT *, trim(regexp_replace(text, '[\s\x{{00a0}}]+', ' ', 'g')) AS flat FROM lex WHERE rank <= 2)),
  cites AS (SELECT t.*, exact1 FROM told t JOIN every USING (query_id, attempt, part) WHERE rank = 1 OR NOT exact1),
  said AS (SELECT query_id, attempt, part, string_agg(CASE rank WHEN 1 THEN 'Primary evidence from ' ELSE 'Additional evidence from ' END || citation_path || ': ' || snippet, ' ' ORDER BY rank) AS said FROM cites GROUP BY ALL),
  placed AS (SELECT e.*, said, CASE grade WHEN 'relevant' THEN 3 WHEN 'ambiguous' THEN 2 ELSE 1 END AS g, coalesce(s1, 0) AS score FROM every e LEFT JOIN said USING (query_id, attempt, part)),
  ordered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY g DESC, score DESC, part, attempt) AS b, row_number() OVER (PARTITION BY query_id ORDER BY g, part, attempt) AS w FROM placed),
  summed AS (SELECT query_id, bool_and(g = 3) AS good, bool_or(g = 2) AS unclear, count(*) AS tries, sum(n) AS every_n, max(score) AS most, flatten(list(ids ORDER BY part, attempt)) AS every_id FROM placed GROUP BY 1),
  parts_told AS (SELECT query_id, string_agg('For ''' || query || ''': ' || snippet, ' ' ORDER BY t.part) AS parts_said FROM told t JOIN every USING (query_id, attempt, part) WHERE rank = 1 GROUP BY 1),
  chosen AS (SELECT p.query_id, p.query AS asked_query, strategy, strategy = 'decomposition' AND good AS won, strategy = 'decomposition' AND NOT good AS lost, unclear, tries, every_n, most, every_id, b, parts_said,
      CASE WHEN strategy = 'decomposition' AND NOT good THEN w ELSE b END AS pick
    FROM plans p JOIN summed USING (query_id) JOIN (SELECT query_id, struct_pack(n, s1, grade, reason, said, ids, part, attempt) AS b FROM ordered WHERE b = 1) USING (query_id) JOIN (SELECT query_id, struct_pack(n, s1, grade, reason, said, ids, part, attempt) AS w FROM ordered WHERE w = 1) USING (query_id)
      LEFT JOIN parts_told USING (query_id)),
  cited AS (SELECT query_id, list(chunk_id ORDER BY place) AS cited, list(citation_path ORDER BY place) AS paths, list(text ORDER BY place) AS texts FROM
    (SELECT query_id, chunk_id, any_value(citation_path) AS citation_path, any_value(text) AS text, min(c.part * 10 + c.rank) AS place FROM cites c JOIN chosen o USING (query_id) WHERE o.won OR (c.part = o.pick.part AND c.attempt = o.pick.attempt) GROUP BY ALL) GROUP BY 1),
  answers AS (SELECT query_id, strategy, CASE WHEN won THEN 'answered' WHEN lost THEN 'refused' WHEN b.grade = 'relevant' THEN 'answered' ELSE 'refused' END AS outcome,
    CASE WHEN won THEN 'relevant' WHEN lost AND unclear THEN 'ambiguous' WHEN lost THEN 'irrelevant' ELSE b.grade END AS grade, CASE WHEN won THEN NULL WHEN lost THEN coalesce(pick.reason, 'insufficient_evidence') ELSE b.reason END AS refusal_reason,
    CASE WHEN won THEN parts_said WHEN NOT lost AND b.grade = 'relevant' THEN b.said END AS answer_text, CAST(CASE WHEN strategy = 'decomposition' THEN every_n ELSE b.n END AS bigint) AS result_count, CASE WHEN strategy = 'decomposition' THEN most ELSE b.s1 END AS top_score,
    coalesce(cited, []) AS cited, coalesce(paths, []) AS paths, coalesce(texts, []) AS texts, CASE WHEN won THEN every_id ELSE pick.ids END AS retrieved, tries, strategy <> 'decomposition' AND tries > 1 AS retried FROM chosen LEFT JOIN cited USING (query_id))"""


@query(f"""{_LOOP} SELECT query_id, strategy, outcome, grade, refusal_reason, answer_text, result_count, top_score, array_to_string(cited, ',') AS cited, array_to_string(retrieved, ',') AS retrieved,
  'understood,' || CASE WHEN strategy = 'none' THEN '' ELSE 'transformed,' END || CASE WHEN retried THEN 'retrieved,graded,retrying,retrieved,graded,' ELSE repeat('retrieved,graded,', CAST(tries AS int)) END || outcome AS states FROM answers""")
def corrective_lexical(spark, sf):
    """The whole corrective plan by identifiers: parts, forced provisions, retries, the better attempt, dates in questions."""
    out = Engine(_chunks(spark, sf)).answer(_requests(spark, [r | {"method": "lexical"} for r in QUESTIONS]))
    ids = lambda c: F.array_join(c, ",")
    return out.select("query_id", "strategy", "outcome", "grade", "refusal_reason", "answer_text", F.col("result_count").cast("bigint"), "top_score", ids(F.col("citations.chunk_id")).alias("cited"), ids(F.col("retrieved_chunk_ids")).alias("retrieved"), ids(F.col("states")).alias("states"))


GOLD = [
    {"case_id": "a1", "category": "exact_lookup", "expected_outcome": "answered", "expected_citation_paths": ["SRC12 > artikel 12.5 >  lid 1"], "expected_citation_substrings": ["Artikel 12.5"], "expected_chunk_ids": ["doc:12"]},
    {"case_id": "a2", "category": "exact_lookup", "expected_outcome": "answered", "expected_grade": "relevant", "expected_chunk_ids": ["doc:101", "doc:102"]},
    {"case_id": "a3", "category": "exact_lookup", "expected_outcome": "refused", "expected_grade": "irrelevant"},
    {"case_id": "a5", "category": "unauthorized_role", "expected_outcome": "refused", "expected_refusal_reason": "no_authorized_source", "forbidden_citation_substrings": ["Artikel"]},
    {"case_id": "a6", "category": "exact_lookup", "expected_outcome": "answered", "forbidden_chunk_ids": ["doc:53"]},
    {"case_id": "a7", "category": "multi_part", "expected_outcome": "answered", "expected_citation_substrings": ["artikel 12.5", "ARTIKEL  8.1"], "expected_chunk_ids": ["doc:12", "doc:8"]},
    {"case_id": "a8", "category": "multi_part", "expected_outcome": "answered", "expected_refusal_reason": "insufficient_evidence"},
    {"case_id": "b2", "category": "semantic_lookup", "expected_outcome": "refused", "expected_grade": "ambiguous", "expected_refusal_reason": "conflicting_evidence", "expected_citation_substrings": ["src1", "src2"]},
]
_WANTS = ["expected_citation_substrings", "expected_citation_paths", "expected_chunk_ids", "forbidden_citation_substrings", "forbidden_chunk_ids"]
_TEXTS = ["case_id", "category", "expected_outcome", "expected_grade", "expected_refusal_reason"]
_GOLD = f"gold({', '.join([*_TEXTS, *_WANTS])}) AS (VALUES " + ", ".join("(" + ", ".join([*[_literal(g.get(c)) for c in _TEXTS], *[_literal(g.get(c, [])) for c in _WANTS]]) + ")" for g in GOLD) + ")"


@query(rf"""{_LOOP}, {_GOLD},
  joined AS (SELECT *, CASE WHEN len(retrieved) > 0 THEN retrieved ELSE cited END AS ids, list_transform(paths, lambda v: trim(regexp_replace(lower(v), '\s+', ' ', 'g'))) AS said_paths, trim(regexp_replace(lower(coalesce(answer_text, '')), '\s+', ' ', 'g')) AS said_text,
    list_transform(expected_citation_substrings, lambda v: trim(regexp_replace(lower(v), '\s+', ' ', 'g'))) AS w1, list_transform(expected_citation_paths, lambda v: trim(regexp_replace(lower(v), '\s+', ' ', 'g'))) AS w2,
    list_transform(forbidden_citation_substrings, lambda v: trim(regexp_replace(lower(v), '\s+', ' ', 'g'))) AS bad, list_transform(texts, lambda v: trim(regexp_replace(lower(v), '\s+', ' ', 'g'))) AS flat FROM gold JOIN answers ON query_id = case_id),
  counted AS (SELECT *, len(list_filter(w1, lambda w: len(list_filter(said_paths, lambda v: contains(v, w))) > 0)) AS n1, len(list_filter(w2, lambda w: list_contains(said_paths, w))) AS n2, len(list_filter(expected_chunk_ids, lambda w: list_contains(ids, w))) AS n3,
    outcome = expected_outcome AS outcome_match, expected_grade IS NULL OR grade = expected_grade AS grade_match, expected_refusal_reason IS NULL OR coalesce(refusal_reason = expected_refusal_reason, false) AS refusal_reason_match,
    len(list_filter(bad, lambda w: contains(said_text, w) OR len(list_filter(said_paths, lambda v: contains(v, w))) > 0)) > 0 OR list_has_any(forbidden_chunk_ids, ids) AS leaked,
    len(list_filter(flat, lambda v: length(v) >= 24 AND contains(said_text, substring(v, 1, 24)))) > 0 AS faithful, len(w1) + len(w2) + len(expected_chunk_ids) AS total FROM joined)
  SELECT case_id, category, outcome_match, grade_match, refusal_reason_match, len(cited) > 0 AS citation_presence, n1 AS expected_citation_match_count, n2 AS expected_exact_citation_match_count, n3 AS expected_chunk_match_count, leaked AS unauthorized_retrieval_failure, faithful AS faithfulness_proxy_pass,
    round(CASE WHEN total > 0 THEN (n1 + n2 + n3) / CAST(total AS double) ELSE 1 END, 9) AS context_precision_proxy,
    outcome_match AND grade_match AND refusal_reason_match AND NOT leaked AND n1 = len(w1) AND n2 = len(w2) AND n3 = len(expected_chunk_ids) AS passed FROM counted""")
def evaluated_cases(spark, sf):
    """Cases with what they expect and forbid, held against the answers of the corrective plan."""
    asked = {r["query_id"]: r for r in QUESTIONS}
    chunks = _chunks(spark, sf)
    answers = Engine(chunks).answer(_requests(spark, [asked[g["case_id"]] | {"method": "lexical"} for g in GOLD])).withColumnRenamed("query_id", "case_id")
    gold = spark.createDataFrame([tuple([*[g.get(c) for c in _TEXTS], *[g.get(c, []) for c in _WANTS]]) for g in GOLD], ", ".join([*[f"{c} string" for c in _TEXTS], *[f"{c} array<string>" for c in _WANTS]]))
    out = EV.evaluate(gold, answers, chunks)
    counts = [F.col(c).cast("bigint").alias(c) for c in ("expected_citation_match_count", "expected_exact_citation_match_count", "expected_chunk_match_count")]
    return out.select("case_id", "category", "outcome_match", "grade_match", "refusal_reason_match", "citation_presence", *counts, "unauthorized_retrieval_failure", "faithfulness_proxy_pass", _r("context_precision_proxy").alias("context_precision_proxy"), "passed")


# ---- grading by given scores -------------------------------------------------------------------------------------------

_ASKS = """CASE doc_id % 5 WHEN 0 THEN 'Can someone qualify for it' WHEN 1 THEN 'the change of 2019' WHEN 2 THEN 'Artikel 3 lid 2' WHEN 3 THEN 'two words' ELSE 'what the rule says here' END"""


@query(rf"""WITH c AS (SELECT doc_id, {_ASKS} AS q, doc_id % 3 AS m, doc_id % 11 AS n11, CASE WHEN doc_id % 6 = 0 THEN DATE '2024-01-01' END AS as_of, doc_id % 4 AS denied, doc_id % 7 AS invalid, CASE WHEN doc_id % 13 = 0 THEN 0 ELSE doc_id % 3 END AS cand FROM labels),
  s AS (SELECT *, CASE WHEN n11 = 0 THEN 0 WHEN n11 = 1 THEN 1 ELSE 2 END AS n, CASE m WHEN 0 THEN (doc_id * 7 % 30) / 100.0::double WHEN 1 THEN CASE WHEN doc_id % 9 = 0 THEN 120.0::double ELSE (doc_id * 7 % 30) * 5.0::double END ELSE (doc_id * 7 % 30) / 40.0::double END AS s1 FROM c),
  t AS (SELECT *, CASE WHEN doc_id % 8 < 2 THEN s1 ELSE s1 / 2 END AS s2, CASE m WHEN 0 THEN 0.2::double WHEN 1 THEN 55 ELSE 0.55::double END AS hi, CASE m WHEN 0 THEN 0.13::double WHEN 1 THEN 20 ELSE 0.3::double END AS lo, doc_id % 9 = 0 AS exact1, doc_id % 17 = 0 AS exact2,
    (doc_id % 2 = 0) AND (n = 1 OR doc_id % 10 < 5) AS all_cases, CASE WHEN doc_id % 2 = 0 THEN 2010 + doc_id % 12 END AS y1, CASE WHEN n = 2 AND doc_id % 10 < 5 THEN 2008 + doc_id % 14 END AS y2 FROM s),
  r AS (SELECT *, CASE WHEN n = 0 THEN CASE WHEN denied > 0 AND cand = 0 THEN 1 WHEN invalid > 0 AND cand = 0 THEN 2 ELSE 3 END
    WHEN as_of IS NOT NULL AND invalid > 0 AND doc_id % 5 = 2 AND NOT (exact1 OR n = 2 AND exact2) THEN 4 WHEN doc_id % 5 = 1 AND greatest(y1, y2) < 2019 THEN 5 WHEN doc_id % 5 = 0 AND NOT exact1 AND all_cases THEN 6 WHEN exact1 THEN 7
    WHEN n = 2 AND s1 >= lo AND s2 >= lo AND doc_id % 16 <> 0 AND abs(s1 - s2) <= 0.01 THEN 8 WHEN s1 >= hi THEN 9 WHEN s1 >= lo THEN 10 WHEN denied > 0 AND s1 < 0.13 AND doc_id % 5 <> 3 AND doc_id % 3 <> 1 THEN 11 ELSE 12 END AS rule FROM t)
  SELECT doc_id, CASE WHEN rule IN (1, 2, 3, 11, 12) THEN 'irrelevant' WHEN rule IN (7, 9) THEN 'relevant' ELSE 'ambiguous' END AS grade,
    CASE WHEN rule IN (1, 11) THEN 'no_authorized_source' WHEN rule IN (2, 4, 5) THEN 'outdated_evidence' WHEN rule IN (3, 6, 10, 12) THEN 'insufficient_evidence' WHEN rule = 8 THEN 'conflicting_evidence' END AS refusal_reason,
    round(CASE WHEN n > 0 THEN s1 END, 9) AS top_score, CASE WHEN n = 0 THEN 0 WHEN n = 1 OR rule IN (11, 12) THEN 1 ELSE 2 END AS n_supporting, CASE WHEN rule = 8 THEN 2 ELSE 0 END AS n_conflicting FROM r""")
def grade_rules(spark, sf):
    """Every rule of grading, in their order, for every labelled document as a request with up to two results of given scores."""
    d, t = F.col("doc_id"), _table(spark, sf, "labels").select("doc_id")
    m, method = d % 3, F.when(d % 3 == 0, "hybrid").when(d % 3 == 1, "lexical").otherwise("dense")
    day = F.when(d % 6 == 0, F.lit("2024-01-01").cast("date"))
    asked = t.select(d.cast("string").alias("query_id"), F.expr(_ASKS).alias("query"), method.alias("method"), day.alias("as_of_date"), d.alias("doc_id"))
    counts = t.select(d.cast("string").alias("query_id"), (d % 4).alias("denied_count"), (d % 7).alias("validity_filtered_count"), F.when(d % 13 == 0, 0).otherwise(d % 3).alias("authorized_candidate_count"))
    n = F.when(d % 11 == 0, 0).when(d % 11 == 1, 1).otherwise(2)
    s1 = F.when(m == 0, (d * 7 % 30) / 100).when(m == 1, F.when(d % 9 == 0, 120.0).otherwise((d * 7 % 30) * 5.0)).otherwise((d * 7 % 30) / 40)
    k = F.col("k")
    score = F.when((k == 1) | (d % 8 < 2), s1).otherwise(s1 / 2)
    case = F.when(k == 1, d % 2 == 0).otherwise(d % 10 < 5)
    decided = F.when(case, F.concat(F.when(k == 1, 2010 + d % 12).otherwise(2008 + d % 14).cast("string"), F.lit("-06-01")))
    # Two results of one document do not conflict.
    doc = F.concat_ws(":", d.cast("string"), F.when((k == 2) & (d % 16 != 0), "other").otherwise("same"))
    chunk = F.struct(F.concat_ws("/", doc, k.cast("string")).alias("chunk_id"), doc.alias("doc_id"), F.when(case, "case_law").otherwise("legislation").alias("source_type"), decided.alias("decision_date"))
    results = t.select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("k")).where(k <= n).select(
        d.cast("string").alias("query_id"), k.alias("rank"), chunk.alias("chunk"),
        F.when(F.when(k == 1, d % 9 == 0).otherwise(d % 17 == 0), 120.0).alias("article_exact_match"),
        F.when(m == 0, score).alias("rerank_score"), F.when(m == 1, score).alias("lexical_score"), F.when(m == 2, score).alias("dense_score"),
        F.when(d % 3 == 1, 0.5).otherwise(0.0).alias("rerank_concept_overlap"), F.lit(0.0).alias("rerank_lexical_overlap"),
    )
    out = E.grade(asked, results, counts)
    return out.select("doc_id", "grade", "refusal_reason", _r("top_score").alias("top_score"), F.size("supporting_chunk_ids").alias("n_supporting"), F.size("conflicting_chunk_ids").alias("n_conflicting"))


# ---- texts as chunks ---------------------------------------------------------------------------------------------------


@query(r"""WITH d AS (SELECT doc_id, CASE doc_id % 2 WHEN 0 THEN 'internal_policy' ELSE 'e_learning' END AS source_type, CASE WHEN doc_id % 3 = 0 THEN text ELSE '# Scope & Aim' || chr(10) || text || chr(10) || '## ' || lang || chr(10) || text END AS c FROM documents),
  h AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(chr(10) || regexp_replace(c, '\r\n?', chr(10), 'g'), '\n\s*##?[ \t]+(\S)', chr(1) || '\1', 'g'), chr(1))[2:],
      lambda x: {'title': trim(split_part(x, chr(10), 1)), 'body': trim(substring(x, instr(x || chr(10), chr(10)) + 1), ' ' || chr(9) || chr(10))}), lambda s: s.body <> '') AS headed,
    list_filter(list_transform(string_split(c, chr(10) || chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10))), lambda x: x <> '') AS paras FROM d),
  s AS (SELECT doc_id, source_type, unnest(CASE WHEN len(headed) > 0 THEN list_transform(headed, lambda x, i: {'title': x.title, 'body': x.body, 'i': i}) ELSE list_transform(paras, lambda x, i: {'title': CASE WHEN len(paras) = 1 THEN 'Body' ELSE 'Paragraph ' || i END, 'body': x, 'i': i}) END) AS s FROM h),
  k AS (SELECT *, coalesce(nullif(trim(regexp_replace(lower(s.title), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'item') AS slug FROM s)
  SELECT 'text:' || doc_id || ':section:' || slug || ':' || s.i AS chunk_id, CASE WHEN doc_id % 5 = 0 THEN 'Guide ' || doc_id ELSE 'Path ' || doc_id END || ' > ' || s.title AS citation_path, slug AS section_type, source_type,
    CASE WHEN doc_id % 7 = 0 THEN '2024-05-01' ELSE '2023-01-01' END AS valid_from, sha256(trim(regexp_replace(s.title || ': ' || s.body, '[\s\x{00a0}]+', ' ', 'g'))) AS text_sha256,
    CASE source_type WHEN 'internal_policy' THEN '{"chunk_kind":"policy_section"}' ELSE '{"chunk_kind":"learning_section"}' END AS metadata FROM k""")
def text_chunks(spark, sf):
    """Every document as a policy or lesson, cut into chunks with their ids, citation paths and dates."""
    d, text = F.col("doc_id"), F.col("text")
    docs = _table(spark, sf, "documents").select(
        F.concat(F.lit("text:"), d.cast("string")).alias("doc_id"), F.when(d % 2 == 0, "internal_policy").otherwise("e_learning").alias("source_type"),
        F.when(d % 3 == 0, text).otherwise(F.concat(F.lit("# Scope & Aim\n"), text, F.lit("\n## "), F.col("lang"), F.lit("\n"), text)).alias("text"),
        F.concat(F.lit("Guide "), d.cast("string")).alias("title"), F.when(d % 5 != 0, F.concat(F.lit("Path "), d.cast("string"))).alias("citation_path"),
        F.when(d % 7 == 0, "2024-05-01").otherwise("").alias("valid_from"), F.lit("2023-01-01").alias("effective_date"),
    )
    c = chunk_texts(docs)
    return c.select("chunk_id", "citation_path", "section_type", "source_type", F.col("valid_from").cast("string"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "metadata")
