"""Queries over the driver's tables, one or more for each family of operators, and the SQL that DuckDB holds them against.

Requests are written out here; every query reads its whole tables. Doubles are rounded to nine places and counts are bigint on
both sides.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexvane.functions import phrases as P
from lexvane.functions import schemas as S
from lexvane.functions import text as T
from lexvane.functions import vectors as V
from lexvane.operators import cache as C
from lexvane.operators import evaluation as EV
from lexvane.operators import evidence as E
from lexvane.operators import retrieval as R
from lexvane.operators import security as SEC
from lexvane.operators.chunking import parse_xml, sections
from lexvane.operators.vector_index import IndexParams, VectorIndex
from lexvane.plans.engine import Engine, plan, requests_of
from lexvane.sources import readers, sinks

REQUESTS = [
    {"query_id": "q1", "query": "Artikel 12.5 lid 1", "role": "helpdesk"},
    {"query_id": "q2", "query": "ECLI:NL:HR:2001:101", "role": "legal_counsel"},
    {"query_id": "q3", "query": "artikel 8.1 lid 2", "role": "inspector", "as_of_date": "2024-06-15"},
    {"query_id": "q4", "query": "src0 > Artikel 0.0 > Lid 1", "role": "helpdesk"},
    {"query_id": "q5", "query": "Artikel 4.4", "role": "ghost"},
    {"query_id": "q6", "query": "src1", "role": "inspector", "source_types": ["case_law", "internal_policy"]},
    {"query_id": "q7", "query": "ECLI:NL:HR:2003:53 after 2015", "role": "legal_counsel"},
]


def _requests(spark: SparkSession, rows: list[dict] = REQUESTS) -> DataFrame:
    import datetime

    return requests_of(spark, [r | {"as_of_date": datetime.date.fromisoformat(r["as_of_date"])} if r.get("as_of_date") else r for r in rows])


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return readers.document_chunks(_table(spark, sf, "documents"))


def _r(c) -> F.Column:
    return F.round(c, 9)


# ---- SQL shared by the oracles -----------------------------------------------------------------------------------------

_CHUNKS = """chunks AS (
  SELECT 'doc:' || doc_id AS chunk_id, CAST(doc_id AS varchar) AS doc_id, doc_id AS d, text, lang,
    source || ' > Artikel ' || (doc_id % 97) || '.' || (doc_id % 7) || ' > Lid ' || (doc_id % 3 + 1) AS citation_path,
    CASE doc_id % 4 WHEN 0 THEN 'legislation' WHEN 1 THEN 'case_law' WHEN 2 THEN 'internal_policy' ELSE 'e_learning' END AS source_type,
    CASE WHEN doc_id % 10 = 9 THEN 'BE' ELSE 'NL' END AS jurisdiction,
    CASE WHEN doc_id % 4 <> 2 THEN 0 WHEN doc_id % 8 = 2 THEN 1 WHEN doc_id % 16 = 6 THEN 2 ELSE 3 END AS security_rank,
    DATE '2020-01-01' + CAST(doc_id % 1500 AS int) AS valid_from,
    CASE WHEN doc_id % 3 <> 0 THEN DATE '2024-06-01' + CAST(doc_id % 900 AS int) END AS valid_to,
    CASE WHEN doc_id % 4 = 0 THEN (doc_id % 97) || '.' || (doc_id % 7) END AS article,
    CASE WHEN doc_id % 4 = 0 THEN CAST(doc_id % 3 + 1 AS varchar) END AS paragraph,
    CASE WHEN doc_id % 4 = 1 THEN 'ECLI:NL:HR:' || (2000 + doc_id % 25) || ':' || doc_id END AS ecli
  FROM documents)"""
_REQS = """reqs(query_id, role, as_of, types, ecli, article, paragraph, norm, named, asked_year) AS (VALUES
  ('q1', 'helpdesk', CAST(NULL AS date), CAST([] AS varchar[]), CAST(NULL AS varchar), '12.5', '1', 'artikel 12 5 lid 1', true, NULL),
  ('q2', 'legal_counsel', NULL, [], 'ECLI:NL:HR:2001:101', NULL, NULL, 'ecli nl hr 2001 101', true, 2001),
  ('q3', 'inspector', DATE '2024-06-15', [], NULL, '8.1', '2', 'artikel 8 1 lid 2', true, NULL),
  ('q4', 'helpdesk', NULL, [], NULL, '0.0', '1', 'src0 artikel 0 0 lid 1', true, NULL),
  ('q5', 'ghost', NULL, [], NULL, '4.4', NULL, 'artikel 4 4', true, NULL),
  ('q6', 'inspector', NULL, ['case_law', 'internal_policy'], NULL, NULL, NULL, 'src1', false, NULL),
  ('q7', 'legal_counsel', NULL, [], 'ECLI:NL:HR:2003:53', NULL, NULL, 'ecli nl hr 2003 53 after 2015', true, 2015))"""
_SEEN = """seen AS (
  SELECT q.*, c.*,
    CASE WHEN role NOT IN ('helpdesk', 'inspector', 'legal_counsel') THEN 'unknown_role'
      WHEN source_type = 'internal_policy' AND role = 'helpdesk' THEN 'role_not_permitted'
      WHEN security_rank > CASE role WHEN 'helpdesk' THEN 1 ELSE 3 END THEN 'classification_exceeds_role_clearance'
      ELSE 'authorized' END AS access,
    CASE WHEN len(types) > 0 AND NOT list_contains(types, source_type) THEN 'source_type' WHEN jurisdiction <> 'NL' THEN 'jurisdiction'
      WHEN as_of IS NOT NULL AND NOT (valid_from <= as_of AND (valid_to IS NULL OR as_of <= valid_to)) THEN 'validity' ELSE 'in_scope' END AS scope
  FROM reqs q, chunks c)"""
_NORM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_LEX = f"""hits AS (
  SELECT query_id, chunk_id, citation_path, source_type, text, ecli, ecli_hit, article_hit, path_hit, path_in,
    300.0 * ecli_hit + 120.0 * article_hit + CASE WHEN paragraph_q IS NOT NULL THEN 20.0 ELSE 0 END * article_hit + 95.0 * path_hit + 55.0 * path_in AS lexical_score
  FROM (SELECT *, q_paragraph AS paragraph_q,
      CASE WHEN q_ecli = ecli THEN 1 ELSE 0 END AS ecli_hit,
      CASE WHEN q_article = article THEN 1 ELSE 0 END AS article_hit,
      CASE WHEN q_article = article AND q_paragraph IS NOT NULL AND q_paragraph <> paragraph THEN 1 ELSE 0 END AS wrong,
      CASE WHEN norm = {_NORM.format("citation_path")} THEN 1 ELSE 0 END AS path_hit,
      CASE WHEN norm <> {_NORM.format("citation_path")} AND contains({_NORM.format("citation_path")}, norm) THEN 1 ELSE 0 END AS path_in
    FROM (SELECT q.query_id, q.norm, q.ecli AS q_ecli, q.article AS q_article, q.paragraph AS q_paragraph, s.chunk_id, s.citation_path, s.source_type, s.text, s.ecli, s.article, s.paragraph
          FROM seen2 s JOIN reqs q USING (query_id)))
  WHERE wrong = 0 AND ecli_hit + article_hit + path_hit + path_in > 0),
lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lexical_score DESC, chunk_id) AS rank FROM hits)"""
_SEEN2 = """seen2 AS (
  SELECT q.query_id, c.* FROM reqs q, chunks c
  WHERE role IN ('helpdesk', 'inspector', 'legal_counsel') AND NOT (source_type = 'internal_policy' AND role = 'helpdesk')
    AND security_rank <= CASE role WHEN 'helpdesk' THEN 1 ELSE 3 END AND jurisdiction = 'NL' AND (len(types) = 0 OR list_contains(types, source_type))
    AND (as_of IS NULL OR (valid_from <= as_of AND (valid_to IS NULL OR as_of <= valid_to))))"""
_SEEN = _SEEN.replace("q.*, c.*", "q.query_id, q.role, q.as_of, q.types, c.chunk_id, c.source_type, c.jurisdiction, c.security_rank, c.valid_from, c.valid_to")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- retrieval ---------------------------------------------------------------------------------------------------------


@query(f"WITH {_CHUNKS}, {_REQS}, {_SEEN2}, {_LEX} SELECT query_id, rank, chunk_id, lexical_score FROM lex WHERE rank <= 10")
def lexical_topk(spark, sf):
    return R.lexical(_requests(spark), _chunks(spark, sf)).select("query_id", F.col("rank").cast("bigint"), F.col("chunk.chunk_id").alias("chunk_id"), "lexical_score")


@query(f"""WITH {_CHUNKS}, w(wanted) AS (VALUES ('src0 artikel 0 0 lid 1'), ('artikel 12 5'), ('lid 3')), n AS (SELECT *, {_NORM.format("citation_path")} AS norm FROM chunks)
  SELECT wanted, source_type, count(*) FILTER (norm = wanted) AS same, count(*) FILTER (norm <> wanted) AS inside FROM n JOIN w ON contains(norm, wanted) GROUP BY 1, 2""")
def citation_path_match(spark, sf):
    """Citation paths that are what is wanted, or hold it, by normalised text."""
    wanted = spark.createDataFrame([("src0 > Artikel 0.0 > Lid 1",), ("ARTIKEL 12.5",), ("Lid 3",)], "q string").select(T.match_norm(F.col("q")).alias("wanted"))
    norm = T.match_norm(F.col("citation_path"))
    met = _chunks(spark, sf).select("source_type", norm.alias("norm")).join(F.broadcast(wanted), F.contains("norm", "wanted"))
    return met.groupBy("wanted", "source_type").agg(F.count_if(F.col("norm") == F.col("wanted")).alias("same"), F.count_if(F.col("norm") != F.col("wanted")).alias("inside"))


@query(f"WITH {_CHUNKS}, {_REQS}, {_SEEN} SELECT query_id, access AS reason, count(*) AS n FROM seen GROUP BY ALL")
def rbac_reason_counts(spark, sf):
    met = _chunks(spark, sf).join(SEC.as_requests(_requests(spark)), F.lit(True))
    return met.groupBy("query_id", SEC.access_of().alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_CHUNKS}, {_REQS}, {_SEEN} SELECT query_id, count(*) AS total_chunk_count, count(*) FILTER (access <> 'authorized') AS denied_count,
  count(*) FILTER (access = 'authorized' AND scope = 'source_type') AS source_type_filtered_count, count(*) FILTER (access = 'authorized' AND scope = 'jurisdiction') AS jurisdiction_filtered_count,
  count(*) FILTER (access = 'authorized' AND scope = 'validity') AS validity_filtered_count, count(*) FILTER (access = 'authorized' AND scope = 'in_scope') AS authorized_candidate_count FROM seen GROUP BY 1""")
def scope_first_failure_counts(spark, sf):
    return SEC.request_counts(_requests(spark), _chunks(spark, sf))


@query(f"""WITH {_CHUNKS}, days(day) AS (VALUES (DATE '2021-03-01'), (DATE '2024-06-15'), (DATE '2026-12-31'))
  SELECT day, source_type, count(*) AS n, min(d) AS first_doc FROM days, chunks WHERE valid_from <= day AND (valid_to IS NULL OR day <= valid_to) GROUP BY 1, 2""")
def validity_asof(spark, sf):
    days = spark.createDataFrame([("2021-03-01",), ("2024-06-15",), ("2026-12-31",)], "d string").select(F.col("d").cast("date").alias("day"))
    met = SEC.valid_at(days, _chunks(spark, sf))
    return met.groupBy("day", "source_type").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("doc_id").cast("bigint")).alias("first_doc"))


@query(f"""WITH {_CHUNKS}, days AS (SELECT CAST(ts AS date) AS day, count(*) AS asked FROM events GROUP BY 1)
  SELECT day, source_type, any_value(asked) AS asked, count(*) AS n, min(d) AS first_doc, count(*) FILTER (valid_to IS NULL) AS open_ended FROM days, chunks WHERE valid_from <= day AND (valid_to IS NULL OR day <= valid_to) GROUP BY 1, 2""")
def validity_of_events(spark, sf):
    """What was valid on the day of each event. Days and validities are counted before they meet."""
    days = _table(spark, sf, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("asked"))
    kinds = _chunks(spark, sf).groupBy("valid_from", "valid_to", "source_type").agg(F.count(F.lit(1)).alias("k"), F.min(F.col("doc_id").cast("bigint")).alias("least"))
    met = SEC.valid_at(days, kinds)
    return met.groupBy("day", "source_type").agg(F.any_value("asked").alias("asked"), F.sum("k").alias("n"), F.min("least").alias("first_doc"), F.coalesce(F.sum(F.when(F.col("valid_to").isNull(), F.col("k"))), F.lit(0)).cast("bigint").alias("open_ended"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS double)) AS v FROM embeddings),
  q AS (SELECT vec_id AS query_id, v AS w FROM e WHERE vec_id % 100 = 0),
  s AS (SELECT query_id, vec_id, round(list_dot_product(v, w) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(w, w))), 9) AS score FROM e, q)
  SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""")
def dense_knn_topk(spark, sf):
    """Every row whose id is divisible by 100 against all rows."""
    e = _table(spark, sf, "embeddings")
    return R.nearest(e, e.where("vec_id % 100 = 0"), 10).withColumn("score", _r("score")).withColumn("rank", F.col("rank").cast("bigint"))


@query("""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS double)) AS v FROM embeddings),
  q AS (SELECT vec_id AS query_id, v AS w, label AS l FROM e WHERE vec_id % 100 = 0),
  dense AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(v, w) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(w, w))), 9) DESC, vec_id) AS rank FROM e, q),
  same AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY vec_id) AS rank FROM e JOIN q ON label = l),
  both_ AS (SELECT * FROM dense WHERE rank <= 100 UNION ALL SELECT * FROM same WHERE rank <= 50)
  SELECT query_id, vec_id, round(rrf, 9) AS rrf_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, vec_id) AS rank FROM
    (SELECT query_id, vec_id, sum(CAST(1 AS double) / (60 + rank)) AS rrf FROM both_ GROUP BY 1, 2)) WHERE rank <= 10""")
def hybrid_rrf(spark, sf):
    """Nearest rows and rows of the same label, fused, for every row whose id is divisible by 100."""
    e = _table(spark, sf, "embeddings")
    asked = e.where("vec_id % 100 = 0")
    dense = R.nearest(e, asked, 100).select("query_id", "vec_id", "rank")
    # The first rows of a label are the same for all queries of that label.
    first = R.top(e.where("label IS NOT NULL").select(F.col("label").alias("query_id"), "vec_id"), F.lit(50), F.col("vec_id")).withColumnRenamed("query_id", "label")
    same = asked.select(F.col("vec_id").alias("query_id"), "label").join(first, "label").select("query_id", "vec_id", "rank")
    found = lambda df: df.select("query_id", "rank", F.struct(F.col("vec_id").alias("chunk_id")).alias("chunk"))
    none = [F.lit(None).cast("double").alias(s) for s in R.LEXICAL]
    wanted = asked.select(F.col("vec_id").alias("query_id"), F.lit("").alias("query"), F.lit(10).alias("top_k"))
    fused = R.fuse(wanted, found(same).select("*", *none, F.array().cast("array<string>").alias("matched_terms")), found(dense).withColumn("dense_score", F.lit(None).cast("double")))
    return fused.where(F.col("rank") <= 10).select("query_id", F.col("chunk.chunk_id").alias("vec_id"), _r("rrf_score").alias("rrf_score"), F.col("rank").cast("bigint").alias("rank"))


def _folder(spark, name: str) -> str:
    """A new folder that driver and executors share: under ``spark.checkpoint.dir``, or one of this machine where Spark runs locally."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lexvane-index-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


_ROLES_OF = "CASE vec_id % 3 WHEN 0 THEN ['helpdesk', 'inspector', 'legal_counsel'] WHEN 1 THEN ['inspector', 'legal_counsel'] ELSE ['legal_counsel'] END"


@query(f"""WITH c AS (SELECT vec_id, {_ROLES_OF} AS roles, vec_id % 4 AS rank_, CASE vec_id % 5 WHEN 0 THEN 'BE' ELSE 'NL' END AS jurisdiction, DATE '2020-01-01' + CAST(vec_id % 900 AS int) AS valid_from,
    CASE WHEN vec_id % 2 = 0 THEN DATE '2021-06-01' + CAST(vec_id % 700 AS int) END AS valid_to, list_transform(embedding, lambda x: CAST(x AS double)) AS v FROM embeddings),
  n AS (SELECT *, sqrt(list_dot_product(v, v)) AS s FROM c),
  q AS (SELECT vec_id AS query_id, v AS w, s AS t, list_extract(['helpdesk', 'inspector', 'legal_counsel'], CAST(vec_id // 100 % 3 + 1 AS int)) AS role, CASE WHEN vec_id // 100 % 2 = 1 THEN DATE '2021-09-01' END AS day FROM n WHERE vec_id % 100 = 0),
  f AS (SELECT query_id, vec_id, round(list_dot_product(v, w) / (s * t), 9) AS score, list_dot_product(v, w) / (s * t) AS exact FROM q, n
    WHERE list_contains(roles, role) AND rank_ <= CASE role WHEN 'helpdesk' THEN 1 ELSE 3 END AND jurisdiction = 'NL' AND (day IS NULL OR (valid_from <= day AND (valid_to IS NULL OR day <= valid_to))))
  SELECT CAST(query_id AS varchar) AS query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, vec_id) AS rank FROM f) WHERE rank <= 10""")
def filtered_vector_search(spark, sf):
    """Every row whose id is divisible by 100 asks for its nearest rows that its role may read, at a date, in an index of all rows; all cells are probed."""
    v, e = F.col("vec_id"), _table(spark, sf, "embeddings")
    chunks = e.select(
        F.lpad(v.cast("string"), 19, "0").alias("chunk_id"), v.cast("string").alias("doc_id"), F.lit("").alias("text"), F.lit("").alias("citation_path"), F.lit("case_law").alias("source_type"),
        F.when(v % 5 == 0, "BE").otherwise("NL").alias("jurisdiction"), (v % 4).cast("int").alias("security_rank"),
        F.when(v % 3 == 0, F.array(*map(F.lit, S.ROLES))).when(v % 3 == 1, F.array(*map(F.lit, S.ROLES[1:]))).otherwise(F.array(F.lit(S.ROLES[2]))).alias("allowed_roles"),
        F.date_add(F.lit("2020-01-01").cast("date"), (v % 900).cast("int")).alias("valid_from"), F.when(v % 2 == 0, F.date_add(F.lit("2021-06-01").cast("date"), (v % 700).cast("int"))).alias("valid_to"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    nth = F.floor(v / 100)
    asked = e.where("vec_id % 100 = 0").select(
        v.cast("string").alias("query_id"), F.lit("").alias("query"), F.element_at(F.array(*map(F.lit, S.ROLES)), (nth % 3 + 1).cast("int")).alias("role"), F.lit(10).alias("top_k"), F.array().cast("array<string>").alias("source_types"),
        F.lit("NL").alias("jurisdiction"), F.when(nth % 2 == 1, F.lit("2021-09-01").cast("date")).alias("as_of_date"), V.unit(F.col("embedding")).alias("embedding"),
    )
    index = VectorIndex.refresh(chunks, _folder(spark, "vector-index"), IndexParams(oversample=20))
    found = index.found(asked, probes=max(1, len(index.meta.centres)))
    return found.select("query_id", F.col("chunk.doc_id").cast("bigint").alias("vec_id"), _r("dense_score").alias("score"), F.col("rank").cast("bigint").alias("rank"))


def _engine(spark, sf) -> Engine:
    # Not cached: one search reads the embeddings, and of a cached table every task reads a whole partition, texts and vectors.
    return Engine(R.indexed(_chunks(spark, sf)))


@query()
def hybrid_search(spark, sf):
    """Both ways fused and reranked, over the documents as chunks."""
    asked = _requests(spark, [{"query_id": "h1", "query": "the thing ation of change employer 30% ruling", "role": "legal_counsel"}, {"query_id": "h2", "query": "Artikel 12.5 lid 1", "role": "helpdesk"}])
    out = _engine(spark, sf).retrieve(asked)
    return out.select("query_id", F.col("rank").cast("bigint"), F.col("chunk.chunk_id").alias("chunk_id"), _r("rrf_score").alias("rrf_score"), _r("dense_score").alias("dense_score"), _r("rerank_score").alias("rerank_score"))


_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_HAS = {k: "(" + " OR ".join(f"contains(low, '{p}')" for p in v) + ")" for k, v in T.CONCEPTS.items()}
_CON = "list_filter([" + ", ".join(f"CASE WHEN {_HAS[k]} THEN '{k}' END" for k in T.CONCEPTS) + "], lambda x: x IS NOT NULL)"
_ALIAS = ", ".join(f"CASE WHEN {_HAS[k]} THEN [{', '.join(repr(a) for a in T.ALIASES[k])}] ELSE [] END" for k in T.CONCEPTS)
_LEXT = f"list_distinct(list_concat(list_filter(regexp_extract_all(low, '[a-z0-9%:.+-]+'), lambda x: x NOT IN ({_STOP})), flatten([{_ALIAS}])))"
_LOW = "trim(regexp_replace(lower({}), '[\\s\\x{{00a0}}]+', ' ', 'g'))"


@query(f"""WITH t AS (SELECT doc_id, {_LOW.format("text")} AS low FROM documents), c AS (SELECT doc_id, {_CON} AS con, {_LEXT} AS lex FROM t)
  SELECT doc_id, array_to_string(con, '|') AS concepts, len(lex) AS n_terms FROM c""")
def semantic_concepts(spark, sf):
    d = _table(spark, sf, "documents")
    found = d.select("doc_id", P.profiled(F.col("text")).alias("p"))
    return found.select("doc_id", F.array_join("p.concepts", "|").alias("concepts"), F.col("p.n_terms").cast("bigint").alias("n_terms"))


_RR_Q = "can an employee change employer and keep the 30% ruling in the nl for the thing"


@query(f"""WITH {_CHUNKS}, q AS (SELECT {_LOW.format(repr(_RR_Q))} AS low), qt AS (SELECT {_CON} AS qc, {_LEXT} AS ql FROM q),
  t AS (SELECT chunk_id, d, source_type, {_LOW.format("citation_path || ' ' || text || ' ' || source_type")} AS low FROM chunks),
  f AS (SELECT chunk_id, d, source_type, {_CON} AS rc, {_LEXT} AS rl FROM t),
  s AS (SELECT chunk_id, source_type, CASE WHEN source_type = 'legislation' THEN least(0.08::double * list_contains(qc, 'concept:thirty_percent_ruling')::INT + 0.08::double * (list_contains(qc, 'concept:employment_change') AND list_contains(qc, 'concept:employer'))::INT, 0.16::double) ELSE 0 END AS bonus, len(list_intersect(qc, rc)) / CAST(len(qc) AS double) AS co, len(list_intersect(ql, rl)) / CAST(len(ql) AS double) AS lo, (d % 13) / CAST(13 AS double) AS ds, CASE d % 5 WHEN 0 THEN CAST(55 AS double) ELSE 0 END AS ls, CAST(1 AS double) / (60 + d % 50) AS rr FROM f, qt)
  SELECT chunk_id, round(co, 9) AS concept_overlap, round(lo, 9) AS lexical_overlap,
    round(bonus, 9) AS source_bonus, round(0.32::double * co + 0.26::double * lo + 0.16::double * ds + 0.12::double * least(ls / 100, 1) + 0.08::double * least(rr / 0.03::double, 1) + bonus, 7) AS rerank_score FROM s""")
def rerank_deterministic(spark, sf):
    c, d = _chunks(spark, sf), F.col("doc_id").cast("bigint")
    rows = c.select(
        F.lit(_RR_Q).alias("query"), F.struct(*[F.col(x) if x in c.columns else F.lit(None).cast("string").alias(x) for x in R.CHUNK_FIELDS]).alias("chunk"),
        ((d % 13) / 13).alias("dense_score"), F.when(d % 5 == 0, 55.0).alias("lexical_score"), (1.0 / (60 + d % 50)).alias("rrf_score"),
    )
    out = R.deterministic(rows)
    return out.select(F.col("chunk.chunk_id").alias("chunk_id"), _r("rerank_concept_overlap").alias("concept_overlap"), _r("rerank_lexical_overlap").alias("lexical_overlap"), _r("rerank_source_bonus").alias("source_bonus"), F.round("rerank_score", 7).alias("rerank_score"))


@query()
def hash_embed(spark, sf):
    """The 256 hashed dimensions of every document: its length and its heaviest place."""
    e = _table(spark, sf, "documents").select("doc_id", V.embed(F.col("text")).alias("e"))
    return e.select("doc_id", _r(V.norm(F.col("e"))).alias("norm"), F.array_position("e", F.array_max("e")).alias("heaviest"))


@query(f"""WITH {_CHUNKS}, {_REQS}, {_SEEN2}, {_LEX}, best AS (SELECT query_id, max(ecli_hit + article_hit + path_hit) AS most FROM lex WHERE rank <= 50 GROUP BY 1)
  SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY lexical_score - 55.0 * path_in DESC, CAST(1 AS double) / (60 + rank) DESC, chunk_id) AS bigint) AS rank
  FROM lex JOIN best USING (query_id) JOIN (SELECT query_id, named FROM reqs) USING (query_id) WHERE rank <= 50 AND (NOT named OR most = 0 OR ecli_hit + article_hit + path_hit > 0)""")
def exact_priority_prune(spark, sf):
    asked, chunks = _requests(spark), _chunks(spark, sf)
    by_terms = R.lexical(asked, chunks, R.LEXICAL_LIMIT)
    none = by_terms.where("false").select("query_id", "rank", "chunk", F.lit(0.0).alias("dense_score"))
    return R.fuse(asked, by_terms, none).select("query_id", F.col("chunk.chunk_id").alias("chunk_id"), F.col("rank").cast("bigint"))


# ---- evidence, plans, answers ------------------------------------------------------------------------------------------


@query(f"""WITH {_CHUNKS}, {_REQS}, {_SEEN}, {_SEEN2}, {_LEX},
  top2 AS (SELECT query_id, max(lexical_score) FILTER (rank = 1) AS s1, max(lexical_score) FILTER (rank = 2) AS s2, max(ecli_hit + article_hit + path_hit) FILTER (rank = 1) AS exact1, max(ecli_hit + article_hit + path_hit) AS any_exact, max(CAST(split_part(ecli, ':', 4) AS int)) FILTER (rank <= 2 AND ecli IS NOT NULL) AS decided, least(max(rank), 10) AS n FROM lex WHERE rank <= 10 GROUP BY 1),
  counts AS (SELECT query_id, count(*) FILTER (access <> 'authorized') AS denied, count(*) FILTER (access = 'authorized' AND scope = 'in_scope') AS cand, count(*) FILTER (access = 'authorized' AND scope = 'validity') AS invalid FROM seen GROUP BY 1)
  SELECT query_id, CASE WHEN n IS NULL THEN 'irrelevant' WHEN as_of IS NOT NULL AND invalid > 0 AND named AND any_exact = 0 THEN 'ambiguous' WHEN decided < asked_year THEN 'ambiguous' WHEN exact1 > 0 THEN 'relevant' WHEN s1 >= 20 AND s2 >= 20 AND abs(s1 - s2) <= 0.01 THEN 'ambiguous' WHEN s1 >= 55 THEN 'relevant' WHEN s1 >= 20 THEN 'ambiguous' ELSE 'irrelevant' END AS grade,
    CASE WHEN n IS NULL AND denied > 0 AND cand = 0 THEN 'no_authorized_source' WHEN n IS NULL AND invalid > 0 AND cand = 0 THEN 'outdated_evidence' WHEN n IS NULL THEN 'insufficient_evidence' WHEN as_of IS NOT NULL AND invalid > 0 AND named AND any_exact = 0 THEN 'outdated_evidence' WHEN decided < asked_year THEN 'outdated_evidence' WHEN exact1 > 0 THEN NULL WHEN s1 >= 20 AND s2 >= 20 AND abs(s1 - s2) <= 0.01 THEN 'conflicting_evidence' WHEN s1 >= 55 THEN NULL ELSE 'insufficient_evidence' END AS refusal_reason,
    s1 AS top_score, coalesce(n, 0) AS n FROM reqs JOIN counts USING (query_id) LEFT JOIN top2 USING (query_id)""")
def evidence_grade(spark, sf):
    asked = _requests(spark).withColumn("method", F.lit("lexical"))
    chunks = _chunks(spark, sf)
    out = E.grade(asked, R.lexical(asked, chunks), SEC.request_counts(asked, chunks))
    return out.select("query_id", "grade", "refusal_reason", "top_score", F.col("n").cast("bigint"))


_QUESTION = """CASE conv_id % 6 WHEN 1 THEN text || ' under Artikel  ' || turn || '.1 lid 2 onderdeel b' WHEN 2 THEN 'artikel ' || (conv_id % 9)
  WHEN 3 THEN 'What is an incoming employee: ' || text WHEN 4 THEN 'Maximum of the 30% ruling in ' || conv_id WHEN 5 THEN 'ECLI:NL:HR:2001:' || conv_id || ' or art. 3 lid 1' ELSE text END"""
_RULES = ", ".join(f"CASE WHEN regexp_matches(q, '(?i){p}') THEN '{to}' END" for p, to in T.REWRITES)


@query(rf"""WITH t AS (SELECT conv_id, turn, trim(regexp_replace({_QUESTION}, '\s+', ' ', 'g')) AS q FROM conversations),
  p AS (SELECT conv_id, turn, q, list_transform(list_filter(string_split_regex(q, '(?i){T.CLAUSE_SPLIT}'), lambda x: length(trim(x)) >= 12), lambda x: trim(x, ' .')) AS parts,
    list_filter(list_transform(list_concat(regexp_extract_all(q, '(?i){T.ECLI}'), regexp_extract_all(q, '(?i){T.ARTICLE_REF}')), lambda i: trim(i)), lambda i: lower(i) <> lower(q)) AS found,
    list_filter([{_RULES}], lambda r: r IS NOT NULL) AS rules FROM t),
  x AS (SELECT *, CASE WHEN len(list_distinct(parts)) >= 2 THEN 1 WHEN len(found) > 0 THEN 2 WHEN len(rules) > 0 THEN 3 ELSE 4 END AS k FROM p)
  SELECT conv_id, turn, CASE k WHEN 1 THEN 'decomposition' WHEN 4 THEN 'none' ELSE 'structured_identifier' END AS strategy, k = 3 AS forced,
    CASE k WHEN 1 THEN len(list_distinct(parts)) WHEN 2 THEN len(list_distinct(found)) WHEN 3 THEN len(rules) ELSE 0 END AS n,
    CASE k WHEN 1 THEN parts[1] WHEN 2 THEN found[1] WHEN 3 THEN rules[1] END AS first FROM x""")
def transform_plan(spark, sf):
    """Plans of every turn as a question: as it stands, with identifiers in it, as one, and as recurring questions."""
    c = _table(spark, sf, "conversations").select("conv_id", "turn", plan(F.expr(_QUESTION)).alias("plan"))
    return c.select("conv_id", "turn", F.col("plan.strategy").alias("strategy"), F.col("plan.forced").alias("forced"), F.size("plan.transformed").cast("bigint").alias("n"), F.try_element_at("plan.transformed", F.lit(1)).alias("first"))


@query()
def corrective_two_pass(spark, sf):
    """The whole corrective plan on identifier, compound and recurring questions."""
    asked = _requests(spark, [*REQUESTS[:5], {"query_id": "d1", "query": "What does Artikel 12.5 lid 1 say; and what does Artikel 8.1 lid 3 say?", "role": "inspector"}, {"query_id": "s1", "query": "What is the definition of an incoming employee for the 30% ruling?", "role": "helpdesk"}])
    out = _engine(spark, sf).answer(asked)
    return out.select("query_id", "strategy", "outcome", "grade", "refusal_reason", F.col("result_count").cast("bigint"), F.array_join("states", ",").alias("states"), F.array_join(F.transform("citations", lambda c: c["chunk_id"]), ",").alias("cited"), "answer_text")


@query(f"""WITH {_CHUNKS}, {_REQS}, {_SEEN2}, {_LEX}, x AS (SELECT *, trim(regexp_replace(text, '[\\s\\x{{00a0}}]+', ' ', 'g')) AS flat, max(CASE WHEN rank = 1 THEN ecli_hit + article_hit + path_hit END) OVER (PARTITION BY query_id) AS exact1 FROM lex)
  SELECT query_id, rank, chunk_id, coalesce(ecli, split_part(citation_path, ' > ', 1)) AS label,
    CASE WHEN length(flat) <= 240 THEN flat ELSE rtrim(substring(flat, 1, 237)) || '...' END AS snippet
  FROM x WHERE rank <= CASE WHEN exact1 > 0 THEN 1 ELSE 2 END""")
def answer_citations(spark, sf):
    asked = _requests(spark).withColumn("method", F.lit("lexical"))
    chunks = _chunks(spark, sf)
    out = E.answer(E.grade(asked, R.lexical(asked, chunks), SEC.request_counts(asked, chunks))).where("n > 0")
    some = out.select("query_id", F.posexplode(E.cited(F.col("rs"), F.col("is_exact"))).alias("i", "r"))
    cited = some.select("query_id", (F.col("i") + 1).cast("bigint").alias("rank"), "r.chunk.*")
    return cited.select("query_id", "rank", "chunk_id", T.source_label(F.col("ecli"), F.col("citation_path")).alias("label"), T.snippet(F.col("text")).alias("snippet"))


# ---- sources, chunking, text -------------------------------------------------------------------------------------------


@query(r"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE 'left out' || chr(10) || '# Heading' || chr(10) || text || chr(10) || '## Next  part ' || chr(13) || chr(10) || text END AS c FROM documents),
  h AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(chr(10) || regexp_replace(c, '\r\n?', chr(10), 'g'), '\n\s*##?[ \t]+(\S)', chr(1) || '\1', 'g'), chr(1))[2:],
      lambda x: {'title': trim(split_part(x, chr(10), 1)), 'body': trim(substring(x, instr(x || chr(10), chr(10)) + 1), ' ' || chr(9) || chr(10))}), lambda s: s.body <> '') AS headed,
    list_filter(list_transform(string_split(c, chr(10) || chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10))), lambda x: x <> '') AS paras FROM t),
  s AS (SELECT doc_id, unnest(CASE WHEN len(headed) > 0 THEN headed ELSE list_transform(paras, lambda x, i: {'title': CASE WHEN len(paras) = 1 THEN 'Body' ELSE 'Paragraph ' || i END, 'body': x}) END) AS s FROM h)
  SELECT doc_id, s.title AS title, length(s.body) AS n_chars FROM s""")
def markdown_sections(spark, sf):
    """Every text cut at its headings: a third as it stands, the others under two headings."""
    d = F.col("doc_id")
    headed = F.concat(F.lit("left out\n# Heading\n"), F.col("text"), F.lit("\n## Next  part \r\n"), F.col("text"))
    cut = _table(spark, sf, "documents").select("doc_id", F.explode(sections(F.when(d % 3 == 0, F.col("text")).otherwise(headed))).alias("s"))
    return cut.select("doc_id", F.col("s.title").alias("title"), F.length("s.body").cast("bigint").alias("n_chars"))


@query("""SELECT doc_id, i AS part, trim(ps[i], chr(10) || ' ' || chr(9)) AS body FROM (SELECT doc_id, ps, unnest(generate_series(1, len(ps))) AS i FROM
  (SELECT doc_id, list_filter(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda x: trim(x, chr(10) || ' ' || chr(9)) <> '') AS ps FROM documents))""")
def paragraph_split(spark, sf):
    d = _table(spark, sf, "documents").select("doc_id", F.posexplode(sections(F.replace("text", F.lit("\n"), F.lit("\n\n")))).alias("i", "s"))
    return d.select("doc_id", (F.col("i") + 1).cast("bigint").alias("part"), F.col("s.body").alias("body"))


@query("SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9%:.+-]+')) AS token FROM documents) GROUP BY 1")
def token_counts(spark, sf):
    t = _table(spark, sf, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("token"))
    return t.groupBy("token", "doc_id").agg(F.count(F.lit(1)).alias("k")).groupBy("token").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("docs"))


@query("""WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9%:.+-]+')) AS token FROM documents), k AS (SELECT token, count(*) AS n FROM t GROUP BY 1)
  SELECT gram, CAST(sum(n) AS bigint) AS n FROM (SELECT n, unnest(CASE WHEN length(token) < 3 THEN [token] ELSE list_transform(generate_series(1, length(token) - 2), lambda i: substring(token, i, 3)) END) AS gram FROM k) GROUP BY 1""")
def trigram_counts(spark, sf):
    t = _table(spark, sf, "documents").select(F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("k"))
    return t.select("k", F.explode(T.trigrams(F.col("token"))).alias("gram")).groupBy("gram").agg(F.sum("k").alias("n"))


@query("""SELECT c_custkey, coalesce(nullif(trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'item') AS slug, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) AS norm,
  'law:' || c_nationkey || ':paragraph:' || coalesce(nullif(trim(regexp_replace(lower(c_mktsegment), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'item') AS chunk_id FROM customer""")
def slug_ids(spark, sf):
    c = _table(spark, sf, "customer")
    return c.select("c_custkey", T.slug(F.col("c_name")).alias("slug"), T.match_norm(F.col("c_name")).alias("norm"), F.concat_ws(":", F.lit("law"), "c_nationkey", F.lit("paragraph"), T.slug(F.col("c_mktsegment"))).alias("chunk_id"))


@query("""WITH u AS (SELECT doc_id, lang, 0 AS src FROM documents UNION ALL SELECT doc_id + 100, lang, 1 FROM documents)
  SELECT doc_id, lang, CAST(src AS bigint) AS src FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY src) AS rn FROM u) WHERE rn = 1""")
def first_wins_dedup(spark, sf):
    d = _table(spark, sf, "documents")
    parts = [d.select("doc_id", "lang", F.lit(0).cast("bigint").alias("src")), d.select((F.col("doc_id") + 100).alias("doc_id"), "lang", F.lit(1).cast("bigint").alias("src"))]
    return sinks.merge_documents(parts).select("doc_id", "lang", "src")


@query(f"WITH {_CHUNKS} SELECT chunk_id, source_type, jurisdiction, security_rank FROM chunks")
def union_all_sources(spark, sf):
    """The four kinds of source, put together again."""
    c = _chunks(spark, sf)
    parts = [c.where(F.col("source_type") == k) for k in S.SOURCE_TYPES]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return every.select("chunk_id", "source_type", "jurisdiction", F.col("security_rank"))


@query(f"WITH {_CHUNKS} SELECT source_type, count(*) AS n FROM chunks GROUP BY ROLLUP (source_type)")
def count_by_source(spark, sf):
    c = _chunks(spark, sf)
    parts = [c.where(F.col("source_type") == k) for k in S.SOURCE_TYPES]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return every.rollup("source_type").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH m AS (SELECT CASE page_id % 2 WHEN 0 THEN 'law' ELSE 'case' END AS source_type, url || page_id AS identifier, CASE WHEN page_id % 3 = 0 THEN NULL ELSE '2024-01-01' END AS version_date, sha256(html) AS sha256, page_id FROM pages)
  SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'unlocked' WHEN page_id % 7 = 0 THEN 'mismatch' ELSE 'ok' END AS status FROM m""")
def lock_verify(spark, sf):
    p = F.col("page_id")
    m = _table(spark, sf, "pages").select(F.when(p % 2 == 0, "law").otherwise("case").alias("source_type"), F.concat("url", p.cast("string")).alias("identifier"), F.when(p % 3 != 0, "2024-01-01").alias("version_date"), F.sha2(F.col("html").cast("binary"), 256).alias("sha256"), "page_id")
    lock = m.where(p % 5 != 0).withColumn("sha256", F.when(p % 7 == 0, "0").otherwise(F.col("sha256"))).drop("page_id")
    return readers.verify(m, lock).select("page_id", "status")


@query(f"WITH {_CHUNKS} SELECT source_type, count(*) AS n, count(DISTINCT chunk_id || '::stress:' || i) AS ids FROM chunks, generate_series(1, 3) t(i) GROUP BY 1")
def stress_expand(spark, sf):
    s = readers.stress(_chunks(spark, sf), 3)
    return s.groupBy("source_type", "chunk_id").agg(F.count(F.lit(1)).alias("k")).groupBy("source_type").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("ids"))


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN trim(text) = '' THEN 'blank_text' END, CASE WHEN doc_id % 6 = 0 THEN 'empty_allowed_roles' END, CASE WHEN doc_id % 5 = 0 THEN 'bad_valid_from' END,
    CASE WHEN doc_id % 5 <> 0 AND doc_id % 7 = 0 THEN 'inverted_validity' END, CASE WHEN doc_id % 11 = 0 THEN 'unknown_source_type' END], lambda x: x IS NOT NULL), ',') AS broken FROM documents""")
def schema_violations(spark, sf):
    d = F.col("doc_id")
    rows = _table(spark, sf, "documents").select(
        "doc_id", "text",
        F.when(d % 6 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("helpdesk"))).alias("allowed_roles"),
        F.when(d % 5 == 0, "2024-1-1").otherwise("2024-02-29").alias("valid_from"),
        F.when(d % 7 == 0, "2023-01-01").alias("valid_to"),
        F.when(d % 11 == 0, "rumour").otherwise("case_law").alias("source_type"),
    )
    return rows.select("doc_id", F.array_join(S.violations(rows.withColumn("doc_id", d.cast("string"))), ",").alias("broken"))


_CASE = (
    '<open-rechtspraak xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:dcterms="http://purl.org/dc/terms/"><rdf:RDF><rdf:Description><dcterms:identifier>ECLI:NL:HR:2020:{0}</dcterms:identifier>'
    "<dcterms:creator>Hoge Raad</dcterms:creator><dcterms:date>2020-05-01</dcterms:date></rdf:Description></rdf:RDF><uitspraak xmlns=\"http://www.rechtspraak.nl/schema/rechtspraak-1.0\">"
    "<section role=\"overwegingen\"><title>De gronden</title><paragroup><nr>2.1</nr><para>a.<?linebreak?>B</para></paragroup><paragroup><nr>2.2</nr><paragroup><nr>2.2.1</nr><para>tekst</para></paragroup></paragroup></section>"
    "<section><title>De feiten</title><para>Feit {0}.</para></section></uitspraak></open-rechtspraak>"
)


@query()
def xml_case_chunks(spark, sf):
    """A ruling in XML for each benchmark item, cut into chunks."""
    files = _table(spark, sf, "benchmark").select(F.concat(F.lit("/cases/"), F.col("item_id").cast("string"), F.lit(".xml")).alias("path"), F.replace(F.lit(_CASE), F.lit("{0}"), F.col("item_id").cast("string")).cast("binary").alias("content"))
    return parse_xml(files, "case_law").select("chunk_id", "citation_path", "section_type", "text", "error")


# ---- cache, evaluation, latency ----------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS double)) AS v FROM embeddings), n AS (SELECT *, sqrt(list_dot_product(v, v)) AS s FROM e),
  q AS (SELECT * FROM n WHERE vec_id % 10 = 0), c AS (SELECT * FROM n WHERE vec_id % 3 <> 0),
  m AS (SELECT q.vec_id AS query_id, c.vec_id AS seq, row_number() OVER (PARTITION BY q.vec_id ORDER BY c.vec_id) AS rn FROM q JOIN c ON q.label = c.label WHERE list_dot_product(q.v, c.v) / (q.s * c.s) >= 0.985)
  SELECT CAST(query_id AS varchar) AS query_id, seq FROM m WHERE rn = 1""")
def cache_probe_first_match(spark, sf):
    e = _table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("string").alias("namespace"), V.unit(F.col("embedding")).alias("embedding"))
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    entries = e.select("namespace", F.col("vec_id").alias("seq"), F.lit("").alias("query"), "embedding", F.lit("{}").alias("response"), F.when(F.col("vec_id") % 3 == 0, now).otherwise(now + F.expr("INTERVAL 1 DAY")).alias("expires_at"))
    asked = e.where("vec_id % 10 = 0").select(F.col("vec_id").cast("string").alias("query_id"), "namespace", "embedding")
    return C.probe(asked, entries, now).select("query_id", "seq")


@query(f"WITH {_CHUNKS} SELECT chunk_id, security_rank = 0 AND d % 2 = 0 AS may_keep FROM chunks")
def cache_cacheable(spark, sf):
    d = F.col("doc_id").cast("bigint")
    return _chunks(spark, sf).select("chunk_id", C.cacheable(F.when(d % 2 == 0, "answered").otherwise("refused"), F.array("security_rank")).alias("may_keep"))


@query(r"""SELECT conv_id, turn, conv_id % 3 <> 0 AND turn % 4 <> 3 AND conv_id % 5 <> 0
  AND NOT regexp_matches(text || CASE WHEN conv_id % 2 = 0 THEN ' ART. 3' WHEN conv_id % 7 = 0 THEN ' Lid 2' ELSE ' articles' END, '(?i)\b(?:ecli:|artikel|article|art\.?|lid|paragraph)\b') AS may_keep FROM conversations""")
def cache_may_keep(spark, sf):
    """The whole rule, on every turn as a question: answered, on relevant evidence, from public sources, and naming no exact source."""
    c = F.col("conv_id")
    asked = F.concat("text", F.when(c % 2 == 0, " ART. 3").when(c % 7 == 0, " Lid 2").otherwise(" articles"))
    outcome, grade = F.when(c % 3 != 0, "answered").otherwise("refused"), F.when(F.col("turn") % 4 != 3, "relevant").otherwise("ambiguous")
    ranks = F.when(c % 5 != 0, F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0), F.lit(2)))
    return _table(spark, sf, "conversations").select("conv_id", "turn", C.cacheable(outcome, ranks, grade, asked).alias("may_keep"))


def _cases(spark, sf) -> DataFrame:
    d = F.col("doc_id")
    kind = F.when(d % 4 == 0, "exact_lookup").when(d % 4 == 1, "semantic_lookup").when(d % 4 == 2, "unauthorized_role").otherwise("multi_part")
    return _table(spark, sf, "labels").select(
        kind.alias("category"), (F.col("quality") == 1).alias("passed"), F.when(d % 3 == 0, "refused").otherwise("answered").alias("outcome"), (d % 5 != 0).alias("citation_presence"),
        (F.col("toxic") == 1).alias("unauthorized_retrieval_failure"), (d % 7 != 0).alias("faithfulness_proxy_pass"), ((d % 11) / 10).alias("context_precision_proxy"),
    )


_METRICS = """m AS (SELECT
  avg(CASE WHEN quality = 1 THEN CAST(1 AS double) ELSE 0 END) AS answerable_vs_refused_accuracy,
  avg(CASE WHEN doc_id % 5 <> 0 THEN CAST(1 AS double) ELSE 0 END) FILTER (doc_id % 3 <> 0) AS citation_presence_rate,
  CAST(count(*) FILTER (doc_id % 4 = 2 AND toxic = 1) AS double) AS unauthorized_retrieval_failures,
  avg(CASE WHEN quality = 1 THEN CAST(1 AS double) ELSE 0 END) FILTER (doc_id % 4 = 0) AS exact_lookup_success,
  avg(CASE WHEN quality = 1 THEN CAST(1 AS double) ELSE 0 END) FILTER (doc_id % 4 = 1) AS semantic_retrieval_success,
  avg(CASE WHEN doc_id % 7 <> 0 THEN CAST(1 AS double) ELSE 0 END) FILTER (doc_id % 3 <> 0) AS faithfulness_proxy,
  avg((doc_id % 11) / CAST(10 AS double)) AS context_precision_proxy FROM labels)"""
_NAMES = [m for m, _, _ in EV.THRESHOLDS]


@query(f"WITH {_METRICS} SELECT {', '.join(f'round({n}, 9) AS {n}' for n in _NAMES)} FROM m")
def eval_metrics(spark, sf):
    return EV.metrics(_cases(spark, sf)).select(*[_r(n).alias(n) for n in _NAMES])


@query(
    f"WITH {_METRICS}, {_METRICS.replace('m AS', 'b AS', 1).replace('quality = 1', 'toxic <> 1')} "
    + " UNION ALL ".join(f"SELECT '{m}' AS metric, '{k}' AS kind, round({m}, 9) AS value, {b}::double AS bound, {m} {'<=' if k == 'max' else '>='} {b}::double AS passed FROM m" for m, k, b in EV.THRESHOLDS)
    + " UNION ALL "
    + " UNION ALL ".join(f"SELECT '{m}' AS metric, 'regression' AS kind, round(m.{m}, 9) AS value, round(b.{m} - 0.05::double, 9) AS bound, m.{m} >= b.{m} - 0.05::double AS passed FROM m, b" for m in EV.REGRESSIONS)
)
def promotion_gate(spark, sf):
    cases = _cases(spark, sf)
    before = EV.metrics(cases.withColumn("passed", ~F.col("unauthorized_retrieval_failure")))
    return EV.promotion(EV.metrics(cases), before).select("metric", "kind", _r("value").alias("value"), _r("bound").alias("bound"), "passed")


@query(rf"""WITH {_CHUNKS}, t AS (SELECT *, trim(regexp_replace(lower(citation_path), '\s+', ' ', 'g')) AS path, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS said, 'artikel ' || (d % 11) || '.' || (d % 3) AS bad FROM chunks)
  SELECT d AS doc_id, coalesce(contains(path, bad) OR contains(said, bad) OR contains(path, 'src3 > artikel 5') OR contains(said, 'src3 > artikel 5'), contains(path, bad) OR contains(path, 'src3 > artikel 5')) OR d % 50 = 7 * d % 50 AS leak FROM t""")
def leak_check(spark, sf):
    """Whether what is forbidden - two citations and an id for each document - was cited, retrieved or said."""
    d = F.col("doc_id").cast("bigint")
    bad = F.array(F.concat(F.lit("ARTIKEL  "), d % 11, F.lit("."), d % 3), F.lit("Src3 > Artikel 5"))
    return _chunks(spark, sf).select(d.alias("doc_id"), EV.leaks(F.array("citation_path"), F.array((d % 50).cast("string")), F.col("text"), bad, F.array((7 * d % 50).cast("string"))).alias("leak"))


@query("""WITH n AS (SELECT item_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM benchmark), d AS (SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM documents)
  SELECT doc_id, item_id FROM d JOIN n ON contains(d.t, substring(n.t, 1, 24)) WHERE length(n.t) >= 24""")
def faithfulness(spark, sf):
    # The benchmark is a fixed, small set.
    return EV.repeated(_table(spark, sf, "documents").select("doc_id", "text"), _table(spark, sf, "benchmark").select("item_id", "text")).select("doc_id", "item_id")


@query("""WITH s AS (SELECT list_sort(list(value)) AS v, count(*) AS cases, avg(value) AS mean, max(value) AS most, avg(CASE WHEN value <= 100 THEN CAST(1 AS double) ELSE 0 END) AS met FROM events WHERE value IS NOT NULL)
  SELECT cases, round(mean, 3) AS mean_ms, round(v[CAST(round_even((cases - 1) * 0.5, 0) AS bigint) + 1], 3) AS p50_ms, round(v[CAST(round_even((cases - 1) * 0.95, 0) AS bigint) + 1], 3) AS p95_ms, round(most, 3) AS max_ms, round(met, 3) AS target_met_rate FROM s""")
def latency_percentiles(spark, sf):
    return EV.latency_report(_table(spark, sf, "events"), "value", 100.0)


# ---- event time --------------------------------------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark, sf):
    from lexvane.streaming.events import tumbling

    return tumbling(_table(spark, sf, "events")).withColumn("total", F.round("total", 6)).withColumn("start", F.col("start").cast("timestamp_ntz") if dict(_table(spark, sf, "events").dtypes)["ts"] == "timestamp_ntz" else F.col("start"))
