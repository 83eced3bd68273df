"""Retrieval for batches of requests: by identifiers, by vectors, and both fused and reranked.

Each operator joins the broadcast requests with one scan of the chunks, under the access and scope condition, and ranks within
a request. Row numbers are filtered, so Spark keeps only each task's best rows before it shuffles them by request.

Results: query_id, rank, chunk (struct), one nullable column for each score, matched_terms.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from lexvane.functions import phrases as P
from lexvane.functions import text as T
from lexvane.functions.schemas import CLEARANCE
from lexvane.functions.vectors import dot, embed, hash_embeddings
from lexvane.operators.security import as_requests, local_requests, may_see, with_rank

LEXICAL_LIMIT, DENSE_LIMIT, WINDOW, FINAL, RRF_K = 50, 100, 50, 10, 60
EXACT = ["ecli_exact_match", "article_exact_match", "paragraph_exact_match", "subparagraph_exact_match", "citation_path_exact_match"]
LEXICAL = [*EXACT, "citation_path_contains_match", "lexical_score"]
CHUNK_FIELDS = ["chunk_id", "doc_id", "text", "citation_path", "source_type", "jurisdiction", "security_rank", "ecli", "decision_date", "section_type", "source_path"]


def _chunk(chunks: DataFrame) -> Column:
    return F.struct(*[F.col(c) if c in chunks.columns else F.lit(None).cast("string").alias(c) for c in CHUNK_FIELDS]).alias("chunk")


def _with_fields(chunks: DataFrame) -> DataFrame:
    out = with_rank(chunks)
    fields = ("ecli", "article", "paragraph", "subparagraph", "citation_path", "section_type", "decision_date", "source_path")
    return out.withColumns({c: F.lit(None).cast("string") for c in fields if c not in out.columns})


def top(df: DataFrame, limit: Column, *order: Column, most: int | None = None) -> DataFrame:
    """Rank within each request, and the rows up to ``limit``.

    ``most`` is the greatest limit of any request. Tasks keep only their best rows before these are shuffled where a limit is a
    number, so ``most`` (or a literal ``limit``) is what bounds what a request's one task reads.
    """
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= limit) if most is None else ranked.where((F.col("rank") <= most) & (F.col("rank") <= limit))


def most_asked(asked: DataFrame, least: int = 0) -> int:
    """The greatest ``top_k`` of requests that are local to the driver, or ``least``."""
    return max([least, *[r[0] or 0 for r in asked.select("top_k").distinct().collect()]])


#: Characters to a run of a citation path that finds candidates for a part of it.
GRAM = 3
_BY_ECLI, _BY_ARTICLE, _BY_PATH, _BY_PART = range(4)


def _key(kind: int, value: Column) -> Column:
    return F.xxhash64(F.lit(kind), value)


def _runs(text: Column, size: int) -> Column:
    """Every run of ``size`` characters of a text, once; none of a shorter one."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def telling_run(text: Column, size: int = GRAM) -> Column:
    """The run of a text by which texts that hold it are looked for: with most digits, then least spaces, then the last.

    Every text that holds ``text`` has each of its runs, so any would do; this one is in few citation paths.
    """
    runs = F.transform(_runs(text, size), lambda g: F.struct(F.length(F.regexp_replace(g, "[^0-9]", "")).alias("d"), (-F.length(F.regexp_replace(g, "[^ ]", ""))).alias("s"), g.alias("g")))
    return F.when(F.length(text) >= size, F.array_max(runs)["g"]).otherwise(text)


def posting_keys(chunks: DataFrame, sizes: list[int]) -> Column:
    """Keys of a chunk: its ECLI, article and path, and every run of its path of these sizes. ``chunks`` has path_norm."""
    exact = F.array(F.when(F.col("ecli").isNotNull(), _key(_BY_ECLI, F.upper("ecli"))), F.when(F.col("article").isNotNull(), _key(_BY_ARTICLE, F.col("article"))), F.when(F.col("path_norm") != "", _key(_BY_PATH, F.col("path_norm"))))
    runs = [F.transform(_runs(F.col("path_norm"), n), lambda g: _key(_BY_PART, g)) for n in sizes]
    return F.concat(F.array_compact(exact), *runs)


def lexical(requests: DataFrame, chunks: DataFrame, least: int = 0, clearance: dict[str, str] = CLEARANCE) -> DataFrame:
    """Exact identifiers and citation paths. The best max(top_k, least) of each request.

    Chunks are cut into keys in one scan and meet the requests' keys in one hash join: ECLI, article, whole path, and for parts of
    paths one telling run of the query. What meets is then compared in full; of the keys by which a request and a chunk meet, the
    first that holds counts, so nothing has to be made distinct.
    """
    terms = requests.withColumn("terms", T.query_terms(F.col("query"))).withColumn("norm", T.match_norm(F.col("query")))
    asked = local_requests(terms)
    # A query shorter than a run is a run of its own size.
    sizes = sorted({min(GRAM, r[0]) for r in asked.select(F.length("norm")).collect() if r[0]})
    keys = F.array_distinct(F.array_compact(F.array(F.when(F.col("terms.ecli").isNotNull(), _key(_BY_ECLI, F.col("terms.ecli"))), F.when(F.col("terms.article").isNotNull(), _key(_BY_ARTICLE, F.col("terms.article"))), F.when(F.col("norm") != "", _key(_BY_PATH, F.col("norm"))), F.when(F.col("norm") != "", _key(_BY_PART, telling_run(F.col("norm")))))))
    # The telling run goes with the request, and what meets is held against it.
    sought = as_requests(asked.withColumn("run", telling_run(F.col("norm"))).withColumn("key", F.explode(keys)))
    c = _with_fields(chunks).withColumn("path_norm", T.match_norm(F.col("citation_path")))
    cut = c.withColumn("_held", F.explode_outer(posting_keys(c, sizes)))
    t = lambda name: F.col(f"q_terms.{name}")
    article = F.coalesce(t("article") == F.col("article"), F.lit(False))
    wrong_paragraph = t("paragraph").isNotNull() & ~F.coalesce(F.col("paragraph") == t("paragraph"), F.lit(False))
    wrong_sub = t("subparagraph").isNotNull() & (T.subparagraph_norm(F.col("subparagraph")) != t("subparagraph"))
    path_same = (F.col("q_norm") != "") & (F.col("q_norm") == F.col("path_norm"))
    path_part = (F.col("q_norm") != "") & ~path_same & F.contains("path_norm", "q_norm")
    ecli = F.coalesce(t("ecli") == F.upper("ecli"), F.lit(False))
    first = F.when(ecli, _key(_BY_ECLI, t("ecli"))).when(article, _key(_BY_ARTICLE, t("article"))).when(path_same, _key(_BY_PATH, F.col("q_norm"))).when(path_part, _key(_BY_PART, F.col("q_run")))
    met = cut.join(sought, F.col("_held") == F.col("q_key")).where((F.col("_held") == first) & ~(article & (wrong_paragraph | wrong_sub)) & may_see(clearance))
    scored = met.select(
        "query_id", "q_top_k", _chunk(c),
        F.when(ecli, 300.0).alias(EXACT[0]),
        F.when(article, 120.0).alias(EXACT[1]),
        F.when(article & t("paragraph").isNotNull(), 20.0).alias(EXACT[2]),
        F.when(article & t("subparagraph").isNotNull(), 10.0).alias(EXACT[3]),
        F.when(path_same, 95.0).alias(EXACT[4]),
        F.when(path_part, 55.0).alias("citation_path_contains_match"),
        F.array_distinct(F.array_compact(F.array(
            F.when(ecli, t("ecli")),
            F.when(article, F.concat(F.lit("article:"), t("article"))),
            F.when(article & t("paragraph").isNotNull(), F.concat(F.lit("paragraph:"), t("paragraph"))),
            F.when(article & t("subparagraph").isNotNull(), F.concat(F.lit("subparagraph:"), t("subparagraph"))),
            F.when(path_same | path_part, F.concat(F.lit("citation:"), F.col("q_norm"))),
        ))).alias("matched_terms"),
    )
    total = sum((F.coalesce(F.col(x), F.lit(0.0)) for x in LEXICAL[:-1]), F.lit(0.0))
    scored = scored.withColumn("lexical_score", total)
    return top(scored, F.greatest(F.col("q_top_k"), F.lit(least)), F.desc("lexical_score"), F.col("chunk.chunk_id"), most=most_asked(asked, least)).drop("q_top_k")


def embedding_text() -> Column:
    """What of a chunk is embedded: its citation, text and identifiers."""
    return T.joined(*[F.coalesce(F.col(x), F.lit("")) for x in ("citation_path", "text", "article", "ecli", "section_type", "source_type")])


def indexed(chunks: DataFrame) -> DataFrame:
    """Chunks with the embedding of their text and citation. Written once; retrieval reads it."""
    return _with_fields(chunks).withColumn("embedding", embed(embedding_text()))


def with_vectors(requests: DataFrame) -> DataFrame:
    """Requests with an ``embedding``: the one they have, or that of their query. Requests are few, so the driver embeds them."""
    if "embedding" in requests.columns:
        return requests
    rows = local_requests(requests).toArrow()
    vectors = pa.array(list(hash_embeddings(rows["query"].to_pylist())), pa.list_(pa.float64()))
    return requests.sparkSession.createDataFrame(rows.append_column("embedding", vectors), StructType([*requests.schema.fields, StructField("embedding", ArrayType(DoubleType()))]))


def dense(requests: DataFrame, chunks: DataFrame, least: int = 0, clearance: dict[str, str] = CLEARANCE) -> DataFrame:
    """Inner product of unit vectors. ``chunks`` has an ``embedding``; requests without one get the embedding of their query.

    Requests whose vector is zero get no results.
    """
    # A query without a single term has the zero vector: no chunk is near it.
    asked = local_requests(with_vectors(requests).where(F.exists("embedding", lambda x: x != 0)))
    c = _with_fields(chunks)
    met = c.join(as_requests(asked), may_see(clearance))
    scored = met.select("query_id", "q_top_k", _chunk(c), dot(F.col("embedding"), F.col("q_embedding")).alias("dense_score"))
    return top(scored, F.greatest(F.col("q_top_k"), F.lit(least)), F.desc("dense_score"), F.col("chunk.chunk_id"), most=most_asked(asked, least)).drop("q_top_k")


# Vectors to a slice of the table and to a block of queries that meet in one call.
SLICE, BLOCK = 4096, 256


def _packed(vectors: DataFrame, id_col: str, vector_col: str, size: int, at: str, rows: str) -> DataFrame:
    """Rows dealt by a hash of their id into lists of about ``size``: ``at`` and the list ``rows`` of (id, v)."""
    parts = max(1, -(-vectors.count() // size))
    dealt = vectors.select(F.pmod(F.xxhash64(id_col), F.lit(parts)).alias(at), F.struct(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).alias("r"))
    return dealt.groupBy(at).agg(F.collect_list("r").alias(rows))


def _matrix(rows: pa.StructArray) -> tuple[pa.Array, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Ids, and for each length of vector the places and the unit vectors; vectors that are null, zero or hold a null have none."""
    v = rows.field("v")
    ends, bad = np.asarray(v.offsets), np.asarray(v.is_null())
    flat = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
    if v.values.null_count:
        holes = np.flatnonzero(np.asarray(v.values.is_null()))
        bad = bad.copy()
        bad[np.searchsorted(ends, holes, "right") - 1] = True
    length, out = np.diff(ends), {}
    for n in np.unique(length[~bad]):
        at = np.flatnonzero(~bad & (length == n))
        m = flat[ends[at][:, None] + np.arange(n)]
        size = np.sqrt((m * m).sum(1))
        there = size != 0
        out[int(n)] = at[there], m[there] / size[there, None]
    return rows.field("id"), out


def _best(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for slice_, block in zip(b.column(0), b.column(1), strict=True):
            ids, of = _matrix(slice_.values)
            asked, qs = _matrix(block.values)
            score = np.zeros((len(asked), len(ids)))
            for n, (at, m) in qs.items():
                if n in of:
                    score[np.ix_(at, of[n][0])] = np.round(m @ of[n][1].T, 9)
            by_id = np.argsort(ids.fill_null(-(2**63)).to_numpy(), kind="stable")
            score = np.where(np.isnan(score), np.inf, score)[:, by_id]
            least = -np.partition(-score, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
            rows, places = [], []
            for i, s in enumerate(score):
                near = np.flatnonzero(s >= least[i])
                near = near[np.argsort(-s[near], kind="stable")][:k]
                rows.append(np.full(len(near), i))
                places.append(near)
            row, place = np.concatenate(rows), np.concatenate(places)
            found = score[row, place]
            yield pa.RecordBatch.from_arrays([asked.take(pa.array(row)), ids.take(pa.array(by_id[place])), pa.array(np.where(np.isinf(found), np.nan, found))], ["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, asked: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` rows of ``vectors`` of highest cosine to each row of ``asked``, itself included: query_id, vec_id, score, rank.

    Every row of ``asked`` meets every row of ``vectors``. Both are packed, blocks of queries with slices of vectors, so that nothing
    has to be broadcast whole and each pair of packs answers with ``k`` rows a query. Scores are rounded to nine places; ties go
    to the lower id; a vector that is null, zero or of another length has the score 0.
    """
    met = _packed(vectors, id_col, vector_col, SLICE, "_s", "of").join(_packed(asked, id_col, vector_col, BLOCK, "_b", "by"), F.lit(True)).select("of", "by")
    kind = vectors.schema[id_col].dataType.simpleString()
    found = met.mapInArrow(lambda it: _best(it, k), f"query_id {kind}, vec_id {kind}, score double")
    return top(found, F.lit(k), F.desc("score"), F.col("vec_id"))


def fuse(requests: DataFrame, by_terms: DataFrame, by_vectors: DataFrame, k: int = RRF_K, window: int = WINDOW) -> DataFrame:
    """Reciprocal-rank fusion. On identifier queries exact hits come first, and where there are any the others go."""
    double, share = F.lit(None).cast("double"), 1.0 / (k + F.col("rank"))
    a = by_terms.withColumns({"dense_score": double, "rrf_lexical": share, "rrf_dense": double})
    b = by_vectors.withColumns({"rrf_dense": share, "rrf_lexical": double, "matched_terms": F.lit(None).cast("array<string>"), **dict.fromkeys(LEXICAL, double)})
    both = a.unionByName(b)
    scores = [*LEXICAL, "dense_score"]
    one = both.groupBy("query_id", F.col("chunk.chunk_id").alias("chunk_id")).agg(
        F.any_value("chunk").alias("chunk"),
        *[F.max(s).alias(s) for s in scores],
        F.sum("rrf_lexical").alias("rrf_lexical"),
        F.sum("rrf_dense").alias("rrf_dense"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("matched_terms")))).alias("matched_terms"),
    )
    exact = sum((F.coalesce(F.col(s), F.lit(0.0)) for s in EXACT), F.lit(0.0))
    one = one.withColumns({"rrf_score": F.coalesce("rrf_lexical", F.lit(0.0)) + F.coalesce("rrf_dense", F.lit(0.0)), "exact_priority": exact})
    one = one.join(F.broadcast(requests.select("query_id", "query", "top_k")), "query_id").withColumn("by_identifier", T.is_identifier_query(F.col("query")))
    first = F.when(F.col("by_identifier"), F.col("exact_priority")).otherwise(0.0)
    one = one.withColumn("most_exact", F.max("exact_priority").over(Window.partitionBy("query_id"))).where(~(F.col("by_identifier") & (F.col("most_exact") > 0) & (F.col("exact_priority") <= 0)))
    return top(one, F.greatest("top_k", F.lit(window)), first.desc(), F.desc("rrf_score"), F.col("chunk_id")).drop("most_exact", "chunk_id")


# Weights of the reranker's signals.
WEIGHTS = {"concept": 0.32, "lexical": 0.26, "dense": 0.16, "exact": 0.12, "rrf": 0.08, "bonus": 0.08, "most_bonus": 0.16}


def deterministic(results: DataFrame) -> DataFrame:
    """Adds rerank_score and its parts. ``results`` has query, chunk and the fused scores."""
    w, c = WEIGHTS, lambda x: F.col(f"chunk.{x}")
    shown = T.joined(*[F.coalesce(c(x), F.lit("")) for x in ("citation_path", "text", "source_type", "section_type")])
    df = results.withColumn("_over", P.overlaps(F.col("query"), shown))
    has = lambda k: F.array_contains("_over.asked", k)
    rule = F.when(has("concept:thirty_percent_ruling"), w["bonus"]).otherwise(0.0) + F.when(has("concept:employment_change") & has("concept:employer"), w["bonus"]).otherwise(0.0)
    general = (c("source_type") == "legislation") & ~T.matches(F.col("query"), T.IDENTIFIER_STRICT)
    df = (
        df.withColumn("rerank_concept_overlap", F.col("_over.concept"))
        .withColumn("rerank_lexical_overlap", F.col("_over.lexical"))
        .withColumn("rerank_dense_signal", F.coalesce("dense_score", F.lit(0.0)))
        .withColumn("rerank_source_bonus", F.when(general, F.least(rule, F.lit(w["most_bonus"]))).otherwise(0.0))
    )
    score = (
        w["concept"] * F.col("rerank_concept_overlap")
        + w["lexical"] * F.col("rerank_lexical_overlap")
        + w["dense"] * F.col("rerank_dense_signal")
        + w["exact"] * F.least(F.coalesce("lexical_score", F.lit(0.0)) / 100.0, F.lit(1.0))
        + w["rrf"] * F.least(F.col("rrf_score") / 0.03, F.lit(1.0))
        + F.col("rerank_source_bonus")
    )
    return df.withColumn("rerank_score", score).drop("_over")


def cross_encoder(load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]]) -> Callable[[DataFrame], DataFrame]:
    """A reranker from a model of pairs (query, citation and text). ``load`` runs once for each worker's iterator."""

    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        predict = load()
        for q, t in batches:
            yield pd.Series(predict(list(zip(q, t, strict=True))), dtype="float64")

    def rerank(results: DataFrame) -> DataFrame:
        from pyspark.sql.functions import pandas_udf

        @pandas_udf("double")
        def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            yield from score(batches)

        pair = F.concat_ws("\n", "chunk.citation_path", "chunk.text")
        return results.withColumn("rerank_score", scored(F.col("query"), pair)).withColumn("rerank_concept_overlap", F.lit(0.0)).withColumn("rerank_lexical_overlap", F.lit(0.0))

    return rerank


# Fixed value: the model that is loaded where none is given.
CROSS_ENCODER = "BAAI/bge-reranker-v2-m3"


def load_cross_encoder(model: str = CROSS_ENCODER) -> Callable[[list[tuple[str, str]]], list[float]]:
    """The predictor of an installed cross-encoder package; RuntimeError where there is none."""
    try:
        from sentence_transformers import CrossEncoder
    except ImportError as e:
        raise RuntimeError("the cross_encoder reranker needs the package sentence-transformers on every worker") from e
    return CrossEncoder(model).predict


RERANKERS: dict[str, Callable[[DataFrame], DataFrame]] = {"deterministic": deterministic, "cross_encoder": cross_encoder(load_cross_encoder)}


def reranker(name: str) -> Callable[[DataFrame], DataFrame]:
    if name not in RERANKERS:
        raise ValueError(f"unknown reranker {name!r}; known: {', '.join(sorted(RERANKERS))}")
    return RERANKERS[name]


Search = Callable[[DataFrame, int, dict[str, str]], DataFrame]


def hybrid(requests: DataFrame, chunks: DataFrame, rerank: Callable[[DataFrame], DataFrame] | None = deterministic, clearance: dict[str, str] = CLEARANCE, by_terms: Search | None = None, by_vectors: Search | None = None) -> DataFrame:
    """Both ways fused; queries without identifiers reranked within the window; top_k of each request.

    ``by_terms`` and ``by_vectors`` are searches of an index, in place of scans of the chunks.
    """
    terms = by_terms(requests, LEXICAL_LIMIT, clearance) if by_terms else lexical(requests, chunks, LEXICAL_LIMIT, clearance)
    vectors = by_vectors(requests, DENSE_LIMIT, clearance) if by_vectors else dense(requests, chunks, DENSE_LIMIT, clearance)
    fused = fuse(requests, terms, vectors)
    if rerank is None:
        return fused.where(F.col("rank") <= F.col("top_k")).drop("query", "top_k")
    scored = rerank(fused)
    own = [c for c in scored.columns if c.startswith("rerank_")]
    scored = scored.select(*[F.when(~F.col("by_identifier"), F.col(c)).alias(c) if c in own else F.col(c) for c in scored.columns])
    order = [F.desc_nulls_last("rerank_score"), F.when(F.col("by_identifier"), F.col("rank")), F.col("chunk.chunk_id")]
    return top(scored.withColumnRenamed("rank", "fused_rank").withColumn("rank", F.col("fused_rank")), F.col("top_k"), *order).drop("query", "top_k", "fused_rank")
