"""A cache of answers: probe by namespace, similarity and expiry; what may be kept; expiry and removal.

The cache is a table: namespace, seq, query, embedding, response (JSON), expires_at; entries that carry ``keys`` are probed without
computing these again. A probe looks only at entries that share a key with the request: keys are the sides of random planes on which
a vector lies, ``BITS`` planes to a key. Two vectors at the threshold share a plane's side with probability 0.945, so one of ``TABLES``
keys with 1 - 1.3e-5; ``exact`` compares all entries of a namespace.
"""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexvane.functions.text import matches
from lexvane.functions.vectors import dot

SIMILARITY, TTL_SECONDS = 0.985, 86_400
BITS, TABLES = 12, 16
CACHE = "namespace string, seq long, query string, embedding array<double>, response string, expires_at timestamp"


def namespace(role: Column, jurisdiction: Column, corpus: str, retrieval: str, generator: str, scope: Column, top_k: Column | None = None) -> Column:
    """Digest of everything an answer depends on besides its query; the scope in sorted order. top_k counts too.

    ``corpus``, ``retrieval`` and ``generator`` name versions: of the chunks, of the ways of search with their reranker and embedding,
    and of the answers' wording.
    """
    key = F.struct(role.alias("role"), jurisdiction.alias("jurisdiction"), F.lit(corpus).alias("corpus"), F.lit(retrieval).alias("retrieval"), F.lit(generator).alias("generator"), F.sort_array(scope).alias("scope"), (F.lit(None).cast("int") if top_k is None else top_k).alias("top_k"))
    return F.sha2(F.to_json(key, {"ignoreNullFields": "false"}), 256)


# Fixed value: what names an exact source in a question; answers to such questions are not shared with similar ones.
NAMES_SOURCE = r"\b(?:ecli:|artikel|article|art\.?|lid|paragraph)\b"


def cacheable(outcome: Column, security_ranks: Column, grade: Column | None = None, query: Column | None = None) -> Column:
    """Answers alone, and only those whose cited sources are all public.

    With ``grade``: only those on relevant evidence. With ``query``: only those to questions that name no exact source.
    """
    public = F.coalesce(F.size(security_ranks) > 0, F.lit(False)) & F.coalesce(F.forall(security_ranks, lambda r: r == 0), F.lit(False))
    may = (outcome == "answered") & public
    if grade is not None:
        may &= F.coalesce(grade == "relevant", F.lit(False))
    return may if query is None else may & ~F.coalesce(matches(query, NAMES_SOURCE), F.lit(False))


def live(cache: DataFrame, now: Column) -> DataFrame:
    return cache.where(F.col("expires_at") > now)


@lru_cache(maxsize=16)
def _planes(dims: int) -> np.ndarray:
    return np.random.default_rng([11, dims]).normal(size=(dims, TABLES * BITS))


def _keys(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        out: list = [None] * len(s)
        for k, v in enumerate(s):
            if v is not None and len(v):
                side = np.nan_to_num(np.asarray(v, np.float64)) @ _planes(len(v)) > 0
                out[k] = side.reshape(TABLES, BITS) @ (1 << np.arange(BITS)) + (np.arange(TABLES) << BITS)
        yield pd.Series(out, dtype=object)


def sign_keys(embedding: Column) -> Column:
    """Keys of a vector, one of each table; null for a null vector."""
    return F.pandas_udf(_keys, "array<long>")(embedding.cast("array<double>"))


def probe(requests: DataFrame, cache: DataFrame, now: Column, threshold: float = SIMILARITY, exact: bool = False) -> DataFrame:
    """The first entry put in, among the live ones of the namespace that are similar enough. Requests: query_id, namespace, embedding."""
    keyed = cache if exact or "keys" in cache.columns else cache.withColumn("keys", sign_keys(F.col("embedding")))
    e = live(keyed, now).select("namespace", "seq", F.col("query").alias("cached_query"), F.col("embedding").alias("e"), "response", *[F.explode("keys").alias("key")] * (not exact))
    asked = requests.select("query_id", "namespace", "embedding")
    if not exact:
        asked = asked.withColumn("key", F.explode(sign_keys(F.col("embedding"))))
    met = asked.join(e, ["namespace"] if exact else ["namespace", "key"]).withColumn("similarity", dot(F.col("embedding"), F.col("e"))).where(F.col("similarity") >= threshold)
    # An entry met by several keys is one entry: the first is taken anyway.
    first = met.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("seq", "cached_query", "response"))).where("n = 1")
    return first.select("query_id", "seq", "cached_query", "similarity", "response")


#: Places for entries between two ticks of the clock.
_EACH_TICK = 4096


def sequence(now: Column) -> Column:
    """Numbers of the entries of one put: by the clock, and within the put by their order."""
    nth = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.monotonically_increasing_id()))  # a batch of answers
    return F.unix_micros(now) * _EACH_TICK + nth - 1


def put(cache: DataFrame, answers: DataFrame, now: Column, ttl: int = TTL_SECONDS) -> DataFrame:
    """The live cache with the cacheable answers after it.

    Answers: namespace, query, embedding, outcome, security_ranks, response; with a grade, the whole rule of what may be kept holds.
    """
    last = cache.agg(F.coalesce(F.max("seq"), F.lit(0).cast("long"))).first()[0]
    whole = [F.col("grade"), F.col("query")] if "grade" in answers.columns else []
    new = answers.where(cacheable(F.col("outcome"), F.col("security_ranks"), *whole))
    new = new.select("namespace", (F.lit(last + 1) + F.monotonically_increasing_id()).cast("long").alias("seq"), "query", "embedding", "response", (now + F.expr(f"INTERVAL {ttl} SECONDS")).alias("expires_at"))
    return live(cache, now).unionByName(new)


def cleared(cache: DataFrame, gone: str) -> DataFrame:
    return cache.where(F.col("namespace") != gone)


def tolerant(raw: Column) -> Column:
    """An entry from its JSON, or null where it can't be read."""
    return F.from_json(raw, "query string, embedding array<double>, response string, expires_at double", {"mode": "PERMISSIVE"})


class TableCache:
    """Answers kept as Parquet in a folder that sessions share, by the day they expire on and by namespace.

    A put writes a folder of its own, so that puts at one time do not clear each other's unfinished files; a probe reads the folders of its namespaces alone; what expired goes by whole days.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _hadoop(self, *parts: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def entries(self) -> DataFrame:
        fs, at = self._hadoop()
        if not fs.exists(at):
            return self.spark.createDataFrame([], f"{CACHE}, keys array<long>")
        return self.spark.read.schema(f"{CACHE}, keys array<long>, put string, day date").parquet(self.path).where(F.col("day") >= F.current_date()).drop("put", "day")

    def get(self, requests: DataFrame, now: Column | None = None, threshold: float = SIMILARITY, exact: bool = False) -> DataFrame:
        """As ``probe``. Requests: query_id, namespace, embedding; their namespaces decide which folders are read."""
        names = [r[0] for r in requests.select("namespace").distinct().collect()]  # one for each kind of request in a batch
        return probe(requests, self.entries().where(F.col("namespace").isin(names)), F.current_timestamp() if now is None else now, threshold, exact)

    def put(self, answers: DataFrame, now: Column | None = None, ttl: int = TTL_SECONDS) -> None:
        """Appends the answers that may be kept. Columns as for the function ``put``, with the grade; entries are in order of time."""
        now = F.current_timestamp() if now is None else now
        may = answers.where(cacheable(F.col("outcome"), F.col("security_ranks"), F.col("grade"), F.col("query")))
        new = may.select("namespace", sequence(now).alias("seq"), "query", "embedding", "response", (now + F.expr(f"INTERVAL {ttl} SECONDS")).alias("expires_at"))
        new.withColumn("keys", sign_keys(F.col("embedding"))).withColumn("day", F.to_date("expires_at")).write.partitionBy("day", "namespace").parquet(f"{self.path}/put={uuid.uuid4().hex}")

    def clear(self, namespace: str) -> None:
        """Removes the entries of one namespace."""
        fs, at = self._hadoop(f"put=*/day=*/namespace={namespace}")
        for found in fs.globStatus(at) or []:
            fs.delete(found.getPath(), True)

    def purge(self, today: datetime.date | None = None) -> None:
        """Removes the days on which everything has expired."""
        fs, at = self._hadoop("put=*/day=*")
        for found in fs.globStatus(at) or []:
            if found.getPath().getName().removeprefix("day=") < (today or datetime.date.today()).isoformat():
                fs.delete(found.getPath(), True)


BACKENDS = {"none": None, "disabled": None, "off": None, "in_memory": "table", "memory": "table", "redis": "table"}


def backend(name: str, enabled: bool = True) -> str | None:
    """What a configured name stands for: no cache, or the cache table."""
    if name not in BACKENDS:
        raise ValueError(f"unknown cache backend {name!r}")
    return BACKENDS[name] if enabled else None
