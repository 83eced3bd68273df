"""An approximate index of vectors: every row stands in the cell of its nearest centre, and a search reads the nearest cells alone.

The centres are fitted on a bounded sample; the index has every row. ``nearest`` in ``retrieval`` is the exact search beside it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexvane.functions.vectors import dot, unit
from lexvane.operators.retrieval import top

#: Rows that the centres are fitted on, at most.
SAMPLE = 50_000


def usable(v: Column) -> Column:
    """Whether a vector has a direction: no null, no component that is null or not finite, not all zero."""
    d = v.cast("array<double>")
    fine = F.forall(d, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(d, lambda x: x != 0)
    return F.coalesce(fine, F.lit(False))


def _lloyd(batches: Iterator[pa.RecordBatch], cells: int, seed: int, rounds: int = 10) -> Iterator[pa.RecordBatch]:
    """Unit centres of one partition's vectors, a row each: spherical k-means in blocks of vectors."""
    parts = [np.asarray(b.column(0).flatten(), np.float32).reshape(b.num_rows, -1) for b in batches if b.num_rows]
    if not parts:
        return
    x = np.concatenate(parts)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:cells]].copy()
    for _ in range(rounds):
        sums, counts = np.zeros_like(centres), np.zeros(len(centres), np.int64)
        for k in range(0, len(x), 4096):
            part = x[k : k + 4096]
            near = np.argmax(part @ centres.T, axis=1)
            np.add.at(sums, near, part)
            counts += np.bincount(near, minlength=len(centres))
        empty = np.flatnonzero(counts == 0)
        sums[empty] = x[rng.integers(0, len(x), len(empty))]
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    out = centres.astype(np.float64)
    yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.list_(pa.float64()))], ["centre"])


def fit_cells(vectors: DataFrame, cells: int, vector_col: str = "embedding", sample: int = SAMPLE, seed: int = 7) -> np.ndarray:
    """Unit centres of ``cells`` groups (cells x dimensions), from about ``sample`` rows at most, in one task. Vectors have one length."""
    good = vectors.where(usable(F.col(vector_col))).select(F.col(vector_col).cast("array<double>").alias("v"))
    n = good.count()
    if not n:
        return np.zeros((0, 0))
    some = good if n <= sample else good.sample(sample / n, seed)
    # In the order of a hash, so that the centres do not depend on how the rows lie.
    rows = some.orderBy(F.xxhash64("v")).coalesce(1).mapInArrow(lambda it: _lloyd(it, min(cells, n), seed), "centre array<double>").collect()
    return np.array([r["centre"] for r in rows])


def _nearest_cells(vectors: DataFrame, centres: np.ndarray, vector_col: str, n: int) -> DataFrame:
    """Adds ``cells``, the ``n`` nearest centres. The centres go to each task: cells x dimensions numbers, set by a parameter."""

    @F.pandas_udf("array<int>")
    def near(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in batches:
            if len(v):
                score = np.stack(v.to_numpy()).astype(np.float64) @ centres.T
                yield pd.Series(list(np.argsort(-score, axis=1, kind="stable")[:, :n].astype(np.int32)))
            else:
                yield pd.Series([], dtype=object)

    return vectors.withColumn("cells", near(F.col(vector_col)))


def write_cells(vectors: DataFrame, centres: np.ndarray, path: str, id_col: str = "vec_id", vector_col: str = "embedding", mode: str = "overwrite") -> None:
    """Every row with a direction, as a unit vector, in folders by cell. Rows without one are near nothing and are not stored."""
    rows = vectors.where(usable(F.col(vector_col))).select(F.col(id_col).alias("id"), unit(F.col(vector_col).cast("array<double>")).alias("v"))
    if not len(centres):
        rows.withColumn("cell", F.lit(0)).write.mode(mode).partitionBy("cell").parquet(path)
        return
    placed = _nearest_cells(rows, centres, "v", 1).withColumn("cell", F.get("cells", 0)).drop("cells")
    # Rows of a cell are brought together in several tasks, so that a large cell is no single task.
    placed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).write.mode(mode).partitionBy("cell").parquet(path)


def _met(index: DataFrame, centres: np.ndarray, asked: DataFrame, probes: int, id_col: str, vector_col: str) -> DataFrame:
    """Queries and the rows of their nearest cells: query_id, vec_id, score, and which of its cells it was (``nth``, from 0)."""
    q = asked.where(usable(F.col(vector_col))).select(F.col(id_col).alias("query_id"), unit(F.col(vector_col).cast("array<double>")).alias("w"))
    q = _nearest_cells(q, centres, "w", probes).select("query_id", "w", F.posexplode("cells").alias("nth", "cell"))
    return index.join(q, "cell").select("query_id", F.col("id").alias("vec_id"), F.round(dot(F.col("v"), F.col("w")), 9).alias("score"), "nth")


def probes_for(index: DataFrame, centres: np.ndarray, some: DataFrame, k: int, recall: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> int:
    """The least number of cells to read so that ``recall`` of the true ``k`` nearest rows of the queries ``some`` are met.

    ``some`` is a bounded sample of queries: each is compared with every row. Vectors without groups need most of the cells.
    """
    true = top(_met(index, centres, some, len(centres), id_col, vector_col), F.lit(k), F.desc("score"), F.col("vec_id"))
    n = dict(true.groupBy("nth").count().collect())  # a row for each cell at most
    share = np.cumsum([n.get(i, 0) for i in range(len(centres))]) / max(1, sum(n.values()))
    return int(np.searchsorted(share, recall)) + 1 if n else len(centres)


def search_cells(index: DataFrame, centres: np.ndarray, asked: DataFrame, k: int, probes: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` indexed rows of highest cosine to each row of ``asked`` in its ``probes`` nearest cells: query_id, vec_id, score, rank.

    Scores are exact, rounded to nine places; ties go to the lower id. With as many probes as cells the search is exact. Queries
    without a direction get nothing.
    """
    if not len(centres):
        return index.select(F.col("id").alias("query_id"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"), F.lit(1).alias("rank")).where("false")
    met = _met(index, centres, asked, probes, id_col, vector_col).drop("nth")
    return top(met, F.lit(k), F.desc("score"), F.col("vec_id"))
