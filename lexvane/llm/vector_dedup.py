"""Near-duplicate vectors by randomised-rotation binary codes with stored correction factors.

Unit vectors are turned by several random rotations and kept as sign codes. Each code stores the inner product f of the vector
with its own code; sign code times query, over f, is then an unbiased estimate of the inner product, and f also gives the width of
its confidence bound. Equal vectors are one node. Tables of ``bits`` sign bits bring together candidates within a label; in a
bucket, pairs whose upper bound lies below the threshold are passed over and all others are computed again in double precision.
A pair that meets in several tables is judged in the first of them only. Buckets answer with link counts and a spanning forest,
never with all their pairs; a large bucket is cut into blocks and every pair of blocks is a task of its own.

At the threshold's angle one table keeps two vectors together with probability (1 - angle / pi) ** bits. The bits follow the
number of vectors of the largest label (its logarithm and ``spare`` more, ``bits`` at least), so that chance meetings stay in
proportion to the rows, and the number of tables follows the bits such that all tables miss a pair at the threshold with a
probability of ``miss`` at most (closer pairs: far less). Links are exact. ``exact`` compares all blocks of a label with each
other instead: nothing is missed, at a cost that grows with the square of a label.

A task takes its buckets in order, many small ones in one call, so that the work depends on the rows and not on the buckets.

Defined cases: a vector that is null, empty, zero or holds null or non-finite components, or whose label is null, links with
nothing; labels of any atomic type are compared as text; vectors of unlike lengths never link; repeated rows are vectors of their own; a null id is never the least id of a
component unless all are null, and its row is not kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from lexvane.llm.common import lean, stored
from lexvane.llm.components import components
from lexvane.llm.tokens import ragged


@dataclass(frozen=True)
class VectorParams:
    threshold: float = 0.98
    #: Least number of sign bits of a table's key, and bits beyond the logarithm of the largest label's vectors.
    bits: int = 16
    spare: int = 4
    #: Most probable share of pairs at the threshold that no table brings together.
    miss: float = 3.5e-5
    #: Half the width of the confidence bound, in standard errors of the estimate.
    sigmas: float = 5.0
    block: int = 1024
    exact: bool = False
    seed: int = 20

    @property
    def tables(self) -> int:
        if self.exact:
            return 1
        together = (1 - math.acos(self.threshold) / math.pi) ** self.bits
        return math.ceil(math.log(self.miss) / math.log1p(-together))


@lru_cache(maxsize=8)
def rotations(dim: int, p: VectorParams) -> np.ndarray:
    """Random rotations below each other: as many as the tables' bits need."""
    rng = np.random.default_rng([p.seed, dim])
    count = math.ceil(p.bits * p.tables / dim)
    return np.concatenate([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(count)])


def encode(unit: np.ndarray, p: VectorParams) -> tuple[np.ndarray, np.ndarray]:
    """Sign bits and, for each rotation, the correction factor f."""
    dim = unit.shape[1]
    turned = unit @ rotations(dim, p).T
    factors = np.abs(turned).reshape(len(unit), -1, dim).sum(axis=2) / math.sqrt(dim)
    return turned > 0, factors


def estimate(bits: np.ndarray, factors: np.ndarray, queries: np.ndarray, p: VectorParams) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of coded vectors with queries (unit vectors), and the standard error for each coded vector."""
    dim = queries.shape[1]
    turned = (queries @ rotations(dim, p).T).astype(np.float32)
    count = factors.shape[1]
    signs = np.where(bits, 1, -1).astype(np.float32).reshape(len(bits), count, dim) / (math.sqrt(dim) * count * factors[:, :, None]).astype(np.float32)
    error = np.sqrt((np.maximum(0, 1 - factors**2) / factors**2).sum(axis=1) / max(1, dim - 1)) / count
    return signs.reshape(len(bits), -1) @ turned.T, error


_ROWS = "id long, label string, node binary, vec binary"


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's vector as bytes, of the width its components have, and a digest of label and vector."""
    for b in batches:
        nodes, vecs = [], []
        single = pa.types.is_float32(b.column(2).type.value_type)
        for label, x in zip(b.column(1).to_pylist(), b.column(2), strict=True):
            ok = label is not None and x.is_valid and x.values is not None and len(x.values) > 0 and x.values.null_count == 0
            v = x.values.to_numpy(zero_copy_only=False).astype("<f4" if single else "<f8") if ok else np.zeros(0)
            top = np.abs(v).max() if len(v) else 0.0
            ok = ok and np.isfinite(top) and top > 0
            vecs.append((v + v.dtype.type(0)).tobytes() if ok else None)
            nodes.append(hashlib.md5(f"{label} {len(v)} ".encode() + vecs[-1]).digest() if ok else None)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes, pa.binary()), pa.array(vecs, pa.binary())], ["id", "label", "node", "vec"])


def _unit(vecs: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(vecs), kind).reshape(len(vecs), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_dim(vecs: list[bytes]) -> Iterator[np.ndarray]:
    size = np.array([len(v) for v in vecs])
    for d in np.unique(size):
        yield np.flatnonzero(size == d)


def _keys(bits: np.ndarray, p: VectorParams) -> np.ndarray:
    """Each table's key: the first bits in order, ``bits`` to a table."""
    if p.exact:
        return np.zeros((len(bits), 1), np.int64)
    return bits[:, : p.bits * p.tables].reshape(len(bits), p.tables, p.bits) @ (np.int64(1) << np.arange(p.bits, dtype=np.int64))


def _codes(batches: Iterator[pa.RecordBatch], p: VectorParams, kind: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        vecs = b.column(3).to_pylist()
        for at in _by_dim(vecs):
            bits, factors = encode(_unit([vecs[k] for k in at], kind), p)
            cols = [b.column(k).take(pa.array(at)) for k in range(4)]
            cols += [pa.array([x.tobytes() for x in np.packbits(bits, axis=1)], pa.binary()), pa.array([x.tobytes() for x in factors.astype("<f4")], pa.binary()), pa.array(list(_keys(bits, p)), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["node", "label", "m", "vec", "code", "factors", "keys"])


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each member's component."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if (new == low).all():
            return low
        low = new


_PAIRS, _ALONE = 16_384, 96


class _Members:
    """Rows of whole groups, a group being two blocks of a bucket (or one block with itself), all of one dimension."""

    def __init__(self, t: pa.Table, p: VectorParams, kind: str) -> None:
        self.p, self.node, self.m = p, t["node"].to_pylist(), t["m"].to_numpy()
        self.side, self.i, self.j, self.t = (t[c].to_numpy() for c in ("side", "i", "j", "t"))
        self.unit = _unit(t["vec"].to_pylist(), kind)
        self.factors = np.frombuffer(b"".join(t["factors"].to_pylist()), "<f4").reshape(len(self.node), -1).astype(np.float64)
        packed = np.frombuffer(b"".join(t["code"].to_pylist()), np.uint8).reshape(len(self.node), -1)
        self.bits = np.unpackbits(packed, axis=1, count=self.factors.shape[1] * self.unit.shape[1]).astype(bool)
        self.keys = _keys(self.bits, p)

    def _open(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Pairs that meet in no table before this one."""
        same = self.keys[a] == self.keys[b]
        return ~(same & (np.arange(same.shape[1]) < self.t[a][:, None])).any(axis=1)

    def _linked(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs whose inner product, in double precision, reaches the threshold."""
        hit = [(self.unit[a[k : k + _PAIRS]] * self.unit[b[k : k + _PAIRS]]).sum(axis=1) >= self.p.threshold for k in range(0, len(a), _PAIRS)]
        keep = np.concatenate([*hit, np.zeros(0, bool)])
        return a[keep], b[keep]

    def dense(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Links of the group in rows lo to hi, estimates by products of matrices, a strip of rows at a time."""
        p, rows = self.p, np.arange(lo, hi)
        left, right = rows[self.side[lo:hi] == self.i[lo]], rows[self.side[lo:hi] == self.j[lo]]
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for k in range(0, len(left), 256):
            strip = left[k : k + 256]
            guess, error = estimate(self.bits[strip], self.factors[strip], self.unit[right], p)
            near = guess + p.sigmas * error[:, None] >= p.threshold
            if self.i[lo] == self.j[lo]:
                near &= strip[:, None] < right[None, :]
            x, y = np.nonzero(near)
            a, b = strip[x], right[y]
            for z in range(0, len(a), _PAIRS):
                free = self._open(a[z : z + _PAIRS], b[z : z + _PAIRS])
                found.append(self._linked(a[z : z + _PAIRS][free], b[z : z + _PAIRS][free]))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def sparse(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links of many small groups, their pairs in one list."""
        p, dim = self.p, self.unit.shape[1]
        rows = ragged(starts, ends - starts)
        after = np.repeat(ends, ends - starts) - rows - 1
        a, b = np.repeat(rows, after), ragged(rows + 1, after)
        across = (self.i[a] == self.j[a]) | (self.side[a] != self.side[b])
        a, b = a[across], b[across]
        turned, signs = (self.unit @ rotations(dim, p).T).astype(np.float32), np.where(self.bits, 1, -1).astype(np.float32)
        count = self.factors.shape[1]
        error = np.sqrt((np.maximum(0, 1 - self.factors**2) / self.factors**2).sum(axis=1) / max(1, dim - 1)) / count
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for k in range(0, len(a), _PAIRS):
            x, y = a[k : k + _PAIRS], b[k : k + _PAIRS]
            free = self._open(x, y)
            x, y = x[free], y[free]
            each = (signs[x] * turned[y]).reshape(len(x), count, dim).sum(axis=2)
            guess = (each / (math.sqrt(dim) * count * self.factors[x])).sum(axis=1)
            near = guess + p.sigmas * error[x] >= p.threshold
            found.append(self._linked(x[near], y[near]))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _judge(t: pa.Table, p: VectorParams, kind: str) -> pa.RecordBatch:
    """Links within whole groups in order: each member's number of linked vectors, and spanning forests."""
    rows = _Members(t, p, kind)
    cut = np.zeros(len(rows.node), bool)
    for c in ("t", "key", "i", "j"):
        v = t[c].to_numpy()
        cut[1:] |= v[1:] != v[:-1]
    label = pc.rank(t["label"].combine_chunks(), tiebreaker="dense").to_numpy() if t.num_rows else np.zeros(0)
    cut[1:] |= label[1:] != label[:-1]
    starts = np.concatenate([[0], np.flatnonzero(cut)])
    ends = np.concatenate([starts[1:], [len(rows.node)]])
    small = ends - starts <= _ALONE
    found = [rows.sparse(starts[small], ends[small]), *[rows.dense(lo, hi) for lo, hi in zip(starts[~small].tolist(), ends[~small].tolist(), strict=True)]]
    a, b = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    links = np.bincount(a, rows.m[b], len(rows.node)) + np.bincount(b, rows.m[a], len(rows.node))
    low = _forest(len(rows.node), a, b)
    some = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays([pa.array([rows.node[k] for k in some], pa.binary()), pa.array([rows.node[low[k]] for k in some], pa.binary()), pa.array(links[some].astype(np.int64))], ["a", "b", "links"])


_GROUP = ["label", "dim", "t", "key", "i", "j"]


def _judged(batches: Iterator[pa.RecordBatch], p: VectorParams, kind: str, most: int = 8192) -> Iterator[pa.RecordBatch]:
    """Judge sorted rows, whole groups of one dimension at a time; the last group of a batch waits for its next rows."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n < most:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        last = t.slice(n - 1)
        same = np.ones(n, bool)
        for c in _GROUP:
            same &= pc.equal(t[c], last[c][0]).to_numpy(zero_copy_only=False)
        whole = n - int(same.sum())
        yield from _by_dims(t.slice(0, whole), p, kind)
        held, n = [x for x in t.slice(whole).to_batches() if x.num_rows], n - whole
    if n:
        yield from _by_dims(pa.Table.from_batches(held), p, kind)


def _by_dims(t: pa.Table, p: VectorParams, kind: str) -> Iterator[pa.RecordBatch]:
    dims = t["dim"].to_numpy()
    for d in np.unique(dims):
        yield _judge(t.filter(pa.array(dims == d)), p, kind)


def vector_components(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", params: VectorParams = VectorParams()) -> DataFrame:
    """One row per row of ``df``: id, n_links, component_id, kept."""
    p, single = params, df.schema[vec_col].dataType == ArrayType(FloatType(), df.schema[vec_col].dataType.containsNull)
    kind = "<f4" if single else "<f8"
    src = df.select(F.col(id_col).cast("long"), F.col(label_col).cast("string"), F.col(vec_col).cast("array<float>" if single else "array<double>"))
    rows = stored(src.mapInArrow(_clean, _ROWS), "vector-rows")
    nodes = stored(rows.where("node IS NOT NULL").groupBy("node", "label").agg(F.count(F.lit(1)).alias("m"), F.any_value("vec").alias("vec"), F.min("id").alias("least")), "vector-nodes")
    most = nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]
    p = replace(p, bits=min(62, max(p.bits, math.ceil(math.log2(most)) + p.spare)))
    coded = stored(nodes.select("node", "label", "m", "vec").mapInArrow(lambda it: lean(_codes(it, p, kind)), "node binary, label string, m long, vec binary, code binary, factors binary, keys array<long>"), "vector-codes")

    # One bucket is a label, a dimension, a table and a key.
    at = coded.select("node", "label", F.octet_length("vec").alias("dim"), F.posexplode("keys").alias("t", "key"))
    bucket = ["label", "dim", "t", "key"]
    full = stored(at.groupBy(*bucket).agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "vector-buckets")
    blocks = F.ceil(F.col("size") / p.block).cast("int")
    met = at.join(full, bucket).withColumn("blocks", blocks).withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = met.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("side", "o")).withColumn("j", F.greatest("side", "o"))
    met = stored(met.select("node", *bucket, "side", "i", "j"), "vector-met")
    groups = met.join(coded.drop("label", "keys"), "node").repartition(*[F.col(c) for c in _GROUP]).sortWithinPartitions(*_GROUP)
    judged = stored(groups.mapInArrow(lambda it: lean(_judged(it, p, kind)), "a binary, b binary, links long"), "vector-links")

    roots = components(judged.select("a", "b"))
    counts = judged.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "node")
    about = nodes.select("node", "m", "least").join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    about = stored(about.select("node", "root", "least", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "vector-about")
    tops = stored(about.groupBy("root").agg(F.min("least").alias("component_id")), "vector-tops")
    about = stored(about.join(tops, "root").select("node", "n_links", "component_id"), "vector-components")
    out = rows.select("id", "node").join(about, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
