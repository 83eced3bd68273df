"""Vector functions, and the hashed text embedding."""

from __future__ import annotations

import hashlib
import re
from array import array
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexvane.functions import text as T
from lexvane.functions.phrases import matcher, slices


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def _bucket(name: str, dims: int) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "big") % dims


@lru_cache(maxsize=50_000)
def _run_bucket(run: str, dims: int) -> int:
    """The place of a run of characters: few runs make up most terms, so these are kept; terms are not."""
    return _bucket(f"tri:{run}", dims)


def _weights(value: str) -> dict[str, float]:
    low = " ".join(value.lower().split())
    out: dict[str, float] = {}
    for t in _TOKEN.findall(low):
        if t not in _STOP:
            out[t] = out.get(t, 0.0) + 1.0
    for name, phrases in T.CONCEPTS.items():
        if any(p in low for p in phrases):
            out[name] = out.get(name, 0.0) + 2.8
            for alias in T.ALIASES[name]:
                out[alias] = out.get(alias, 0.0) + 1.4
    return out


_STOP = frozenset(T.STOPWORDS)
_TOKEN = re.compile(T.TOKEN, re.I)


def hash_embedding(value: str, dims: int = 256) -> np.ndarray:
    """Unit vector of hashed terms, with each term's runs of three characters at a fifth of its weight."""
    v = np.zeros(dims)
    for term, w in _weights(value or "").items():
        v[_bucket(f"tok:{term}", dims)] += w
        bare = term.replace("concept:", "").replace("_", "").replace(" ", "")
        for g in [bare[k : k + 3] for k in range(len(bare) - 2)] if len(bare) >= 3 else [bare]:
            v[_run_bucket(g, dims)] += 0.2 * w
    size = float(np.sqrt((v * v).sum()))
    return v / size if size else v


class _Terms:
    """Places of the terms met so far, in one flat array: a term's own, then those of its runs. Forgotten when there are many."""

    most = 200_000

    def __init__(self, dims: int) -> None:
        self.dims, self.ids, self.places, self.ends = dims, {}, array("q"), array("q", [0])

    def number(self, term: str) -> int:
        n = self.ids.get(term)
        if n is None:
            n = self.ids[term] = len(self.ids)
            bare = term.replace("concept:", "").replace("_", "").replace(" ", "")
            self.places.append(_bucket(f"tok:{term}", self.dims))
            self.places.extend(_run_bucket(bare[k : k + 3], self.dims) for k in range(max(1, len(bare) - 2)))
            self.ends.append(len(self.places))
        return n


_TERMS: dict[int, _Terms] = {}


@lru_cache(maxsize=1024)
def _added(mask: int) -> tuple[tuple[str, float], ...]:
    """Terms that concepts (as bits) add to a text, with their weights."""
    return tuple(x for k, name in enumerate(T.CONCEPTS) if mask >> k & 1 for x in ((name, 2.8), *((a, 1.4) for a in T.ALIASES[name])))


def hash_embeddings(texts: list[str | None], dims: int = 256) -> np.ndarray:
    """``hash_embedding`` of many texts: each distinct term is hashed once, and the sums of all texts are one sparse sum."""
    find = matcher()
    known = _TERMS.setdefault(dims, _Terms(dims))
    if len(known.ids) > known.most:
        known = _TERMS[dims] = _Terms(dims)
    ids: list[int] = []
    weights: list[float] = []
    held = []
    for value in texts:
        low = " ".join((value or "").lower().split())
        own = Counter(_TOKEN.findall(low))
        for w in _STOP & own.keys():
            del own[w]
        added = _added(find.mask(low))
        ids += map(known.number, own)
        ids += [known.number(t) for t, _ in added]
        weights += own.values()
        weights += [w for _, w in added]
        held.append(len(own) + len(added))
    # The arrays as they are: these views end before the next term is met.
    ends, places, col = np.frombuffer(known.ends, np.int64), np.frombuffer(known.places, np.int64), np.array(ids, np.int64)
    n = ends[col + 1] - ends[col]
    before = np.cumsum(n) - n
    each = np.arange(n.sum()) + np.repeat(ends[col] - before, n)
    shares = np.full(len(each), 0.2)
    shares[before] = 1.0
    row = np.repeat(np.arange(len(texts)), held)
    v = np.bincount(np.repeat(row, n) * dims + places[each], np.repeat(np.array(weights, np.float64), n) * shares, len(texts) * dims).astype(np.float64).reshape(-1, dims)
    size = np.sqrt((v * v).sum(1, keepdims=True))
    return np.divide(v, size, out=v, where=size > 0)


def embed(c: Column, dims: int = 256) -> Column:
    """The embedding of a text column, in Arrow batches. Meant for building an index once, not for every query."""

    @F.arrow_udf("array<double>")
    def run(s: pa.Array) -> pa.Array:
        v, k = np.empty((len(s), dims)), 0
        for part in slices(s):
            v[k : k + len(part)] = hash_embeddings(part, dims)
            k += len(part)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1, dtype=np.int32) * dims), pa.array(v.ravel()))

    return run(c)
