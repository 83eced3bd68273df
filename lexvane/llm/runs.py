r"""Periodic runs of words, by divide and conquer over a text's words.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), of at least max(``min_length``,
``times`` * q) words, that no neighbouring word extends with the same period. Words are ``[^\x20\x09-\x0D]+``.

Words are interned as ids. A text is halved again and again; at each midpoint two Z-functions, of right # left and of reversed
left # reversed right, say for every period at once how far the words agree to both sides with those a period later. What agrees
long enough is a crossing repetition; where the agreement reaches a whole half it is extended by the Z-values behind it. A run that
lies on several midpoints, or that a multiple of its period finds too, is one interval with its smallest period.

In a run, as many words as ``_least_match`` gives agree with those one period later. So a half without a sequence of that many
words that comes back within the text holds no run and is not looked into: rolling hashes of a whole Arrow batch find such
sequences by one sort. That only spares work: each run is within the halves that are looked into.

A row is one text and needs no other row, so the operator is one pass without a shuffle, and a lost task is one scan again.

Defined cases: a null text has no words, no runs and an empty collapsed text; texts of any length are read whole, in memory that
follows the longest text of a batch; repeated rows give repeated results; an empty table gives an empty result; other columns pass
through, and the operator's own columns get underscores in front where their names are taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as S

from lexvane.llm.common import lean, unused_name

#: Bytes of text that are interned and hashed together.
_SLICE = 8 << 20


@dataclass(frozen=True)
class RunParams:
    min_length: int = 24
    times: int = 3


def _least_match(p: RunParams) -> int:
    """The fewest words of a run that agree with those a period later."""
    return min(max(p.min_length - q, (p.times - 1) * q) for q in range(1, p.min_length + 1))


def z_function(s: list[int]) -> list[int]:
    """For each place, how many elements from there agree with those from the start; the length at place 0."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[i + k] == s[k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _crossing(ids: list[int], lo: int, hi: int, p: RunParams) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of repetitions in [lo, hi) on both sides of its midpoint, as far as they reach within [lo, hi)."""
    mid = (lo + hi) // 2
    left, right = ids[lo:mid], ids[mid:hi]
    ahead = np.array(z_function([*right, -1, *left, -2]))
    back = np.array(z_function([*left[::-1], -1, *right[::-1], -2]))
    most = (hi - lo) // p.times
    # Words from the midpoint on against those q later. Where all q words before the midpoint agree too, what stands before them counts.
    q = np.arange(1, min(most, len(right)) + 1)
    before = back[len(left) + 1 + len(right) - q]
    behind = np.append(back[: len(left)], 0)[np.minimum(q, len(left))]
    before = np.where(before >= q, q + behind, before)
    after = np.where(q < len(right), ahead[np.minimum(q, len(right) - 1)], 0)
    good = np.flatnonzero(before + after + q >= np.maximum(p.min_length, p.times * q))
    yield from zip((mid - before[good]).tolist(), (mid + after[good] + q[good]).tolist(), q[good].tolist(), strict=True)
    # Words up to the midpoint against those q earlier, where the agreement ends within q words after it.
    q = np.arange(1, min(most, len(left)) + 1)
    after = ahead[len(right) + 1 + len(left) - q]
    before = np.append(back[: len(left)], 0)[np.minimum(q, len(left))]
    good = np.flatnonzero((after < q) & (before + after + q >= np.maximum(p.min_length, p.times * q)))
    yield from zip((mid - q[good] - before[good]).tolist(), (mid + after[good]).tolist(), q[good].tolist(), strict=True)


def find_runs(ids: list[int], p: RunParams = RunParams(), looked: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period. ``looked``: words that may lie in a run; halves without any are passed over."""
    upto = None if looked is None else np.concatenate([[0], np.cumsum(looked)])
    found: dict[tuple[int, int], int] = {}
    todo = [(0, len(ids))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < p.min_length or (upto is not None and upto[hi] == upto[lo]):
            continue
        for start, end, q in _crossing(ids, lo, hi, p):
            # At an end of the half the words beyond it may go on; the run then lies on the midpoint that made this end.
            if (start > lo or start == 0 or ids[start - 1] != ids[start - 1 + q]) and (end < hi or end == len(ids) or ids[end] != ids[end - q]):
                found[start, end] = min(q, found.get((start, end), q))
        mid = (lo + hi) // 2
        todo += [(lo, mid), (mid, hi)]
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def _returning(ids: np.ndarray, ends: np.ndarray, p: RunParams) -> np.ndarray:
    """Whether a word may lie in a run: it is from a sequence that comes back in its text within a run's longest period, up to there."""
    w, n = _least_match(p), len(ids)
    if n <= w:
        return np.zeros(n, bool)
    # Hashes of w words from those of powers of two; equal sequences have equal hashes.
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    out, size, done, power = None, 1, 0, h
    while size <= w:
        if w & size:
            out = power[: n - w + 1] if out is None else out * np.uint64(0xC2B2AE3D27D4EB4F) + power[done : done + n - w + 1]
            done += size
        if 2 * size <= w:
            power = power[: len(power) - size] * np.uint64(0xBF58476D1CE4E5B9 + 2 * size) + power[size:]
            power ^= power >> np.uint64(31)
        size *= 2
    lengths = np.diff(ends)
    text = np.repeat(np.arange(len(lengths)), lengths)
    at = np.flatnonzero(text[: n - w + 1] == text[w - 1 :])
    key = out[at] + text[at].astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    order = np.argsort(key, kind="stable")
    a, b = at[order[:-1]], at[order[1:]]
    same = (key[order[:-1]] == key[order[1:]]) & (text[a] == text[b]) & (b - a <= lengths[text[a]] // p.times)
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, a[same], 1)
    np.add.at(step, b[same] + w, -1)
    return np.cumsum(step[:-1]) > 0


def _slices(texts: list[bytes]) -> Iterator[list[bytes]]:
    part: list[bytes] = []
    size = 0
    for t in texts:
        if part and size + len(t) > _SLICE:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def _judged(batches: Iterator[pa.RecordBatch], at: int, p: RunParams, kinds: pa.Schema) -> Iterator[pa.RecordBatch]:
    for b in batches:
        first = 0
        for part in _slices([x or b"" for x in b.column(at).cast(pa.binary()).to_pylist()]):
            words = [t.split() for t in part]
            ends = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
            known: dict[bytes, int] = {}
            ids = np.fromiter((known.setdefault(x, len(known)) for w in words for x in w), np.int64, int(ends[-1]))
            known.clear()
            may = _returning(ids, ends, p)
            some = np.add.reduceat(np.append(may, False).astype(np.int64), np.minimum(ends[:-1], len(may)))
            runs, texts = [], []
            for k, own in enumerate(words):
                a, z = int(ends[k]), int(ends[k + 1])
                found = find_runs(ids[a:z].tolist(), p, may[a:z]) if z > a and some[k] else []
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                if found:
                    step = np.zeros(z - a + 1, np.int64)
                    for s, n, q in found:
                        step[s + q] += 1
                        step[s + n] -= 1
                    own = [own[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()]
                texts.append(b" ".join(own))
            kept = b.slice(first, len(part))
            first += len(part)
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(np.diff(ends)), pa.array(runs, kinds.field(-2).type), pa.array(texts, pa.binary()).cast(pa.string())], schema=pa.schema([*kept.schema, *list(kinds)[-3:]]))


_RUNS = S.ArrayType(S.StructType([S.StructField(x, S.LongType()) for x in ("start", "length", "period")]))


def collapse_runs(df: DataFrame, text_col: str = "text", params: RunParams = RunParams()) -> DataFrame:
    """``df`` with ``n_words``, ``runs`` (start, length, period; by start and period) and ``collapsed``: the words that no run holds after its first period, joined by one space."""
    p, at = params, df.columns.index(text_col)
    names = [unused_name(df, x) for x in ("n_words", "runs", "collapsed")]
    schema = S.StructType([*df.schema.fields, S.StructField(names[0], S.LongType()), S.StructField(names[1], _RUNS), S.StructField(names[2], S.StringType())])
    inner = pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])
    kinds = pa.schema([(names[0], pa.int64()), (names[1], pa.list_(inner)), (names[2], pa.string())])
    return df.mapInArrow(lambda it: lean(_judged(it, at, p, kinds)), schema)
