"""Phrases and terms of texts in Arrow batches: one automaton over the phrases of all concepts reads each text once.

``text.concepts`` and ``text.lexical_terms`` say the same as expressions inside the JVM, with a search for each phrase.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexvane.functions import text as T

_TOKEN = re.compile(T.TOKEN)
_STOP = frozenset(T.STOPWORDS)
NAMES = list(T.CONCEPTS)
_NAMED = pa.list_(pa.string())


class PhraseMatcher:
    """Which groups of phrases a text holds, as bits. Phrases are found anywhere, inside words too."""

    def __init__(self, groups: dict[str, list[str]]) -> None:
        import ahocorasick

        bits: dict[str, int] = {}
        for k, phrases in enumerate(groups.values()):
            for p in phrases:
                bits[p] = bits.get(p, 0) | 1 << k
        self.all = (1 << len(groups)) - 1
        self.tree = ahocorasick.Automaton()
        for p, mask in bits.items():
            # A phrase's end is the end of all phrases within it that end there too.
            self.tree.add_word(p, mask)
        self.tree.make_automaton()

    def mask(self, low: str) -> int:
        found = 0
        for _, mask in self.tree.iter(low):
            found |= mask
            if found == self.all:
                break
        return found


@lru_cache(maxsize=1)
def matcher() -> PhraseMatcher:
    """The worker's automaton over the phrases of all concepts."""
    return PhraseMatcher(T.CONCEPTS)


@lru_cache(maxsize=256)
def _names(mask: int) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """The concepts of a mask, and the terms that they add."""
    own = tuple(n for k, n in enumerate(NAMES) if mask >> k & 1)
    return own, tuple(dict.fromkeys(a for n in own for a in T.ALIASES[n]))


def terms_of(low: str, mask: int) -> dict[str, None]:
    """Tokens that are no stop words and what the concepts add, once each and in order."""
    out = dict.fromkeys(_TOKEN.findall(low))
    for w in _STOP & out.keys():
        del out[w]
    for a in _names(mask)[1]:
        out.setdefault(a)
    return out


#: Texts that are worked on together, and their bytes, about.
_TOGETHER, _BYTES = 1000, 1 << 20


def slices(texts: pa.Array, most: int = _TOGETHER, size: int = _BYTES) -> Iterator[list[str | None]]:
    """The texts of an Arrow batch in order, some at a time: up to ``most``, and of about ``size`` bytes or a single longer one.

    Only these become Python's, so a worker's memory follows the longest text and not the batch.
    """
    total = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    k = 0
    while k < len(texts):
        gone = total[k - 1] if k else 0
        end = min(k + most, max(k + 1, int(np.searchsorted(total, gone + size, "right"))))
        yield texts.slice(k, end - k).to_pylist()
        k = end


def _low(c: Column) -> Column:
    return T.squeeze(F.lower(c))


def annotated(c: Column) -> Column:
    """Struct of a text's concepts (array of names), its number of lexical terms and these terms. A null text has no concepts and null terms."""

    @F.arrow_udf("concepts array<string>, n_terms int, terms array<string>")
    def run(low: pa.Array) -> pa.Array:
        find, concepts, numbers, words = matcher(), [], [], []
        for part in slices(low):
            for x in part:
                mask = find.mask(x or "")
                terms = None if x is None else terms_of(x, mask)
                concepts.append(_names(mask)[0])
                numbers.append(None if x is None else len(terms))
                words.append(None if x is None else list(terms))
        return pa.StructArray.from_arrays([pa.array(concepts, _NAMED), pa.array(numbers, pa.int32()), pa.array(words, _NAMED)], ["concepts", "n_terms", "terms"])

    return run(_low(c))


def profiled(c: Column) -> Column:
    """``annotated`` without the terms themselves."""

    @F.arrow_udf("concepts array<string>, n_terms int")
    def run(low: pa.Array) -> pa.Array:
        find, concepts, numbers = matcher(), [], []
        for part in slices(low):
            for x in part:
                mask = find.mask(x or "")
                concepts.append(_names(mask)[0])
                numbers.append(None if x is None else len(terms_of(x, mask)))
        return pa.StructArray.from_arrays([pa.array(concepts, _NAMED), pa.array(numbers, pa.int32())], ["concepts", "n_terms"])

    return run(_low(c))


def held(text: Column, phrases: list[str]) -> Column:
    """Which of some phrases, none of them empty, a text holds anywhere, as they are written: an array of their places in the list, in order.

    One automaton over all phrases, built once by each task, reads a text once, however many phrases there are. None in a null text.
    """

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import ahocorasick

        tree = ahocorasick.Automaton()
        for k, p in enumerate(phrases):
            tree.add_word(p, k)
        if phrases:
            tree.make_automaton()
        for b in batches:
            yield pa.array([sorted({k for _, k in tree.iter(x)}) if x and phrases else [] for part in slices(b) for x in part], pa.list_(pa.int32()))

    return run(text)


def overlaps(asked: Column, shown: Column) -> Column:
    """Struct: shares of the asked text's concepts and terms that the shown text has (0 where it has none), and the asked concepts.

    A row's terms stay in the worker: only these few numbers come back.
    """

    @F.arrow_udf("concept double, lexical double, asked array<string>")
    def run(q: pa.Array, r: pa.Array) -> pa.Array:
        find, known, concepts, lexical, names = matcher(), {}, [], [], []
        for part in slices(r):
            for a, b in zip(q.slice(len(names), len(part)).to_pylist(), part, strict=True):
                if a not in known:
                    mask = find.mask(a or "")
                    known[a] = mask, terms_of(a or "", mask).keys()
                mask, terms = known[a]
                other = find.mask(b or "")
                theirs = terms_of(b or "", other).keys()
                concepts.append((mask & other).bit_count() / mask.bit_count() if mask else 0.0)
                lexical.append(len(terms & theirs) / len(terms) if terms else 0.0)
                names.append(_names(mask)[0])
        return pa.StructArray.from_arrays([pa.array(concepts, pa.float64()), pa.array(lexical, pa.float64()), pa.array(names, _NAMED)], ["concept", "lexical", "asked"])

    return run(_low(asked), _low(shown))
