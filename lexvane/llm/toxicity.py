"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

A word, folded to lower-case letters with a mark at its start, maps to its subsequences of three characters within five places;
each place skipped costs a factor ``decay``. The normalised inner product of two such maps is the kernel, so an insult with a
character put in, doubled or written with signs between its letters stays close to the plain one. Runs of single letters
("i d i o t") are read as one word. A word of more than 16 letters (glued text, text without white space) is judged by every
stretch of 5 to 16 of its letters, each as if it stood alone: running sums of table entries give all of them in
linear time, and an insult in a run counts the same however long the run is.

Labels are given for whole texts, so training alternates: every toxic text names its most toxic word, the machine is fitted on
those words (and on altered copies of them) against words of clean texts, and clean words that it gets wrong join the others.
Landmarks are words of either class; features are K(x, Z) K(Z, Z)^(-1/2), and the machine minimises the squared hinge loss. As the
kernel has an explicit map, the landmarks' weights are added up into one table over subsequences, and scoring a word is a sum of
table entries: the same decision at a cost that does not depend on the number of landmarks. A text's margin is its words' largest;
a logistic curve fitted on training texts set aside turns it into a score.

The model is fitted on at most ``most_toxic`` and ``most_clean`` labelled texts of at most ``most_chars`` characters, taken in order
of a hash of the id. Scoring covers every whole text. Labels, language, source and id are no inputs of a score.

Defined cases: a null or empty text, or one without words, gets the curve's value at the lowest margin; equal texts get equal
scores; repeated rows are kept; null labels are left out; a null id is not held out; without labels of both classes all scores
are the share of toxic labels (0 without labels); an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexvane.llm.common import lean, unused_name
from lexvane.llm.tokens import fresh

_SIZE = 36
_OTHER, _START, _NONE = 28, 27, 255
_LOW = -2.0
#: Bytes of text that are taken at a time.
_SLICE = 4 << 20
_BLOCK = 20_000


@dataclass(frozen=True)
class ToxicityParams:
    decay: float = 0.7
    landmarks: int = 128
    rounds: int = 4
    #: Each toxic text names its most toxic word and up to so many more that are clearly toxic.
    more: int = 2
    #: Altered copies of each toxic word; together they weigh as much as the word.
    copies: int = 6
    #: Weight of an altered copy against a text in the curve.
    curve_weight: float = 0.05
    cost: float = 10.0
    most_toxic: int = 1500
    most_clean: int = 2500
    most_chars: int = 20_000
    most_words: int = 8_000
    threshold: float = 0.3
    seed: int = 7


#: Offsets of the second and third character of a subsequence.
_OFFSETS = [(1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4)]
#: Letters of the stretches that a longer word is judged by.
_SHORTEST, _LONGEST = 5, 16
_SPACED = r"(^|\s)\pL(\s\pL){3,}(\s|$)"
_SPACED_PY = re.compile(r"(?:(?<=\s)|^)[^\W\d_](?:\s[^\W\d_]){3,}(?=\s|$)")


@lru_cache(maxsize=1)
def _folds() -> np.ndarray:
    """Class of each character of the basic plane: a-z by their base letter, look-alike digits as letters, signs as nothing."""
    table = np.full(1 << 16, _NONE, np.uint8)
    for c in range(1 << 16):
        ch = chr(c)
        if not ch.isalnum():
            continue
        base = unicodedata.normalize("NFKD", ch.lower())[:1]
        base = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "ß": "s", "ø": "o", "ı": "i", "ł": "l"}.get(base, base)
        table[c] = ord(base) - 97 if "a" <= base <= "z" else 26 if base.isdigit() else _OTHER + c % 8
    return table


def fold(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all words' characters, a mark before each word, and the number of the word for each character."""
    raw = np.frombuffer("\n".join([*words, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = raw == 10
    owner = np.cumsum(ends) - ends
    cls = np.where(raw < 1 << 16, _folds()[np.minimum(raw, 0xFFFF)], _OTHER + (raw % 8).astype(np.uint8)).astype(np.uint8)
    cls[ends] = _START
    # Each word's end sign becomes the next word's start mark: put one before the first and drop the last.
    cls, owner = np.concatenate([[np.uint8(_START)], cls[:-1]]), np.concatenate([[0], owner[:-1] + ends[:-1]])
    keep = cls != _NONE
    return cls[keep], owner[keep]


def features(words: list[str], decay: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, subsequence, weight) of every word, each pair once. Weights are not normalised."""
    return _subsequences(*fold(words), decay)


def _subsequences(cls: np.ndarray, owner: np.ndarray, decay: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    code = cls.astype(np.int64)
    keys, weights = [], []
    for d1, d2 in _OFFSETS:
        n = len(code) - d2
        if n <= 0:
            continue
        same = np.flatnonzero(owner[:n] == owner[d2:])
        keys.append((owner[same] * _SIZE + code[same]) * _SIZE**2 + code[same + d1] * _SIZE + code[same + d2])
        weights.append(np.full(len(same), decay ** (d2 - 2), np.float32))
    if not sum(map(len, keys)):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    key, weight = np.concatenate(keys), np.concatenate(weights)
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first] // _SIZE**3, key[first] % _SIZE**3, np.add.reduceat(weight, first)


def _stretches(cls: np.ndarray, owner: np.ndarray, table: np.ndarray, bias: float, decay: float) -> tuple[np.ndarray, np.ndarray]:
    """The best stretch that begins at each letter: its margin and its letters. ``cls``: letters of words, without their marks.

    A stretch is a word of its own, with the mark put before it. Running sums count a subsequence that it has twice as two, which can
    only make a margin larger; of each letter's best one, those above zero are then mapped and normalised as words are.
    """
    n = len(cls)
    best, size = np.full(n, _LOW), np.zeros(n, np.int64)
    code = cls.astype(np.int64)
    # For each width, sums of the table over subsequences that begin before a place; subsequences over a word's end are in no stretch.
    upto: dict[int, np.ndarray] = {}
    marked, norm_mark = np.zeros(n), 0.0
    weights = {d2: 0.0 for d2 in (2, 3, 4)}
    for d1, d2 in _OFFSETS:
        w = decay ** (d2 - 2)
        weights[d2] += w * w
        norm_mark += w * w
        value = np.zeros(n + 1)
        if n > d2:
            value[1 : n - d2 + 1] = w * table[(code[: n - d2] * _SIZE + code[d1 : n - d2 + d1]) * _SIZE + code[d2:]]
        upto[d2] = upto.get(d2, 0) + np.cumsum(value)
        if n >= d2:
            marked[: n - d2 + 1] += w * table[(_START * _SIZE + code[d1 - 1 : n - d2 + d1]) * _SIZE + code[d2 - 1 :]]
    for length in range(_SHORTEST, min(_LONGEST, n) + 1):
        starts = np.flatnonzero(owner[: n - length + 1] == owner[length - 1 :])
        value = marked[starts] + sum(upto[d2][starts + length - d2] - upto[d2][starts] for d2 in weights)
        norm = norm_mark + sum((length - d2) * w for d2, w in weights.items())
        margin = value / np.sqrt(norm) + bias
        more = margin > best[starts]
        best[starts[more]], size[starts[more]] = margin[more], length
    some = np.flatnonzero(best > 0)
    for k in range(0, len(some), _BLOCK):
        at = some[k : k + _BLOCK]
        n = size[at] + 1
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        marks = place == 0
        letters = np.where(marks, np.uint8(_START), cls[np.repeat(at, n) + np.maximum(place - 1, 0)])
        w, u, x = _subsequences(letters, np.repeat(np.arange(len(at)), n), decay)
        best[at] = np.bincount(w, x * table[u], len(at)) / np.sqrt(np.bincount(w, x * x, len(at))) + bias
    return best, size


def _long(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each word has more letters than a stretch, and the letters of these words with the words' numbers."""
    cls, owner = fold(words)
    letters = cls != _START
    count = np.bincount(owner[letters], minlength=len(words) + 1)[: len(words)] if len(words) else np.zeros(0, np.int64)
    some = letters & (np.append(count, 0)[owner] > _LONGEST)
    return count > _LONGEST, cls[some], owner[some]


def margins(words: list[str], table: np.ndarray, bias: float, decay: float) -> np.ndarray:
    """The machine's decision for each word; the lowest for words with no subsequence. Taken in blocks, to bound memory."""
    out = [np.zeros(0)]
    for k in range(0, len(words), _BLOCK):
        part = words[k : k + _BLOCK]
        long, cls, owner = _long(part)
        w, u, x = features(["" if z else v for v, z in zip(part, long.tolist(), strict=True)] if long.any() else part, decay)
        norm = np.bincount(w, x * x, len(part))
        found = np.where(norm > 0, np.bincount(w, x * table[u], len(part)) / np.sqrt(np.maximum(norm, 1e-12)) + bias, _LOW)
        if len(cls):
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            found[owner[first]] = np.maximum.reduceat(_stretches(cls, owner, table, bias, decay)[0], first)
        out.append(found)
    return np.concatenate(out)


def telling_stretches(words: list[str], table: np.ndarray, bias: float, decay: float) -> list[str]:
    """Of each word longer than a stretch its most toxic one, in letters; other words as they are."""
    out = list(words)
    long, cls, owner = _long(words)
    if long.any():
        best, size = _stretches(cls, owner, table, bias, decay)
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        for a, z in zip(first, [*first[1:], len(cls)], strict=True):
            at = a + int(np.argmax(best[a:z]))
            out[owner[a]] = "".join(chr(97 + c) if c < 26 else "2" for c in cls[at : at + size[at]].tolist())
    return out


def words_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, each text's words as numbers of these, and the number of words of each text."""
    texts = fresh(pc.fill_null(texts.cast(pa.large_string()), ""))
    spaced = pc.match_substring_regex(texts, pattern=_SPACED)
    if pc.any(spaced).as_py():
        joined = [_SPACED_PY.sub(lambda m: re.sub(r"\s", "", m[0]), x) if s else x for x, s in zip(texts.to_pylist(), spaced.to_pylist(), strict=True)]
        texts = pa.array(joined, pa.large_string())
    split = pc.utf8_split_whitespace(texts)
    coded = split.flatten().dictionary_encode()
    sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False), sizes


@dataclass(frozen=True)
class ToxicityModel:
    table: np.ndarray | None
    bias: float
    slope: float
    shift: float
    constant: float
    decay: float

    def text_margins(self, texts: pa.Array) -> np.ndarray:
        words, flat, sizes = words_of(texts)
        by_word = margins(words, self.table, self.bias, self.decay)
        out = np.full(len(sizes), _LOW)
        some = np.flatnonzero(sizes)
        if len(some):
            starts = np.cumsum(sizes) - sizes
            out[some] = np.maximum.reduceat(by_word[flat], starts[some])
        return out

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.table is None:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.text_margins(texts) + self.shift, -40, 40)))


def _dense(words: list[str], landmarks: list[str], decay: float) -> np.ndarray:
    """Kernel values of words with landmarks."""
    zw, zu, zx = features(landmarks, decay)
    zx = zx / np.sqrt(np.maximum(np.bincount(zw, zx * zx, len(landmarks)), 1e-12))[zw]
    used, at = np.unique(zu, return_inverse=True)
    table = np.zeros((len(used), len(landmarks)), np.float32)
    table[at, zw] = zx
    out = np.zeros((len(words), len(landmarks)), np.float32)
    for k in range(0, len(words), 500):
        part = words[k : k + 500]
        w, u, x = features(part, decay)
        x = x / np.sqrt(np.maximum(np.bincount(w, x * x, len(part)), 1e-12))[w]
        place = np.searchsorted(used, u)
        ok = (place < len(used)) & (used[np.minimum(place, len(used) - 1)] == u)
        w, place, x = w[ok], place[ok], x[ok].astype(np.float32)
        if len(w):
            first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
            out[k + w[first]] = np.add.reduceat(table[place] * x[:, None], first)
    return out


def _squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float) -> np.ndarray:
    """Newton steps on the squared hinge loss with a bias in the last place."""
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1).astype(np.float64)
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(12):
        inside = y * (x @ w) < 1
        a = x[inside] * (cost * weight[inside])[:, None]
        new = np.linalg.solve(ridge + a.T @ x[inside], a.T @ y[inside])
        if np.abs(new - w).max() < 1e-4:
            break
        w = new
    return w


def _altered(words: list[str], rng: np.random.Generator) -> list[str]:
    """Copies with a letter put in, doubled or left out."""
    out = []
    for w in words:
        if len(w) > 3:
            k, kind = int(rng.integers(1, len(w))), rng.random()
            put = chr(97 + int(rng.integers(26))) if kind < 0.65 else w[k - 1] if kind < 0.85 else ""
            out.append(w[:k] + put + w[k + (not put) :])
    return out


def fit(texts: list[str], labels: np.ndarray, p: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """Fit on labelled texts, in the order given; every fourth is set aside for the curve."""
    share = float(labels.mean()) if len(labels) else 0.0
    blank = ToxicityModel(None, 0.0, 1.0, 0.0, share, p.decay)
    aside = np.arange(len(labels)) % 4 == 3
    if min((labels[~aside] == 1).sum(), (labels[~aside] == 0).sum()) < 2:
        return blank
    rng = np.random.default_rng(p.seed)
    words, flat, sizes = words_of(pa.array(texts, pa.large_string()))
    owner = np.repeat(np.arange(len(texts)), sizes)
    pairs = np.unique(owner * len(words) + flat)
    doc, word = pairs // len(words), pairs % len(words)
    learn = ~aside[doc]
    toxic, clean = learn & (labels[doc] == 1), learn & (labels[doc] == 0)
    n_toxic, n_clean = (labels[~aside] == 1).sum(), (labels[~aside] == 0).sum()

    # First guess: the words whose runs of three are found far more often in toxic texts than in clean ones.
    cls, at = fold(words)
    run = np.flatnonzero(at[:-2] == at[2:]) if len(at) > 2 else np.zeros(0, np.int64)
    gram, gram_word = (cls[run].astype(np.int64) * _SIZE + cls[run + 1]) * _SIZE + cls[run + 2], at[run]
    starts = np.searchsorted(gram_word, np.arange(len(words) + 1))

    def grams_in(mask: np.ndarray) -> np.ndarray:
        """In how many texts each run of three is; a few texts at a time."""
        out = np.zeros(_SIZE**3, np.int64)
        d, v = doc[mask], word[mask]
        at_ = np.searchsorted(d, np.arange(0, len(texts) + 100, 100))
        for lo, hi in zip(at_[:-1], at_[1:], strict=True):
            lens = (starts[1:] - starts[:-1])[v[lo:hi]]
            ends = np.cumsum(lens)
            idx = np.arange(lens.sum()) - np.repeat(ends - lens, lens) + np.repeat(starts[v[lo:hi]], lens)
            seen = np.unique(np.repeat(d[lo:hi], lens) * _SIZE**3 + gram[idx])
            out += np.bincount(seen % _SIZE**3, minlength=_SIZE**3)
        return out

    odds = np.log((grams_in(toxic) + 2) / (n_toxic + 4)) - np.log((grams_in(clean) + 2) / (n_clean + 4))
    val = odds[gram]
    guess = np.full(len(words), -9.0)
    if len(val) > 2:
        three = (val[:-2] + val[1:-1] + val[2:]) / 3
        inside = gram_word[:-2] == gram_word[2:]
        np.maximum.at(guess, gram_word[:-2][inside], three[inside])

    clean_words, clean_counts = np.unique(word[clean], return_counts=True)
    common = clean_words[np.argsort(-clean_counts, kind="stable")[: p.most_words // 4]]
    drawn = rng.choice(clean_words, min(len(clean_words), p.most_words // 2), replace=False)
    in_clean = np.zeros(len(words), bool)
    in_clean[clean_words] = True
    hard = clean_words[np.argsort(-guess[clean_words], kind="stable")[: p.most_words // 4]]
    score = np.where(in_clean, -9.0, guess)
    table, bias, floor = np.zeros(_SIZE**3), 0.0, 0.5
    stretches: list[str] = []
    for turn in range(p.rounds):
        order = np.lexsort((-score[word[toxic]], doc[toxic]))
        named, by = word[toxic][order], doc[toxic][order]
        place = np.arange(len(by)) - np.searchsorted(by, by)
        best = named[np.where(place == 0, score[named] > floor, (place <= p.more) & (score[named] > floor + 1) & ~in_clean[named])]
        if not len(best):
            return blank
        kinds = Counter(best.tolist())
        ranked = telling_stretches([words[k] for k, _ in kinds.most_common()], table if turn else odds, bias, p.decay)
        often = np.sqrt([n for _, n in kinds.most_common()])
        whole = np.array([len(w) > 3 for w in ranked])
        positive, weight_of = list(ranked), [often]
        for _ in range(p.copies):
            positive += _altered(ranked, rng)
            weight_of.append(often[whole] / p.copies)
        weight_of = np.concatenate(weight_of)
        chosen = np.unique(np.concatenate([common, drawn, hard]))
        negative = [words[k] for k in chosen]
        changed = _altered(negative[:: max(1, len(negative) // 1500)], rng)
        against = np.sqrt(np.concatenate([clean_counts[np.searchsorted(clean_words, chosen)], np.ones(len(changed) + len(stretches))]))
        negative += changed + stretches
        half = p.landmarks // 2
        marks = ranked[:half] + [words[k] for k in hard[: half // 2]] + [words[k] for k in common[: half - half // 2]]
        marks = list(dict.fromkeys(marks))
        kzz = _dense(marks, marks, p.decay).astype(np.float64)
        vals, vecs = np.linalg.eigh(kzz)
        root = vecs / np.sqrt(np.maximum(vals, 1e-3)) @ vecs.T
        x = _dense(positive + negative, marks, p.decay) @ root.astype(np.float32)
        y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
        weight = np.concatenate([weight_of / weight_of.sum(), against / against.sum()]) * 1000
        w = _squared_hinge(x, y, weight, p.cost)
        # The landmarks' weights, added up over the subsequences of the landmarks.
        beta = root @ w[:-1]
        zw, zu, zx = features(marks, p.decay)
        zx = zx / np.sqrt(np.maximum(np.bincount(zw, zx * zx, len(marks)), 1e-12))[zw]
        table, bias = np.bincount(zu, zx * beta[zw], _SIZE**3), float(w[-1])
        found = margins(words, table, bias, p.decay)
        hard = np.unique(np.concatenate([hard[: p.most_words // 8], clean_words[np.argsort(-found[clean_words], kind="stable")[: p.most_words // 4]]]))
        score, floor = found, -0.5
        # Stretches of long clean words that look toxic are clean as well.
        worst = clean_words[np.argsort(-found[clean_words], kind="stable")[: p.most_words // 4]]
        shown = [words[k] for k in worst]
        stretches = list(dict.fromkeys([*stretches, *(a for a, w in zip(telling_stretches(shown, table, bias, p.decay), shown, strict=True) if a != w)]))[: p.most_words // 2]
    table = table.astype(np.float32)

    model = ToxicityModel(table, bias, 1.0, 0.0, share, p.decay)
    # Training texts set aside give the curve, along with altered copies of their toxic words.
    held = ~learn & (labels[doc] == 1)
    order = np.lexsort((-score[word[held]], doc[held]))
    top = word[held][order][np.flatnonzero(np.diff(np.concatenate([[-1], doc[held][order]])))]
    changed = _altered([words[k] for k in top if score[k] > 0], rng)
    m = np.concatenate([model.text_margins(pa.array([texts[k] for k in np.flatnonzero(aside)], pa.large_string())), margins(changed, table, bias, p.decay)])
    t = np.concatenate([labels[aside].astype(float), np.ones(len(changed))])
    r = np.concatenate([np.ones(aside.sum()), np.full(len(changed), p.curve_weight)])
    a, c = 4.0, 0.0
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(a * m + c, -30, 30)))
        g = np.array([(r * (q - t) * m).sum() + 0.02 * (a - 4.0), (r * (q - t)).sum() + 0.02 * c])
        v = r * q * (1 - q)
        h = np.array([[(v * m * m).sum() + 0.02, (v * m).sum()], [(v * m).sum(), v.sum() + 0.02]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / np.abs(step).max())
        a, c = a - step[0], c - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return ToxicityModel(table, bias, float(max(a, 0.5)), float(c), share, p.decay)


def training_rows(docs: DataFrame, labels: DataFrame, p: ToxicityParams, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The bounded sample (i, t, y) of labelled texts that may be learned from, in one partition."""
    may = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y"))
    may = may.where(F.pmod(F.crc32(F.col("i").cast("string").cast("binary")), F.lit(4)) != 2).distinct()
    short = docs.where(F.char_length(text_col) <= p.most_chars).select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"))
    chosen = []
    for y, most in ((1, p.most_toxic), (0, p.most_clean)):
        chosen.append(may.where(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(most))
    # At most most_toxic + most_clean rows: a side that may be broadcast.
    return short.join(F.broadcast(chosen[0].unionAll(chosen[1])), "i").dropDuplicates(["i", "t", "y"]).select("i", "t", "y").coalesce(1)


_FITTED = "table binary, bias double, slope double, shift double, constant double"


def _fit(batches: Iterator[pa.RecordBatch], p: ToxicityParams) -> Iterator[pa.RecordBatch]:
    """The model of one partition's texts, as a row."""
    parts = list(batches)
    rows = pa.Table.from_batches(parts) if parts else pa.table({"i": [], "t": pa.array([], pa.string()), "y": pa.array([], pa.int32())})
    del parts
    texts, y = rows["t"].to_pylist(), rows["y"].to_numpy().astype(np.int64)
    order = sorted(range(len(y)), key=lambda k: (hash_of(rows["i"][k].as_py()), texts[k], y[k]))
    model = fit([texts[k] for k in order], y[order], p)
    table = None if model.table is None else model.table.astype("<f4").tobytes()
    yield pa.RecordBatch.from_arrays([pa.array([table], pa.binary()), *[pa.array([x], pa.float64()) for x in (model.bias, model.slope, model.shift, model.constant)]], ["table", "bias", "slope", "shift", "constant"])


def hash_of(i: object) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(str(i).encode())


def _score(batches: Iterator[pa.RecordBatch], model: ToxicityModel, at: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(at)
        size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        scores, k = [np.zeros(0)], 0
        while k < len(texts):
            z = max(k + 1, int(np.searchsorted(size, (size[k - 1] if k else 0) + _SLICE, side="right")))
            scores.append(model.score(texts.slice(k, z - k)))
            k = z
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(scores))], [*b.schema.names, "score"])


def score_documents(df: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """``df`` and the column score (named with underscores in front if taken)."""
    name = unused_name(df, "score")
    names = [f"c{k}" for k in range(len(df.columns))]
    inner = df.toDF(*names)
    schema = inner.withColumn("score", F.lit(0.0)).schema
    at = df.columns.index(text_col)
    return inner.mapInArrow(lambda it: lean(_score(it, model, at)), schema).toDF(*df.columns, name)


def fit_on_labels(docs: DataFrame, labels: DataFrame, p: ToxicityParams = ToxicityParams(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Fit in one task on the bounded sample; the driver gets the model alone, a table of 46,656 numbers."""
    found = training_rows(docs, labels, p, id_col, text_col, label_col).mapInArrow(lambda it: lean(_fit(it, p)), _FITTED).collect()
    if not found:  # no rows, no partition
        return fit([], np.zeros(0, np.int64), p)
    row = found[0]
    table = None if row["table"] is None else np.frombuffer(row["table"], "<f4")
    return ToxicityModel(table, row["bias"], row["slope"], row["shift"], row["constant"], p.decay)
