"""Token ids of whole texts by a public tokenizer, with each distinct word encoded once.

The tokenizer used here never lets a token cross white space, so a text's ids are its words' ids in order. Words are split and
counted by Arrow kernels, new words go to the tokenizer in bulk, and known words come from a bounded cache.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Ranges of Latin letters; a run of signs between such a letter and white space is a piece of its own for the tokenizer. U+0130 is
#: left out: its lower-case form ends in a combining mark, and the tokenizer does not part signs from a mark.
_LATIN = r"A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}"
_TAIL = rf"([{_LATIN}])([,.%&*$#!?;:]+)(\s|$)"
_PLAIN = r"^[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+$"
_SLICE = 4 << 20
_CACHE = 300_000
_LOADED: dict[str, WordEncoder] = {}


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each run, one run after the other."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lens)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lens), lens)


def fresh(texts: pa.Array) -> pa.Array:
    """A copy that starts at its buffers' beginning: some string kernels misread slices."""
    return texts.take(pa.array(np.arange(len(texts))))


class WordEncoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        # Lower-cased Latin words need neither normalisation nor a pattern: white space alone parts them.
        self.quick = Tokenizer.from_file(path)
        self.quick.normalizer = normalizers.Sequence([])
        self.quick.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.full.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values()) + 1
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.words, self.starts, self.lens, self.flat = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _quick(self, words: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for k in range(0, len(words), 1000):
            part = words[k : k + 1000]
            ids = np.asarray(self.quick.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            cut = np.flatnonzero(self.ends[ids]) + 1
            out += np.split(ids, cut[:-1]) if len(cut) == len(part) and cut[-1] == len(ids) else self._full(part)
        return out

    def _full(self, words: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, np.uint32) for e in self.full.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, words: pa.Array, plain: pa.Array) -> None:
        quick, rest = words.filter(plain), words.filter(pc.invert(plain))
        ids = self._quick(quick.to_pylist()) + self._full(rest.to_pylist())
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        at = len(self.flat)
        self.words = pa.concat_arrays([self.words, quick, rest])
        self.starts = np.concatenate([self.starts, at + np.cumsum(lens) - lens])
        self.lens = np.concatenate([self.lens, lens])
        self.flat = np.concatenate([self.flat, *ids])

    def _some(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, pattern=_TAIL, replacement=r"\1 \2\3"))
        counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        plain = pc.match_substring_regex(coded.dictionary, pattern=_PLAIN)
        folded = pc.if_else(plain, pc.utf8_lower(coded.dictionary), coded.dictionary).dictionary_encode()
        words, plain = folded.dictionary, pc.match_substring_regex(folded.dictionary, pattern=_PLAIN)
        if len(self.words) > _CACHE:
            self._forget()
        new = pc.is_null(pc.index_in(words, value_set=self.words))
        if pc.any(new).as_py():
            self._learn(words.filter(new), plain.filter(new))
        place = pc.index_in(words, value_set=self.words).to_numpy(zero_copy_only=False).astype(np.int64)
        place = place[folded.indices.to_numpy(zero_copy_only=False)][coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
        lens = self.lens[place]
        ids = self.flat[ragged(self.starts[place], lens)]
        upto = np.concatenate([[0], np.cumsum(lens)])
        return ids, upto[np.concatenate([[0], np.cumsum(counts)])]

    def encode(self, texts: pa.Array | pa.ChunkedArray):
        """Yield (first text's number, ids of several texts one after the other, offsets of each text in them)."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            base = size[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(size, base + _SLICE, side="right")))
            part = texts.slice(at, upto - at)
            part = fresh(part.cast(pa.string()) if size[upto - 1] - base < 2**30 else part)
            yield at, *self._some(part)
            at = upto


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for this tokenizer file."""
    if path not in _LOADED:
        _LOADED[path] = WordEncoder(path)
    return _LOADED[path]
