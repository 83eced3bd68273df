import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from lexvane.llm.id_output import decode_values, encode_corpus, encode_values
from lexvane.llm.packing import PackParams, pack_documents, pack_lengths, tier_groups
from lexvane.llm.tokens import WordEncoder
from tests.conftest import SF

PATH = public_tokenizers.path("word_bpe_49k.json")


def _ids(texts):
    t = Tokenizer.from_file(PATH)
    return [np.array(e.ids, "<u4") for e in t.encode_batch(texts, add_special_tokens=False)]


def test_words_give_the_whole_texts_ids(spark, monkeypatch):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts += ["", " ", "it's, we'll!! don't. x,y. a.,b $$$ c$$$ d́. İstanbul, ΣΑΣ. Å H̱ ẖ, \x1cq \x85 r", "<|endoftext|> a<|startoftext|>, <|EndOfText|>.", "µ ª º ﬁn ǅ, ß. Ÿ; ²³ 12.5 a1,b2. 'S 'T"]
    enc = WordEncoder(PATH)
    monkeypatch.setattr("lexvane.llm.tokens._SLICE", 50_000)
    for _ in range(2):  # the second time from the cache
        found = [ids[o:p] for _, ids, offs in enc.encode(pa.array(texts)) for o, p in zip(offs[:-1], offs[1:], strict=True)]
        for a, b, text in zip(found, _ids(texts), texts, strict=True):
            assert a.tolist() == b.tolist(), text[:80]
        assert len(found) == len(texts)


def _differ(texts):
    found = [ids[o:p] for _, ids, offs in WordEncoder(PATH).encode(pa.array(texts)) for o, p in zip(offs[:-1], offs[1:], strict=True)]
    return [t for t, a, b in zip(texts, found, _ids(texts), strict=True) if a.tolist() != b.tolist()]


def test_every_letter_before_every_sign():
    letters = [chr(c) for c in range(0x20, 0x250)] + [chr(c) for c in (0x301, 0x307, 0x1E9E, 0x1E96, 0x2126, 0x212B, 0xFB01, 0x4E2D, 0x1F600)]
    signs = [*",.%&*$#!?;:", "...", "?!", "$.", "'s,", "-", '"', ")"]
    texts = [f"{c}{s}" for c in letters for s in signs] + [f"ab{c}{s} x{c}{s}\n{c}" for c in letters for s in signs]
    assert _differ(texts) == []


def test_random_texts():
    rng = np.random.default_rng(5)
    pool = list("abzABZ019éÉİıßŸǅǰẞ,.%&*$#!?;:'\"-()<|>_ \t\n\x0b\x1c\x85\xa0\u0301\u0307\u2028ﬁµªΣς中😀") + ["'s ", "'LL ", "<|endoftext|>", " i\u0307, ", "İ, "]
    texts = ["".join(rng.choice(pool, rng.integers(1, 24))) for _ in range(100_000)]
    assert _differ(texts) == []


def test_values_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        v = (rng.integers(0, 2**32, n, dtype=np.uint64) >> rng.integers(0, 32, n).astype(np.uint64)).astype(np.uint32)
        c, d = encode_values(v)
        assert (decode_values(np.frombuffer(c, np.uint8), np.frombuffer(d, np.uint8), n) == v).all()


def test_id_files(odd, nothing):
    rows = sorted(encode_corpus(odd, PATH).collect(), key=lambda r: r.start)
    at = 0
    docs = defaultdict(list)
    src = [tuple(r)[:2] for r in odd.collect()]
    for (i, _), ids in zip(src, _ids([t or "" for _, t in src]), strict=True):
        docs[i].append((len(ids) + 1, zlib.crc32(np.append(ids, 2).astype("<u4").tobytes())))
    assert [r.doc_id for r in rows] == sorted((i for i, _ in src), key=lambda x: -1 if x is None else x)
    for r in rows:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in docs[r.doc_id]
        at += r.n_tokens
    assert encode_corpus(nothing, PATH).count() == 0


def test_packing(odd, nothing):
    rows = pack_documents(odd, PATH).collect()
    src = [tuple(r)[:2] for r in odd.collect()]
    want = sorted((str(i), k, zlib.crc32(x[k : k + 2048].tobytes()), len(x)) for (i, _), ids in zip(src, _ids([t or "" for _, t in src]), strict=True) for x in [np.append(ids, 1).astype("<u4")] for k in range(0, len(x), 2048))
    assert sorted((str(r.doc_id), r.start, r.ids_crc32, r.doc_tokens) for r in rows) == want
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for pieces in seqs.values():
        at = 0
        for off, n in sorted(pieces):
            assert off == at
            at += n
        assert at <= 2048
    assert pack_documents(nothing, PATH).count() == 0


def test_tiers_and_padding():
    rng = np.random.default_rng(1)
    lengths = np.minimum(2048, rng.geometric(1 / 500, 5000))
    p = PackParams()
    seq, off, tier = pack_lengths(lengths, p)
    used = np.bincount(seq, lengths)
    assert used.max() <= 2048 and used.sum() / (2048 * len(used)) > 0.995
    assert all(t >= u for t, u in zip(tier, used[seq], strict=True))


def test_each_tier_is_packed():
    rng = np.random.default_rng(1)
    lengths, p = np.minimum(2048, rng.geometric(1 / 500, 5000)), PackParams()
    seq, off, tier = pack_lengths(lengths, p, by_tier=True)
    used, of = np.bincount(seq, lengths), np.zeros(seq.max() + 1, int)
    of[seq] = tier
    assert (of[seq] == tier).all() and (used <= of).all() and used.sum() / of.sum() > 0.98
    assert {t: int((of == t).sum()) > 10 for t in p.tiers[1:]} == dict.fromkeys(p.tiers[1:], True)
    # A sequence has the tier that its longest piece is routed to.
    longest = np.zeros(len(of), int)
    np.maximum.at(longest, seq, lengths)
    assert [next(t for t in p.tiers if t >= x) for x in longest] == of.tolist()
    # Gaps of long sequences hold pieces of shorter tiers.
    assert (lengths[tier == 2048] <= 1024).any()
    group = tier_groups(used, of, p)
    for g in set(group):
        assert len(set(of[group == g])) == 1 and of[group == g].sum() <= p.step_sequences * p.window
    for t in p.tiers:
        sums = [used[group == g].sum() for g in set(group[of == t])]
        assert not sums or max(sums) - min(sums) <= 2 * t


def test_short_documents_fill_short_tiers():
    p = PackParams()
    seq, _, tier = pack_lengths(np.array([100] * 20 + [500] * 4 + [1000] * 2), p, by_tier=True)
    assert set(tier) == {256, 512, 1024}


def test_very_many_empty_texts_make_more_files(spark, tmp_path):
    from lexvane.llm.id_output import read_id_files, write_id_files

    df = spark.range(200_000).selectExpr("id AS doc_id", "CASE id % 3 WHEN 0 THEN '' END AS text")
    files = write_id_files(df, PATH, f"file://{tmp_path}/ids", file_bytes=1 << 18)
    assert files.count() >= 12 and files.agg({"n_ids": "max"}).first()[0] <= 40_000
    rows = read_id_files(files, f"file://{tmp_path}/ids").toPandas().sort_values("id")
    assert len(rows) == 200_000 and (rows["start"].to_numpy() == np.arange(200_000)).all() and (rows["n_tokens"] == 1).all()
