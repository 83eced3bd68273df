import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np

from lexvane.llm import queries as Q
from lexvane.llm.runs import RunParams, _returning, collapse_runs, find_runs, z_function
from tests.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(ids, p=RunParams()):
    found = {}
    for q in range(1, len(ids) // p.times + 1):
        k = 0
        while k + q < len(ids):
            end = k
            while end + q < len(ids) and ids[end] == ids[end + q]:
                end += 1
            if end > k and end + q - k >= max(p.min_length, p.times * q):
                found.setdefault((k, end + q), q)
            k = max(end, k + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def test_z_function():
    rng = random.Random(2)
    for _ in range(300):
        s = [rng.randrange(2) for _ in range(rng.randrange(30))]
        want = [next((j for j in range(len(s) - k) if s[j] != s[k + j]), len(s) - k) for k in range(len(s))]
        assert z_function(s) == want


def test_runs_against_brute_force():
    rng, many = random.Random(1), 0
    for _ in range(3000):
        p = RunParams(rng.choice([4, 6, 24]), rng.choice([2, 3]))
        words = rng.choice([1, 2, 3, 50])
        ids = [rng.randrange(words) for _ in range(rng.randrange(150))]
        for _ in range(rng.randrange(4)):
            a, q = rng.randrange(len(ids) + 1), rng.randrange(1, 12)
            for k in range(a + q, min(len(ids), a + rng.randrange(80))):
                ids[k] = ids[k - q]
        want = brute(ids, p)
        many += len(want)
        assert find_runs(ids, p) == want
        # Hashing a batch of texts spares halves and loses nothing.
        may = _returning(np.array([7, 7, *ids, 7, 7]), np.array([0, 2, 2 + len(ids), 4 + len(ids)]), p)
        assert find_runs(ids, p, may[2 : 2 + len(ids)]) == want
    assert many > 1000


def test_one_word_over_and_over():
    assert find_runs([5] * 30_000) == [(0, 30_000, 1)]


def want(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in runs)]
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(kept))


def test_query_on_short_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 4000").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(100_000 + k, ("a b c " * k + "x y " * 20) if k % 3 else "\x1c  é\x0b" * k) for k in range(60)], "doc_id long, text string"))
    out = Q.QUERIES["op12_periodic_runs"]

    class Reader:  # the query over a small table of its own
        def __init__(self, df):
            self.read, self.parquet = self, lambda path: df

    found = sorted(map(tuple, out(Reader(docs), "").collect()))
    assert found == sorted(want(*r) for r in docs.collect())
    assert sum(r[1] > 0 for r in found) > 20


def test_odd_rows(odd, nothing):
    df = odd.withColumnRenamed("h", "runs")
    out = collapse_runs(df)
    assert out.columns == [*df.columns, "n_words", "_runs", "collapsed"]
    rows = sorted(out.collect(), key=str)
    assert [tuple(r)[: len(df.columns)] for r in rows] == sorted(map(tuple, df.collect()), key=lambda r: str([x for x in rows if tuple(x)[: len(r)] == r][0]))
    for r in rows:
        words = WORD.findall(r.text or "")
        assert r.n_words == len(words) and [tuple(x) for x in r._runs] == brute(words)
    assert [r.collapsed for r in rows if r.doc_id in (3, 4)] == ["", ""]
    assert {r.collapsed for r in rows if r.doc_id == 7} == {"same text twice"}
    assert collapse_runs(nothing).count() == 0
