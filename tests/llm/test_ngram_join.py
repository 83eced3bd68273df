import random
import re
from collections import defaultdict

import pytest

from lexvane.llm.ngram_join import NgramParams, ngram_components
from tests.conftest import SF


def brute(rows, n, t):
    """All pairs, by an inverted index and union-find."""
    sets = []
    for _, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    index = defaultdict(list)
    for k, s in enumerate(sets):
        near = defaultdict(int)
        for g in s:
            for j in index[g]:
                near[j] += 1
            index[g].append(k)
        for j, c in near.items():
            if 100 * c >= t * (len(s) + len(sets[j]) - c):
                up[find(k)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return sorted(((i, len(s), least[find(k)] if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def run(df, p):
    return sorted((tuple(r)[:3] for r in ngram_components(df, params=p).collect()), key=str)


@pytest.mark.parametrize("n,t", [(4, 85), (5, 80)])
def test_documents_match_brute_force(spark, n, t):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    assert run(df, NgramParams(n=n, threshold=t)) == brute([(r.doc_id, r.text) for r in df.collect()], n, t)


def test_near_copies_chains_and_hot_passages(spark):
    rng = random.Random(5)
    word = lambda: "w" + str(rng.randrange(5000))
    passage = [word() for _ in range(60)]
    base = [word() for _ in range(80)]
    rows = []
    for k in range(400):
        kind, text = k % 4, []
        if kind == 0:
            text = passage + [word() for _ in range(rng.randrange(120))]
        elif kind == 1:
            text = list(base)
            for _ in range(rng.randrange(5)):
                text[rng.randrange(80)] = word()
        elif kind == 2:
            base2 = list(base[:40]) + passage[:10]
            base2[rng.randrange(50)] = word()
            text = base2
        else:
            text = [word() for _ in range(rng.randrange(6))]
        rows.append((k, " ".join(text).title() if k % 3 else "  ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for p in (NgramParams(n=4, threshold=85, local=8, slice_bytes=20_000), NgramParams(n=4, threshold=85, few=1, block=16, columns=50), NgramParams(n=4, threshold=85, few=10**6), NgramParams(n=3, threshold=50)):
        assert run(df, p) == brute(rows, p.n, p.threshold)


def test_odd_rows(odd, nothing):
    assert run(odd, NgramParams()) == brute([(r.doc_id, r.text) for r in odd.collect()], 5, 80)
    assert ngram_components(nothing).count() == 0


def test_versions_in_a_chain_and_boilerplate(spark):
    """Versions that drift word by word are one component; texts of all lengths around one passage stay apart."""
    rng = random.Random(6)
    words = [f"v{k}" for k in range(2000)]
    ids = rng.sample(range(10**6), 600)
    rows = [(ids[k], " ".join(words[5 * k : 5 * k + 150])) for k in range(300)]
    passage = " ".join(f"p{k}" for k in range(40))
    rows += [(ids[300 + k], passage + "".join(f" q{k}_{j}" for j in range(k))) for k in range(250)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for p in (NgramParams(n=4, threshold=85), NgramParams(n=4, threshold=85, block=32, few=2)):
        got = run(df, p)
        assert got == brute(rows, p.n, p.threshold)
    assert len({c for i, _, c in got if i in set(ids[:300])}) == 1
