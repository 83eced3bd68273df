import numpy as np
import pyarrow as pa
import pytest

from lexvane.llm.toxicity import ToxicityModel, ToxicityParams, _dense, features, fit, fit_on_labels, margins, score_documents, telling_stretches, words_of

BAD = ["blorgnak", "fizzwump", "snargle"]


def _corpus(n=600, seed=0):
    rng = np.random.default_rng(seed)
    syl = ["ta", "re", "mi", "so", "la", "do", "ven", "ter", "al", "in"]
    texts, labels = [], []
    for k in range(n):
        words = ["".join(rng.choice(syl, int(rng.integers(1, 4)))) for _ in range(40)]
        if k % 3 == 0:
            words[int(rng.integers(40))] = BAD[k % 9 // 3]
        texts.append(" ".join(words))
        labels.append(int(k % 3 == 0))
    return texts, np.array(labels)


def test_kernel_map_matches_its_definition():
    word, decay = "^banana", 0.7
    want = {}
    for i in range(len(word)):
        for j in range(i + 1, len(word)):
            for k in range(j + 1, min(len(word), i + 5)):
                key = word[i] + word[j] + word[k]
                want[key] = want.get(key, 0) + decay ** (k - i - 2)
    _, u, x = features(["banana"], decay)
    assert len(u) == len(want)
    assert sorted(np.round(x, 4).tolist()) == pytest.approx(sorted(round(v, 4) for v in want.values()), abs=1e-3)


def test_held_out_texts_and_altered_insults():
    model = fit(*_corpus())
    texts, labels = _corpus(300, 1)
    said = model.score(pa.array(texts)) >= 0.3
    assert (said == labels).mean() > 0.98
    odd = ["so la b l o r g n a k mi", "ta fizz-wump re", "FIZZ*WUMP!", "la blorrgnak", "sna.rg.le", "so blorxgnak ta"]
    assert (model.score(pa.array(odd)) >= 0.3).sum() >= 5
    assert (model.score(pa.array(["talare misola", "", None, "…", "solado " * 3000])) < 0.3).all()


@pytest.mark.parametrize("glue", [12, 20, 30, 60, 400])
def test_insults_in_glued_text(glue):
    """An insult counts wherever it stands in a run and however long the run is, plain or spelt with signs or a letter put in."""
    model = fit(*_corpus())
    rng = np.random.default_rng(3)
    syl = ["ta", "re", "mi", "so", "la", "do", "ven", "ter", "al", "in"]
    runs = ["".join(rng.choice(syl, glue))[:glue] for _ in range(40)]
    insults = ["blorgnak", "fizzwump", "snargle", "f-i-z-z-w-u-m-p", "b.l.o.r.g.n.a.k", "fizzxwump", "SNARGLE"]
    glued = [r[:at] + bad + r[at:] for r in runs for bad in insults for at in [int(rng.integers(glue + 1))]]
    said = model.score(pa.array(glued)) >= 0.3
    assert said.mean() >= 0.95, [g for g, s in zip(glued, said, strict=True) if not s][:5]
    assert (model.score(pa.array(runs)) >= 0.3).mean() <= 0.05


def test_stretches_are_words_of_their_own():
    """Running sums give what a stretch has as a word, where no subsequence comes twice."""
    rng = np.random.default_rng(4)
    table, word = rng.normal(size=36**3), "abcdefghijklmnopqrstuvwxyz"
    best = max(margins([word[k : k + n]], table, 0.3, 0.7)[0] for n in range(5, 17) for k in range(len(word) - n + 1))
    assert margins([word, "x", word[:16]], table, 0.3, 0.7)[0] == pytest.approx(best, abs=1e-5)
    assert telling_stretches([word, "short"], table, 0.3, 0.7)[1] == "short"
    assert margins(telling_stretches([word], table, 0.3, 0.7), table, 0.3, 0.7)[0] == pytest.approx(best, abs=1e-5)


def test_insults_between_no_break_spaces():
    model = fit(*_corpus())
    clean = ["ta", "re", "mi", "so", "la", "do", "ven", "ter", "al", "in"] * 6
    for at in range(0, 40, 7):
        assert model.score(pa.array(["\u00a0".join([*clean[:at], "fizzwump", *clean[at:]])]))[0] >= 0.3
    assert model.score(pa.array(["\u00a0".join(clean)]))[0] < 0.3


def _plain_kernel(a, b, decay):
    """The normalised kernel of two words, from its definition."""

    def mapped(word):
        word, out = "^" + word, {}
        for i in range(len(word)):
            for j in range(i + 1, len(word)):
                for k in range(j + 1, min(len(word), i + 5)):
                    key = word[i] + word[j] + word[k]
                    out[key] = out.get(key, 0) + decay ** (k - i - 2)
        return out

    x, y = mapped(a), mapped(b)
    size = lambda m: sum(v * v for v in m.values()) ** 0.5
    return sum(v * y.get(k, 0) for k, v in x.items()) / (size(x) * size(y))


def test_decisions_match_the_landmark_form():
    """One table of subsequences decides as K(x, Z) K(Z, Z)^(-1/2) w does, and a text as its worst word."""
    p = ToxicityParams()
    marks, some = ["blorgnak", "snargle", "tarevan", "solado"], ["blorxgnak", "banana", "snargl", "teralin"]
    kzz = np.array([[_plain_kernel(a, b, p.decay) for b in marks] for a in marks])
    kxz = np.array([[_plain_kernel(a, b, p.decay) for b in marks] for a in some])
    assert _dense(marks, marks, p.decay) == pytest.approx(kzz, abs=1e-5) and _dense(some, marks, p.decay) == pytest.approx(kxz, abs=1e-5)
    vals, vecs = np.linalg.eigh(kzz)
    root, w = vecs / np.sqrt(vals) @ vecs.T, np.array([1.0, 0.5, -0.7, -0.2])
    zw, zu, zx = features(marks, p.decay)
    zx = zx / np.sqrt(np.bincount(zw, zx * zx))[zw]
    table = np.bincount(zu, zx * (root @ w)[zw], 36**3)
    assert margins(some, table, 0.1, p.decay) == pytest.approx(kxz @ root @ w + 0.1, abs=1e-4)
    model = ToxicityModel(table.astype(np.float32), 0.1, 2.0, 0.0, 0.0, p.decay)
    assert model.text_margins(pa.array([" ".join(some)]))[0] == pytest.approx((kxz @ root @ w + 0.1).max(), abs=1e-4)


def test_query_columns_and_what_is_never_learned_from(spark, tmp_path):
    """Rows of remainder 2 are held out: turning their labels round changes no score."""
    import zlib

    from lexvane.llm.queries import op1_toxicity

    texts, labels = _corpus(240)
    out = []
    for flip in (False, True):
        d = tmp_path / str(flip)
        spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
        rows = [(k, int(y) if not flip or zlib.crc32(str(k).encode()) % 4 != 2 else 1 - int(y)) for k, y in enumerate(labels)]
        spark.createDataFrame(rows, "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
        out.append(sorted(map(tuple, op1_toxicity(spark, str(d)).select("doc_id", "held_out", "score", "predicted").collect())))
    assert out[0] == out[1] and len(out[0]) == 240
    for i, held, score, predicted in out[0]:
        assert held == (zlib.crc32(str(i).encode()) % 4 == 2) and predicted == int(score >= 0.3)
    assert np.mean([r[3] == labels[r[0]] for r in out[0]]) > 0.95


def test_long_texts_and_clashing_names(spark):
    model = fit(*_corpus())
    df = spark.createDataFrame([(1, "talare " * 9000 + "snargle", 0.5), (2, "talare " * 9000, None)], "doc_id long, text string, score double")
    got = {r.doc_id: r for r in score_documents(df, model).collect()}
    assert got[1]._score >= 0.3 > got[2]._score and got[1].score == 0.5
    words, flat, sizes = words_of(pa.array(["a b a", None, ""]))
    assert [words[k] for k in flat] == ["a", "b", "a", "", ""] and sizes.tolist() == [3, 1, 1]


def test_odd_rows(spark, odd, nothing):
    model = fit(*_corpus(150))
    out = score_documents(odd, model)
    assert out.columns == [*odd.columns, "score"] and out.count() == odd.count()
    rows = out.collect()
    assert len({r.score for r in rows if r.doc_id in (6, 7)}) == 1
    assert all(0 <= r.score <= 1 for r in rows)
    assert score_documents(nothing, model).count() == 0
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 1)], "doc_id long, toxic int")
    assert fit_on_labels(odd, labels).table is None
    assert fit_on_labels(nothing, labels.where("false")).constant == 0.0
    assert ToxicityModel(None, 0, 1, 0, 0.25, 0.7).score(pa.array(["a", None])).tolist() == [0.25, 0.25]
    assert margins([], np.zeros(36**3), 0.0, 0.7).tolist() == []
