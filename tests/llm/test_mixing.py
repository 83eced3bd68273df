import numpy as np
import pytest

from lexvane.llm.mixing import MixParams, mix, rake, rake_kept


def test_raking_meets_the_margins(spark):
    rng = np.random.default_rng(0)
    rows = [(f"s{i}", lang, t, int(rng.integers(100, 10_000)) * (50 if i == 0 else 1), 1) for i in range(6) for lang in ("en", "de", "fr") for t in ("a", "b")]
    p = MixParams(targets={"lang": {"en": 0.5, "de": 0.3}, "topic": {"a": 0.6, "b": 0.4}}, rounds=30)
    got = rake(spark.createDataFrame(rows, "source string, lang string, topic string, tokens long, n long"), p).toPandas()
    total = got.tokens.sum()
    assert got.groupby("lang").weight.sum().div(total).to_dict() == pytest.approx({"en": 0.5, "de": 0.3, "fr": 0.2}, abs=1e-3)
    assert got.groupby("topic").weight.sum().div(total).to_dict() == pytest.approx({"a": 0.6, "b": 0.4}, abs=1e-3)
    own = got.groupby("source").tokens.sum() ** 0.5
    assert got.groupby("source").weight.sum().div(total).to_dict() == pytest.approx((own / own.sum()).to_dict(), abs=1e-3)
    # The same fixed point as plain fitting in numpy.
    x = got.pivot_table(index="source", columns=["lang", "topic"], values="tokens").to_numpy().reshape(6, 3, 2).astype(float)
    langs, goals = sorted(set(got.lang)), {"en": 0.5, "de": 0.3, "fr": 0.2}
    for _ in range(200):
        x *= ((own / own.sum()).to_numpy() / x.sum(axis=(1, 2)))[:, None, None]
        x *= (np.array([goals[k] for k in langs]) / x.sum(axis=(0, 2)))[None, :, None]
        x *= (np.array([0.6, 0.4]) / x.sum(axis=(0, 1)))[None, None, :]
    y = got.pivot_table(index="source", columns=["lang", "topic"], values="weight").to_numpy().reshape(6, 3, 2) / total
    assert np.abs(x - y).max() < 1e-3


def test_sampling_meets_the_probabilities(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "repeat('word ', 20) AS text", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 5) END AS source", "CASE WHEN id % 4 = 0 THEN 'de' ELSE 'en' END AS lang")
    out = mix(docs, params=MixParams(keep=0.5)).toPandas()
    assert out.mix_tokens.eq(20).all() and len(out) == 20_000
    assert (out.mix_prob * out.mix_tokens).sum() == pytest.approx(0.5 * out.mix_tokens.sum(), rel=0.01)
    assert out.mix_keep.mean() == pytest.approx(0.5, abs=0.015)
    for _, g in out.groupby(["source", "lang"]):
        assert abs(g.mix_keep.mean() - g.mix_prob.iloc[0]) < 5 * (0.25 / len(g)) ** 0.5


def test_odd_rows(odd, nothing):
    rows = mix(odd).collect()
    assert len(rows) == odd.count() and all(r.mix_prob is not None for r in rows)
    assert len({r.mix_keep for r in rows if r.doc_id == 7}) == 1
    assert mix(nothing).count() == 0


def _kept(spark, rows, p):
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long, n long")
    got = cells.join(rake_kept(cells, p), ["source", "lang", "topic"]).toPandas()
    got["kept"] = got.tokens * got.prob
    assert len(got) == len(rows) and got.prob.between(0, 1).all()
    return got, lambda m: got.groupby(m).kept.sum().div(got.kept.sum()).to_dict()


def test_kept_tokens_meet_the_targets_when_cells_are_kept_whole(spark):
    # Cells of b are small in s0 and s1, so they reach the bound and the others have to make up for them.
    rows = [(f"s{i}", lang, "t", n, 1) for i, (a, b) in enumerate([(9000, 100), (5000, 200), (3000, 4000)]) for lang, n in (("a", a), ("b", b))]
    got, share = _kept(spark, rows, MixParams(targets={"source": {"s0": 0.4, "s1": 0.3, "s2": 0.3}, "lang": {"a": 0.75, "b": 0.25}}, keep=0.6, rounds=40))
    assert (got.prob == 1).any() and got.kept.sum() == pytest.approx(0.6 * got.tokens.sum(), rel=1e-3)
    assert share("source") == pytest.approx({"s0": 0.4, "s1": 0.3, "s2": 0.3}, abs=1e-3)
    assert share("lang") == pytest.approx({"a": 0.75, "b": 0.25}, abs=1e-3)


def test_targets_without_enough_tokens_lower_what_is_kept(spark):
    rows = [(s, lang, t, n, 1) for s in ("x", "y") for t in ("p", "q") for lang, n in (("en", 7000), ("es", 500))]
    rows.append(("x", "en", "rare", 10, 1))
    with pytest.warns(UserWarning, match="topic: .*rare"):
        got, share = _kept(spark, rows, MixParams(targets={"lang": {"en": 0.8, "es": 0.2}}, keep=0.7))
    assert share("lang") == pytest.approx({"en": 0.8, "es": 0.2}, abs=1e-3)
    assert got[got.lang == "es"].prob.to_list() == pytest.approx([1.0] * 4, abs=1e-3) and got.kept.sum() == pytest.approx(2000 / 0.2, rel=1e-3)
    assert got[got.topic == "rare"].prob.to_list() == pytest.approx([1.0], abs=1e-3)  # a margin without targets is held at what it has


def test_documents_kept_meet_the_targets(spark):
    docs = spark.range(30_000).selectExpr("id AS doc_id", "repeat('word ', 20) AS text", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 5) END AS source", "CASE WHEN id % 12 = 0 THEN 'es' WHEN id % 4 = 1 THEN 'de' ELSE 'en' END AS lang")
    out = mix(docs, params=MixParams(targets={"lang": {"en": 0.55, "de": 0.3, "es": 0.15}})).toPandas()
    got = out[out.mix_keep].groupby("lang").mix_tokens.sum() / out[out.mix_keep].mix_tokens.sum()
    assert got.to_dict() == pytest.approx({"en": 0.55, "de": 0.3, "es": 0.15}, abs=0.015)
