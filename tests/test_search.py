import numpy as np
import pytest

from lexvane.operators import retrieval as R
from lexvane.queries import QUERIES
from tests.conftest import SF


def _brute(rows, ids, k):
    m = np.array([r.embedding for r in rows], float)
    m /= np.linalg.norm(m, axis=1)[:, None]
    out = {}
    for r, v in zip(rows, m, strict=True):
        if r.vec_id in ids:
            score = np.round(m @ v, 9)
            out[r.vec_id] = [(rows[i].vec_id, score[i]) for i in sorted(range(len(rows)), key=lambda i: (-score[i], rows[i].vec_id))[:k]]
    return out


@pytest.mark.parametrize("size,block", [(4096, 256), (64, 2)])
def test_every_hundredth_vector_meets_all(spark, monkeypatch, size, block):
    monkeypatch.setattr(R, "SLICE", size)
    monkeypatch.setattr(R, "BLOCK", block)
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    asked = {r.vec_id for r in rows if r.vec_id % 100 == 0}
    want, got = _brute(rows, asked, 10), {}
    for r in sorted(QUERIES["dense_knn_topk"](spark, SF).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == asked and len(asked) == 5
    for q, best in want.items():
        assert [v for v, _ in got[q]] == [v for v, _ in best] and np.allclose([s for _, s in got[q]], [s for _, s in best], atol=2e-9)
    label, near, fused = {r.vec_id: r.label for r in rows}, _brute(rows, asked, 100), {}
    for r in sorted(QUERIES["hybrid_rrf"](spark, SF).collect(), key=lambda r: r["rank"]):
        fused.setdefault(r.query_id, []).append(r.vec_id)
    assert fused.keys() == asked
    for q in asked:
        score = {}
        for found in ([v for v, _ in near[q]], sorted(v for v in label if label[v] == label[q])[:50]):
            for k, v in enumerate(found, 1):
                score[v] = score.get(v, 0) + 1 / (60 + k)
        assert fused[q] == sorted(score, key=lambda v: (-round(score[v], 9), v))[:10]


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0]), (4, [2.0, 0.0]), (5, [None, 1.0]), (6, [-1.0, 0.0])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.vec_id, r.score) for r in sorted(R.nearest(e, e.where("vec_id = 0"), 7).collect(), key=lambda r: r["rank"])]
    assert got == [(0, 1.0), (4, 1.0), (1, 0.0), (2, 0.0), (3, 0.0), (5, 0.0), (6, -1.0)]
    assert R.nearest(e.where("false"), e.where("vec_id = 0"), 7).count() == 0
