import numpy as np

from lexvane.operators import cells as X
from lexvane.operators.retrieval import nearest

SF = "/root/testdata/sf0.01"


def test_recall_and_exact_mode(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    asked = e.where("vec_id % 100 = 0")
    want = {(r.query_id, r.vec_id) for r in nearest(e, asked, 10).collect()}
    centres = X.fit_cells(e, 16, sample=300)
    X.write_cells(e, centres, f"{tmp_path}/i")
    index = spark.read.parquet(f"{tmp_path}/i")
    assert index.count() == e.count()
    recall = lambda n: len(want & {(r.query_id, r.vec_id) for r in X.search_cells(index, centres, asked, 10, n).collect()}) / len(want)
    probes = X.probes_for(index, centres, e.where("vec_id % 50 = 1"), 10)
    assert 1 <= probes < len(centres) and recall(probes) >= 0.9 and recall(len(centres)) == 1.0


def test_odd_vectors(spark, tmp_path):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [0.0, 3.0])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    centres = X.fit_cells(e, 2)
    X.write_cells(e, centres, f"{tmp_path}/i")
    got = X.search_cells(spark.read.parquet(f"{tmp_path}/i"), centres, e, 2, 2).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == [(0, 1, 0, 1.0), (0, 2, 1, 1.0), (1, 1, 0, 1.0), (1, 2, 1, 1.0), (6, 1, 6, 1.0), (6, 2, 0, 0.0)]
    assert X.fit_cells(e.where("false"), 4).shape == (0, 0) and np.allclose(np.linalg.norm(centres, axis=1), 1)
