import hashlib
import random

import pytest

from lexvane.llm.components import components


def _label(k):
    return bytearray(hashlib.md5(str(k).encode()).digest())


def test_long_chain_with_random_labels_settles(spark):
    n = 10_000
    df = spark.createDataFrame([(_label(k), _label(k + 1)) for k in range(n - 1)], "a binary, b binary")
    rows = components(df).collect()
    least = bytes(min(_label(k) for k in range(n)))
    assert len(rows) == n and {bytes(r.root) for r in rows} == {least}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(5, 5), (7, 8), (8, 7), (7, 8), (None, 3), (1000, 1000)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((r.node, r.root) for r in got) == sorted((x, find(x)) for x in up)


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
