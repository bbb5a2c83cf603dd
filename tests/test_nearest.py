"""Nearest vectors by estimates that are made exact where they must be, against exact distances of all pairs."""

import numpy as np
import pytest

from tesserae.operators import vectors as V


def brute(q, b, ids, k):
    d2 = V.squared_distances(q, b)
    return [[(int(ids[j]), d2[i, j]) for j in np.lexsort((ids, d2[i]))[:k]] for i in range(len(q))]


def found(block, n):
    out = [[] for _ in range(n)]
    for r, i, d in zip(block.rows, block.found, block.d2):
        out[r].append((int(i), d))
    return out


@pytest.mark.parametrize("shift", [0.0, 1e7])
def test_blocks_give_exact_neighbours(shift):
    rng = np.random.default_rng(3)
    q, b = rng.normal(size=(50, 24)) + shift, rng.normal(size=(3000, 24)) + shift
    b[100:200] = b[0]  # ties
    ids = rng.permutation(3000)
    block = V.Nearest(q, np.arange(50), 7)
    for at in range(0, 3000, 500):
        block.meet(b[at : at + 500], ids[at : at + 500])
    assert found(block, 50) == brute(q, b, ids, 7)
    if not shift:
        assert block.rescored < 50 * 3000 / 50  # estimates alone settle the others


def test_far_values_and_short_tables():
    q, b = np.array([[1e200, 0.0], [0.0, 1.0]]), np.array([[1e200, 1.0], [0.0, 3.0], [0.0, 1.0]])
    block = V.Nearest(q, np.arange(2), 5)
    block.meet(b, np.array([3, 1, 2]))
    assert [i for i, _ in found(block, 2)[1]] == [2, 1, 3] and found(block, 2)[0][0] == (3, 1.0)


def test_few_blocks_held(spark, monkeypatch):
    monkeypatch.setattr(V, "HELD", 1)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(0, 4, 3)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(5)
    got = {}
    for r in V.knn(df, df, 4).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append((r.id, r.d2))
    m, ids = np.array([v for _, v in rows]), np.arange(300)
    assert got == dict(enumerate(brute(m, m, ids, 4)))
