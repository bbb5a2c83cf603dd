"""Top-k over many lanes, packs and copies against all scores."""

import math

import numpy as np
from pyspark.sql import functions as F

from tesserae.llm import top_k as K


def test_many_lanes_share_their_thresholds(spark, monkeypatch):
    for name, value in (("LANE", 60), ("BLOCK", 16), ("PACK", 5), ("QUERIES", 20)):
        monkeypatch.setattr(K, name, value)
    rng = np.random.default_rng(21)
    centers = rng.normal(size=(12, 6)) * 3
    vectors = [(i, [float(x) for x in centers[i // 60] + rng.normal(size=6)]) for i in range(720)] + [(900 + i, [0.5] * 6) for i in range(30)] + [(1, [9.0] * 3)]
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>").repartition(4)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in K.top_k(df, F.col("vec_id") % 10 == 0).collect())
    whole = {i: np.floor(1024 * np.array(v)).astype(np.int64) for i, v in vectors[:-1]}
    want = []
    for q in whole:
        if q % 10 == 0:
            best = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:10]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want) and math.isclose(len(want), 75 * 10)


def test_fewer_than_k(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [1.0]), (100, [1.0, 1.0])], "vec_id bigint, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in K.top_k(df, F.col("vec_id") % 100 == 0).collect())
    assert got == [(0, 1, 1, 2 << 20), (0, 2, 2, 1 << 20)]
