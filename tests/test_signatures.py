"""Row significance against all scores: counts, order, rows without hits, other lengths, nulls and empty tables."""

import numpy as np
import pytest

from tesserae.operators import vectors as V


def test_signatures_against_all_scores(spark):
    rng = np.random.default_rng(2)
    base = [(i, rng.normal(size=6).round(2).tolist()) for i in range(3000)] + [(5000 + i, [9.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(4)] + [(9000, [1.0, 2.0]), (9001, None)]
    queries = [(i, v) for i, v in base if i % 40 == 0] + [(7, [0.0] * 6), (8, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]), (9, [1.0])]
    schema = "vec_id bigint, embedding array<double>"
    b, q = spark.createDataFrame(base, schema).repartition(7), spark.createDataFrame(queries, schema)
    got = {r.row: r for r in V.signatures(q, b, 2.0, 5).collect()}
    assert set(got) == {i for i, _ in queries}
    flat = {(r.row, r["rank"]): r for r in V.rowsig(q, b, 2.0, 5).collect()}
    for i, v in queries:
        r, own = got[i], [(k, np.dot(v, x)) for k, x in base if x is not None and len(x) == len(v)]
        assert r.n == len(own)
        if not own:
            assert (r.mean, r.sd, r.above, r.hits) == (None, None, 0, [])
            continue
        s = np.array([x for _, x in own])
        mean, sd = s.mean(), s.std() if s.std() > 0 else 1e-12
        assert r.mean == pytest.approx(mean, abs=1e-12) and r.sd == pytest.approx(sd, rel=1e-9)
        hit = sorted((-x, k) for k, x in own if x > mean + 2 * sd)
        assert (r.above, r.above4, r.above5) == (len(hit), *(sum(-x > mean + z * sd for x, _ in hit) for z in (4, 5)))
        assert [(h["rank"], h.id) for h in r.hits] == [(n + 1, k) for n, (_, k) in enumerate(hit[:5])]
        assert all(flat[i, h["rank"]].id == h.id for h in r.hits)
    assert got[7].above == 0 and got[8].above > 5 and [h.id for h in got[8].hits[:4]] == [5000, 5001, 5002, 5003]
    assert len(flat) == sum(len(r.hits) for r in got.values())


def test_signatures_of_nothing(spark):
    schema = "vec_id bigint, embedding array<double>"
    none, one = spark.createDataFrame([], schema), spark.createDataFrame([(1, [1.0, 2.0])], schema)
    assert V.signatures(none, one).count() == 0
    assert [(r.n, r.above, r.hits) for r in V.signatures(one, none).collect()] == [(0, 0, [])]
