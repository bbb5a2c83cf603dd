"""Medians by narrowing brackets against numpy, with ties, nulls, NaN and groups of all sizes."""

import numpy as np
import pytest

from tesserae.operators.quantiles import medians


def test_medians_of_all_kinds(spark):
    rng = np.random.default_rng(1)
    groups = {
        "normal": rng.normal(size=3001), "even": rng.normal(size=3000), "ties": rng.integers(0, 3, 3000).astype(float), "one": np.full(2000, 7.0),
        "most": np.concatenate([np.full(2990, 1.0), rng.normal(size=10)]), "halves": np.repeat([1.0, 2.0], 1000), "long tail": np.exp(rng.normal(size=2000) * 20),
        "ends": np.array([-np.inf, np.inf] * 500 + [3.0]), "nan": np.concatenate([np.full(900, np.nan), np.arange(1100.0)]), "small": np.array([4.0, 1.0, 3.0]), None: rng.normal(size=999),
    }
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("normal", None), ("nothing", None)]
    df = spark.createDataFrame(rows, "kind string, x double").repartition(5)
    for gathered in (20, 500, 100_000):
        got = {r.kind: r.mid for r in medians(df, "kind", "x", "mid", gathered).collect()}
        assert set(got) == set(groups)
        for g, vs in groups.items():
            s = np.sort(vs)  # NaN last
            want = (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2
            assert got[g] == pytest.approx(want, nan_ok=True, rel=1e-15), (g, gathered)


def test_medians_of_nothing(spark):
    assert medians(spark.createDataFrame([], "k int, x double"), "k", "x").count() == 0
