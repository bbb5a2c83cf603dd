"""Series solved by aggregates against the solver of one group, and a claim of a million roots."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions import ratings as R
from tesserae.operators import series as S

COLUMNS = ("rating", "deviation", "volatility", "matches", "witnesses")


def _entries(spark, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for claim, size in (("a", 400), ("b", 37), ("c", 1), ("d", 90), (None, 25)):
        for root in range(size):
            games = int(rng.choice([0, 1, 3, 50, 4000]))
            wins = float(rng.choice([0, 0.5, 1]) * games if claim != "d" else games)
            trust = float(rng.choice([0.0, 0.1, 0.6, 0.95, 1.0]))
            rows.append((claim, root, games, wins, trust, float(rng.choice([1500, 1700, 900])), float(rng.choice([0, 80])), float(rng.choice([0, 200]))))
    rows += [("idle", 1, 0, 0.0, 0.9, None, None, None), ("idle", 2, 4, 4.0, 0.0, None, None, None)]
    return rows, spark.createDataFrame(rows, "claim string, root int, games bigint, wins double, trust double, opponent double, opponent_deviation double, witness_deviation double")


def test_aggregates_equal_the_group(spark):
    rows, df = _entries(spark)
    got = {r.claim: r for r in S.standings(df, gathered=0).collect()}
    grouped = {r.claim: r for r in S.standings(df).collect()}
    assert set(got) == set(grouped) == {r[0] for r in rows}
    for claim in got:
        mine = [r for r in rows if r[0] == claim]
        arrays = [np.array([r[k] for r in mine], float) for k in range(2, 8)]
        want = R.series(*arrays[:3], *(None if np.isnan(x).any() else x for x in arrays[3:]))
        for c in COLUMNS:
            assert got[claim][c] == pytest.approx(want[c], abs=1e-7) and grouped[claim][c] == pytest.approx(want[c], abs=1e-7), (claim, c)


def test_information_of_roots(spark):
    _, df = _entries(spark, 4)
    one, two = ({(r.claim, r.root): r.information for r in S.information(df, gathered=g).collect()} for g in (0, 1000))
    assert set(one) == set(two) and all(one[k] == pytest.approx(two[k], rel=1e-9) for k in one)


def test_zero_is_a_zero(spark):
    """The sum that a strength makes zero, by bisection of the whole posterior."""
    rows, df = _entries(spark, 5)
    for r in S.standings(df.where("claim = 'a'").drop("opponent", "opponent_deviation", "witness_deviation"), gathered=0).collect():
        n, wins, trust = (np.array([x[k] for x in rows if x[0] == "a" and x[2] > 0 and x[4] > 0], float) for k in (2, 3, 4))
        with np.errstate(divide="ignore"):
            precision = np.minimum((R.SCALE / R.FLOOR) ** 2, 3 * trust**2 / (np.pi**2 * (1 - trust**2)))
        score = 0.5 + trust * (wins / n - 0.5)
        lo, hi = -100.0, 100.0
        for _ in range(100):
            mu = (lo + hi) / 2
            a, b = np.full(len(n), -1e5), np.full(len(n), 1e5)
            for _ in range(90):
                x = (a + b) / 2
                up = precision * (mu - x) + n * (score - 1 / (1 + np.exp(-np.clip(x, -700, 700)))) > 0
                a, b = np.where(up, x, a), np.where(up, b, x)
            lo, hi = (mu, hi) if -mu / S.PHI2 + (precision * (a - mu)).sum() > 0 else (lo, mu)
        assert r.rating == pytest.approx(R.RATING + R.SCALE * lo, abs=1e-5)


def test_empty_and_extra_columns(spark):
    df = spark.createDataFrame([], "claim string, root int, games bigint, wins double, trust double, mu double, size int")
    assert S.standings(df).count() == S.information(df, gathered=0).count() == 0
    one = spark.createDataFrame([("x", 1, 5, 4.0, 0.9, 7.0, 1)], df.schema)
    assert S.standings(one, gathered=0).collect()[0].rating == pytest.approx(S.standings(one).collect()[0].rating, abs=1e-9)


def test_claim_of_a_million_roots(spark):
    """A claim of 10^6 roots beside 1,000 small ones: solved by aggregates, and equal to the group's solver on the whole claim."""
    n = 1_000_000
    hot = spark.range(n).select(F.lit(-1).cast("bigint").alias("claim"), F.col("id").alias("root"))
    cold = spark.range(3000).select((F.col("id") % 1000).alias("claim"), F.col("id").alias("root"))
    k = F.pmod(F.xxhash64("root", "claim"), F.lit(97))
    df = hot.unionByName(cold).select("claim", "root", (1 + k % 7).alias("games"), ((1 + k % 7) * (k % 5) / 4.0).alias("wins"), ((k % 19 + 1) / 20.0).alias("trust"))
    got = {r.claim: r for r in S.standings(df).collect()}
    assert len(got) == 1001 and got[-1].witnesses == n
    # equal roots count as often as they come: the whole claim in one process, as the group's solver sees it
    pdf = df.where("claim = -1").select("games", "wins", "trust").toPandas()
    want = R.series(pdf["games"], pdf["wins"], pdf["trust"])
    for c in COLUMNS:
        assert got[-1][c] == pytest.approx(want[c], rel=1e-9)
