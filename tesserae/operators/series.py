"""The joint posterior of claims from their roots, where a claim may have more roots than one task should hold.

A claim's strength is the zero of a falling sum over its roots. A claim of few roots is solved in its group. For the others each
step of a bracketed Newton search is an aggregate: the claims' strengths are broadcast, each root answers where it is
with its slope and its information, and both are summed per claim before they are shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.functions import ratings as R
from tesserae.operators.checkpoints import cut, written

#: A claim of more roots than this is solved by aggregates.
GATHERED = 100_000
#: Claims solved by aggregates, at most: their strengths are broadcast. With more roots in all, GATHERED grows.
BROADCAST = 100_000
#: A search halves its bracket or its step in each round, so it ends long before.
ROUNDS = 400
MU0, PHI2 = 0.0, (R.DEVIATION / R.SCALE) ** 2
_OPTIONAL = {"opponent": R.RATING, "opponent_deviation": 0.0, "witness_deviation": 0.0}


def _optional(folded: DataFrame) -> dict:
    return {c: F.coalesce(F.col(c).cast("double"), F.lit(v)) if c in folded.columns else F.lit(v) for c, v in _OPTIONAL.items()}


def _roots(folded: DataFrame) -> DataFrame:
    """claim, root and what a root says in numbers: n games with a score, against an anchor, by weight and precision."""
    o = _optional(folded)
    t = F.least(F.col("trust").cast("double"), F.lit(1.0))
    use = folded.where("games > 0 and trust > 0 and not isnan(trust)")
    score = 0.5 + F.col("trust") * (F.col("wins") / F.col("games") - 0.5)
    weight = 1.0 / F.sqrt(1.0 + 3.0 * F.pow(o["opponent_deviation"] / R.SCALE, F.lit(2.0)) / F.pow(F.lit(np.pi), F.lit(2.0)))
    precision = R.witness_precision(t, F.greatest(F.lit(R.FLOOR), o["witness_deviation"]))
    return use.select("claim", "root", F.col("games").cast("double").alias("n"), score.alias("score"), ((o["opponent"] - R.RATING) / R.SCALE).alias("anchor"), weight.alias("weight"), precision.alias("precision"))


def _answers(roots: DataFrame, state: DataFrame, keep: list[str]) -> DataFrame:
    """`keep`, slope and information of each root whose claim has a strength `mu` in `state`; roots stay where they are."""
    at = F.broadcast(state.select(F.col("claim").alias("_claim"), "mu"))
    joined = roots.join(at, F.col("claim").eqNullSafe(F.col("_claim"))).drop("_claim")

    def run(batches):
        for batch in batches:
            numbers = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("mu", "n", "score", "anchor", "weight", "precision"))
            slope, info = R.sources(*numbers)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(slope), pa.array(info)], names=[*keep, "slope", "information"])

    numbers = [T.StructField(c, T.DoubleType()) for c in ("slope", "information")]
    return joined.mapInArrow(run, T.StructType([*(roots.schema[c] for c in keep), *numbers]))


def _sums(roots: DataFrame, state: DataFrame) -> DataFrame:
    return _answers(roots, state, ["claim"]).groupBy(F.col("claim").alias("_claim")).agg(F.sum("slope").alias("gain"), F.sum("information").alias("information"))


def strengths(roots: DataFrame) -> DataFrame:
    """(claim, mu) of each claim of `roots`, of which there must be few enough to broadcast.

    The bracket: no root pulls beyond its own games' score, nor harder than its games, so one aggregate bounds the zero.
    A step that leaves the bracket, or isn't half as long as the one before, is replaced by halving.
    """
    target = F.col("anchor") + F.when(F.col("score") <= 0, float("-inf")).when(F.col("score") >= 1, float("inf")).otherwise(F.log(F.col("score") / (1.0 - F.col("score")))) / F.col("weight")
    reach = PHI2 * F.sum(F.col("n") * F.col("weight"))
    ends = roots.groupBy("claim").agg(F.greatest(MU0 - reach, F.least(F.lit(MU0), F.min(target))).alias("lo"), F.least(MU0 + reach, F.greatest(F.lit(MU0), F.max(target))).alias("hi"))
    state = cut(ends.select("claim", "lo", "hi", F.lit(MU0).alias("mu"), F.lit(float("inf")).alias("step")))
    ready = []
    for _ in range(ROUNDS):
        s = state.join(_sums(roots, state), F.col("claim").eqNullSafe(F.col("_claim")))
        slope = (MU0 - F.col("mu")) / PHI2 + F.col("gain")
        s = s.withColumns({"new": F.col("mu") + slope / (1.0 / PHI2 + F.col("information")), "lo": F.when(slope >= 0, F.col("mu")).otherwise(F.col("lo")), "hi": F.when(slope <= 0, F.col("mu")).otherwise(F.col("hi"))})
        fine = (F.col("new") >= F.col("lo")) & (F.col("new") <= F.col("hi")) & (F.abs(F.col("new") - F.col("mu")) <= 0.5 * F.col("step"))
        s = s.withColumn("new", F.when(fine, F.col("new")).otherwise(F.col("lo") + 0.5 * (F.col("hi") - F.col("lo"))))
        s = s.withColumn("step", F.abs(F.col("new") - F.col("mu")))
        s = cut(s.select("claim", "lo", "hi", F.col("new").alias("mu"), "step", (F.col("step") <= 1e-13 * F.greatest(F.lit(1.0), F.abs("new"))).alias("done")))
        ready.append(s.where("done").select("claim", "mu"))
        state = s.where("not done").drop("done")
        if state.isEmpty():
            break
    else:
        raise ValueError(f"strengths not found in {ROUNDS} rounds")
    out = ready[0]
    for more in ready[1:]:
        out = out.unionByName(more)
    return cut(out.coalesce(1))


def _split(folded: DataFrame, gathered: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of claims to solve in their groups, and those of claims to solve by aggregates (None: there are none)."""
    folded = written(folded)
    sizes = folded.groupBy("claim").agg(F.count("*").alias("size"))
    most, total = sizes.agg(F.max("size"), F.sum("size")).first()
    gathered = max(gathered, (total or 0) // BROADCAST)
    if (most or 0) <= gathered:
        return folded, None
    large = F.broadcast(cut(sizes.where(F.col("size") > gathered).select(F.col("claim").alias("_claim"))))
    same = F.col("claim").eqNullSafe(F.col("_claim"))
    return folded.join(large, same, "left_anti"), folded.join(large, same, "left_semi")


def _series(pdf: pd.DataFrame) -> dict:
    return R.series(pdf["games"], pdf["wins"], pdf["trust"], pdf["opponent"], pdf["opponent_deviation"], pdf["witness_deviation"])


_STANDING = "rating double, deviation double, volatility double, matches bigint, witnesses bigint"


def standings(folded: DataFrame, gathered: int = GATHERED) -> DataFrame:
    """(claim, rating, deviation, volatility, matches, witnesses) from (claim, root, games, wins, trust), a row for each root.

    Columns opponent, opponent_deviation and witness_deviation count where they are there; null in them is their default.
    Roots without games or trust don't inform; a claim with none that does keeps the prior. No rows: no rows.
    """
    folded = folded.select("claim", "root", "games", "wins", F.col("trust").cast("double").alias("trust"), *(c.alias(k) for k, c in _optional(folded).items()))
    kind = folded.schema["claim"].dataType.simpleString()
    few, many = _split(folded, gathered)

    def solve(pdf):
        s = _series(pdf)
        return pd.DataFrame({"claim": [pdf["claim"].iloc[0]], **{k: [s[k]] for k in ("rating", "deviation", "volatility", "matches", "witnesses")}})

    out = few.groupBy("claim").applyInPandas(solve, f"claim {kind}, {_STANDING}")
    if many is None:
        return out
    roots = written(_roots(many))
    solved = strengths(roots)
    counts = many.groupBy("claim").agg(F.sum("games").cast("bigint").alias("matches"), F.count(F.when((F.col("games") > 0) & (F.col("trust") > 0) & ~F.isnan("trust"), 1)).alias("witnesses"))
    sums = solved.join(_sums(roots, solved), F.col("claim").eqNullSafe(F.col("_claim"))).select("_claim", "mu", "gain", "information")
    ended = counts.join(sums, F.col("claim").eqNullSafe(F.col("_claim")), "left").drop("_claim")

    def finish(batches):
        for batch in batches:
            rows = batch.to_pydict()
            ends = [R.settle(m, g, i) if i else (R.RATING, R.DEVIATION, R.VOLATILITY) for m, g, i in zip(rows["mu"], rows["gain"], rows["information"])]
            arrays = [pa.array([e[k] for e in ends], pa.float64()) for k in range(3)]
            take = {c: batch.column(batch.schema.get_field_index(c)) for c in ("claim", "matches", "witnesses")}
            yield pa.RecordBatch.from_arrays([take["claim"], *arrays, take["matches"], take["witnesses"]], names=["claim", "rating", "deviation", "volatility", "matches", "witnesses"])

    return out.unionByName(ended.mapInArrow(finish, out.schema))


def information(folded: DataFrame, gathered: int = GATHERED) -> DataFrame:
    """(claim, root, information) of each root that informs; columns as for standings()."""
    folded = folded.select("claim", "root", "games", "wins", F.col("trust").cast("double").alias("trust"), *(c.alias(k) for k, c in _optional(folded).items()))
    few, many = _split(folded, gathered)

    def solve(pdf):
        out = pdf[["claim", "root"]].copy()
        out["information"] = _series(pdf)["information"]
        return out[out["information"] > 0]

    kinds = {c: folded.schema[c].dataType.simpleString() for c in ("claim", "root")}
    out = few.groupBy("claim").applyInPandas(solve, f"claim {kinds['claim']}, root {kinds['root']}, information double")
    if many is None:
        return out
    roots = written(_roots(many))
    return out.unionByName(_answers(roots, strengths(roots), ["claim", "root"]).where("information > 0").drop("slope"))
