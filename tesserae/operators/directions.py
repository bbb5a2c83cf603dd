"""Means of directions by group. Groups of at most GATHERED points are taken together; of larger ones only sums are made."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.functions import sphere
from tesserae.operators.checkpoints import cut

#: Points of a group that one task takes at once.
GATHERED = 1 << 17
_NAMES = [f"p{d}" for d in range(4)]


def _unit_points(df: DataFrame, key: str, at: list[str]) -> DataFrame:
    return df.select(key, *(c.alias(n) for c, n in zip(sphere.unit([F.col(c).cast("double") for c in at]), _NAMES)))


def _settled(points: np.ndarray, at: np.ndarray, steps: int, tolerance: float) -> np.ndarray | None:
    """Where the mean tangent towards the points vanishes, from `at` on; null if the steps don't settle."""
    for _ in range(steps):
        cosine = points @ at
        across = points - np.outer(cosine, at)
        sine = np.linalg.norm(across, axis=1)
        turn = np.divide(np.arctan2(sine, cosine), sine, out=np.zeros_like(sine), where=sine != 0)
        move = turn @ across / len(points)
        far = np.linalg.norm(move)
        if far > 0:
            at = np.cos(far) * at + np.sin(far) / far * move
            at = at / np.linalg.norm(at)
        if not far >= tolerance:
            return at if far < tolerance else None
    return None


def karcher_means(df: DataFrame, key: str, at: list[str], steps: int = 128, tolerance: float = 1e-12, gathered: int = GATHERED) -> DataFrame:
    """(key, karcher): the point of the sphere that has no mean tangent towards the group's directions.

    Null if the steps don't settle, as for points at the origin. A group whose directions cancel out begins at its least
    point. For groups of more than `gathered` points a step is one aggregate: the mean of the tangents at where each
    group stands, which it then follows.
    """
    points = cut(_unit_points(df, key, at))
    sums = points.groupBy(key).agg(*(F.sum(n).alias(n) for n in _NAMES), F.min(F.struct(*_NAMES)).alias("least"), F.count("*").alias("n"))
    flat = F.lit(True)
    for n in _NAMES:
        flat = flat & (F.col(n) == 0)
    start = sphere.unit([F.when(flat, F.col(f"least.{n}")).otherwise(F.col(n)) for n in _NAMES])
    sums = cut(sums.select(F.col(key).alias("_key"), "n", *(c.alias(f"a{d}") for d, c in enumerate(start))))
    here = [F.col(f"a{d}") for d in range(4)]
    own = points.join(sums, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        found = _settled(pdf[_NAMES].to_numpy(), pdf[["a0", "a1", "a2", "a3"]].iloc[0].to_numpy(), steps, tolerance)
        return pd.DataFrame({key: pdf[key].iloc[:1], "karcher": [found]})

    schema = T.StructType([df.schema[key], T.StructField("karcher", T.ArrayType(T.DoubleType()))])
    small = own.where(F.col("n") <= gathered).groupBy(key).applyInPandas(together, schema)
    state = sums.where(F.col("n") > gathered).select("_key", *here)
    if state.isEmpty():
        return small
    large = points.join(state.select("_key"), F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
    keys, done = state.select("_key"), None
    for _ in range(steps):
        tangents = sphere.log(here, [F.col(n) for n in _NAMES])
        means = large.join(state, F.col(key).eqNullSafe(F.col("_key"))).groupBy("_key", *(f"a{d}" for d in range(4))).agg(*(F.avg(c).alias(f"g{d}") for d, c in enumerate(tangents)))
        g = [F.col(f"g{d}") for d in range(4)]
        moved = cut(means.select("_key", *(c.alias(f"a{d}") for d, c in enumerate(sphere.exp(here, g))), F.sqrt(sphere.dot(g, g)).alias("size")))
        settled = moved.where(F.col("size") < tolerance).drop("size")
        done = settled if done is None else done.union(settled)
        state = moved.where((F.col("size") >= tolerance) & ~F.isnan("size")).drop("size")
        if state.isEmpty():
            break
    found = done.select(F.col("_key").alias("_found"), F.array(*here).alias("karcher"))
    return small.union(keys.join(found, F.col("_key").eqNullSafe(F.col("_found")), "left").select(F.col("_key").alias(key), "karcher"))


def dominant_directions(df: DataFrame, key: str, at: list[str]) -> DataFrame:
    """(key, eigen): the axis of the group's directions: of the scatter matrix, ten sums, the eigenvector of the largest eigenvalue."""
    pairs = [(i, j) for i in range(4) for j in range(i, 4)]
    sums = _unit_points(df, key, at).groupBy(key).agg(F.array(*(F.sum(F.col(f"p{i}") * F.col(f"p{j}")) for i, j in pairs)).alias("sums"))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def axis(rows: pd.Series) -> pd.Series:
        out = []
        for x in rows:
            m = np.zeros((4, 4))
            for (i, j), v in zip(pairs, x):
                m[i, j] = m[j, i] = v
            out.append(sphere.dominant(m) if np.isfinite(m).all() else None)
        return pd.Series(out)

    return sums.select(key, axis("sums").alias("eigen"))
