"""Measures between trajectories, arrays of 4D points. Each is a dynamic program over the matrix of distances."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Cells of all matrices of distances that are filled at once.
CELLS = 1 << 21


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of every vertex of a to every one of b; the leading dimensions are pairs of trajectories."""
    d = a[..., :, None, :] - b[..., None, :, :]
    d *= d
    return ((d[..., 0] + d[..., 1]) + d[..., 2]) + d[..., 3]


def _frechet(d: np.ndarray, skips: int) -> np.ndarray:
    n, rows, columns = d.shape
    # best[i, j][u, v]: the least largest gap of a walk to (i, j) with u and v vertices skipped
    best = np.full((rows, columns, n, skips + 1, skips + 1), np.inf)
    best[0, 0, :, 0, 0] = d[:, 0, 0]
    moves = [(di, dj) for di in range(3) for dj in range(3) if (di or dj) and (skips or max(di, dj) < 2)]
    for i in range(rows):
        for j in range(columns):
            if i or j:
                here = best[i, j]
                for di, dj in moves:
                    if di <= i and dj <= j:
                        u, v = int(di == 2), int(dj == 2)
                        came = best[i - di, j - dj][:, : skips + 1 - u, : skips + 1 - v]
                        here[:, u:, v:] = np.minimum(here[:, u:, v:], came)
                np.maximum(here, d[:, i, j, None, None], out=here)
    return np.sqrt(best[-1, -1].reshape(n, -1).min(axis=1))


def _dtw(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n, rows, columns = d.shape
    gaps = np.sqrt(d)
    total, steps = np.full((columns + 1, n), np.inf), np.zeros((columns + 1, n), np.int64)
    total[0] = 0.0
    for i in range(rows):
        now, count = np.full_like(total, np.inf), np.zeros_like(steps)
        for j in range(columns):
            least = np.minimum(np.minimum(total[j], total[j + 1]), now[j])
            # of equal sums the shortest walk
            count[j + 1] = 1 + np.min([np.where(t == least, s, columns + rows) for t, s in ((total[j], steps[j]), (total[j + 1], steps[j + 1]), (now[j], count[j]))], axis=0)
            now[j + 1] = least + gaps[:, i, j]
        total, steps = now, count
    return total[-1], steps[-1]


def _edr(d: np.ndarray, eps: float) -> np.ndarray:
    n, rows, columns = d.shape
    other = ~(np.sqrt(d) <= eps)
    place = np.arange(columns + 1)
    row = np.repeat(place[None], n, axis=0)
    for i in range(rows):
        now = np.minimum(row[:, 1:] + 1, row[:, :-1] + other[:, i])
        # insertions run along the row: a running minimum of cost minus place
        full = np.concatenate([np.full((n, 1), i + 1), now], axis=1) - place
        row = np.minimum.accumulate(full, axis=1) + place
    return row[:, -1]


def frechet(a: np.ndarray, b: np.ndarray, skips: int = 0) -> float:
    """Discrete Frechet distance, up to `skips` interior vertices of each side passed over. Empty: infinity."""
    return float(_frechet(squared(a, b)[None], skips)[0]) if len(a) and len(b) else math.inf


def dtw(a: np.ndarray, b: np.ndarray) -> tuple[float, int]:
    """Least sum of gaps over walks of both, and the length of the shortest such walk. Empty: infinity, 0."""
    if not len(a) or not len(b):
        return math.inf, 0
    total, steps = _dtw(squared(a, b)[None])
    return float(total[0]), int(steps[0])


def edr(a: np.ndarray, b: np.ndarray, eps: float) -> int:
    """Edits that turn one into the other, vertices within eps being equal."""
    return int(_edr(squared(a, b)[None], eps)[0]) if len(a) and len(b) else len(a) + len(b)


def hausdorff_column(a: Column, b: Column) -> Column:
    """Largest least gap between two arrays of points, both ways, in built-in functions."""
    gap = lambda p, q: F.sqrt(F.aggregate(F.zip_with(p, q, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    one = lambda p, q: F.array_max(F.transform(p, lambda x: F.array_min(F.transform(q, lambda y: gap(x, y)))))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), float("inf")).otherwise(F.greatest(one(a, b), one(b, a)))


def _points(x) -> np.ndarray:
    return np.array([np.asarray(p, float) for p in x]).reshape(-1, 4)


def _by_shape(x: pd.Series, y: pd.Series, empty, measure) -> list:
    """measure(d) over the pairs of equal sizes together, d being their squared distances; empty(a, b) where a side has no vertex."""
    out: list = [None] * len(x)
    shapes: dict[tuple[int, int], list[int]] = {}
    pairs = [(_points(p), _points(q)) for p, q in zip(x, y)]
    for i, (a, b) in enumerate(pairs):
        if len(a) and len(b):
            shapes.setdefault((len(a), len(b)), []).append(i)
        else:
            out[i] = empty(a, b)
    for (rows, columns), every in shapes.items():
        step = max(1, CELLS // (rows * columns))
        for at in range(0, len(every), step):
            some = every[at : at + step]
            for i, v in zip(some, measure(squared(np.stack([pairs[i][0] for i in some]), np.stack([pairs[i][1] for i in some])))):
                out[i] = v
    return out


def measures_column(a: Column, b: Column, eps: float, skips: int = 1) -> Column:
    """struct(frechet, frechet_skips, dtw, dtw_steps, edr) of two arrays of points, in one pass over both."""

    @F.pandas_udf("frechet double, frechet_skips double, dtw double, dtw_steps bigint, edr bigint")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        every = lambda d: zip(_frechet(d, 0), _frechet(d, skips), *_dtw(d), _edr(d, eps))
        rows = _by_shape(x, y, lambda p, q: (math.inf, math.inf, math.inf, 0, len(p) + len(q)), every)
        return pd.DataFrame(rows, columns=["frechet", "frechet_skips", "dtw", "dtw_steps", "edr"])

    return run(a, b)


def frechet_column(a: Column, b: Column, skips: int = 0) -> Column:
    @F.pandas_udf(T.DoubleType())
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(_by_shape(x, y, lambda p, q: math.inf, lambda d: _frechet(d, skips)), dtype=float)

    return run(a, b)


def dtw_column(a: Column, b: Column) -> Column:
    @F.pandas_udf("dist double, steps bigint")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(_by_shape(x, y, lambda p, q: (math.inf, 0), lambda d: zip(*_dtw(d))), columns=["dist", "steps"])

    return run(a, b)


def edr_column(a: Column, b: Column, eps: float) -> Column:
    @F.pandas_udf(T.LongType())
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(_by_shape(x, y, lambda p, q: len(p) + len(q), lambda d: _edr(d, eps)), dtype="int64")

    return run(a, b)
