"""Fixed-point coordinates m / 2^53 in four dimensions, their exact mean, the 4D Hilbert order and range covers of it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ONE = 1 << 53
CELLS = 4096  # cells looked at before a cover stops refining


def truncated(x: Column) -> Column:
    """The fixed-point value of a double, towards zero; clamped to [-1, 1], 0 for no number."""
    x = x.cast("double")
    return F.when(F.isnan(x), F.lit(0)).when(x >= 1, F.lit(ONE)).when(x <= -1, F.lit(-ONE)).otherwise((x * float(ONE)).cast("bigint")).cast("bigint")


def exactly(x: Column) -> Column:
    """The fixed-point value of a double that lies on the grid, else null."""
    m = x.cast("double") * float(ONE)
    return F.when((x >= -1) & (x <= 1) & (m == F.floor(m)), m.cast("bigint"))


def as_double(m: Column) -> Column:
    return m / F.lit(float(ONE))


def mean(m: Column) -> Column:
    """Aggregate: the exact average, truncated towards zero; 0 of no rows."""
    total, n = F.sum(m.cast("decimal(38,0)")), F.count(m)
    return F.coalesce(F.call_function("div", total, n.cast("decimal(20,0)")), F.lit(0)).cast("bigint")


def inside(ms: list[Column]) -> Column:
    """Every axis within [-1, 1] and the point within the unit ball, in whole numbers."""
    squares = [m.cast("decimal(19,0)") * m.cast("decimal(19,0)") for m in ms]
    ok = F.lit(True)
    for m in ms:
        ok = ok & (m >= -ONE) & (m <= ONE)
    total = sum((F.when(ok, s.cast("decimal(36,0)")).otherwise(F.lit(0).cast("decimal(36,0)")) for s in squares[1:]), F.when(ok, squares[0].cast("decimal(36,0)")).otherwise(F.lit(0).cast("decimal(36,0)")))
    return ok & (total <= F.lit(str(1 << 106)).cast("decimal(38,0)"))


def grid(m: Column) -> Column:
    """The Hilbert grid axis, 0 to 65535, of a fixed-point value."""
    return F.when(m <= -ONE, 0).when(m >= ONE, 65535).otherwise(F.shiftright(m + F.lit(ONE), 38)).cast("int")


def grid_of(x: Column) -> Column:
    """The grid axis of a double: floor((x + 1) * 32768) without the rounding of x + 1."""
    return F.when(~(x > -1), 0).when(x >= 1, 65535).otherwise(32768 + F.floor(x * 32768.0)).cast("int")


def encode(g: np.ndarray) -> np.ndarray:
    """(n, 4) grid axes to Hilbert values (uint64), after Skilling: undo excess rotations bit by bit, Gray-code, interleave."""
    x = [g[:, d].astype(np.uint64) for d in range(4)]
    for bit in range(15, 0, -1):
        q, low = np.uint64(1 << bit), np.uint64((1 << bit) - 1)
        for d in range(4):
            here = (x[d] & q) != 0
            swap = np.where(here, np.uint64(0), (x[0] ^ x[d]) & low)
            x[0] = np.where(here, x[0] ^ low, x[0] ^ swap)
            if d:
                x[d] = x[d] ^ swap
    for d in range(1, 4):
        x[d] = x[d] ^ x[d - 1]
    turn = np.zeros_like(x[0])
    for bit in range(15, 0, -1):
        turn ^= np.where((x[3] & np.uint64(1 << bit)) != 0, np.uint64((1 << bit) - 1), np.uint64(0))
    out = np.zeros_like(x[0])
    for bit in range(15, -1, -1):
        for d in range(4):
            out = (out << np.uint64(1)) | (((x[d] ^ turn) >> np.uint64(bit)) & np.uint64(1))
    return out


def decode(h: np.ndarray) -> np.ndarray:
    """Hilbert values to (n, 4) grid axes."""
    h = h.astype(np.uint64)
    x = [np.zeros_like(h) for _ in range(4)]
    for bit in range(16):
        for d in range(4):
            x[d] |= ((h >> np.uint64(4 * bit + 3 - d)) & np.uint64(1)) << np.uint64(bit)
    first = x[3] >> np.uint64(1)
    for d in range(3, 0, -1):
        x[d] ^= x[d - 1]
    x[0] ^= first
    for bit in range(1, 16):
        q, low = np.uint64(1 << bit), np.uint64((1 << bit) - 1)
        for d in range(3, -1, -1):
            here = (x[d] & q) != 0
            swap = np.where(here, np.uint64(0), (x[0] ^ x[d]) & low)
            x[0] = np.where(here, x[0] ^ low, x[0] ^ swap)
            if d:
                x[d] = x[d] ^ swap
    return np.stack(x, axis=1).astype(np.int64)


def _key(h: np.ndarray) -> np.ndarray:
    """Unsigned curve order as signed order: the top bit flipped."""
    return (h ^ np.uint64(1 << 63)).view(np.int64)


def hilbert_key(g0: Column, g1: Column, g2: Column, g3: Column) -> Column:
    """The stored key: a bigint whose signed order is the order along the curve."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf(T.LongType())
    def key(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(_key(encode(np.stack([a, b, c, d], axis=1))))

    return key(g0, g1, g2, g3)


def hilbert_grid(key: Column) -> Column:
    """The grid axes of a stored key, as an array of four."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf(T.ArrayType(T.IntegerType()))
    def axes(k: pd.Series) -> pd.Series:
        return pd.Series(list(decode(k.to_numpy(np.int64).view(np.uint64) ^ np.uint64(1 << 63)).astype(np.int32)))

    return axes(key)


def _cover(state, cap: int) -> list[tuple[int, int]]:
    """Key ranges of the cells that `state(low corners, side)` calls 1 (inside) or 2 (crossing); 0 is outside.

    Level by level crossing cells are split, while no more than CELLS are looked at; what still crosses then is taken
    whole. Neighbouring ranges are joined, then the narrowest gaps are closed until `cap` ranges are left.
    """
    prefixes, taken, looked = np.zeros(1, np.uint64), [], 0
    for level in range(1, 17):
        prefixes = (prefixes[:, None] * np.uint64(16) + np.arange(16, dtype=np.uint64)).ravel()
        looked += len(prefixes)
        shift, side = np.uint64(4 * (16 - level)), 1 << (16 - level)
        corner = decode(prefixes << shift) & ~(side - 1)
        kind = state(corner, side)
        span = (1 << (4 * (16 - level))) - 1
        crossing = prefixes[kind == 2]
        stop = level == 16 or looked + 16 * len(crossing) > CELLS
        for p in prefixes[(kind == 1) | ((kind == 2) & stop)].tolist():
            taken.append((p << int(shift), (p << int(shift)) + span))
        if stop or not len(crossing):
            break
        prefixes = crossing
    ranges: list[list[int]] = []
    for lo, hi in sorted(taken):
        if ranges and lo <= ranges[-1][1] + 1:
            ranges[-1][1] = max(hi, ranges[-1][1])
        else:
            ranges.append([lo, hi])
    gaps = sorted(range(1, len(ranges)), key=lambda i: (ranges[i][0] - ranges[i - 1][1], i))
    closed = set(gaps[: max(0, len(ranges) - cap)])
    out: list[list[int]] = []
    for i, r in enumerate(ranges):
        if i in closed:
            out[-1][1] = r[1]
        else:
            out.append(list(r))
    return [(lo - (1 << 63), hi - (1 << 63)) for lo, hi in out]


def box_ranges(low: list[int], high: list[int], cap: int = 64) -> list[tuple[int, int]]:
    """Ascending ranges of stored keys that cover all grid points with low <= axis <= high."""
    lo, hi = np.array(low), np.array(high)

    def state(corner, side):
        out = ((corner > hi) | (corner + side - 1 < lo)).any(axis=1)
        whole = ((corner >= lo) & (corner + side - 1 <= hi)).all(axis=1)
        return np.where(out, 0, np.where(whole, 1, 2))

    return _cover(state, cap) if (lo <= hi).all() else []


def ball_ranges(center: list[float], radius: float, cap: int = 64) -> list[tuple[int, int]]:
    """Ranges that cover all points of the unit ball within `radius` of `center`."""
    c = np.array(center, float)

    def state(corner, side):
        lo = corner / 32768.0 - 1.0
        hi = lo + side / 32768.0
        near = np.maximum(np.maximum(lo - c, c - hi), 0.0)
        far = np.maximum(np.abs(lo - c), np.abs(hi - c))
        origin = np.maximum(np.maximum(lo, -hi), 0.0)
        slack = 1e-9
        out = ((near**2).sum(1) > radius**2 + slack) | ((origin**2).sum(1) > 1.0 + slack)
        whole = (far**2).sum(1) <= radius**2 - slack
        return np.where(out, 0, np.where(whole, 1, 2))

    return _cover(state, cap)


def in_ranges(key: Column, ranges: list[tuple[int, int]]) -> Column:
    """A predicate that reaches the scan as comparisons of the key; it must be followed by the exact one."""
    out = F.lit(False)
    for lo, hi in ranges:
        out = out | key.between(lo, hi)
    return out
