"""Budgets of work: presets, estimates, which limit is exceeded first, and sums of counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTERS = ("wall_us", "db_probes", "rows_scanned", "bytes_alloc", "hops", "tokens_out")
#: Limits in the order of COUNTERS; 0 is no limit. (Fixed values.)
PRESETS = {
    "FAST": (100_000, 8, 4_096, 16 << 20, 2, 256),
    "STANDARD": (250_000, 32, 65_536, 64 << 20, 4, 1_024),
    "DEEP": (2_000_000, 256, 1_048_576, 512 << 20, 8, 8_192),
    "UNLIMITED": (0, 0, 0, 0, 0, 0),
}
#: Microseconds for a probe, row, kilobyte, hop and token.
WEIGHTS = {"db_probes": 150.0, "rows_scanned": 0.25, "bytes_alloc": 0.5 / 1024, "hops": 200.0, "tokens_out": 5.0}
TOP64, TOP32 = (1 << 64) - 1, (1 << 32) - 1


def estimate_us(prefix: str = "", wall_limit: int = 0) -> Column:
    """What the counters will take, at most the wall limit if there is one."""
    total = sum((F.col(prefix + c).cast("double") * w for c, w in WEIGHTS.items()), F.lit(0.0))
    out = F.floor(total).cast("decimal(20,0)")
    return F.least(out, F.lit(wall_limit).cast("decimal(20,0)")) if wall_limit else out


def actual_us(prefix: str = "") -> Column:
    wall = F.col(prefix + "wall_us").cast("decimal(20,0)")
    return F.when(wall > 0, wall).otherwise(estimate_us(prefix))


def exceeded(preset: str, prefix: str = "") -> Column:
    """0, or the number (from 1, in the order of COUNTERS) of the first limit that is exceeded."""
    out = F.lit(0)
    for number, (name, most) in reversed(list(enumerate(zip(COUNTERS, PRESETS[preset]), 1))):
        if most:
            out = F.when(F.col(prefix + name) > most, number).otherwise(out)
    return out


def merged(df: DataFrame, keys: list[str]) -> DataFrame:
    """Counters summed per key, saturating at their width; truncated if any was; the first reason by `ord`."""
    tops = {"hops": TOP32, "tokens_out": TOP32}
    sums = [F.least(F.sum(F.col(c).cast("decimal(38,0)")), F.lit(str(tops.get(c, TOP64))).cast("decimal(38,0)")).cast("decimal(20,0)").alias(c) for c in COUNTERS]
    reason = F.coalesce(F.min_by(F.when(F.col("reason") != 0, F.col("reason")), F.when(F.col("reason") != 0, F.col("ord"))), F.lit(0))
    return df.groupBy(*keys).agg(*sums, F.max("truncated").alias("truncated"), reason.alias("reason"))
