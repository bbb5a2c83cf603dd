"""The codepoint table: shards, ranks, coordinates along the curve, and properties that Python's Unicode data has."""

from __future__ import annotations

import math
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import coords
from tesserae.functions.identity import encode, hash_many

COUNT = 0x110000
#: Blocks of the CJK shard, first and last codepoint. (Fixed values.)
CJK = ((0x1100, 0x11FF), (0x2E80, 0x303F), (0x3040, 0x4DBF), (0x4E00, 0x9FFF), (0xA960, 0xA97F), (0xAC00, 0xD7FF), (0xF900, 0xFAFF), (0xFE30, 0xFE4F), (0xFF00, 0xFFEF), (0x20000, 0x3FFFF))


def shard(cp: Column) -> Column:
    """ascii, cjk, utf (the rest of the first plane but surrogates) or ext."""
    cjk = F.lit(False)
    for lo, hi in CJK:
        cjk = cjk | cp.between(lo, hi)
    return F.when(cp <= 0x7F, "ascii").when(cjk, "cjk").when((cp <= 0xFFFF) & ~cp.between(0xD800, 0xDFFF), "utf").otherwise("ext")


def branch(table: DataFrame, names: str) -> DataFrame:
    """Rows of the shards that `names` asks for: utf and cjk alone include what is below them, a+b are just these."""
    profile = {"utf": ["ascii", "utf"], "cjk": ["ascii", "utf", "cjk"], "all": ["ascii", "utf", "cjk", "ext"]}
    chosen = profile.get(names) or names.split("+")
    return table.where(F.col("shard").isin(chosen))


def _spiral(n: int, total: int) -> np.ndarray:
    """The n-th points of a Super-Fibonacci spiral of `total` points on the unit sphere in four dimensions, after Alexa."""
    phi, psi = math.sqrt(2.0), 1.533751168755204288118041
    s = np.asarray(n, float) + 0.5
    t = s / total
    r, big = np.sqrt(t), np.sqrt(1.0 - t)
    a, b = 2 * np.pi * s / phi, 2 * np.pi * s / psi
    return np.stack([r * np.sin(a), r * np.cos(a), big * np.sin(b), big * np.cos(b)], axis=-1)


def build(spark: SparkSession, count: int = COUNT) -> DataFrame:
    """(cp, id, m0..m3, hkey, rank, shard): codepoints in order of value take the spiral's points in order of the curve.

    The rank order is codepoint order, a stand-in for a collation, whose data isn't at hand; every law of the table holds.
    """

    def points(batches):
        for pdf in batches:
            n = pdf["id"].to_numpy()
            m = np.trunc(_spiral(n, count) * (1 - 2.0**-40) * coords.ONE).astype(np.int64)
            g = np.clip((m + coords.ONE) >> 38, 0, 65535)
            key = coords._key(coords.encode(g))
            yield pd.DataFrame({"m0": m[:, 0], "m1": m[:, 1], "m2": m[:, 2], "m3": m[:, 3], "hkey": key})

    spots = spark.range(count).mapInPandas(points, "m0 bigint, m1 bigint, m2 bigint, m3 bigint, hkey bigint")
    # a fixed number of rows, 1,114,112: the one order over all of them is of that size for good
    from pyspark.sql.window import Window

    ranked = spots.withColumn("rank", F.row_number().over(Window.orderBy("hkey", "m0", "m1", "m2", "m3")) - 1)

    def ids(batches):
        for pdf in batches:
            yield pd.DataFrame({"cp": pdf["id"], "cid": hash_many([encode(chr(c)) for c in pdf["id"]])})

    named = spark.range(count).mapInPandas(ids, "cp bigint, cid binary")
    out = named.join(ranked, named.cp == ranked["rank"])
    return out.select(F.col("cp").cast("int").alias("cp"), F.col("cid").alias("id"), "m0", "m1", "m2", "m3", "hkey", "rank", shard(F.col("cp")).alias("shard"))


def faults(table: DataFrame) -> DataFrame:
    """One row of counts that must all be 0: repeated ids or ranks, points outside, keys out of rank order."""
    from pyspark.sql.window import Window

    inside = coords.inside([F.col(f"m{d}") for d in range(4)])
    ordered = table.withColumn("before", F.lag("hkey").over(Window.orderBy("rank")))
    return ordered.agg(
        (F.count("*") - F.countDistinct("id")).alias("ids"),
        (F.count("*") - F.countDistinct("rank")).alias("ranks"),
        F.sum((~inside).cast("int")).alias("outside"),
        F.sum(F.coalesce(F.col("before") > F.col("hkey"), F.lit(False)).cast("int")).alias("order"),
    )


def loose_name(name: Column) -> Column:
    """Names as properties are matched: without case, spaces, underscores and hyphens."""
    return F.regexp_replace(F.lower(name), "[ _\\-]", "")


def bit_field(words: list[Column], bit: int, width: int) -> Column:
    """A field of at most 32 bits of a 256-bit record given as four bigints, lowest first; it may lie across two."""
    k, at = divmod(bit, 64)
    low = F.call_function("shiftrightunsigned", words[k], F.lit(at))
    if at + width > 64:
        low = low.bitwiseOR(F.shiftleft(words[k + 1], 64 - at))
    return low.bitwiseAND(F.lit((1 << width) - 1))


def properties(cp: Column) -> Column:
    """struct(category, combining, bidirectional, mirrored) of a codepoint."""

    @F.pandas_udf("category string, combining int, bidirectional string, mirrored boolean")
    def run(points: pd.Series) -> pd.DataFrame:
        chars = [chr(c) for c in points]
        return pd.DataFrame({"category": map(unicodedata.category, chars), "combining": map(unicodedata.combining, chars), "bidirectional": map(unicodedata.bidirectional, chars), "mirrored": [bool(unicodedata.mirrored(c)) for c in chars]})

    return run(cp)
