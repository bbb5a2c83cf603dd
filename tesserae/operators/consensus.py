"""Claims, witnesses and roots as DataFrames: folding, scopes, standings, shares, tallies."""

from __future__ import annotations

import math

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.functions import ratings as R


def fold(entries: DataFrame) -> DataFrame:
    """(claim, root, games, wins, trust): one row for each dependence root of a claim, summed before any shuffle."""
    return entries.groupBy("claim", "root").agg(F.sum("games").alias("games"), F.sum("wins").alias("wins"), F.max("trust").alias("trust"))


def scoped(entries: DataFrame, allowed: DataFrame | None, min_trust: float = 0.0) -> DataFrame:
    """Entries of allowed witnesses with enough trust; no scope (None) allows all, an empty one nobody."""
    if allowed is None:
        return entries
    return entries.where(F.col("trust") >= min_trust).join(allowed.select("witness").distinct(), "witness", "left_semi")


def shares(weights: DataFrame, group: str, member: str, weight: str) -> DataFrame:
    """(group, member, share): weights as basis points that sum to 10,000 by largest remainder, ties to the smaller member."""
    w = Window.partitionBy(group)
    exact = 10000.0 * F.try_divide(F.col(weight), F.sum(weight).over(w))
    parts = weights.select(group, member, weight, F.coalesce(exact, F.lit(0.0)).alias("exact")).withColumn("whole", F.floor("exact").cast("int"))
    ranked = w.orderBy(F.desc(F.when(F.col(weight) > 0, F.col("exact") - F.col("whole")).otherwise(-1.0)), member)
    parts = parts.withColumns({"place": F.row_number().over(ranked), "missing": F.when(F.sum(weight).over(w) > 0, 10000 - F.sum("whole").over(w)).otherwise(0)})
    return parts.select(group, member, (F.col("whole") + (F.col("place") <= F.col("missing")).cast("int")).alias("share"))


def tally(rows: DataFrame, keys: list[str], times: Column, score: Column, position: Column, record: bool = True) -> DataFrame:
    """Testimony per key: games (counted once a row, or its times if a record), tokens, wins and the least positive position."""
    n = times.cast("double")
    return rows.groupBy(*keys).agg(
        F.sum(n if record else F.lit(1.0)).alias("games"),
        F.sum(n).alias("tokens"),
        F.sum((n if record else F.lit(1.0)) * score).alias("wins"),
        F.min(F.when(position > 0, position)).alias("position"),
    )


def replay(matchups: DataFrame) -> DataFrame:
    """(claim, rating, deviation, volatility) after one matchup after another in `ord` order: trust, score per row.

    An ordered fold can't be split, so a claim's matchups meet in one group, as three numbers each.
    """

    def run(pdf):
        standing = (R.RATING, R.DEVIATION, R.VOLATILITY)
        for trust, score in zip(*(pdf.sort_values("ord")[c] for c in ("trust", "score"))):
            standing = R.attest(standing, float(trust), float(score))
        return pd.DataFrame({"claim": [pdf["claim"].iloc[0]], "rating": [standing[0]], "deviation": [standing[1]], "volatility": [standing[2]]})

    kind = matchups.schema["claim"].dataType.simpleString()
    return matchups.groupBy("claim").applyInPandas(run, f"claim {kind}, rating double, deviation double, volatility double")


def periods(games: DataFrame) -> DataFrame:
    """(player, rating, deviation, volatility) after one Glicko-2 period of rows (player, opponent, opponent_deviation, score).

    A period needs two sums over a player's games, so they are summed before any shuffle and no player's games are gathered.
    """
    g = 1.0 / F.sqrt(1.0 + 3.0 * F.pow(F.col("opponent_deviation") / R.SCALE, F.lit(2.0)) / math.pi**2)
    expect = 1.0 / (1.0 + F.exp(g * (F.col("opponent") - R.RATING) / R.SCALE))
    sums = games.groupBy("player").agg(F.sum(g * (F.col("score") - expect)).alias("gain"), F.sum(g * g * expect * (1.0 - expect)).alias("info"))

    def run(batches):
        for batch in batches:
            gains, infos = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("gain", "info"))
            ends = [R.advance((R.RATING, R.DEVIATION, R.VOLATILITY), x, y) for x, y in zip(gains, infos)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([e[k] for e in ends], pa.float64()) for k in range(3))], names=["player", "rating", "deviation", "volatility"])

    kind = games.schema["player"].dataType.simpleString()
    return sums.mapInArrow(run, f"player {kind}, rating double, deviation double, volatility double")


def trust_by_id(rows: DataFrame, id_column: str) -> DataFrame:
    """Rows with `prior`: that of the trust class whose name's text id they carry, null for others. A table of 16 rows."""
    from tesserae.operators.text import text_ids

    spark = rows.sparkSession
    classes = spark.createDataFrame([(n, p) for n, p in R.TRUST_CLASSES], "label string, prior double")
    ids = text_ids(classes, "label", "label").select(F.col("label"), F.col("id").alias("class_id"))
    known = classes.join(ids, "label").select("class_id", "prior")
    return rows.join(F.broadcast(known), F.col(id_column) == F.col("class_id"), "left").drop("class_id")
