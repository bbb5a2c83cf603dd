"""Ratings kept over a stream of matchups, one state of three numbers for each claim. Replaying the batch is the truth."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tesserae.functions import ratings as R

OUTPUT = "claim string, matchups bigint, rating double, deviation double, volatility double"


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, *standing = state.get if state.exists else (0, R.RATING, R.DEVIATION, R.VOLATILITY)
    standing = tuple(standing)
    rows = pd.concat(list(batches), ignore_index=True).sort_values("ord")
    for trust, score in zip(rows["trust"], rows["score"]):
        standing = R.attest(standing, float(trust), float(score))
    n += len(rows)
    state.update((n, *standing))
    yield pd.DataFrame({"claim": [key[0]], "matchups": [n], "rating": [standing[0]], "deviation": [standing[1]], "volatility": [standing[2]]})


def rated(matchups: DataFrame) -> DataFrame:
    """(claim, matchups, rating, deviation, volatility), updated by each batch of (claim, ord, trust, score) in `ord` order.

    Matchups are played in the order in which they arrive by batch; what comes late is played late.
    """
    return matchups.groupBy("claim").applyInPandasWithState(_fold, OUTPUT, "n bigint, rating double, deviation double, volatility double", "update", GroupStateTimeout.NoTimeout)


def kept(matchups: DataFrame, folder: str) -> DataFrame:
    """Run rated() over what there is to read, and give each claim's last state; the same folder goes on where it stopped."""
    return last_states(rated(matchups), folder)


def last_states(updates: DataFrame, folder: str) -> DataFrame:
    """Run a stream of updated states until all there is to read is read, and give each claim's last one.

    Updates go to Parquet files in `folder`, a subfolder for each batch that a retry writes over; nothing of them is kept on
    the driver. The stream's own checkpoints stand beside it, so the same folder goes on where it stopped.
    """
    spark = updates.sparkSession
    spark.createDataFrame([], OUTPUT).write.mode("overwrite").parquet(f"{folder}/updates/batch=-1")

    def store(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/updates/batch={number}")

    query = updates.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").foreachBatch(store).start()
    query.processAllAvailable()
    query.stop()
    names = [f.name for f in spark.createDataFrame([], OUTPUT).schema][1:]
    last = spark.read.parquet(f"{folder}/updates").groupBy("claim").agg(F.max_by(F.struct(*names), "matchups").alias("last"))
    return last.select("claim", "last.*")
