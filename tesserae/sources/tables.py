"""Reading the driver's tables, and the sequences and trajectories that the queries make of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, ord, id): each user's event types in order of time."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("seq"), F.struct("ts", "event_id").alias("ord"), F.col("event_type").alias("id"))


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, path): each embedding as 16 points of 4 dimensions."""
    wide = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    point = lambda i: F.slice("e", 4 * i + 1, 4)
    return wide.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(15)), point).alias("path"))
