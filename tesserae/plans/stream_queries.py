"""Queries that run as streams over the driver's files until these are read, then show the last state of each claim."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tesserae.functions import ratings as R
from tesserae.operators.checkpoints import shared_folder, written
from tesserae.plans.catalogue import register
from tesserae.sources.tables import table
from tesserae.streaming.late import kept_late
from tesserae.streaming.ratings import kept


def _matchups(events):
    priors = F.array(*(F.lit(p) for _, p in R.TRUST_CLASSES))
    return events.where("value is not null").select(F.col("event_type").alias("claim"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("ord"), F.get(priors, (F.col("user_id") % 16).cast("int")).alias("trust"), (F.col("value") > 50).cast("double").alias("score"))


@register("stream_ratings", "SELECT event_type AS claim, CAST(count(*) AS BIGINT) AS matchups FROM events WHERE value IS NOT NULL GROUP BY event_type")
def stream_ratings(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    files = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    games = _matchups(files).drop("at")
    return kept(games, f"{shared_folder(spark)}/ratings-{uuid.uuid4().hex}").select("claim", "matchups")


#: How late an event of stream_late comes at most, and the delay that waits for it.
LATE, DELAY, DELIVERIES = 3600, "61 minutes", 4


@register("stream_late")
def stream_late(spark, sf_dir):
    """All events, each delivered up to an hour after its time, in DELIVERIES batches by time of arrival: ratings as if they had come in order."""
    games = _matchups(table(spark, sf_dir, "events"))
    come = games.withColumn("come", F.unix_seconds("at") + F.pmod(F.xxhash64("ord"), F.lit(LATE)))
    first, last = come.agg(F.min("come"), F.max("come")).first()
    folder = f"{shared_folder(spark)}/late-{uuid.uuid4().hex}"
    part = F.when(F.lit(first == last), 1).otherwise(F.least(F.floor((F.col("come") - F.lit(first)) * DELIVERIES / F.lit((last or 0) - (first or 0))) + 1, F.lit(DELIVERIES)))
    dealt = written(come.withColumn("part", part))
    files = spark.readStream.schema(games.schema).parquet(f"{folder}/in/*")
    for number in range(1, DELIVERIES + 1):  # the stream takes each delivery in one batch and goes on with the next
        dealt.where(F.col("part") == number).drop("come", "part").write.parquet(f"{folder}/in/{number}")
        states = kept_late(files, DELAY, folder)
    return states
