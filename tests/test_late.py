"""Matchups that come late against playing all of them in order."""

import datetime
import random

import pytest

from tesserae.operators import consensus
from tesserae.plans.catalogue import queries
from tesserae.plans.stream_queries import _matchups
from tesserae.streaming.late import kept_late

START = datetime.datetime(2020, 1, 1)
SCHEMA = "claim string, at timestamp, ord bigint, trust double, score double"


def written(spark, folder, number, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{number}")


def run(spark, folder, delay):
    files = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    return {r.claim: r for r in kept_late(files, delay, f"{folder}/out").collect()}


def same(got, spark, rows):
    # times never disagree with ord here
    want = {r.claim: r for r in consensus.replay(spark.createDataFrame(rows, SCHEMA)).collect()}
    count = {c: sum(r[0] == c for r in rows) for c in want}
    assert {c: r.matchups for c, r in got.items()} == count
    for c, r in got.items():
        assert (r.rating, r.deviation, r.volatility) == pytest.approx((want[c].rating, want[c].deviation, want[c].volatility), abs=1e-9)


def test_any_order_within_the_delay(spark, tmp_path):
    rng = random.Random(8)
    rows = [(f"c{i % 3}", START + datetime.timedelta(minutes=i // 2), i, (i % 5) / 5 - 0.2, float(rng.random() < 0.6)) for i in range(240)]
    # each arrives up to 30 minutes late; the first claim falls silent
    rows = [r for r in rows if r[0] != "c0" or r[2] < 60]
    come = sorted(rows, key=lambda r: r[2] + rng.random() * 60)
    seen = []
    for i in range(4):
        part = come[i * len(come) // 4 : (i + 1) * len(come) // 4]
        written(spark, tmp_path, i, part)
        seen += part
        if i in (1, 3):
            same(run(spark, tmp_path, "31 minutes"), spark, seen)


def test_nulls_repeats_and_no_rows(spark, tmp_path):
    row = ("a", START, 1, 0.5, 1.0)
    written(spark, tmp_path, 0, [row, row, (None, START, 2, 0.5, 1.0), ("b", None, 3, 0.5, 1.0), ("a", START, 4, None, 1.0)])
    same(run(spark, tmp_path, "1 minute"), spark, [row, row])
    written(spark, f"{tmp_path}/none", 0, [])
    assert run(spark, f"{tmp_path}/none", "1 minute") == {}


def test_events_that_come_late(spark, sf_dir):
    got = {r.claim: r for r in queries()["stream_late"](spark, sf_dir).collect()}
    rows = [tuple(r) for r in _matchups(spark.read.parquet(f"{sf_dir}/events.parquet")).collect()]
    rows.sort(key=lambda r: r[1:3])
    same(got, spark, [(c, at, i, trust, score) for i, (c, at, _, trust, score) in enumerate(rows)])
