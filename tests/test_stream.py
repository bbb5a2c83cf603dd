"""The stream of ratings against playing all matchups in one go."""

import pytest
from pyspark.sql import functions as F

from tesserae.operators import consensus
from tesserae.streaming.ratings import kept


def test_stream_ends_where_the_replay_does(spark, tmp_path):
    rows = [(f"c{i % 3}", i, (i % 5) / 5 - 0.2, float(i % 7 < 4)) for i in range(120)]
    games = spark.createDataFrame(rows, "claim string, ord bigint, trust double, score double")
    want = {r.claim: r for r in consensus.replay(games).collect()}
    for i, part in enumerate((games.where("ord < 70"), games.where("ord >= 70"))):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        files = spark.readStream.schema(games.schema).parquet(f"{tmp_path}/in/*")
        got = {r.claim: r for r in kept(files, f"{tmp_path}/out").collect()}
    assert {c: r.matchups for c, r in got.items()} == {"c0": 40, "c1": 40, "c2": 40}
    for claim, r in got.items():
        assert (r.rating, r.deviation, r.volatility) == pytest.approx((want[claim].rating, want[claim].deviation, want[claim].volatility), abs=1e-9)


def test_empty_stream(spark, tmp_path):
    schema = "claim string, ord bigint, trust double, score double"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/in")
    assert kept(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out").where(F.lit(True)).count() == 0
