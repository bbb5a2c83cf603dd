"""Queries over whole tables against brute force."""

import pandas as pd

import __spark_entry__ as entry


def test_composed_paths_take_all_events(spark, sf_dir):
    events = pd.read_parquet(f"{sf_dir}/events.parquet").sort_values(["ts", "event_id"])
    paths = {tuple(x) for _, x in events.groupby("user_id")["event_type"]}
    assert entry.queries()["composed_paths_whole"](spark, sf_dir).first().ids == len(paths)


def test_pg_arrays_take_all_events(spark, sf_dir):
    events = pd.read_parquet(f"{sf_dir}/events.parquet")
    got = {r.user_id: r.n for r in entry.queries()["pg_arrays_whole"](spark, sf_dir).collect()}
    assert got == events.groupby("user_id").size().to_dict()
