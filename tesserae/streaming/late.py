"""Ratings over a stream whose matchups come late: each takes the place that its time gives it, and what follows is played again."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tesserae.functions import ratings as R
from tesserae.streaming.ratings import OUTPUT, last_states

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What is settled, and a matchup that is open: its place (time in microseconds, then ord), what it says, and the standing after it.
SETTLED = "n bigint, rating double, deviation double, volatility double"
OPEN = "at bigint, ord bigint, trust double, score double, rating double, deviation double, volatility double"


class Replayer(StatefulProcessor):
    """A claim's settled standing, and its open matchups in order with the standing after each.

    A matchup is settled once the watermark has passed its time: nothing that is still taken can come before it. One that comes
    between open ones is played at its place, and only those after it again. Timers settle claims that hear nothing more.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled, self.open = handle.getValueState("settled", SETTLED), handle.getListState("open", OPEN)

    def _settle(self, standing: tuple, rows: list[tuple], watermark: int) -> tuple[tuple, list[tuple]]:
        done = bisect_left(rows, (1000 * watermark,))
        return ((standing[0] + done, *rows[done - 1][4:]), rows[done:]) if done else (standing, rows)

    def _keep(self, standing: tuple, rows: list[tuple]) -> None:
        self.settled.update(standing)
        if rows:
            self.open.put(rows)
        else:
            self.open.clear()

    def _known(self) -> tuple[tuple, list[tuple]]:
        standing = tuple(self.settled.get()) if self.settled.exists() else (0, R.RATING, R.DEVIATION, R.VOLATILITY)
        return standing, [tuple(r) for r in self.open.get()] if self.open.exists() else []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        standing, held = self._known()
        come = sorted(x for pdf in rows for x in zip(pdf["at_us"].tolist(), pdf["ord"].tolist(), pdf["trust"].tolist(), pdf["score"].tolist()))
        first = bisect_left(held, come[0])
        again = sorted([*(r[:4] for r in held[first:]), *come])
        now, done = held[first - 1][4:] if first else standing[1:], held[:first]
        for at, order, trust, score in again:
            now = R.attest(now, trust, score)
            done.append((at, order, trust, score, *now))
        total = standing[0] + len(done)
        latest = done[-1][0]
        standing, left = self._settle(standing, done, timerValues.getCurrentWatermarkInMs())
        self._keep(standing, left)
        if left and not any(True for _ in self.handle.listTimers()):
            self.handle.registerTimer(latest // 1000 + 1)
        yield pd.DataFrame({"claim": [key[0]], "matchups": [total], "rating": [now[0]], "deviation": [now[1]], "volatility": [now[2]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        standing, left = self._settle(*self._known(), timerValues.getCurrentWatermarkInMs())
        self._keep(standing, left)
        if left:
            self.handle.registerTimer(left[-1][0] // 1000 + 1)
        return iter(())

    def close(self) -> None:
        pass


def replayed(matchups: DataFrame, delay: str) -> DataFrame:
    """(claim, matchups, rating, deviation, volatility), updated by each batch of (claim string, at timestamp, ord, trust, score).

    Any order of arrival within `delay` gives the ratings of playing all by (at, ord). The stream's watermark refuses what is later than
    that. Rows with a null in any of the five columns say nothing and are left out; repeated rows are played as often as they come.
    A claim's state is its matchups within the delay and four numbers.
    """
    marked = matchups.select("claim", "at", "ord", "trust", "score").na.drop().withWatermark("at", delay)
    rows = marked.selectExpr("claim", "at", "unix_micros(at) AS at_us", "CAST(ord AS BIGINT) AS ord", "CAST(trust AS DOUBLE) AS trust", "CAST(score AS DOUBLE) AS score")
    return rows.groupBy("claim").transformWithStateInPandas(Replayer(), OUTPUT, "Update", "EventTime")


def kept_late(matchups: DataFrame, delay: str, folder: str) -> DataFrame:
    """Run replayed() over what there is to read, and give each claim's last state; the same folder goes on where it stopped."""
    conf, name = matchups.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, STORE)  # timers and lists of state need it; a query takes the setting as it starts
    try:
        return last_states(replayed(matchups, delay), folder)
    finally:
        conf.set(name, before)
