"""What changed between two looks at the contests in play."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

LOOK = (
    "seen_at timestamp, match_id string, competition_id string, home_team string, "
    "away_team string, status string, home_goals int, away_goals int"
)
EVENT = (
    "match_id string, kind string, home_team string, away_team string, home_goals int, "
    "away_goals int, seen_at timestamp"
)
_STATE = "home_team string, away_team string, home_goals int, away_goals int, last_ms long"
KICK_OFF, GOAL, FULL_TIME = "kick_off", "goal", "full_time"
_NAMES = [part.split()[0] for part in EVENT.split(", ")]


def _number(value):
    return None if value is None or pd.isna(value) else int(value)


class _Contest(StatefulProcessor):
    """The last sighting of one contest, and a timer for its end."""

    def __init__(self, silent: pd.Timestamp, wait_ms: int):
        self.silent, self.wait_ms = silent, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", _STATE)

    def _over(self, name: str, known: tuple) -> tuple:
        return (name, FULL_TIME, *known[:4], pd.Timestamp(known[4], unit="ms"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # Looks at the same moment are told apart by what they saw, so order of arrival is nothing.
        order = ["seen_at", "home_goals", "away_goals"]
        looks = pd.concat(list(rows)).sort_values(order, kind="stable")
        before = known = tuple(self.last.get()) if self.last.exists() else None
        out = []
        for r in looks.itertuples(index=False):
            if r.status != "live":
                continue
            hg, ag, seen = _number(r.home_goals), _number(r.away_goals), pd.Timestamp(r.seen_at)
            at = int(seen.value // 1_000_000)
            if known is not None and at > known[4] + self.wait_ms:
                out.append(self._over(key[0], known))
                known = None
            kind = None
            if known is None:
                kind = KICK_OFF if seen > self.silent else None
            elif (hg, ag) != (_number(known[2]), _number(known[3])):
                kind = GOAL
            if kind:
                out.append((key[0], kind, r.home_team, r.away_team, hg, ag, seen))
            known = (r.home_team, r.away_team, hg, ag, at)
        if known is not None and known != before:
            if before is not None:
                self.handle.deleteTimer(before[4] + self.wait_ms)
            self.last.update(known)
            self.handle.registerTimer(known[4] + self.wait_ms)
        yield pd.DataFrame(out, columns=_NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.last.exists():
            known = tuple(self.last.get())
            if expiredTimerInfo.getExpiryTimeInMs() == known[4] + self.wait_ms:
                out.append(self._over(key[0], known))
                self.last.clear()
        yield pd.DataFrame(out, columns=_NAMES)

    def close(self) -> None:
        pass


def events(
    looks: DataFrame, first_look: str | dt.datetime, gone_after: str | int = 60,
    delay: str = "0 seconds",
) -> DataFrame:
    """Kick-offs, goals and full times from a stream of looks.

    A contest first seen in play kicked off, a changed score is a goal, and one
    that is missing for more than ``gone_after`` seconds is over: when a later
    look shows it again, which then kicks off anew, or else when the watermark,
    which only moves when looks arrive, has passed that time. So a failed look
    never ends a match, and how looks fall into micro-batches changes nothing.
    Rows of the first look announce nothing. A contest that is over leaves no
    state; looks behind the watermark are dropped and counted by the engine.
    """
    processor = _Contest(pd.Timestamp(first_look), int(gone_after) * 1000)
    return (
        looks.withWatermark("seen_at", delay)
        .groupBy("match_id")
        .transformWithStateInPandas(processor, EVENT, "Append", "EventTime")
    )


def followed(stream: DataFrame, teams: DataFrame | Sequence[str] | None) -> DataFrame:
    """Only what involves a followed team; following nobody means everything."""
    if teams is None or (not isinstance(teams, DataFrame) and not teams):
        return stream
    if not isinstance(teams, DataFrame):
        return stream.filter(F.col("home_team").isin(*teams) | F.col("away_team").isin(*teams))
    # A list of followed teams may be long, so it is joined rather than inlined;
    # each side is one stream-static semi join.
    home = stream.join(teams.select(F.col("team").alias("home_team")), "home_team", "left_semi")
    away = stream.join(
        teams.select(F.col("team").alias("home_team")), "home_team", "left_anti"
    ).join(teams.select(F.col("team").alias("away_team")), "away_team", "left_semi")
    return home.unionByName(away)
