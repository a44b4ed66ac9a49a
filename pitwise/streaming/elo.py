"""Elo over a stream: the batch walk with its state kept between micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from pitwise.operators.elo import DEFAULT, EloSettings, Ratings, pool_of
from pitwise.schema import KEY

_OUTPUT = (
    "match_id string, elo_home double, elo_away double, elo_expected_home double, "
    "elo_home_played int, elo_away_played int, late boolean"
)
_NAMES = [part.split()[0] for part in _OUTPUT.split(", ")]
_ORDER = ["date", "competition_id", KEY]
_GAME = pa.schema([
    ("date", pa.date32()), ("competition_id", pa.string()), (KEY, pa.string()), ("season", pa.string()),
    ("home_team_id", pa.string()), ("away_team_id", pa.string()), ("home_goals", pa.float64()),
    ("away_goals", pa.float64()),
])
#: Contests that are rows of a data frame at one time.
_SLICE = 1 << 14


class _Walk(StatefulProcessor):
    """One country: a rating per team, and the contest the walk stands at."""

    def __init__(self, settings: EloSettings):
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.teams = handle.getMapState(
            "teams", "team string", "rating double, played int, season string"
        )
        self.reached = handle.getValueState(
            "reached", "date date, competition_id string, match_id string"
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        reached = tuple(self.reached.get()) if self.reached.exists() else None
        kept = []
        for chunk in rows:
            if reached is not None:
                late = pd.Series([k <= reached for k in zip(*(chunk[c] for c in _ORDER))], index=chunk.index, dtype=bool)
                if late.any():
                    yield pd.DataFrame({KEY: chunk.loc[late, KEY], "late": True}).reindex(columns=_NAMES)
                chunk = chunk[~late]
            if len(chunk):
                kept.append(pa.RecordBatch.from_pandas(chunk[_GAME.names], _GAME, preserve_index=False))
        if not kept:
            return
        games = pa.Table.from_batches(kept).sort_by([(c, "ascending") for c in _ORDER])
        # Only the teams of this batch are read, and only they are written back.
        walked = Ratings(self.settings)
        seats = pa.chunked_array([*games["home_team_id"].chunks, *games["away_team_id"].chunks])
        for team in seats.unique().to_pylist():
            if self.teams.containsKey((team,)):
                walked.put(team, *self.teams.getValue((team,)))
        for at in range(0, len(games), _SLICE):
            part = games.slice(at, _SLICE).to_pandas()
            named = part.rename(columns={"home_team_id": "home", "away_team_id": "away"})
            columns = [part[KEY].tolist(), *walked.walk(named), [False] * len(part)]
            yield pd.DataFrame(dict(zip(_NAMES, columns, strict=True)), columns=_NAMES)
        for team, rating, played, season in walked.rows():
            self.teams.updateValue((team,), (float(rating), int(played), season))
        self.reached.update(tuple(games[c][-1].as_py() for c in _ORDER))

    def close(self) -> None:
        pass


def rate_stream(matches: DataFrame, settings: EloSettings = DEFAULT) -> DataFrame:
    """Ratings of contests arriving in date order, ``late`` ones refused.

    State per country is a row for each team and the last contest walked; a
    micro-batch reads and writes the rows of its own teams. It is sorted within
    itself, and contests up to the one reached before come out as ``late``
    without a rating: they move nothing, so the other ratings stay those of the
    batch walk without them. Late ones leave as they are read; what is walked is
    held in columns and sorted there. The trigger's file limit bounds how much of
    a country that is.
    """
    columns = (*_ORDER, "season", "home_team_id", "away_team_id", "home_goals", "away_goals")
    return (
        matches.select(pool_of(F.col("home_team_id")).alias("pool"), *columns)
        .groupBy("pool")
        .transformWithStateInPandas(_Walk(settings), _OUTPUT, "Append", "None")
    )
