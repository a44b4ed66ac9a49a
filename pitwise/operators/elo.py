"""Elo ratings: a sequential walk per country, run as sorted, resumable streams.

A rating depends on every earlier contest of both teams, so within a country
the walk is sequential. Three things keep it within bounds at any size:

* rows reach the walk as a *sorted partition* read batch by batch; nothing
  gathers a country's rows, only the current rating of each team is held;
* the calendar is cut into blocks in which the largest country fits a task. Each block is one job whose final ratings are written to a table and
  seed the next, so a lost executor repeats one block and not the history;
* a block whose largest country is still too long is split into the groups of
  teams that met within it. Groups that never met cannot influence each other,
  so the result is the same to the last bit.
"""

from __future__ import annotations

import datetime as dt
import itertools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitwise.functions import scoring as S
from pitwise.operators.settings import ABOVE_ZERO, SHARE, bounded
from pitwise.schema import KEY
from pitwise.session import durable

MAX_ROWS_PER_TASK = 1_000_000


@dataclass(frozen=True)
class EloSettings:
    k: float = 14.0
    home_advantage: float = 80.0
    initial: float = 1500.0
    scale: float = 400.0
    season_carry: float = 0.97
    damping: float = 2.2

    def __post_init__(self):
        bounded(self, k=ABOVE_ZERO, scale=ABOVE_ZERO, damping=ABOVE_ZERO, season_carry=SHARE)


DEFAULT = EloSettings()


class Ratings:
    """The teams of one unit of work, each a slot, and batches walked over them.

    What no rating enters (seasons begun, contests played, margins) is worked out for a whole batch
    at once; only the exchange of points is a loop. A rating may be a float (one setting) or an
    array (one entry per setting of a grid).
    """

    def __init__(self, settings):
        self.settings = settings
        self.slots: dict[str, int] = {}
        self.rating, self.played, self.season = [], [], []

    def slot(self, team: str) -> int:
        at = self.slots.setdefault(team, len(self.rating))
        if at == len(self.rating):
            self.rating.append(self.settings.initial)
            self.played.append(0)
            self.season.append(None)
        return at

    def put(self, team: str, rating: float, played: int, season: str | None) -> None:
        at = self.slot(team)
        self.rating[at], self.played[at], self.season[at] = rating, played, season

    def rows(self) -> list[tuple]:
        """(team, rating, contests played, season last seen) of every team."""
        return [(t, self.rating[i], self.played[i], self.season[i]) for t, i in self.slots.items()]

    def _appearances(self, seats: np.ndarray, seasons: np.ndarray, scored: np.ndarray):
        """For each appearance: does a season begin, and how many contests came before it.

        Sides alternate, home first. The table's own seasons and counts move on to the end.
        """
        order = np.argsort(seats, kind="stable")
        seat, label, ran = seats[order], seasons[order], scored[order].astype(np.int64)
        head = np.flatnonzero(np.append(True, seat[1:] != seat[:-1]))
        size = np.diff(np.append(head, len(seat)))
        earlier = np.append([None], label[:-1])
        earlier[head] = [self.season[s] for s in seat[head]]
        upto = np.cumsum(ran) - ran
        known = np.array([self.played[s] for s in seat[head]]) - upto[head]
        count = upto + np.repeat(known, size)
        for s, end in zip(seat[head].tolist(), (head + size - 1).tolist()):
            self.season[s], self.played[s] = label[end], int(count[end] + ran[end])
        begun, before = np.empty(len(seat), dtype=bool), np.empty(len(seat), dtype=np.int64)
        begun[order], before[order] = label != earlier, count
        return begun, before

    def walk(self, games: pd.DataFrame) -> tuple[list, list, list, list, list]:
        """Columns of what both sides bring to each contest, in the order given.

        ``games`` has season, home, away, home_goals and away_goals. A contest without a score
        moves no points.
        """
        if games.empty:
            return [], [], [], [], []
        sides = [[self.slot(t) for t in games[side]] for side in ("home", "away")]
        margin = (games["home_goals"].astype(float) - games["away_goals"].astype(float)).to_numpy()
        begun, before = self._appearances(
            np.column_stack(sides).ravel(),
            np.repeat(games["season"].to_numpy(dtype=object), 2),
            np.repeat(~np.isnan(margin), 2),
        )
        by, sign = np.abs(margin), np.sign(margin)
        # the margin's factor: 1, 1.5 for two goals, then an eighth more for each
        factor = np.select([by < 2, by < 3], [1.0, 1.5], (11.0 + by) / 8.0).tolist()
        s, rating = self.settings, self.rating
        brought: tuple[list, list, list] = ([], [], [])
        for h, a, new_h, new_a, way, f in zip(
            *sides, begun[::2].tolist(), begun[1::2].tolist(), sign.tolist(), factor, strict=True
        ):
            for at, new in ((h, new_h), (a, new_a)):
                if new:
                    rating[at] = s.initial + s.season_carry * (rating[at] - s.initial)
            ahead = rating[h] + s.home_advantage - rating[a]
            expected = 1.0 / (1.0 + 10.0 ** (-ahead / s.scale))
            for column, value in zip(brought, (rating[h], rating[a], expected)):
                column.append(value)
            if way == way:  # there was a score
                points = s.k * f * s.damping / (s.damping + 0.001 * way * ahead) * ((1 + way) / 2 - expected)
                rating[h], rating[a] = rating[h] + points, rating[a] - points
        return *brought, before[::2].tolist(), before[1::2].tolist()


def by_unit(batch: pd.DataFrame, column: str) -> Iterator[tuple[str, pd.DataFrame]]:
    """The consecutive runs of one unit within a sorted batch."""
    units = batch[column].to_numpy()
    cuts = [0, *(np.flatnonzero(units[1:] != units[:-1]) + 1).tolist(), len(units)]
    for start, stop in itertools.pairwise(cuts):
        if stop > start:
            yield units[start], batch.iloc[start:stop]


_INPUT = (
    "unit string, date date, competition_id string, match_id string, season string, "
    "home string, away string, home_goals int, away_goals int, "
    "seed_rating double, seed_played int"
)
_OUTPUT = (
    "kind string, pool string, match_id string, season string, team string, "
    "elo_home double, elo_away double, elo_expected_home double, "
    "elo_home_played int, elo_away_played int"
)
_OUT_NAMES = [part.split()[0] for part in _OUTPUT.split(", ")]


def pool_of(team_id: Column) -> Column:
    return F.substring_index(team_id, ":", 1)


def _rows(matches: DataFrame) -> DataFrame:
    return matches.select(
        pool_of(F.col("home_team_id")).alias("pool"),
        "date",
        "competition_id",
        KEY,
        "season",
        F.col("home_team_id").alias("home"),
        F.col("away_team_id").alias("away"),
        F.col("home_goals").cast("int"),
        F.col("away_goals").cast("int"),
        F.lit(None).cast("double").alias("seed_rating"),
        F.lit(None).cast("int").alias("seed_played"),
    )


def _walk(settings: EloSettings):
    """A partition function over rows sorted by unit and canonical order.

    Seed rows carry no date, sort first, and set a team's state. At the end of
    a unit its state is emitted as rows of their own kind.
    """

    def state(pool_name: str, teams: Ratings) -> list[tuple]:
        return [
            ("state", pool_name, None, season, team, rating, None, None, played, None)
            for team, rating, played, season in teams.rows()
        ]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit, pool_name, teams = None, None, Ratings(settings)
        for batch in batches:
            out = []
            for name, part in by_unit(batch, "unit"):
                if name != unit:
                    out.extend(state(pool_name, teams))
                    unit, pool_name, teams = name, part["pool"].iloc[0], Ratings(settings)
                seeded = part[KEY].isna()
                seeds = part.loc[seeded, ["home", "seed_rating", "seed_played", "season"]]
                for team, rating, played, season in seeds.itertuples(index=False):
                    teams.put(team, float(rating), int(played), season)
                games = part[~seeded]
                n = len(games)
                out.extend(zip(
                    ["match"] * n, games["pool"], games[KEY], games["season"], [None] * n, *teams.walk(games)
                ))
            if out:
                yield pd.DataFrame(out, columns=_OUT_NAMES)
        if teams.slots:
            yield pd.DataFrame(state(pool_name, teams), columns=_OUT_NAMES)

    return run


def _run_block(rows: DataFrame, settings: EloSettings, unit: Column | None = None) -> DataFrame:
    """Walk one block of rows (seeds included); matches and final states come out."""
    keyed = rows.withColumn("unit", unit if unit is not None else F.col("pool"))
    ordered = keyed.repartition("unit").sortWithinPartitions(
        "unit", F.col("date").asc_nulls_first(), "competition_id", KEY
    )
    return ordered.mapInPandas(_walk(settings), _OUTPUT)


def _ratings(walked: DataFrame) -> DataFrame:
    return walked.filter(F.col("kind") == "match").select(
        KEY,
        "elo_home",
        "elo_away",
        "elo_expected_home",
        "elo_home_played",
        "elo_away_played",
    )


def _seeds(state: DataFrame) -> DataFrame:
    """Final states of a block as the seed rows of the next."""
    null = F.lit(None)
    return state.filter(F.col("kind") == "state").select(
        "pool",
        null.cast("date").alias("date"),
        null.cast("string").alias("competition_id"),
        null.cast("string").alias(KEY),
        "season",
        F.col("team").alias("home"),
        null.cast("string").alias("away"),
        null.cast("int").alias("home_goals"),
        null.cast("int").alias("away_goals"),
        F.col("elo_home").alias("seed_rating"),
        F.col("elo_home_played").alias("seed_played"),
    )


def plan_blocks(
    rows: DataFrame, limit: int
) -> list[tuple[dt.date | None, dt.date | None, bool]]:
    """Date ranges ``[from, to)`` in which no pool holds more than ``limit`` rows.

    Works on the size of the largest pool per day, one number per calendar day.
    The flag marks a single day that is over the limit on its own.
    """
    per_day = (
        rows.groupBy("pool", "date")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("date")
        .agg(F.max("n").alias("n"))
        .orderBy("date")
        .collect()
    )
    blocks: list[tuple[dt.date | None, dt.date | None, bool]] = []
    start, held = None, 0
    for i, day in enumerate(per_day):
        if held and held + day["n"] > limit:
            blocks.append((start, day["date"], held > limit))
            start, held = day["date"], 0
        elif i == 0:
            start = day["date"]
        held += day["n"]
    blocks.append((start, None, held > limit))
    return blocks


def components(pairs: DataFrame) -> DataFrame:
    """``(team, group)`` of teams connected through ``pairs(home, away)``.

    Smallest-label propagation with shortcuts: each round every team takes the
    smallest label among itself and its neighbours, then the label of that
    label, so chains close in few rounds. Each round is one written table.
    """
    both = pairs.select(F.col("home").alias("a"), F.col("away").alias("b")).union(
        pairs.select(F.col("away").alias("a"), F.col("home").alias("b"))
    )
    edges = durable(both.distinct(), "elo-edges")
    labels = durable(
        edges.groupBy(F.col("a").alias("team")).agg(F.least(F.col("team"), F.min("b")).alias("group")),
        "elo-labels",
    )
    while True:
        near = edges.join(labels.withColumnRenamed("team", "b"), "b").groupBy("a").agg(
            F.min("group").alias("near")
        )
        moved = labels.join(near, F.col("team") == F.col("a")).select(
            "team", "group", F.least("group", "near").alias("next")
        )
        hop = labels.select(F.col("team").alias("next"), F.col("group").alias("hop"))
        after = durable(
            moved.join(hop, "next", "left").select(
                "team", "group", F.least("next", F.coalesce("hop", "next")).alias("next")
            ),
            "elo-labels",
        )
        changed = after.filter(F.col("next") != F.col("group")).limit(1).count()
        labels = after.select("team", F.col("next").alias("group"))
        if not changed:
            return labels


def _split_units(rows: DataFrame) -> DataFrame:
    """Attach to every row the group of teams it belongs to within this block."""
    met = rows.filter(F.col("away").isNotNull()).select("home", "away").distinct()
    groups = components(met)
    tagged = rows.join(groups, rows["home"] == groups["team"], "left").drop("team")
    # A seeded team that does not play in this block is a group of its own.
    return tagged.withColumn("unit", F.coalesce("group", "home")).drop("group")


def _walked(matches: DataFrame, settings: EloSettings, max_rows_per_task: int) -> list[DataFrame]:
    """The walked blocks in calendar order, each written to the shared folder before the next starts."""
    rows = _rows(matches)
    parts: list[DataFrame] = []
    for start, end, oversized in plan_blocks(rows, max_rows_per_task):
        block = rows
        if start is not None:
            block = block.filter(F.col("date") >= F.lit(start))
        if end is not None:
            block = block.filter(F.col("date") < F.lit(end))
        if parts:
            block = block.unionByName(_seeds(parts[-1]))
        unit = None
        if oversized:
            block, unit = _split_units(block), F.col("unit")
        parts.append(durable(_run_block(block, settings, unit), "elo-block"))
    return parts


def rate(
    matches: DataFrame,
    settings: EloSettings = DEFAULT,
    max_rows_per_task: int = MAX_ROWS_PER_TASK,
) -> DataFrame:
    """Ratings every contest was played from, before its own result."""
    return reduce(DataFrame.unionByName, map(_ratings, _walked(matches, settings, max_rows_per_task)))


def final_state(
    matches: DataFrame,
    settings: EloSettings = DEFAULT,
    max_rows_per_task: int = MAX_ROWS_PER_TASK,
) -> DataFrame:
    """Every team's rating after its last contest: what a resumed walk starts from."""
    walked = _walked(matches, settings, max_rows_per_task)[-1]  # teams that rest are carried along
    return walked.filter(F.col("kind") == "state").select(
        "pool",
        "team",
        "season",
        F.col("elo_home").alias("rating"),
        F.col("elo_home_played").alias("played"),
    )


def squared_error(rated: DataFrame, matches: DataFrame) -> DataFrame:
    """Mean squared gap between expected and realised home score."""
    actual = (
        F.when(F.col("home_goals") > F.col("away_goals"), 1.0)
        .when(F.col("home_goals") < F.col("away_goals"), 0.0)
        .otherwise(0.5)
    )
    joined = rated.select(KEY, "elo_expected_home").join(
        matches.select(KEY, "home_goals", "away_goals"), KEY
    )
    gap = F.col("elo_expected_home") - actual
    return joined.agg(F.avg(gap * gap).alias("mse"), F.count(F.lit(1)).alias("n"))


# ---- grid search -----------------------------------------------------------------

# The searched settings.
K_GRID = (10.0, 14.0, 18.0, 22.0, 26.0, 32.0)
HOME_GRID = (40.0, 55.0, 65.0, 80.0, 100.0)
CARRY_GRID = (0.75, 0.85, 0.92, 0.97, 1.0)


@dataclass(frozen=True)
class _Grid:
    """Settings as parallel arrays, so that one walk scores all of them."""

    k: np.ndarray
    home_advantage: np.ndarray
    season_carry: np.ndarray
    initial: float
    scale: float
    damping: float


#: Settings that one unit walks together.
SLICE = 30
_GRID_OUTPUT = (
    "kind string, pool string, slice int, season string, team string, ratings array<double>, "
    "played int, errors array<double>, n bigint"
)
_GRID_NAMES = [part.split()[0] for part in _GRID_OUTPUT.split(", ")]


def _grid_walk(slices: list[_Grid]):
    """A partition function over rows sorted by unit and canonical order; a unit walks one slice.

    Seed rows hold an array of ratings, one per setting of the slice. At the end of a unit come the
    states of its teams and the summed squared error of every setting.
    """

    def told(pool_name, at, teams, errors, n) -> list[tuple]:
        states = [
            ("state", pool_name, at, season, team, np.broadcast_to(rating, len(errors)).tolist(), played, None, 0)
            for team, rating, played, season in teams.rows()
        ]
        return [*states, ("error", pool_name, at, None, None, None, None, errors.tolist(), n)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit, pool_name, at, teams, errors, n = None, None, None, None, None, 0
        for batch in batches:
            out = []
            for name, part in by_unit(batch, "unit"):
                if name != unit:
                    if unit is not None:
                        out.extend(told(pool_name, at, teams, errors, n))
                    unit, pool_name, at = name, part["pool"].iloc[0], int(part["slice"].iloc[0])
                    teams, errors, n = Ratings(slices[at]), np.zeros(len(slices[at].k)), 0
                seeded = part[KEY].isna()
                seeds = part.loc[seeded, ["home", "seed_ratings", "seed_played", "season"]]
                for team, ratings, played, season in seeds.itertuples(index=False):
                    teams.put(team, np.array(ratings, dtype=float), int(played), season)
                games = part[~seeded]
                gap = (games["home_goals"].astype(float) - games["away_goals"].astype(float)).to_numpy()
                actual = (1 + np.nan_to_num(np.sign(gap))) / 2
                for chance, happened in zip(teams.walk(games)[2], actual.tolist(), strict=True):
                    errors += (chance - happened) ** 2
                n += len(games)
            if out:
                yield pd.DataFrame(out, columns=_GRID_NAMES)
        if unit is not None:
            yield pd.DataFrame(told(pool_name, at, teams, errors, n), columns=_GRID_NAMES)

    return run


def _grid_seeds(walked: DataFrame) -> DataFrame:
    null = F.lit(None)
    return walked.filter(F.col("kind") == "state").select(
        "pool", null.cast("date").alias("date"), null.cast("string").alias("competition_id"),
        null.cast("string").alias(KEY), "season", F.col("team").alias("home"), null.cast("string").alias("away"),
        null.cast("int").alias("home_goals"), null.cast("int").alias("away_goals"),
        F.col("played").alias("seed_played"), F.col("ratings").alias("seed_ratings"), "slice",
    )


def grid_search(
    matches: DataFrame,
    k_values: Sequence[float] = K_GRID,
    home_values: Sequence[float] = HOME_GRID,
    carry_values: Sequence[float] = CARRY_GRID,
    base: EloSettings = DEFAULT,
    max_rows_per_task: int = MAX_ROWS_PER_TASK,
) -> DataFrame:
    """Mean squared error of every combination, best first.

    Walked over the same blocks as the ratings: a task holds one slice of the settings and a block
    of one country at most, ratings are handed from block to block as arrays, and every block is
    written, so a lost executor costs one block. Only the window handed in is read.
    """
    combos = list(itertools.product(k_values, home_values, carry_values))
    parts = [combos[at : at + SLICE] for at in range(0, len(combos), SLICE)]
    slices = [
        _Grid(*(np.array(column) for column in zip(*part, strict=True)), base.initial, base.scale, base.damping)
        for part in parts
    ]
    every = F.sequence(F.lit(0), F.lit(len(slices) - 1))
    rows = _rows(matches).drop("seed_rating").withColumn("seed_ratings", F.lit(None).cast("array<double>"))
    walked: list[DataFrame] = []
    for start, end, oversized in plan_blocks(rows, max_rows_per_task):
        block = rows
        if start is not None:
            block = block.filter(F.col("date") >= F.lit(start))
        if end is not None:
            block = block.filter(F.col("date") < F.lit(end))
        block = block.withColumn("slice", F.explode(every))
        if walked:
            block = block.unionByName(_grid_seeds(walked[-1]))
        block = _split_units(block) if oversized else block.withColumn("unit", F.col("pool"))
        keyed = block.withColumn("unit", F.concat_ws("|", "unit", "slice"))
        ordered = keyed.repartition("unit").sortWithinPartitions(
            "unit", F.col("date").asc_nulls_first(), "competition_id", KEY
        )
        walked.append(durable(ordered.mapInPandas(_grid_walk(slices), _GRID_OUTPUT), "elo-grid"))
    settings = matches.sparkSession.createDataFrame(
        [(at, i, *combo) for at, part in enumerate(parts) for i, combo in enumerate(part)],
        "slice int, at int, k double, home_advantage double, season_carry double",
    )
    errors = reduce(DataFrame.unionByName, walked).filter(F.col("kind") == "error")
    each = errors.select("slice", "n", F.posexplode("errors").alias("at", "sse"))
    return (
        each.join(settings, ["slice", "at"])
        .groupBy("k", "home_advantage", "season_carry")
        .agg((F.sum("sse") / F.sum("n")).alias("mse"), F.sum("n").alias("n"))
        .orderBy("mse", "k", "home_advantage", "season_carry")
    )


def expected_from(home: str, away: str, settings: EloSettings = DEFAULT) -> Column:
    return S.expected_score(F.col(home), F.col(away), settings.home_advantage, settings.scale)
