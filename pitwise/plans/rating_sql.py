"""SQL that walks the Elo ratings contest by contest, for engines with recursive queries.

A walk keeps one row per country and setting: the ratings, counts and seasons of its teams as lists, and
what the contest of that step was played from. Nothing of it runs in Spark.
"""

from __future__ import annotations

from collections.abc import Sequence

from pitwise.operators.elo import DEFAULT, EloSettings
from pitwise.plans.contests import WITH_CONTESTS


def rounded(value: str, digits: int = 6) -> str:
    """A double rounded half away from zero, as ``registry.tidy`` does."""
    scale = f"CAST(1{'0' * digits} AS DOUBLE)"
    return f"sign({value}) * floor(abs({value}) * {scale} + 0.5) / {scale} + 0.0"


def _settings_rows(combos: Sequence[tuple[float, float, float]]) -> str:
    return ", ".join(
        f"(CAST({k!r} AS DOUBLE), CAST({home!r} AS DOUBLE), CAST({carry!r} AS DOUBLE))" for k, home, carry in combos
    )


def walk(
    combos: Sequence[tuple[float, float, float]] | None = None,
    where: str = "TRUE",
    base: EloSettings = DEFAULT,
) -> str:
    """``WITH`` clause whose last table ``walked`` has a row per step, country and setting.

    Step 0 is the start. ``where`` chooses contests; ``combos`` are (k, home advantage, season carry).
    """
    combos = combos or [(base.k, base.home_advantage, base.season_carry)]

    def entered(side: str) -> str:  # a season that begins pulls the rating back
        held = f"w.rating[r.{side}]"
        begun = f"r.season IS DISTINCT FROM w.season[r.{side}]"
        return f"CASE WHEN {begun} THEN {base.initial!r} + w.carry * ({held} - {base.initial!r}) ELSE {held} END"

    def updated(column: str, home: str, away: str) -> str:
        return (
            f"list_transform({column}, lambda x, i: CASE WHEN i = h THEN {home} WHEN i = a THEN {away} "
            f"ELSE x END) AS {column}"
        )

    return f"""{WITH_CONTESTS.replace("WITH ", "WITH RECURSIVE ", 1)},
    teams AS (SELECT pool, team, row_number() OVER (PARTITION BY pool ORDER BY team) AS slot FROM (
      SELECT lower(country) AS pool, home_team_id AS team FROM contests
      UNION SELECT lower(country), away_team_id FROM contests) AS u),
    settings(k, home_advantage, carry) AS (VALUES {_settings_rows(combos)}),
    steps AS MATERIALIZED (
      SELECT match_id, lower(country) AS pool, season, h.slot AS h, a.slot AS a, home_goals - away_goals AS margin,
        row_number() OVER (PARTITION BY lower(country) ORDER BY date, competition_id, match_id) AS n
      FROM contests JOIN teams h ON h.team = home_team_id JOIN teams a ON a.team = away_team_id
      WHERE {where}),
    walked AS (
      SELECT pool, k, home_advantage, carry, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS match_id,
        list(CAST({base.initial!r} AS DOUBLE)) AS rating, list(CAST(0 AS INTEGER)) AS played,
        list(CAST(NULL AS VARCHAR)) AS season, CAST(NULL AS DOUBLE) AS elo_home, CAST(NULL AS DOUBLE) AS elo_away,
        CAST(NULL AS DOUBLE) AS elo_expected_home, CAST(NULL AS INTEGER) AS elo_home_played,
        CAST(NULL AS INTEGER) AS elo_away_played, CAST(NULL AS INTEGER) AS margin
      FROM teams, settings GROUP BY pool, k, home_advantage, carry
      UNION ALL
      SELECT pool, k, home_advantage, carry, n, match_id,
        {updated("rating", "elo_home + points", "elo_away - points")},
        {updated("played", "x + scored", "x + scored")},
        {updated("season", "entering", "entering")},
        elo_home, elo_away, elo_expected_home, elo_home_played, elo_away_played, margin
      FROM (
        SELECT *, CASE WHEN margin IS NULL THEN 0.0 ELSE
            k * (CASE WHEN abs(margin) < 2 THEN 1.0 WHEN abs(margin) < 3 THEN 1.5
                 ELSE CAST(11 + abs(margin) AS DOUBLE) / 8 END)
            * ({base.damping!r} / ({base.damping!r} + CAST(0.001 AS DOUBLE) * sign(margin) * ahead))
            * ((1 + sign(margin)) / CAST(2 AS DOUBLE) - elo_expected_home) END AS points,
          CAST(CASE WHEN margin IS NULL THEN 0 ELSE 1 END AS INTEGER) AS scored
        FROM (
          SELECT *, 1 / (1 + pow(CAST(10 AS DOUBLE), -ahead / {base.scale!r})) AS elo_expected_home
          FROM (
            SELECT *, elo_home + home_advantage - elo_away AS ahead
            FROM (
              SELECT w.pool, w.k, w.home_advantage, w.carry, r.n, r.match_id, r.h, r.a, r.season AS entering,
                CAST(r.margin AS INTEGER) AS margin, w.rating, w.played, w.season,
                {entered("h")} AS elo_home, {entered("a")} AS elo_away,
                w.played[r.h] AS elo_home_played, w.played[r.a] AS elo_away_played
              FROM walked w JOIN steps r ON r.pool = w.pool AND r.n = w.n + 1) AS seated) AS gap) AS priced) AS paid)
    """


_CHANCE = "pow(elo_expected_home - (1 + sign(margin)) / CAST(2 AS DOUBLE), 2)"

RATINGS = f"""{walk()} SELECT match_id, {rounded("elo_home")} AS elo_home, {rounded("elo_away")} AS elo_away,
  {rounded("elo_expected_home")} AS elo_expected_home, elo_home_played, elo_away_played
FROM walked WHERE n > 0"""

SQUARED_ERROR = f"""{walk()} SELECT {rounded(f"avg({_CHANCE})")} AS mse, count(*) AS n FROM walked WHERE n > 0"""


def grid_error(combos: Sequence[tuple[float, float, float]], where: str) -> str:
    """Mean squared error of every setting over the contests that ``where`` chooses."""
    return f"""{walk(combos, where)} SELECT k, home_advantage, carry AS season_carry,
      {rounded(f"avg({_CHANCE})")} AS mse, count(*) AS n FROM walked WHERE n > 0 GROUP BY 1, 2, 3"""
