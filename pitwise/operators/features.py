"""Team-history and head-to-head features over canonical contests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitwise.functions.scoring import points
from pitwise.operators import windows as W
from pitwise.schema import FEATURE_SCHEMA, KEY, conform

FORM_WINDOW = 5
CONGESTION_DAYS = 14
H2H_WINDOW = 5

_ROLLING = {
    "form_points_5": "points",
    "goals_for_5": "goals_for",
    "goals_against_5": "goals_against",
    "shots_for_5": "shots_for",
    "shots_against_5": "shots_against",
}
_SHARED = ("matches_played", "rest_days", "matches_14d", *_ROLLING)


def team_days(matches: DataFrame) -> DataFrame:
    """What each team knew before each of its days, per venue it played at that day.

    One row per ``(side, day)`` where ``side`` is the team and the venue in one
    value, so that home and away look up the very same table.
    """
    long = W.long_form(matches).withColumn(W.DAY, W.day_number(F.col("date")))
    # The last rows per (team, venue, day) contain the last rows per (team, day),
    # so the team and the venue windows share one reduction and one exchange.
    tail = W.tail_with_counts(long, ["team", "venue"], FORM_WINDOW).repartition(F.col("team"))
    known = tail.select(
        "team",
        "venue",
        W.DAY,
        W.prior_count(["team"]).alias("matches_played"),
        W.days_since_previous(["team"]).alias("rest_days"),
        W.count_within(["team"], CONGESTION_DAYS).alias("matches_14d"),
        *[
            W.trailing_mean(src, ["team"], FORM_WINDOW).alias(name)
            for name, src in _ROLLING.items()
        ],
        W.trailing_mean("points", ["team", "venue"], FORM_WINDOW).alias("venue_points"),
    )
    here = {v: F.col("venue") == v for v in ("home", "away")}
    per_day = known.groupBy("team", W.DAY).agg(
        *[F.max(name).alias(name) for name in _SHARED],
        *[F.bool_or(here[v]).alias(f"at_{v}") for v in here],
        *[F.max(F.when(here[v], F.col("venue_points"))).alias(f"points_{v}") for v in here],
    )
    venues = F.array(
        *[
            F.struct(
                side_key(F.col("team"), v).alias("side"),
                F.col(f"at_{v}").alias("at"),
                F.col(f"points_{v}").alias("venue_points_5"),
            )
            for v in here
        ]
    )
    return per_day.select(W.DAY, *_SHARED, F.inline(venues)).filter("at").drop("at")


def side_key(team: Column, venue: str) -> Column:
    return F.concat_ws("|", F.lit(venue), team)


def pair_days(matches: DataFrame) -> DataFrame:
    """Earlier meetings of each unordered pair before each of its days."""
    first = F.least("home_team_id", "away_team_id")
    home_first = F.col("home_team_id") == first
    home = points(F.col("home_goals"), F.col("away_goals"))
    away = points(F.col("away_goals"), F.col("home_goals"))
    pairs = matches.select(
        "match_id",
        first.alias("first"),
        F.greatest("home_team_id", "away_team_id").alias("second"),
        W.day_number(F.col("date")).alias(W.DAY),
        F.when(home_first, home).otherwise(away).alias("first_points"),
        F.when(home_first, away).otherwise(home).alias("second_points"),
    )
    keys = ["first", "second"]
    tail = W.tail_with_counts(pairs, keys, H2H_WINDOW).repartition(*keys)
    known = tail.select(
        *keys,
        W.DAY,
        W.prior_count(keys).alias("meetings"),
        W.trailing_mean("first_points", keys, H2H_WINDOW).alias("first_mean"),
        W.trailing_mean("second_points", keys, H2H_WINDOW).alias("second_mean"),
    )
    return known.groupBy(*keys, W.DAY).agg(
        F.max("meetings").alias("h2h_matches"),
        F.max("first_mean").alias("first_mean"),
        F.max("second_mean").alias("second_mean"),
    )


def team_history(matches: DataFrame) -> DataFrame:
    """Nine features per side, keyed by contest.

    The per-day table is joined once as the home and once as the away side. It
    is the same subplan with the same columns both times, so Spark computes its
    exchange once. Like all tables here it grows with the contests, so it is merged
    and not sent round, however small Spark takes it to be.
    """
    days = team_days(matches)
    names = [*_SHARED, "venue_points_5"]
    base = matches.select(
        KEY,
        *[side_key(F.col(f"{v}_team_id"), v).alias(f"{v}_side") for v in ("home", "away")],
        W.day_number(F.col("date")).alias(W.DAY),
    )
    for venue in ("home", "away"):
        one = days.select(
            F.col("side").alias(f"{venue}_side"),
            W.DAY,
            *[F.col(name).alias(f"{venue}_{name}") for name in names],
        )
        base = base.join(one.hint("merge"), [f"{venue}_side", W.DAY], "left")
    return base.select(KEY, *[f"{v}_{name}" for v in ("home", "away") for name in names])


def head_to_head(matches: DataFrame) -> DataFrame:
    """Earlier meetings and the home side's points in them, keyed by contest."""
    days = pair_days(matches)
    base = matches.select(
        KEY,
        "home_team_id",
        F.least("home_team_id", "away_team_id").alias("first"),
        F.greatest("home_team_id", "away_team_id").alias("second"),
        W.day_number(F.col("date")).alias(W.DAY),
    )
    return base.join(days.hint("merge"), ["first", "second", W.DAY], "left").select(
        KEY,
        "h2h_matches",
        F.when(F.col("home_team_id") == F.col("first"), F.col("first_mean"))
        .otherwise(F.col("second_mean"))
        .alias("h2h_home_points"),
    )


BUILDERS = {"team_history": team_history, "head_to_head": head_to_head}


def build(matches: DataFrame, builders=tuple(BUILDERS)) -> DataFrame:
    """The feature table; columns of builders left out stay null."""
    out = matches.select(KEY)
    for name in builders:
        out = out.join(BUILDERS[name](matches).hint("merge"), KEY, "left")
    return conform(out, FEATURE_SCHEMA)
