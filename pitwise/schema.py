"""The typed tables every operator reads and writes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = "match_id"
TARGET = "result"
CLASSES = ("H", "D", "A")

_S, _B, _H, _I, _D, _DT = (
    T.StringType(),
    T.ByteType(),
    T.ShortType(),
    T.IntegerType(),
    T.DoubleType(),
    T.DateType(),
)


def _struct(pairs) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in pairs])


STAT_NAMES = ("shots", "shots_on_target", "corners", "fouls", "yellows", "reds")
STAT_COLUMNS = tuple(f"{side}_{name}" for name in STAT_NAMES for side in ("home", "away"))
ODDS_COLUMNS = ("odds_home", "odds_draw", "odds_away")
HALF_TIME_COLUMNS = ("ht_home_goals", "ht_away_goals", "ht_result")
OUTCOME_COLUMNS = ("home_goals", "away_goals", "result")

MATCH_SCHEMA = _struct(
    [
        ("match_id", _S),
        ("provider", _S),
        ("competition_id", _S),
        ("country", _S),
        ("competition", _S),
        ("tier", _B),
        ("season", _S),
        ("date", _DT),
        ("kickoff", _S),
        ("home_team", _S),
        ("away_team", _S),
        ("home_team_id", _S),
        ("away_team_id", _S),
        ("home_goals", _H),
        ("away_goals", _H),
        ("result", _S),
        ("ht_home_goals", _H),
        ("ht_away_goals", _H),
        ("ht_result", _S),
        *[(c, _H) for c in STAT_COLUMNS],
        ("referee", _S),
        *[(c, _D) for c in ODDS_COLUMNS],
    ]
)
MATCH_COLUMNS = tuple(MATCH_SCHEMA.names)

CORE_COLUMNS = (
    "match_id",
    "provider",
    "competition_id",
    "country",
    "competition",
    "season",
    "date",
    "home_team",
    "away_team",
    "home_team_id",
    "away_team_id",
    "home_goals",
    "away_goals",
    "result",
)

# Which side of kick-off a column becomes known on. Anything derived from a
# post-match column of the same row is a leak.
PRE_MATCH = frozenset(MATCH_COLUMNS[:13]) | frozenset(ODDS_COLUMNS)
POST_MATCH = frozenset(MATCH_COLUMNS) - PRE_MATCH
BENCHMARK = frozenset(ODDS_COLUMNS)

# A block of columns a source may or may not supply, and the column whose
# presence decides it.
CAPABILITIES = {
    "half_time": "ht_home_goals",
    "match_stats": "home_shots",
    "referee": "referee",
    "odds": "odds_home",
}

ELO_COLUMNS = ("elo_home", "elo_away", "elo_expected_home", "elo_home_played", "elo_away_played")
GOAL_COLUMNS = (
    "dc_home_lambda",
    "dc_away_lambda",
    "dc_prob_home",
    "dc_prob_draw",
    "dc_prob_away",
)
GOAL_PROBS = GOAL_COLUMNS[2:]
RATING_SCHEMA = _struct(
    [
        (KEY, _S),
        ("elo_home", _D),
        ("elo_away", _D),
        ("elo_expected_home", _D),
        ("elo_home_played", _I),
        ("elo_away_played", _I),
        *[(c, _D) for c in GOAL_COLUMNS],
    ]
)


@dataclass(frozen=True)
class Feature:
    """One derived column: its type, its block, and the columns it may read."""

    name: str
    dtype: T.DataType
    group: str
    reads: frozenset
    description: str

    @property
    def can_leak(self) -> bool:
        return bool(self.reads & POST_MATCH)


_ID = frozenset({"match_id", "date", "home_team_id", "away_team_id"})
_GOALS = frozenset({"home_goals", "away_goals"})
_SHOTS = frozenset({"home_shots", "away_shots"})


def _both(suffix, dtype, group, reads, text):
    return [
        Feature(f"{side}_{suffix}", dtype, group, reads, text.format(side=side))
        for side in ("home", "away")
    ]


FEATURES: tuple[Feature, ...] = (
    *_both("matches_played", _I, "form", _ID, "earlier matches of the {side} team"),
    *_both("form_points_5", _D, "form", _ID | _GOALS, "{side} points per match, last five"),
    *_both("goals_for_5", _D, "form", _ID | _GOALS, "{side} goals scored per match, last five"),
    *_both("goals_against_5", _D, "form", _ID | _GOALS, "{side} goals let in, last five"),
    *_both("shots_for_5", _D, "form", _ID | _SHOTS, "{side} shots per match, last five"),
    *_both("shots_against_5", _D, "form", _ID | _SHOTS, "{side} shots faced, last five"),
    *_both("venue_points_5", _D, "form", _ID | _GOALS, "{side} points, last five at this venue"),
    *_both("rest_days", _H, "schedule", _ID, "days since the {side} team last played"),
    *_both("matches_14d", _H, "schedule", _ID, "{side} matches in the fortnight before"),
    Feature("h2h_matches", _H, "head_to_head", _ID, "earlier meetings, either venue"),
    Feature(
        "h2h_home_points", _D, "head_to_head", _ID | _GOALS, "home points over last five meetings"
    ),
)
FEATURE_COLUMNS = tuple(f.name for f in FEATURES)
FEATURE_SCHEMA = _struct([(KEY, _S), *[(f.name, f.dtype) for f in FEATURES]])

# What each rating column may read.
RATING_READS: dict[str, frozenset] = {
    **{c: _ID | _GOALS | {"competition_id", "season"} for c in ELO_COLUMNS},
    **{c: _ID | _GOALS | {"competition_id"} for c in GOAL_COLUMNS},
}

# Design matrix blocks, in order: ten rating columns, then the twenty features.
BLOCKS: dict[str, tuple[str, ...]] = {
    "elo": ELO_COLUMNS,
    "goal_model": GOAL_COLUMNS,
    "form": tuple(f.name for f in FEATURES if f.group == "form"),
    "schedule": tuple(f.name for f in FEATURES if f.group == "schedule"),
    "head_to_head": tuple(f.name for f in FEATURES if f.group == "head_to_head"),
}
DESIGN_COLUMNS = tuple(c for members in BLOCKS.values() for c in members)

IDENTITY_COLUMNS = (
    "match_id",
    "competition_id",
    "season",
    "date",
    "home_team",
    "away_team",
    "home_team_id",
    "away_team_id",
)
HISTORY_COLUMNS = (
    "match_id",
    "competition_id",
    "season",
    "date",
    "kickoff",
    "home_team",
    "away_team",
    "home_goals",
    "away_goals",
    "result",
    "ht_home_goals",
    "ht_away_goals",
)

PROBS = ("prob_home", "prob_draw", "prob_away")
FORECAST_SCHEMA = _struct(
    [
        ("fold", _I),
        (KEY, _S),
        ("competition_id", _S),
        *[(p, _D) for p in PROBS],
        ("forecaster", _S),
        (TARGET, _S),
    ]
)
PREDICTION_SCHEMA = _struct(
    [
        ("id", T.LongType()),
        ("predicted_at", T.TimestampType()),
        (KEY, _S),
        ("competition_id", _S),
        ("home_team", _S),
        ("away_team", _S),
        ("match_date", _DT),
        ("model", _S),
        ("model_version", _S),
        *[(p, _D) for p in PROBS],
        ("in_sample", T.BooleanType()),
    ]
)
POOLED = "ALL"


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` onto ``schema``: declared order and types, absent columns null."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def require_columns(df: DataFrame, names) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def order_key(*, prefix: str = "") -> Column:
    """The canonical order of contests as one comparable value."""
    return F.struct(
        F.col(f"{prefix}date"), F.col(f"{prefix}competition_id"), F.col(f"{prefix}match_id")
    )


CANONICAL_ORDER = ("date", "competition_id", "match_id")
