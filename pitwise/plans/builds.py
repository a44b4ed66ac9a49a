"""Derived tables: ratings, features, the modelling frame, future design rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitwise.operators import elo as E
from pitwise.operators import features as FE
from pitwise.operators import goals as G
from pitwise.operators.resolve import not_played
from pitwise.schema import (
    DESIGN_COLUMNS,
    FEATURE_COLUMNS,
    IDENTITY_COLUMNS,
    KEY,
    MATCH_SCHEMA,
    RATING_SCHEMA,
    conform,
)


def ratings(matches: DataFrame, models=("elo", "goals"), elo=E.DEFAULT, goal=G.DEFAULT) -> DataFrame:
    """The rating table; a model left out leaves its columns null."""
    out = matches.select(KEY)
    if "elo" in models:
        out = out.join(E.rate(matches, elo), KEY, "left")
    if "goals" in models:
        out = out.join(G.rate(matches, goal), KEY, "left")
    return conform(out, RATING_SCHEMA)


def features(matches: DataFrame, builders=tuple(FE.BUILDERS)) -> DataFrame:
    return FE.build(matches, builders)


def modelling_frame(
    matches: DataFrame, rated: DataFrame | None = None, featured: DataFrame | None = None
) -> DataFrame:
    """Matches with ratings and features where they exist.

    Left joins on one key: a first appearance without history stays in.
    """
    out = matches
    for table in (rated, featured):
        if table is not None:
            out = out.join(table, KEY, "left")
    return out


def served_columns(frame: DataFrame) -> DataFrame:
    """Identity and design columns: nothing known only after kick-off, no price."""
    return frame.select(*IDENTITY_COLUMNS, *DESIGN_COLUMNS)


def upcoming_rows(
    matches: DataFrame, fixtures: DataFrame, elo=E.DEFAULT, goal=G.DEFAULT
) -> DataFrame:
    """Design rows of future contests, from the same producers as the history.

    Fixtures are appended without a score, rated and featured with everything
    before them, and only their rows are kept.
    """
    fresh = conform(not_played(fixtures, matches), MATCH_SCHEMA)
    everything = conform(matches, MATCH_SCHEMA).unionByName(fresh)
    wanted = fresh.select(KEY)

    def only(table: DataFrame) -> DataFrame:
        return table.join(wanted, KEY, "left_semi")

    frame = modelling_frame(
        fresh,
        only(ratings(everything, elo=elo, goal=goal)),
        only(features(everything)),
    )
    return served_columns(frame)


def design_coverage(frame: DataFrame) -> DataFrame:
    """How many rows carry a value in every feature column."""
    complete = F.lit(True)
    for c in FEATURE_COLUMNS:
        complete = complete & F.col(c).isNotNull()
    return frame.agg(F.count(F.lit(1)).alias("rows"), F.count_if(complete).alias("complete"))
