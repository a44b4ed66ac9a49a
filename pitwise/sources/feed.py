"""Live-feed JSON: nested match documents to fixture rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitwise.functions import text as X
from pitwise.sources.registry import FEED_CODES

# The nested document, as declared by the feed; every branch may be absent.
DOCUMENT = """
id bigint, utcDate string, status string, minute int,
competition struct<code: string, name: string>, area struct<name: string>,
homeTeam struct<name: string, shortName: string, crest: string>,
awayTeam struct<name: string, shortName: string, crest: string>,
score struct<fullTime: struct<home: int, away: int>>
"""

# The feed's status words.
UPCOMING = ("SCHEDULED", "TIMED")
DOCUMENTED = (
    "SCHEDULED",
    "TIMED",
    "IN_PLAY",
    "PAUSED",
    "LIVE",
    "FINISHED",
    "POSTPONED",
    "SUSPENDED",
    "CANCELLED",
    "AWARDED",
)
SHOWN = {
    "SCHEDULED": "scheduled",
    "TIMED": "scheduled",
    "IN_PLAY": "live",
    "PAUSED": "live",
    "FINISHED": "finished",
}


def is_upcoming(status: Column, home_score: Column) -> Column:
    """Documented as upcoming, or an undocumented word on an unscored match."""
    status = F.coalesce(status, F.lit("None"))
    return status.isin(*UPCOMING) | (~status.isin(*DOCUMENTED) & home_score.isNull())


def status_of(status: Column, home_score: Column) -> Column:
    """What a match card shows: a known word, scheduled for a misreported one, or unknown."""
    words = F.create_map(*[F.lit(x) for pair in SHOWN.items() for x in pair])
    status = F.coalesce(status, F.lit("None"))
    return F.coalesce(
        F.try_element_at(words, status),
        F.when(is_upcoming(status, home_score), "scheduled").otherwise("unknown"),
    )


def instant(text: Column) -> Column:
    """An ISO stamp as a UTC instant; one without an offset is read as UTC."""
    return F.try_to_timestamp(
        F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), text).otherwise(F.concat(text, F.lit("Z")))
    )


def fixtures(documents: DataFrame, column: str = "json") -> DataFrame:
    """One row per document with the nested branches flattened."""
    d = F.from_json(F.col(column), DOCUMENT)
    codes = F.create_map(*[F.lit(x) for pair in FEED_CODES.items() for x in pair])
    flat = documents.select(*[c for c in documents.columns if c != column], d.alias("d"))
    score = F.col("d.score.fullTime")
    utc = instant(F.col("d.utcDate"))
    return flat.select(
        *[c for c in documents.columns if c != column],
        F.col("d.id").alias("feed_id"),
        F.try_element_at(codes, F.col("d.competition.code")).alias("competition_id"),
        F.col("d.competition.code").alias("feed_code"),
        utc.alias("utc"),
        F.to_date(X.uk_time(utc)).alias("date"),
        F.date_format(X.uk_time(utc), "HH:mm").alias("kickoff"),
        F.col("d.status").alias("feed_status"),
        status_of(F.col("d.status"), score["home"]).alias("status"),
        F.col("d.minute").alias("minute"),
        F.col("d.homeTeam.name").alias("home_name"),
        F.col("d.homeTeam.shortName").alias("home_short"),
        F.col("d.awayTeam.name").alias("away_name"),
        F.col("d.awayTeam.shortName").alias("away_short"),
        score["home"].alias("home_goals"),
        score["away"].alias("away_goals"),
        is_upcoming(F.col("d.status"), score["home"]).alias("upcoming"),
    )


def unpublished(rows: DataFrame, published: DataFrame) -> DataFrame:
    """Feed rows the provider's own list does not carry yet."""
    keys = ["Div", "Date", "HomeTeam"]
    return rows.join(published.select(*keys), keys, "left_anti")
