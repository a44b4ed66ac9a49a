"""Questions a results page asks of the match table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitwise.functions import scoring as S
from pitwise.operators.clean import first_per_key
from pitwise.operators.windows import long_form
from pitwise.schema import KEY

FORM_MATCHES = 5
H2H_MATCHES = 10


def involving(matches: DataFrame, teams: Sequence[str]) -> DataFrame:
    """Rows of any of the teams, either side; no teams asked for means every row."""
    if not teams:
        return matches
    return matches.filter(F.col("home_team").isin(*teams) | F.col("away_team").isin(*teams))


def for_team(matches: DataFrame, team: str, limit: int = 200) -> DataFrame:
    """One team's most recent rows, newest first."""
    return involving(matches, [team]).orderBy(F.col("date").desc(), F.col(KEY).desc()).limit(limit)


def meetings(matches: DataFrame, home: str, away: str, limit: int = H2H_MATCHES) -> DataFrame:
    """Meetings of two teams either way round, newest first."""
    one = (F.col("home_team") == home) & (F.col("away_team") == away)
    other = (F.col("home_team") == away) & (F.col("away_team") == home)
    return matches.filter(one | other).orderBy(F.col("date").desc(), F.col(KEY).desc()).limit(limit)


def record(matches: DataFrame, team: str) -> DataFrame:
    """Wins, draws and losses over the given rows from one side's view."""
    letter = S.letter(F.col("result"), F.col("home_team") == team)
    return matches.agg(
        F.count_if(letter == "W").alias("wins"),
        F.count_if(letter == "D").alias("draws"),
        F.count_if(letter == "L").alias("losses"),
    )


def form_strings(matches: DataFrame, n: int = FORM_MATCHES) -> DataFrame:
    """The last ``n`` results of every team as letters, oldest first.

    Ranked filter first: at most ``n`` rows per team leave a map task, and the
    list that is gathered holds at most ``n`` letters.
    """
    sides = matches.select(
        KEY,
        "date",
        F.inline(
            F.array(
                F.struct(
                    F.col("home_team_id").alias("team"),
                    S.letter(F.col("result"), F.lit(True)).alias("letter"),
                ),
                F.struct(
                    F.col("away_team_id").alias("team"),
                    S.letter(F.col("result"), F.lit(False)).alias("letter"),
                ),
            )
        ),
    )
    newest = Window.partitionBy("team").orderBy(F.col("date").desc(), F.col(KEY).desc())
    last = sides.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= n)
    ordered = F.array_sort(F.collect_list(F.struct("date", KEY, "letter")))
    return last.groupBy("team").agg(
        F.array_join(F.transform(ordered, lambda e: e["letter"]), "").alias("form")
    )


def last_rows(matches: DataFrame, n: int, by: str = "competition_id") -> DataFrame:
    """The last ``n`` rows of each group in canonical order."""
    w = Window.partitionBy(by).orderBy(F.col("date").desc(), F.col(KEY).desc())
    return matches.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def last_seasons(matches: DataFrame, seasons: int, competition: str | None = None) -> DataFrame:
    """Rows of each competition's last ``seasons`` season labels.

    The labels are ranked on their own small distinct table and joined back, so
    no window ever sees a competition's rows.
    """
    scope = matches if competition is None else matches.filter(
        F.col("competition_id") == competition
    )
    labels = scope.filter(F.col("season").isNotNull()).select("competition_id", "season").distinct()
    w = Window.partitionBy("competition_id").orderBy(F.col("season").desc())
    wanted = labels.withColumn("_r", F.dense_rank().over(w)).filter(F.col("_r") <= seasons)
    return scope.join(wanted.drop("_r"), ["competition_id", "season"], "left_semi")


def teams_in(matches: DataFrame) -> DataFrame:
    """Every team name on either side, once."""
    home = matches.select(F.col("home_team").alias("team"))
    away = matches.select(F.col("away_team").alias("team"))
    return home.union(away).filter("team IS NOT NULL").distinct()


def search(matches: DataFrame, needle: str) -> DataFrame:
    """Teams whose name contains the text, with the competition each is in now."""
    low = F.lower(F.lit(needle))
    sides = matches.select(
        "date",
        KEY,
        "competition_id",
        F.explode(F.array("home_team", "away_team")).alias("team"),
    ).filter(F.contains(F.lower("team"), low))
    return sides.groupBy("team").agg(
        F.max_by("competition_id", F.struct("date", KEY)).alias("competition_id")
    )


def club_country_pools(matches: DataFrame, days: int = 400) -> DataFrame:
    """Names seen in each country during the last ``days`` days of the table."""
    last = matches.select(F.max("date")).scalar()
    recent = matches.filter(F.col("date") >= F.date_sub(last, days))
    return (
        recent.select(
            F.substring_index("competition_id", "_", 1).alias("country_code"),
            F.explode(F.array("home_team", "away_team")).alias("team"),
        )
        .distinct()
    )


def single_season_teams(matches: DataFrame) -> DataFrame:
    """Teams seen (at home) in exactly one season."""
    return (
        matches.groupBy(F.col("home_team_id").alias("team"))
        .agg(F.countDistinct("season").alias("seasons"), F.min("season").alias("season"))
        .filter("seasons = 1")
        .select("team", "season")
    )


def systematic_sample(df: DataFrame, k: int, total: int) -> DataFrame:
    """About ``k`` of ``total`` rows, the same ones on every run, chosen by 60 bits of the key's MD5."""
    step = -(-total // k) if k < total else 1
    bits = F.conv(F.substring(F.md5(F.col(KEY).cast("binary")), 1, 15), 16, 10).cast("long")
    return df.filter(bits % step == 0)


def latest_per_key(df: DataFrame, keys, order) -> DataFrame:
    """Keep the last row per key by an explicit order."""
    return first_per_key(df, keys, [F.col(c).desc() for c in order])


def appearances(matches: DataFrame) -> DataFrame:
    return long_form(matches)
