"""Reports assembled from scored forecasts; each gathers a few small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitwise.operators import evaluate as EV
from pitwise.operators import folds as FD
from pitwise.operators import market as MK
from pitwise.schema import CLASSES


def baseline_backtest(frame: DataFrame, folds=None, **kw) -> DataFrame:
    """Every baseline over every fold, in one job once the boundaries are known."""
    chosen = folds if folds is not None else FD.walk_forward(frame, **kw)
    return EV.score_table(EV.scored_terms(EV.baselines(frame, chosen)))


def competition_card(matches: DataFrame) -> DataFrame:
    """Coverage of the match table, one row per competition."""
    sides = matches.select(
        "competition_id", F.explode(F.array("home_team_id", "away_team_id")).alias("team")
    )
    teams = sides.groupBy("competition_id").agg(F.countDistinct("team").alias("teams"))

    def share(condition):
        return F.avg(F.when(condition, 1.0).otherwise(0.0))

    rows = matches.groupBy("competition_id").agg(
        F.any_value("country").alias("country"),
        F.any_value("competition").alias("competition"),
        F.any_value("tier").alias("tier"),
        F.count(F.lit(1)).alias("matches"),
        F.countDistinct("season").alias("seasons"),
        F.min("date").alias("first_match"),
        F.max("date").alias("last_match"),
        share(F.col("home_shots").isNotNull()).alias("stats"),
        share(F.col("ht_home_goals").isNotNull()).alias("half_time"),
        share(F.col("odds_home").isNotNull()).alias("odds"),
        share(F.col("result") == "H").alias("home_win"),
    )
    return rows.join(teams, "competition_id").orderBy(
        "country", F.col("tier").asc_nulls_last(), "competition_id"
    )


def totals(matches: DataFrame) -> DataFrame:
    def share(label):
        return F.avg(F.when(F.col("result") == label, 1.0).otherwise(0.0))

    return matches.agg(
        F.count(F.lit(1)).alias("matches"),
        F.countDistinct("competition_id").alias("competitions"),
        F.countDistinct("country").alias("countries"),
        F.countDistinct("season").alias("seasons"),
        F.min("date").alias("first_match"),
        F.max("date").alias("last_match"),
        share("H").alias("home_win"),
        share("D").alias("draw"),
        share("A").alias("away_win"),
    )


def team_count(matches: DataFrame) -> DataFrame:
    home = matches.select(F.col("home_team_id").alias("team"))
    away = matches.select(F.col("away_team_id").alias("team"))
    return home.union(away).agg(F.countDistinct("team").alias("teams"))


def market_report(forecasts: DataFrame, matches: DataFrame, name: str) -> DataFrame:
    return MK.disagreement(MK.with_prices(forecasts, matches, name))


def _lines(df: DataFrame, columns) -> list[str]:
    head = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]

    def cell(v):
        return f"{v:.4f}" if isinstance(v, float) else str(v)

    rows = df.select(*columns).collect()
    return head + ["| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in rows]


def model_card(scores: DataFrame, forecasts: DataFrame, name: str) -> str:
    """One Markdown page: pooled scores, reliability, by class, worst competitions."""
    mine = forecasts.filter(F.col("forecaster") == name)
    table = EV.reliability(mine).orderBy("bin")
    error = EV.calibration_error(table).first()["calibration_error"]
    page = [f"# {name}", "", "## Scores", ""]
    page += _lines(EV.pooled_table(scores), ("forecaster", "n", "log_loss", "rps", "accuracy"))
    page += ["", f"## Reliability (calibration error {error:.4f})", ""]
    page += _lines(table, ("bin", "lower", "upper", "n", "predicted", "observed", "gap"))
    by_class = EV.reliability(mine, by=["class"])
    for label in CLASSES:
        page += ["", f"### {label}", ""]
        page += _lines(
            by_class.filter(F.col("class") == label).orderBy("bin"),
            ("bin", "n", "predicted", "observed", "gap"),
        )
    page += ["", "## Least reliable competitions", ""]
    page += _lines(EV.worst_competitions(mine), ("competition_id", "matches", "calibration_error"))
    return "\n".join(page) + "\n"
