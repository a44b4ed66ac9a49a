"""A forecaster against the price: loss by how far apart the two were."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitwise.functions import scoring as S
from pitwise.operators.clean import first_per_key
from pitwise.schema import KEY, ODDS_COLUMNS, PROBS, TARGET


def with_prices(forecasts: DataFrame, matches: DataFrame, name: str) -> DataFrame:
    """One forecaster's rows with the de-vigged price of the same contest."""
    odds = first_per_key(
        matches.select(KEY, *ODDS_COLUMNS), [KEY], [F.col(c).asc_nulls_last() for c in ODDS_COLUMNS]
    )
    market = S.implied(ODDS_COLUMNS)
    return (
        forecasts.filter(F.col("forecaster") == name)
        .join(odds, KEY, "inner")
        .select(
            *forecasts.columns,
            *[m.alias(f"market_{i}") for i, m in zip(("home", "draw", "away"), market, strict=True)],
        )
    )


MARKET_PROBS = ("market_home", "market_draw", "market_away")


def disagreement(priced: DataFrame) -> DataFrame:
    """Per band of distance: contests, both losses, the deficit, the share better."""
    usable = priced.filter(S.is_priced(PROBS) & S.is_priced(MARKET_PROBS))
    gap = S.distance(PROBS, MARKET_PROBS)
    terms = usable.select(
        S.band(gap).alias("band"),
        S.log_loss(PROBS, TARGET).alias("model"),
        S.log_loss(MARKET_PROBS, TARGET).alias("market"),
    )
    better = F.when(F.col("model") < F.col("market"), 1.0).otherwise(0.0)
    table = terms.groupBy("band").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("model").alias("model"),
        F.avg("market").alias("market"),
        F.avg(better).alias("model_better"),
    )
    order = F.array_position(F.array(*[F.lit(b) for b in S.BAND_LABELS]), F.col("band"))
    return table.select(
        "band",
        "n",
        "model",
        "market",
        (F.col("model") - F.col("market")).alias("model_minus_market"),
        "model_better",
    ).orderBy(order)
