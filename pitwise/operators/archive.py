"""Scoring what was served: drift of each model version against its backtest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitwise.functions import scoring as S
from pitwise.operators.clean import first_per_key
from pitwise.schema import CLASSES, KEY, PROBS, TARGET

VERSION = ("model", "model_version")


def latest(log: DataFrame) -> DataFrame:
    """The last forecast per contest and version; repeats are one piece of evidence."""
    return first_per_key(
        log, [KEY, *VERSION], [F.col("predicted_at").desc(), F.col("id").desc()]
    )


def resolved(log: DataFrame, matches: DataFrame) -> DataFrame:
    """Each forecast with its outcome where there is one; no forecast is lost."""
    outcomes = first_per_key(
        matches.select(KEY, TARGET), [KEY], [F.col(TARGET).asc_nulls_last()]
    )
    return log.join(outcomes, KEY, "left")


def reference_population(forecasts: DataFrame, name: str | None = None) -> DataFrame:
    """Size, mean loss and sample spread of a backtest's per-contest losses."""
    rows = forecasts if name is None else forecasts.filter(F.col("forecaster") == name)
    loss = S.log_loss(PROBS, TARGET)
    n = F.count(F.lit(1))
    return rows.agg(
        n.alias("n"),
        F.when(n >= 2, F.avg(loss)).alias("log_loss"),
        F.when(n >= 2, F.stddev_samp(loss)).alias("spread"),
    )


def _number(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("double")


def summarise(log: DataFrame, matches: DataFrame, spread, baseline=None) -> DataFrame:
    """The drift report: one row per served version, newest first."""
    rows = resolved(latest(log), matches)
    known = F.coalesce(F.col(TARGET).isin(*CLASSES), F.lit(False))
    scorable = known & ~F.col("in_sample")

    def mean(term: Column) -> Column:
        return F.avg(F.when(scorable, term))

    table = rows.groupBy(*VERSION).agg(
        F.count(F.lit(1)).alias("logged"),
        F.count_if("in_sample").alias("in_sample"),
        F.count_if(~known).alias("unresolved"),
        F.count_if(scorable).alias("n"),
        mean(S.log_loss(PROBS, TARGET)).alias("log_loss"),
        mean(S.rps(PROBS, TARGET)).alias("rps"),
        mean(S.hit(PROBS, TARGET)).alias("accuracy"),
        F.min("predicted_at").alias("first_served"),
        F.max("predicted_at").alias("last_served"),
    )
    base, sigma = _number(baseline), _number(spread)
    drift = F.when(F.col("n") > 0, F.col("log_loss") - base)
    reach = S.detectable(sigma, F.col("n"))
    return table.select(
        *VERSION,
        "logged",
        "in_sample",
        "unresolved",
        "n",
        "log_loss",
        "rps",
        "accuracy",
        base.alias("baseline"),
        sigma.alias("spread"),
        drift.alias("drift"),
        reach.alias("detectable"),
        F.coalesce(F.abs(drift) > reach, F.lit(False)).alias("distinguishable"),
        "first_served",
        "last_served",
    ).orderBy(F.col("last_served").desc())


def horizon(spark, spread: float, differences) -> DataFrame:
    """How many scored forecasts each difference takes to be seen."""
    if not all(d > 0 for d in differences):
        raise ValueError("a detectable difference is positive")
    rows = spark.createDataFrame([(float(d),) for d in differences], "difference double")
    return rows.withColumn("needed", S.needed(F.lit(float(spread)), F.col("difference")))
