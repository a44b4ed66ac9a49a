"""Expanding walk-forward folds, cut on dates."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitwise.schema import TARGET

FOLDS = 5
HORIZON_DAYS = 365
MIN_TRAIN = 380


@dataclass(frozen=True)
class Fold:
    """Train on everything before ``start``; evaluate on ``[start, end)``."""

    index: int
    start: dt.date
    end: dt.date

    def train(self, df: DataFrame) -> DataFrame:
        return df.filter(F.col("date") < F.lit(self.start))

    def evaluate(self, df: DataFrame) -> DataFrame:
        return df.filter((F.col("date") >= F.lit(self.start)) & (F.col("date") < F.lit(self.end)))


def walk_forward(
    df: DataFrame,
    folds: int = FOLDS,
    horizon_days: int = HORIZON_DAYS,
    min_train: int = MIN_TRAIN,
) -> list[Fold]:
    """The usable folds, earliest first.

    Two one-row aggregates decide the boundaries: the last date, then the size
    of both halves of every fold. A fold with too little to train on or nothing
    to evaluate is left out; having none is an error.
    """
    if folds < 1 or horizon_days < 1:
        raise ValueError("folds and horizon_days must be positive")
    last = df.agg(F.max("date")).first()[0]
    if last is None:
        raise ValueError("no rows to split")
    end = last + dt.timedelta(days=1)
    starts = [end - dt.timedelta(days=horizon_days * (folds - i)) for i in range(folds)]
    planned = [
        Fold(i, start, start + dt.timedelta(days=horizon_days)) for i, start in enumerate(starts)
    ]
    sizes = df.agg(
        *[F.count_if(F.col("date") < F.lit(f.start)).alias(f"t{f.index}") for f in planned],
        *[
            F.count_if((F.col("date") >= F.lit(f.start)) & (F.col("date") < F.lit(f.end))).alias(
                f"e{f.index}"
            )
            for f in planned
        ],
    ).first()
    usable = [f for f in planned if sizes[f"t{f.index}"] >= min_train and sizes[f"e{f.index}"] > 0]
    if not usable:
        raise ValueError("no fold has enough history to train on")
    return usable


def fold_of(date: Column, folds: Sequence[Fold]) -> Column:
    """Index of the fold that evaluates a date; null outside every fold."""
    expr = None
    for f in folds:
        inside = (date >= F.lit(f.start)) & (date < F.lit(f.end))
        expr = F.when(inside, f.index) if expr is None else expr.when(inside, f.index)
    return expr.cast("int")


def evaluation_rows(df: DataFrame, folds: Sequence[Fold]) -> DataFrame:
    """Every evaluated row once, with its fold; the date range reaches the scan."""
    first, last = min(f.start for f in folds), max(f.end for f in folds)
    inside = df.filter((F.col("date") >= F.lit(first)) & (F.col("date") < F.lit(last)))
    return inside.withColumn("fold", fold_of(F.col("date"), folds)).filter("fold IS NOT NULL")


def fold_sizes(df: DataFrame, folds: Sequence[Fold]) -> DataFrame:
    """One row per fold: boundaries and the size of both halves, in one pass."""
    counts = df.agg(
        *[
            F.struct(
                F.lit(f.index).alias("fold"),
                F.lit(f.start).alias("start"),
                F.lit(f.end).alias("end"),
                F.count_if(F.col("date") < F.lit(f.start)).alias("train"),
                F.count_if(
                    (F.col("date") >= F.lit(f.start)) & (F.col("date") < F.lit(f.end))
                ).alias("evaluate"),
            ).alias(f"f{f.index}")
            for f in folds
        ]
    )
    return counts.select(F.inline(F.array(*[F.col(f"f{f.index}") for f in folds])))


def class_priors(df: DataFrame, folds: Sequence[Fold]) -> DataFrame:
    """Each fold's own base rates over its training half: one pass for all folds."""

    def share(f: Fold, label: str) -> Column:
        before = F.col("date") < F.lit(f.start)
        n = F.count_if(before & F.col(TARGET).isNotNull())
        return F.try_divide(F.count_if(before & (F.col(TARGET) == label)), n)

    row = df.agg(
        *[
            F.struct(
                F.lit(f.index).alias("fold"),
                share(f, "H").alias("prior_home"),
                share(f, "D").alias("prior_draw"),
                share(f, "A").alias("prior_away"),
            ).alias(f"f{f.index}")
            for f in folds
        ]
    )
    return row.select(F.inline(F.array(*[F.col(f"f{f.index}") for f in folds])))


def tuning_slice(df: DataFrame, folds: Sequence[Fold]) -> DataFrame:
    """Everything strictly before the first evaluated date."""
    return df.filter(F.col("date") < F.lit(min(f.start for f in folds)))
