"""Point-in-time windows: what a key knew strictly before a date.

All windows cut at the *date*: two rows of one key on one day see the same past
and never each other. That lets every window be answered per ``(key, day)``
instead of per row, which is what makes it hold when one key owns a large share
of the table:

* counts need only the number of rows per ``(key, day)``, a partial aggregate;
* a mean over the last ``w`` rows needs at most the last ``w`` rows of each day,
  kept by a ranked filter that Spark applies on the map side already.

After that reduction one key holds at most ``days x (w + 1)`` rows, a number
bounded by the calendar and not by the data, and only then is anything
partitioned by the key alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitwise.functions.scoring import points

DAY = "_day"


def day_number(date: Column) -> Column:
    return F.unix_date(date.cast("date"))


def long_form(matches: DataFrame) -> DataFrame:
    """Two rows per contest, one from each side's view."""

    def side(venue, own, other):
        return F.struct(
            F.lit(venue).alias("venue"),
            F.col(f"{own}_team_id").alias("team"),
            F.col(f"{other}_team_id").alias("opponent"),
            F.col(f"{own}_goals").cast("double").alias("goals_for"),
            F.col(f"{other}_goals").cast("double").alias("goals_against"),
            F.col(f"{own}_shots").cast("double").alias("shots_for"),
            F.col(f"{other}_shots").cast("double").alias("shots_against"),
            points(F.col(f"{own}_goals"), F.col(f"{other}_goals")).alias("points"),
        )

    return matches.select(
        "match_id",
        "date",
        F.inline(F.array(side("home", "home", "away"), side("away", "away", "home"))),
    )


def day_tail(df: DataFrame, keys: Sequence[str], width: int, order: str = "match_id") -> DataFrame:
    """The last ``width`` rows of every ``(keys, day)``.

    A ranked filter: Spark keeps only ``width`` rows per group in each map task
    before the shuffle, so a hot day never travels whole.
    """
    w = Window.partitionBy(*keys, DAY).orderBy(F.col(order).desc())
    return (
        df.withColumn("_rank", F.row_number().over(w))
        .filter(F.col("_rank") <= width)
        .drop("_rank")
    )


def tail_with_counts(
    df: DataFrame, keys: Sequence[str], width: int, order: str = "match_id"
) -> DataFrame:
    """:func:`day_tail` plus ``_n``, the full number of rows of the ``(keys, day)``.

    ``_n`` sits on one row per group, so summing it over any frame of whole days
    counts every row of the input. Both sides are partitioned by ``(keys, day)``
    already, so a merge join adds no exchange; it is asked for by name, because the
    counts grow with the table and must never be gathered to be sent round.
    """
    by = [*keys, DAY]
    w = Window.partitionBy(*by).orderBy(F.col(order).desc())
    tail = df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= width)
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_total"))
    return (
        tail.join(counts.hint("merge"), by)
        .withColumn("_n", F.when(F.col("_rank") == 1, F.col("_total")))
        .drop("_rank", "_total")
    )


def prior_count(keys: Sequence[str]) -> Column:
    """Over a counted tail: rows of the key on strictly earlier dates."""
    w = Window.partitionBy(*keys).orderBy(DAY)
    return F.coalesce(F.sum("_n").over(w.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))


def count_within(keys: Sequence[str], span: int) -> Column:
    """Over a counted tail: rows of the key in ``[day - span, day)``."""
    w = Window.partitionBy(*keys).orderBy(DAY)
    return F.coalesce(F.sum("_n").over(w.rangeBetween(-span, -1)), F.lit(0))


def days_since_previous(keys: Sequence[str]) -> Column:
    """Gap to the last strictly earlier date of the key; null on its first."""
    w = Window.partitionBy(*keys).orderBy(DAY)
    return F.col(DAY) - F.max(DAY).over(w.rangeBetween(Window.unboundedPreceding, -1))


def trailing_mean(
    value: str, keys: Sequence[str], width: int, order: str = "match_id"
) -> Column:
    """Mean of the last ``width`` rows before the row's day, on its day's first row.

    A null value takes up a place in the window and is left out of the mean. The
    frame of a day's *first* row looks back over earlier days only; on the
    day's other rows it would see same-day rows, so there the answer is null and
    an aggregate over the day picks the one value up.
    """
    ordered = Window.partitionBy(*keys).orderBy(F.col(DAY), F.col(order))
    previous = F.lag(DAY).over(ordered)
    mean = F.avg(F.col(value)).over(ordered.rowsBetween(-width, -1))
    return F.when(previous.isNull() | (previous < F.col(DAY)), mean)
