"""Exact quantiles without gathering values in one place."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitwise.session import durable

_BUCKETS = 256
#: The sketch errs by this share of the rows at most.
_SKETCH = 0.001


def _at_ranks(counts: DataFrame, wanted: dict[tuple[str, int], tuple[float, float]]) -> dict:
    """The value of each ``(column, zero-based rank)``, by narrowing the interval that holds it.

    ``wanted`` gives each its first interval. A round is one aggregate into at most 256 buckets per
    open interval; an interval closes when the bucket holding its rank has a single value.
    """
    found, ranges = {}, {key: (0, low, high) for key, (low, high) in wanted.items()}
    while True:
        found.update({key: low for key, (_, low, high) in ranges.items() if low >= high})
        ranges = {key: r for key, r in ranges.items() if key not in found}
        if not ranges:
            return found
        rows = [(column, rank, low, high) for (column, rank), (_, low, high) in ranges.items()]
        spans = counts.sparkSession.createDataFrame(rows, "column string, rank long, low double, high double")
        inside = counts.join(spans, "column").filter("value BETWEEN low AND high")
        share = (F.col("value") - F.col("low")) / (F.col("high") - F.col("low"))
        buckets = (
            inside.groupBy("column", "rank", F.least(F.floor(share * _BUCKETS), F.lit(_BUCKETS - 1)).alias("bucket"))
            .agg(F.sum("n").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
            .orderBy("column", "rank", "bucket")
            .collect()
        )
        closed = set()
        for b in buckets:
            key = (b["column"], b["rank"])
            if key in closed:
                continue
            before = ranges[key][0]
            if before + b["n"] > b["rank"]:
                ranges[key] = (before, b["low"], b["high"])
                closed.add(key)
            else:
                ranges[key] = (before + b["n"], *ranges[key][1:])


def _counted(df: DataFrame, columns: Sequence[str], kept=None) -> DataFrame:
    """How often each value of a column comes, for the values that ``kept`` lets through."""
    values = [F.col(c).cast("double") for c in columns]
    if kept is not None:
        values = [F.when(kept(c, v), v) for c, v in zip(columns, values)]
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), v.alias("value")) for c, v in zip(columns, values)
    ])
    return durable(
        df.select(F.inline(cells)).filter("value IS NOT NULL")
        .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")),
        "value-counts",
    )


def _at_places(counts: DataFrame, places: dict[str, float], before: dict[str, int]) -> dict[str, float]:
    """The value at each column's place, between two ranks; ``before`` values lie below the counted ones."""
    ends = {
        r["column"]: (r["low"], r["high"])
        for r in counts.groupBy("column").agg(F.min("value").alias("low"), F.max("value").alias("high")).collect()
    }
    wanted = {
        (c, rank - before[c]): ends[c]
        for c, place in places.items()
        for rank in {math.floor(place), math.ceil(place)}
    }
    at = _at_ranks(counts, wanted)
    out = {}
    for c, place in places.items():
        lower, upper = (at[c, rank - before[c]] for rank in (math.floor(place), math.ceil(place)))
        out[c] = lower + (upper - lower) * (place - math.floor(place))
    return out


def exact_quantiles(df: DataFrame, columns: Sequence[str], q: float = 0.5) -> dict[str, float | None]:
    """Quantile of every column, with linear interpolation between the two middle ranks.

    A sketch gives every column an interval that should hold its rank; the values below it are
    counted and only those inside, a few in a thousand, are shuffled. A column whose counts say that
    the rank lies elsewhere has all its values counted. Equal values are counted together before
    anything is shuffled, so a value that fills a third of the table is one row. Nothing but sketches
    and bucket totals reaches the driver. A column without a value has none.
    """
    columns = list(dict.fromkeys(columns))
    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    ends = [max(0.0, q - 2 * _SKETCH), min(1.0, q + 2 * _SKETCH)]
    spans = {c: s for c, s in zip(columns, doubles.approxQuantile(columns, ends, _SKETCH)) if s}
    told = doubles.agg(
        *[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)],
        *[F.count_if(F.col(c) < spans[c][0]).alias(f"b{i}") for i, c in enumerate(columns) if c in spans],
        *[F.count_if(F.col(c).between(*spans[c])).alias(f"i{i}") for i, c in enumerate(columns) if c in spans],
    ).first()
    places = {c: q * (told[f"n{i}"] - 1) for i, c in enumerate(columns) if told[f"n{i}"]}
    before = {c: told[f"b{i}"] for i, c in enumerate(columns) if c in spans}
    near = {
        c: places[c] for i, c in enumerate(columns)
        if c in spans and before[c] <= math.floor(places[c])
        and math.ceil(places[c]) < before[c] + told[f"i{i}"]
    }
    out: dict[str, float | None] = dict.fromkeys(columns)
    if near:
        inside = _counted(doubles, list(near), lambda c, v: v.between(*spans[c]))
        out.update(_at_places(inside, near, before))
    if far := {c: place for c, place in places.items() if c not in near}:
        out.update(_at_places(_counted(doubles, list(far)), far, dict.fromkeys(far, 0)))
    return out


def exact_quantile(df: DataFrame, column: str, q: float = 0.5) -> float | None:
    return exact_quantiles(df, [column], q)[column]


def exact_median(df: DataFrame, column: str) -> float | None:
    return exact_quantile(df, column, 0.5)
