"""The registered queries: a callable each, and SQL that must agree where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` names its columns exactly as the query does."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def tidy(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded half away from zero for comparison, in plain arithmetic.

    ``round`` on a double goes through decimal objects; scaling and flooring
    stays in generated code. Infinite and very large values pass through, and
    adding zero turns a negative zero into zero.
    """
    scale = 10.0**digits

    def rounded(c):
        near = F.signum(c) * F.floor(F.abs(c) * scale + 0.5) / scale + F.lit(0.0)
        return F.when(F.abs(c) < 1e9, near).otherwise(c)

    return df.select(
        *[
            rounded(F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )
