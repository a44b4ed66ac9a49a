"""Named views over Parquet and the point-in-time scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitwise.functions.text import IDENTIFIER
from pitwise.schema import (
    CANONICAL_ORDER,
    FEATURE_SCHEMA,
    HISTORY_COLUMNS,
    MATCH_COLUMNS,
    MATCH_SCHEMA,
    RATING_SCHEMA,
    conform,
)


def read_matches(
    matches: DataFrame,
    competitions: Sequence[str] | None = None,
    since: str | None = None,
    until: str | None = None,
    columns: Sequence[str] | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Filtered, projected, ordered scan; both date bounds are inclusive.

    ``None`` means no filter while an empty list of competitions means no rows.
    Output keeps the canonical column order whatever order was asked for.
    """
    if columns is not None:
        unknown = [c for c in columns if c not in MATCH_COLUMNS]
        if unknown:
            raise ValueError(f"unknown columns: {unknown}")
    wanted = [c for c in MATCH_COLUMNS if columns is None or c in columns]
    out = matches
    if competitions is not None:
        chosen = list(competitions)
        out = out.filter(F.col("competition_id").isin(*chosen) if chosen else F.lit(False))
    if since is not None:
        out = out.filter(F.col("date") >= F.lit(since).cast("date"))
    if until is not None:
        out = out.filter(F.col("date") <= F.lit(until).cast("date"))
    if not ordered:
        return out.select(*wanted)
    # Sort on the key columns first, then narrow, so the order never depends on
    # which columns were asked for.
    return out.orderBy(*CANONICAL_ORDER).select(*wanted)


def history(matches: DataFrame, **filters) -> DataFrame:
    """The twelve columns a results page shows."""
    return read_matches(matches, columns=HISTORY_COLUMNS, **filters)


class Catalog:
    """Temporary views over Parquet paths, attached all or nothing."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._attached: set[str] = set()

    def _reader(self, path: str, schema) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        try:
            return reader.parquet(path)
        except AnalysisException as error:
            raise FileNotFoundError(f"no table at {path}") from error

    def attach_parquet(self, name: str, path: str, schema=None) -> DataFrame:
        """A named view over Parquet; a missing path fails here, not at first read."""
        if not IDENTIFIER.match(name):
            raise ValueError(f"not a view name: {name!r}")
        df = self._reader(path, schema)
        df.createOrReplaceTempView(name)
        self._attached.add(name)
        return df

    def open_matches(
        self, path: str, ratings: str | None = None, features: str | None = None
    ) -> "Catalog":
        """Attach the match table and its derived tables; one missing attaches none."""
        plan = [("matches", path, MATCH_SCHEMA)]
        if ratings:
            plan.append(("ratings", ratings, RATING_SCHEMA))
        if features:
            plan.append(("features", features, FEATURE_SCHEMA))
        ready = [(name, self._reader(where, schema)) for name, where, schema in plan]
        for name, df in ready:
            df.createOrReplaceTempView(name)
            self._attached.add(name)
        return self

    def query(self, sql: str, params=None) -> DataFrame:
        """SQL with bound parameters, by name or by position."""
        return self.spark.sql(sql, args=params)

    def table(self, name: str, builder: str) -> DataFrame:
        if name not in self._attached:
            raise LookupError(f"no {name} table attached; build it with {builder}")
        return self.spark.table(name)

    def matches(self, **filters) -> DataFrame:
        return read_matches(self.table("matches", "sources.landing.ingest"), **filters)

    def ratings(self) -> DataFrame:
        return conform(self.table("ratings", "plans.builds.ratings"), RATING_SCHEMA)

    def features(self) -> DataFrame:
        return conform(self.table("features", "plans.builds.features"), FEATURE_SCHEMA)

    def count(self) -> int:
        return self.table("matches", "sources.landing.ingest").count()

    def views(self) -> list[str]:
        return sorted(self._attached)


def read_report(spark: SparkSession, path: str) -> DataFrame | None:
    """One written report, or ``None`` where it has not been built."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None
