"""Ingest: a landing directory of provider files to the canonical table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitwise.functions import text as X
from pitwise.operators import clean
from pitwise.session import durable
from pitwise.sources import lines

PROVIDER = "football-data"
# ``main/<season code>/<division>`` and ``extra/<country>``, each a CSV file or a
# directory of CSV parts (``key=value`` directory names included).
_PART = r"(?:[a-z_]+=)?"
_END = r"(?:\.csv|/[^/]+\.csv)$"
_MAIN = rf"/main/{_PART}(\d{{4}})/{_PART}([^/.]+){_END}"
_EXTRA = rf"/extra/{_PART}([^/.]+){_END}"


@dataclass(frozen=True)
class Landed:
    matches: DataFrame
    shaped: DataFrame
    files: DataFrame
    rows: DataFrame


def ingest(spark: SparkSession, root: str, registry: DataFrame, native: bool = False) -> Landed:
    """Read both layouts under ``root``, clean them and combine them."""
    files, rows = lines.scan_files(spark, root)
    dims = registry.select("competition_id", "country", "competition", "tier", "feed", "code",
                           "league_filter")
    path = F.col("path")
    main = rows.filter(path.rlike(_MAIN)).select(
        "*",
        F.regexp_extract(path, _MAIN, 2).alias("code"),
        X.season_code_to_label(F.regexp_extract(path, _MAIN, 1)).alias("season"),
    )
    main = clean.keep_own_division(main, F.col("code")).join(
        dims.filter(F.col("feed") == "main"), "code"
    )
    extra = rows.filter(path.rlike(_EXTRA)).select(
        "*",
        F.regexp_extract(path, _EXTRA, 1).alias("code"),
        X.normalise_season(lines.field("Season")).alias("season"),
    )
    extra = clean.split_by_league(extra, dims).filter(F.col("season").isNotNull())
    shaped = clean.shape(main, clean.MAIN_LAYOUT, PROVIDER).unionByName(
        clean.shape(extra, clean.EXTRA_LAYOUT, PROVIDER)
    )
    # Parsed once: the counts, the unreadable files and the table itself read it back.
    shaped = clean.readable_files(durable(shaped, "landed"))
    return Landed(clean.combine([clean.canonical(shaped, native)]), shaped, files, rows)
