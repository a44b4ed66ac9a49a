import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pitwise.schema import MATCH_SCHEMA, conform  # noqa: E402
from pitwise.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Contests from short tuples: (id, day, home, away, hg, ag) plus keyword columns."""

    def build(rows, competition="ENG_1", season="2020-21", **extra):
        start = dt.date(2020, 8, 1)
        code = competition.split("_")[0].lower()
        data = []
        for mid, day, home, away, hg, ag in rows:
            result = None if hg is None else "H" if hg > ag else "A" if hg < ag else "D"
            data.append(
                (mid, competition, season, start + dt.timedelta(days=day), f"{code}:{home}",
                 f"{code}:{away}", home, away, hg, ag, result, "England", "Premier League", "p", 1)
            )
        df = spark.createDataFrame(
            data,
            "match_id string, competition_id string, season string, date date, "
            "home_team_id string, away_team_id string, home_team string, away_team string, "
            "home_goals int, away_goals int, result string, country string, competition string, "
            "provider string, tier int",
        )
        for name, value in extra.items():
            df = df.withColumn(name, value)
        return conform(df, MATCH_SCHEMA)

    return build


@pytest.fixture(scope="session")
def league(make):
    """Two seasons of eight teams, with same-day repeats and unscored rows."""
    import random

    rng = random.Random(3)
    rows = []
    for i in range(260):
        home, away = rng.sample("abcdefgh", 2)
        scored = rng.random() > 0.05
        rows.append(
            (f"m{i:04d}", rng.randrange(240), home, away, rng.randrange(5) if scored else None,
             rng.randrange(4) if scored else None)
        )
    from pyspark.sql import functions as F

    n = F.substring("match_id", 2, 4).cast("int")
    return make(
        rows,
        season=None,
        home_shots=F.when(n % 4 != 0, (n % 17).cast("smallint")),
        away_shots=F.when(n % 4 != 0, (n % 13).cast("smallint")),
    ).withColumn("season", F.when(F.col("date") < "2020-12-01", "2020").otherwise("2021"))
