"""The given tables read as two-sided contests.

``CONTESTS`` is one SQL text that both Spark and an ANSI engine run unchanged:
every order becomes a contest between two of twenty teams of a country, with a
score, statistics and prices derived from its amounts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitwise.schema import MATCH_SCHEMA, conform

CONTESTS = """
SELECT
  'm' || lpad(CAST(k AS VARCHAR(20)), 12, '0') AS match_id,
  'orders' AS provider,
  country || '_' || CAST(tier AS VARCHAR(2)) AS competition_id,
  country AS country,
  country || ' division ' || CAST(tier AS VARCHAR(2)) AS competition,
  CAST(CASE WHEN tier = 2 THEN NULL ELSE tier END AS TINYINT) AS tier,
  CASE WHEN country = 'LOW' THEN CAST(y AS VARCHAR(4))
       WHEN mo >= 7 THEN CAST(y AS VARCHAR(4)) || '-' || lpad(CAST((y + 1) % 100 AS VARCHAR(2)), 2, '0')
       ELSE CAST(y - 1 AS VARCHAR(4)) || '-' || lpad(CAST(y % 100 AS VARCHAR(2)), 2, '0') END AS season,
  d AS date,
  CASE WHEN k % 3 = 0 THEN NULL ELSE '15:00' END AS kickoff,
  'Team ' || CAST(h AS VARCHAR(2)) AS home_team,
  'Team ' || CAST(a AS VARCHAR(2)) AS away_team,
  lower(country) || ':team-' || CAST(h AS VARCHAR(2)) AS home_team_id,
  lower(country) || ':team-' || CAST(a AS VARCHAR(2)) AS away_team_id,
  CAST(hg AS SMALLINT) AS home_goals,
  CAST(ag AS SMALLINT) AS away_goals,
  CASE WHEN hg > ag THEN 'H' WHEN hg < ag THEN 'A' ELSE 'D' END AS result,
  CASE WHEN played THEN CAST(hg - hg % 2 AS SMALLINT) END AS ht_home_goals,
  CASE WHEN played THEN CAST(ag - ag % 2 AS SMALLINT) END AS ht_away_goals,
  CASE WHEN NOT played THEN NULL WHEN hg - hg % 2 > ag - ag % 2 THEN 'H'
       WHEN hg - hg % 2 < ag - ag % 2 THEN 'A' ELSE 'D' END AS ht_result,
  CASE WHEN played THEN CAST(p % 20 AS SMALLINT) END AS home_shots,
  CASE WHEN played THEN CAST(pc % 18 AS SMALLINT) END AS away_shots,
  CASE WHEN played THEN CAST(p % 20 - p % 20 % 3 AS SMALLINT) END AS home_shots_on_target,
  CASE WHEN played THEN CAST(pc % 18 - pc % 18 % 4 AS SMALLINT) END AS away_shots_on_target,
  CASE WHEN played THEN CAST(p % 9 AS SMALLINT) END AS home_corners,
  CASE WHEN played THEN CAST(pc % 8 AS SMALLINT) END AS away_corners,
  CASE WHEN played THEN CAST(p % 17 AS SMALLINT) END AS home_fouls,
  CASE WHEN played THEN CAST(pc % 16 AS SMALLINT) END AS away_fouls,
  CASE WHEN played THEN CAST(p % 5 AS SMALLINT) END AS home_yellows,
  CASE WHEN played THEN CAST(pc % 6 AS SMALLINT) END AS away_yellows,
  CASE WHEN played THEN CAST(p % 2 AS SMALLINT) END AS home_reds,
  CASE WHEN played THEN CAST(pc % 2 AS SMALLINT) END AS away_reds,
  CASE WHEN k % 5 = 0 THEN NULL ELSE 'Referee ' || CAST(k % 13 AS VARCHAR(2)) END AS referee,
  CASE WHEN k % 11 = 0 THEN NULL ELSE CAST(1.2 + CAST(k % 37 AS DOUBLE) / 10.0 AS DOUBLE) END AS odds_home,
  CASE WHEN k % 11 = 0 THEN NULL ELSE CAST(1.2 + CAST(k * 3 % 37 AS DOUBLE) / 10.0 AS DOUBLE) END AS odds_draw,
  CASE WHEN k % 11 = 0 THEN NULL ELSE CAST(1.2 + CAST(k * 7 % 37 AS DOUBLE) / 10.0 AS DOUBLE) END AS odds_away
FROM (
  SELECT k, h, (h + 1 + k % 19) % 20 AS a, p, pc, p % 5 AS hg, pc % 4 AS ag, d, played, country,
         year(d) AS y, month(d) AS mo, CASE WHEN k % 4 = 0 THEN 2 ELSE 1 END AS tier
  FROM (
    SELECT o_orderkey AS k, o_custkey % 20 AS h, CAST(floor(o_totalprice) AS BIGINT) AS p,
           CAST(floor(o_totalprice * 100) AS BIGINT) AS pc, CAST(o_orderdate AS DATE) AS d,
           o_orderstatus <> 'P' AS played, substr(o_orderpriority, 3, 3) AS country
    FROM orders
  ) AS raw
) AS shaped
"""

WITH_CONTESTS = f"WITH contests AS ({CONTESTS})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical contest table of one data directory."""
    orders = table(spark, sf_dir, "orders")
    return conform(spark.sql(CONTESTS.replace("FROM orders", "FROM {orders}"), orders=orders),
                   MATCH_SCHEMA)


def split_upcoming(matches: DataFrame, since: str) -> tuple[DataFrame, DataFrame]:
    """Rows before ``since`` as played, the rest stripped of everything known later."""
    from pitwise.schema import BENCHMARK, POST_MATCH

    cut = F.lit(since).cast("date")
    hidden = POST_MATCH | BENCHMARK
    upcoming = matches.filter(F.col("date") >= cut).select(
        *[
            F.lit(None).cast(f.dataType).alias(f.name) if f.name in hidden else F.col(f.name)
            for f in MATCH_SCHEMA.fields
        ]
    )
    return matches.filter(F.col("date") < cut), upcoming
