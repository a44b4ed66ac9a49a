"""Registered queries: each runs a stream over the given tables to its end and reads the sink.

Inputs are the tables cut into files by time, one file per micro-batch where
order matters, so the stream sees them arrive.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pitwise.operators import elo
from pitwise.plans import rating_sql
from pitwise.plans.contests import WITH_CONTESTS, contests, table
from pitwise.plans.registry import query, tidy
from pitwise.schema import KEY
from pitwise.session import durable, scratch_path
from pitwise.streaming import elo as stream_elo
from pitwise.streaming import live, log


def _run(spark, stream, schema):
    out, checkpoint = scratch_path(spark, "sink"), scratch_path(spark, "offsets")
    log.append_to(stream, out, checkpoint).awaitTermination()
    return spark.read.schema(schema).parquet(out)


def _land(df, by):
    """Write ``df`` as one file per value of ``by``, in that order of arrival."""
    root = scratch_path(df.sparkSession, "arrivals")
    df = durable(df, "arriving")
    steps = [r[0] for r in df.select(by).distinct().orderBy(by).collect()]
    for step in steps:  # a few periods; each is one append
        df.filter(F.col(by) == step).drop(by).repartition(1).write.mode("append").parquet(root)
    return root  # one file each, as a file is what a trigger takes


def _streamed_ratings(m):
    root = _land(m.withColumn("period", F.year("date")), "period")
    return stream_elo.rate_stream(log.read_files(m.sparkSession, root, m.schema, per_trigger=1))


@query("stream_elo_ratings", rating_sql.RATINGS)
def stream_elo_ratings(spark, sf_dir):
    """Ratings of a stream of years; equal to the batch walk."""
    rated = _run(spark, _streamed_ratings(contests(spark, sf_dir)), stream_elo._OUTPUT)
    return tidy(rated.drop("late"))


@query(
    "stream_elo_equals_batch",
    f"{WITH_CONTESTS} SELECT count(*) AS rows, CAST(0 AS BIGINT) AS different FROM contests",
)
def stream_elo_equals_batch(spark, sf_dir):
    m = contests(spark, sf_dir)
    streamed = _run(spark, _streamed_ratings(m), stream_elo._OUTPUT)
    batch = elo.rate(m).select(KEY, F.col("elo_home").alias("b_home"),
                               F.col("elo_away").alias("b_away"))
    both = streamed.join(batch, KEY, "full_outer")
    same = F.col("elo_home").eqNullSafe(F.col("b_home")) & F.col("elo_away").eqNullSafe(
        F.col("b_away")
    )
    return both.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~same).alias("different"))


@query(
    "stream_elo_late_rows",
    f"""{WITH_CONTESTS}
    SELECT lower(country) AS pool, count(*) AS rated,
      count(*) FILTER (year(date) < (SELECT max(year(date)) FROM contests)) AS late,
      CAST(0 AS BIGINT) AS different FROM contests GROUP BY 1""",
)
def stream_elo_late_rows(spark, sf_dir):
    """Every contest but those of the last year comes again behind the others: refused, nothing moves."""
    m = contests(spark, sf_dir)
    last = m.agg(F.max(F.year("date"))).first()[0]
    again = m.filter(F.year("date") < last).withColumn(KEY, F.concat(F.lit("again-"), KEY))
    root = _land(
        m.withColumn("period", F.year("date")).unionByName(
            again.withColumn("period", F.lit(last + 1))), "period",
    )
    stream = stream_elo.rate_stream(log.read_files(spark, root, m.schema, per_trigger=1))
    out = _run(spark, stream, stream_elo._OUTPUT)
    batch = elo.rate(m).select(KEY, F.col("elo_home").alias("b_home"))
    pools = m.unionByName(again).select(KEY, F.lower("country").alias("pool"))
    moved = ~F.col("late") & ~F.col("elo_home").eqNullSafe(F.col("b_home"))
    return out.join(pools, KEY).join(batch, KEY, "left").groupBy("pool").agg(
        F.count_if(~F.col("late")).alias("rated"), F.count_if("late").alias("late"),
        F.count_if(moved).alias("different"),
    )


def looks(events):
    """Event rows read as looks at contests in play: one contest per user."""
    return events.select(
        F.col("ts").cast("timestamp").alias("seen_at"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias(KEY),
        F.lit("X_1").alias("competition_id"),
        F.concat(F.lit("Home "), F.col("user_id").cast("string")).alias("home_team"),
        F.concat(F.lit("Away "), F.col("user_id").cast("string")).alias("away_team"),
        F.when(F.col("event_type") == "error", "unknown").otherwise("live").alias("status"),
        F.floor(F.col("value") / 50).cast("int").alias("home_goals"),
        F.lit(0).alias("away_goals"),
    )


_GONE_DAYS = 3


@query(
    "stream_live_events",
    f"""WITH seen AS (SELECT user_id, ts, CAST(floor(value / 50) AS INTEGER) AS g FROM events
      WHERE event_type <> 'error'),
    steps AS (SELECT *, lag(g) OVER w AS b, lag(ts) OVER w AS last, lead(ts) OVER w AS next
      FROM seen WINDOW w AS (PARTITION BY user_id ORDER BY ts, g)),
    marked AS (SELECT *, b IS NULL OR ts > last + INTERVAL {_GONE_DAYS} DAY AS begins,
      CASE WHEN next IS NULL THEN ts + INTERVAL {_GONE_DAYS} DAY < (SELECT max(ts) FROM events)
        ELSE next > ts + INTERVAL {_GONE_DAYS} DAY END AS over FROM steps)
    SELECT 'kick_off' AS kind, count(*) AS n FROM marked WHERE begins
    UNION ALL SELECT 'goal', count(*) FROM marked WHERE NOT begins AND b <> g
    UNION ALL SELECT 'full_time', count(*) FROM marked WHERE over""",
)
def stream_live_events(spark, sf_dir):
    """Kick-offs, score changes and full times over the event stream, a month per micro-batch.

    A contest unseen for three days is over: told by a later look at it or by the watermark's timer.
    """
    rows = table(spark, sf_dir, "events")
    dated = looks(rows).withColumn("period", F.date_trunc("month", "seen_at"))
    root = _land(dated, "period")
    stream = log.read_files(spark, root, live.LOOK, per_trigger=1)
    out = _run(spark, live.events(stream, "2000-01-01", _GONE_DAYS * 86400), live.EVENT)
    return out.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stream_followed_teams",
    "SELECT 'u' || CAST(user_id AS VARCHAR) AS match_id, count(*) AS n FROM events "
    "WHERE user_id % 7 = 0 GROUP BY 1",
)
def stream_followed_teams(spark, sf_dir):
    rows = looks(table(spark, sf_dir, "events"))
    root = scratch_path(spark, "arrivals")
    rows.write.parquet(root)
    users = table(spark, sf_dir, "events").filter("user_id % 7 = 0").select(
        F.concat(F.lit("Home "), F.col("user_id").cast("string")).alias("team")
    ).distinct()
    out = _run(spark, live.followed(log.read_files(spark, root, live.LOOK), users), live.LOOK)
    return out.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"))


@query(
    "stream_first_sight",
    "SELECT event_id, user_id FROM events",
)
def stream_first_sight(spark, sf_dir):
    """Monthly pulls that overlap: every second event comes again a month later, each is kept once.

    State is dropped when the watermark has passed a pull and its overlap.
    """
    events = table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")
    )
    month = F.date_trunc("month", "ts")
    again = events.filter("event_id % 2 = 0").withColumn("period", F.add_months(month, 1).cast("timestamp"))
    root = _land(events.withColumn("period", month).unionByName(again), "period")
    stream = log.read_files(spark, root, events.schema, per_trigger=1)
    out = _run(spark, log.first_sight(stream, "ts", "70 days", ["event_id"]), events.schema)
    return out.select("event_id", "user_id")


@query(
    "stream_resolved_forecasts",
    f"""{WITH_CONTESTS}, told AS (SELECT match_id, date, result,
        CAST(substr(match_id, 2, 12) AS BIGINT) % 2 = 0 AS settled FROM contests),
      reached AS (SELECT least(max(date), max(CASE WHEN settled THEN date END) + INTERVAL 1 DAY)
        - INTERVAL 1 DAY AS mark FROM told)
    SELECT match_id, CASE WHEN settled THEN result END AS result FROM told
    WHERE settled OR date + INTERVAL 10 DAY < (SELECT mark FROM reached)""",
)
def stream_resolved_forecasts(spark, sf_dir):
    """Forecasts joined to outcomes that arrive a day later, as two streams.

    Every second contest is never settled: its forecast comes out without a result once its ten days
    have passed, and the youngest still wait.
    """
    m = contests(spark, sf_dir)
    left = m.select(KEY, F.col("date").cast("timestamp").alias("predicted_at"))
    even = F.substring(KEY, 2, 12).cast("long") % 2 == 0
    right = m.filter(even).select(
        KEY, "result", F.date_add("date", 1).cast("timestamp").alias("settled_at")
    )
    a, b = scratch_path(spark, "forecasts"), scratch_path(spark, "outcomes")
    left.write.parquet(a)
    right.write.parquet(b)
    joined = log.resolve_stream(
        log.read_files(spark, a, left.schema), log.read_files(spark, b, right.schema)
    )
    out = _run(spark, joined, "match_id string, predicted_at timestamp, result string")
    return out.select(KEY, "result")
