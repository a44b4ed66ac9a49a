"""Registered queries: point-in-time windows, features, ratings and leakage probes."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from pitwise.operators import elo, features, folds, goals, history, probes, quality
from pitwise.functions.scoring import points
from pitwise.operators import windows as W
from pitwise.plans import builds, rating_sql
from pitwise.plans.contests import WITH_CONTESTS, contests, split_upcoming, table
from pitwise.plans.registry import query, tidy
from pitwise.schema import ELO_COLUMNS, FEATURES, GOAL_COLUMNS, KEY, POST_MATCH, RATING_READS
from pitwise.session import durable

_SIDES = f"""{WITH_CONTESTS}, long AS (
  SELECT match_id, date, 'home' AS venue, home_team_id AS team,
    CAST(home_goals AS DOUBLE) AS gf, CAST(away_goals AS DOUBLE) AS ga,
    CAST(home_shots AS DOUBLE) AS sf, CAST(away_shots AS DOUBLE) AS sa,
    CASE WHEN home_goals > away_goals THEN 3.0 WHEN home_goals = away_goals THEN 1.0 ELSE 0.0 END AS pts
  FROM contests
  UNION ALL SELECT match_id, date, 'away', away_team_id, CAST(away_goals AS DOUBLE),
    CAST(home_goals AS DOUBLE), CAST(away_shots AS DOUBLE), CAST(home_shots AS DOUBLE),
    CASE WHEN away_goals > home_goals THEN 3.0 WHEN home_goals = away_goals THEN 1.0 ELSE 0.0 END
  FROM contests),
rolled AS (SELECT *,
    count(*) OVER earlier AS played, date - max(date) OVER earlier AS rest,
    count(*) OVER (PARTITION BY team ORDER BY date RANGE BETWEEN INTERVAL 14 DAY PRECEDING
      AND INTERVAL 1 DAY PRECEDING) AS busy,
    avg(pts) OVER last5 AS r_pts, avg(gf) OVER last5 AS r_gf, avg(ga) OVER last5 AS r_ga,
    avg(sf) OVER last5 AS r_sf, avg(sa) OVER last5 AS r_sa,
    avg(pts) OVER (PARTITION BY team, venue ORDER BY date, match_id
      ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS r_vp
  FROM long
  WINDOW earlier AS (PARTITION BY team ORDER BY date RANGE BETWEEN UNBOUNDED PRECEDING
      AND INTERVAL 1 DAY PRECEDING),
    last5 AS (PARTITION BY team ORDER BY date, match_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
known AS (SELECT match_id, venue, played, rest, busy,
    first_value(r_pts) OVER d AS f_pts, first_value(r_gf) OVER d AS f_gf,
    first_value(r_ga) OVER d AS f_ga, first_value(r_sf) OVER d AS f_sf,
    first_value(r_sa) OVER d AS f_sa,
    first_value(r_vp) OVER (PARTITION BY team, venue, date ORDER BY match_id) AS f_vp
  FROM rolled WINDOW d AS (PARTITION BY team, date ORDER BY match_id))"""

_SIDED = "".join(
    f""", CAST({v}.played AS INTEGER) AS {s}_matches_played,
    round({v}.f_pts, 6) AS {s}_form_points_5, round({v}.f_gf, 6) AS {s}_goals_for_5,
    round({v}.f_ga, 6) AS {s}_goals_against_5, round({v}.f_sf, 6) AS {s}_shots_for_5,
    round({v}.f_sa, 6) AS {s}_shots_against_5, round({v}.f_vp, 6) AS {s}_venue_points_5,
    CAST({v}.rest AS SMALLINT) AS {s}_rest_days, CAST({v}.busy AS SMALLINT) AS {s}_matches_14d"""
    for v, s in (("h", "home"), ("a", "away"))
)

_H2H = """pairs AS (SELECT match_id, date, home_team_id, least(home_team_id, away_team_id) AS p1,
    greatest(home_team_id, away_team_id) AS p2,
    CASE WHEN home_goals > away_goals THEN 3.0 WHEN home_goals = away_goals THEN 1.0 ELSE 0.0 END AS hp,
    CASE WHEN away_goals > home_goals THEN 3.0 WHEN home_goals = away_goals THEN 1.0 ELSE 0.0 END AS ap
  FROM contests),
met AS (SELECT match_id, date, home_team_id, p1, p2,
    count(*) OVER (PARTITION BY p1, p2 ORDER BY date RANGE BETWEEN UNBOUNDED PRECEDING
      AND INTERVAL 1 DAY PRECEDING) AS n,
    avg(CASE WHEN home_team_id = p1 THEN hp ELSE ap END) OVER w AS r1,
    avg(CASE WHEN home_team_id = p1 THEN ap ELSE hp END) OVER w AS r2
  FROM pairs WINDOW w AS (PARTITION BY p1, p2 ORDER BY date, match_id
    ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
faced AS (SELECT match_id, home_team_id, p1, n, first_value(r1) OVER d AS f1,
    first_value(r2) OVER d AS f2 FROM met
  WINDOW d AS (PARTITION BY p1, p2, date ORDER BY match_id))"""


@query(
    "features_team_history",
    f"""{_SIDES} SELECT h.match_id{_SIDED} FROM known h JOIN known a
    ON h.match_id = a.match_id AND h.venue = 'home' AND a.venue = 'away'""",
)
def features_team_history(spark, sf_dir):
    """Form and schedule of both sides, from what was known before the day."""
    types = {f.name: f.dtype for f in FEATURES}
    out = features.team_history(contests(spark, sf_dir))
    return tidy(out.select(KEY, *[F.col(n).cast(types[n]).alias(n) for n in out.columns[1:]]))


@query(
    "features_head_to_head",
    f"""{WITH_CONTESTS}, {_H2H} SELECT match_id, CAST(n AS SMALLINT) AS h2h_matches,
      round(CASE WHEN home_team_id = p1 THEN f1 ELSE f2 END, 6) AS h2h_home_points FROM faced""",
)
def features_head_to_head(spark, sf_dir):
    out = features.head_to_head(contests(spark, sf_dir))
    return tidy(out.withColumn("h2h_matches", F.col("h2h_matches").cast("smallint")))


@query(
    "features_full_build",
    f"""{_SIDES}, {_H2H} SELECT h.match_id{_SIDED}, CAST(n AS SMALLINT) AS h2h_matches,
      round(CASE WHEN home_team_id = p1 THEN f1 ELSE f2 END, 6) AS h2h_home_points
    FROM known h JOIN known a ON h.match_id = a.match_id AND h.venue = 'home' AND a.venue = 'away'
    JOIN faced f ON f.match_id = h.match_id""",
)
def features_full_build(spark, sf_dir):
    return tidy(builds.features(contests(spark, sf_dir)))


@query(
    "features_partial_build",
    f"""{WITH_CONTESTS}, {_H2H} SELECT match_id, CAST(NULL AS DOUBLE) AS home_form_points_5,
      CAST(n AS SMALLINT) AS h2h_matches FROM faced""",
)
def features_partial_build(spark, sf_dir):
    """A build of one producer: the other's columns are there and null."""
    built = builds.features(contests(spark, sf_dir), ["head_to_head"])
    return built.select(KEY, "home_form_points_5", "h2h_matches")


@query(
    "windows_over_event_users",
    """WITH d AS (SELECT user_id, event_id, CAST(ts AS DATE) AS date, value FROM events),
    w AS (SELECT user_id, event_id, date, count(*) OVER e AS prior,
        date - max(date) OVER e AS gap,
        count(*) OVER (PARTITION BY user_id ORDER BY date RANGE BETWEEN INTERVAL 7 DAY PRECEDING
          AND INTERVAL 1 DAY PRECEDING) AS within,
        avg(value) OVER (PARTITION BY user_id ORDER BY date, event_id
          ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS r
      FROM d WINDOW e AS (PARTITION BY user_id ORDER BY date RANGE BETWEEN UNBOUNDED PRECEDING
        AND INTERVAL 1 DAY PRECEDING)),
    f AS (SELECT user_id, date, prior, gap, within,
        first_value(r) OVER (PARTITION BY user_id, date ORDER BY event_id) AS mean3 FROM w)
    SELECT user_id, date, any_value(prior) AS prior, CAST(any_value(gap) AS INTEGER) AS gap,
      any_value(within) AS within, round(any_value(mean3), 6) AS mean3 FROM f GROUP BY user_id, date""",
)
def windows_over_event_users(spark, sf_dir):
    """The four window primitives over another table and key."""
    rows = table(spark, sf_dir, "events").select(
        "user_id", "event_id", F.col("ts").cast("date").alias("date"), "value"
    ).withColumn(W.DAY, W.day_number(F.col("date")))
    keys = ["user_id"]
    tail = W.tail_with_counts(rows, keys, 3, "event_id").repartition(*keys)
    known = tail.select(
        "user_id",
        "date",
        W.prior_count(keys).alias("prior"),
        W.days_since_previous(keys).alias("gap"),
        W.count_within(keys, 7).alias("within"),
        W.trailing_mean("value", keys, 3, "event_id").alias("mean3"),
    )
    return tidy(
        known.groupBy("user_id", "date").agg(
            *[F.max(c).alias(c) for c in ("prior", "gap", "within", "mean3")]
        )
    )


@query(
    "modelling_frame_left_joins",
    f"""{_SIDES}, {_H2H} SELECT c.match_id, c.competition_id, c.result,
      CAST(h.played AS INTEGER) AS home_matches_played, round(h.f_pts, 6) AS home_form_points_5,
      CAST(f.n AS SMALLINT) AS h2h_matches
    FROM contests c LEFT JOIN known h ON h.match_id = c.match_id AND h.venue = 'home'
      AND c.date >= DATE '1996-01-01'
    LEFT JOIN faced f ON f.match_id = c.match_id AND c.date >= DATE '1996-01-01'""",
)
def modelling_frame_left_joins(spark, sf_dir):
    """Rows without a derived row stay in the frame with nulls."""
    m = contests(spark, sf_dir)
    late = m.filter(F.col("date") >= F.lit("1996-01-01").cast("date")).select(KEY)
    built = builds.features(m).join(late, KEY, "left_semi")
    return tidy(
        builds.modelling_frame(m, None, built).select(
            KEY, "competition_id", "result", "home_matches_played", "home_form_points_5",
            "h2h_matches",
        )
    )


@query(
    "feature_coverage",
    f"""{_SIDES}, per AS (SELECT h.f_pts AS home_form_points_5, h.f_vp AS home_venue_points_5,
        h.f_sf AS home_shots_for_5, h.rest AS home_rest_days FROM known h WHERE h.venue = 'home')
    SELECT unnest(['home_form_points_5', 'home_venue_points_5', 'home_shots_for_5',
        'home_rest_days']) AS "column",
      round(unnest([avg(CAST(home_form_points_5 IS NOT NULL AS DOUBLE)),
        avg(CAST(home_venue_points_5 IS NOT NULL AS DOUBLE)),
        avg(CAST(home_shots_for_5 IS NOT NULL AS DOUBLE)),
        avg(CAST(home_rest_days IS NOT NULL AS DOUBLE))]), 6) AS share,
      count(*) FILTER (home_form_points_5 IS NOT NULL AND home_venue_points_5 IS NOT NULL
        AND home_shots_for_5 IS NOT NULL AND home_rest_days IS NOT NULL) AS complete_rows
    FROM per""",
)
def feature_coverage(spark, sf_dir):
    built = builds.features(contests(spark, sf_dir), ["team_history"])
    return tidy(
        quality.column_coverage(
            built,
            ["home_form_points_5", "home_venue_points_5", "home_shots_for_5", "home_rest_days"],
        )
    )


# ---- ratings ---------------------------------------------------------------------


@query("elo_ratings", rating_sql.RATINGS)
def elo_ratings(spark, sf_dir):
    return tidy(elo.rate(contests(spark, sf_dir)))


@query(
    "elo_counts",
    f"""{WITH_CONTESTS}, sides AS (SELECT match_id, date, competition_id, 'h' AS v,
        home_team_id AS team FROM contests
      UNION ALL SELECT match_id, date, competition_id, 'a', away_team_id FROM contests),
    n AS (SELECT match_id, v, row_number() OVER (PARTITION BY team
      ORDER BY date, competition_id, match_id) - 1 AS k FROM sides)
    SELECT h.match_id, CAST(h.k AS INTEGER) AS elo_home_played,
      CAST(a.k AS INTEGER) AS elo_away_played
    FROM n h JOIN n a ON h.match_id = a.match_id AND h.v = 'h' AND a.v = 'a'""",
)
def elo_counts(spark, sf_dir):
    """The walk's own counts: every earlier row of a team, same-day rows included."""
    return elo.rate(contests(spark, sf_dir)).select(KEY, "elo_home_played", "elo_away_played")


@query(
    "elo_zero_sum",
    f"""{WITH_CONTESTS} SELECT lower(country) AS pool, count(DISTINCT home_team_id) AS teams,
      CAST(1500 AS DOUBLE) AS mean_rating FROM contests WHERE country = 'LOW' OR country <> 'LOW'
    GROUP BY country""",
)
def elo_zero_sum(spark, sf_dir):
    """Without a season carry every country's ratings average exactly the initial value."""
    state = elo.final_state(contests(spark, sf_dir), elo.EloSettings(season_carry=1.0))
    return tidy(
        state.groupBy("pool").agg(
            F.count(F.lit(1)).alias("teams"), F.avg("rating").alias("mean_rating")
        ),
        3,
    )


@query("elo_mean_squared_error", rating_sql.SQUARED_ERROR)
def elo_mean_squared_error(spark, sf_dir):
    m = contests(spark, sf_dir)
    return tidy(elo.squared_error(elo.rate(m), m))


@query(
    "elo_grid_search",
    rating_sql.grid_error(
        list(itertools.product(elo.K_GRID, elo.HOME_GRID, elo.CARRY_GRID)),
        "date < (SELECT max(date) + 1 - 365 * 5 FROM contests)",
    ),
)
def elo_grid_search(spark, sf_dir):
    """Every setting scored on the contests before the first evaluated date."""
    m = contests(spark, sf_dir)
    return tidy(elo.grid_search(folds.tuning_slice(m, folds.walk_forward(m))))


#: Refit dates, which of them have enough contests and teams, and the teams each has seen.
GOAL_FITS = f"""{WITH_CONTESTS.replace("WITH ", "WITH RECURSIVE ", 1)},
    days AS (SELECT DISTINCT competition_id, date FROM contests),
    refits(competition_id, r) AS (
      SELECT competition_id, min(date) FROM contests GROUP BY 1
      UNION ALL SELECT s.competition_id, (SELECT min(d.date) FROM days d
        WHERE d.competition_id = s.competition_id AND d.date >= s.r + 60) FROM refits s WHERE s.r IS NOT NULL),
    seen AS (SELECT c.competition_id, f.r, match_id, home_team_id, away_team_id FROM contests c JOIN refits f
      ON f.competition_id = c.competition_id AND c.date < f.r AND c.date >= f.r - 1095 WHERE f.r IS NOT NULL),
    members AS (SELECT competition_id, r, home_team_id AS team FROM seen UNION SELECT competition_id, r, away_team_id FROM seen),
    sized AS (SELECT competition_id, r, count(*) AS matches FROM seen GROUP BY 1, 2),
    good AS (SELECT competition_id, r, matches, count(*) AS teams FROM sized JOIN members USING (competition_id, r)
      GROUP BY 1, 2, 3 HAVING matches >= 150 AND count(*) >= 6),
    placed AS (SELECT match_id, home_team_id, away_team_id, c.competition_id,
      (SELECT max(r) FROM good g WHERE g.competition_id = c.competition_id AND g.r <= c.date) AS r FROM contests c),
    covered AS (SELECT p.match_id, h.team IS NOT NULL AND a.team IS NOT NULL AS rated FROM placed p
      LEFT JOIN members h ON h.competition_id = p.competition_id AND h.r = p.r AND h.team = p.home_team_id
      LEFT JOIN members a ON a.competition_id = p.competition_id AND a.r = p.r AND a.team = p.away_team_id)"""


def _sound_goals(rated):
    """Whether a contest has the five values, and whether they are what rates and probabilities can be."""
    home, away, *probs = GOAL_COLUMNS
    total = sum((F.col(p) for p in probs), F.lit(0.0))
    sound = (F.col(home) > 0) & (F.col(away) > 0) & (F.abs(total - 1) < 1e-9) & (F.least(*probs) > 0)
    empty = F.coalesce(*GOAL_COLUMNS).isNull()
    return F.col(home).isNotNull().alias("rated"), F.coalesce(sound, empty).alias("sound")


@query("goal_model_ratings", f"{GOAL_FITS} SELECT match_id, rated, TRUE AS sound FROM covered")
def goal_model_ratings(spark, sf_dir):
    """Which contests the goal model rates: those whose teams the latest good refit has seen."""
    rated = goals.rate(contests(spark, sf_dir))
    return rated.select(KEY, *_sound_goals(rated))


@query(
    "goal_model_optimum",
    f"""{GOAL_FITS} SELECT competition_id, CAST(r - DATE '1970-01-01' AS INTEGER) AS refit, teams, matches,
      TRUE AS optimal FROM good""",
)
def goal_model_optimum(spark, sf_dir):
    """The likelihood's derivatives at the published strengths of every refit: none is left."""
    m = contests(spark, sf_dir)
    sums = durable(goals.window_sums(m, goals.refit_schedule(m)), "goal-sums")
    fits = durable(goals.fit_all(sums), "goal-strengths")
    found = goals.stationarity(sums, fits)
    return found.select("competition_id", "refit", "teams", "matches", (F.col("residual") < 1e-6).alias("optimal"))


@query(
    "goal_model_window_sums",
    f"""{WITH_CONTESTS}, RECURSIVE_DAYS AS (SELECT DISTINCT competition_id, date FROM contests),
    firsts AS (SELECT competition_id, min(date) AS r FROM contests GROUP BY 1),
    last AS (SELECT max(date) AS e FROM contests),
    refits AS (SELECT * FROM (WITH RECURSIVE s AS (
        SELECT competition_id, r FROM firsts
        UNION ALL SELECT s.competition_id, (SELECT min(d.date) FROM RECURSIVE_DAYS d
          WHERE d.competition_id = s.competition_id AND d.date >= s.r + 60) FROM s
        WHERE s.r IS NOT NULL) SELECT * FROM s WHERE r IS NOT NULL) AS q)
    SELECT c.competition_id, CAST(f.r - DATE '1970-01-01' AS INTEGER) AS refit,
      c.home_team_id AS home, c.away_team_id AS away, count(*) AS matches,
      round(sum(exp(-0.002 * (f.r - c.date))), 6) AS n,
      round(sum(home_goals * exp(-0.002 * (f.r - c.date))), 6) AS hg,
      round(sum(CASE WHEN home_goals = 0 AND away_goals = 1 THEN exp(-0.002 * (f.r - c.date))
        ELSE 0 END), 6) AS n01
    FROM contests c JOIN refits f ON f.competition_id = c.competition_id AND c.date < f.r
      AND c.date >= f.r - 1095 GROUP BY 1, 2, 3, 4""",
)
def goal_model_window_sums(spark, sf_dir):
    """What each refit sees: the weighted sums its likelihood depends on."""
    m = contests(spark, sf_dir)
    sums = goals.window_sums(m, goals.refit_schedule(m))
    return tidy(
        sums.select("competition_id", "refit", "home", "away", "matches", "n", "hg", "n01")
    )


@query(
    "ratings_table",
    f"""SELECT e.*, rated, TRUE AS sound FROM ({rating_sql.RATINGS}) AS e
    JOIN ({GOAL_FITS} SELECT * FROM covered) AS g USING (match_id)""",
)
def ratings_table(spark, sf_dir):
    """Both rating models beside each other: the Elo columns, and where the goal model speaks."""
    rated = builds.ratings(contests(spark, sf_dir))
    return tidy(rated.select(KEY, *ELO_COLUMNS, *_sound_goals(rated)))


_UPCOMING_SINCE = "2001-06-01"


@query(
    "upcoming_design_rows",
    f"""{WITH_CONTESTS},
    sides AS (SELECT home_team_id AS team FROM contests WHERE date < DATE '{_UPCOMING_SINCE}'
      UNION ALL SELECT away_team_id FROM contests WHERE date < DATE '{_UPCOMING_SINCE}'),
    counted AS (SELECT team, count(*) AS n FROM sides GROUP BY 1),
    met AS (SELECT least(home_team_id, away_team_id) AS a, greatest(home_team_id, away_team_id) AS b, date FROM contests)
    SELECT match_id, competition_id, season, date, home_team, away_team,
      CAST(coalesce(h.n, 0) AS INTEGER) AS elo_home_played, CAST(coalesce(a.n, 0) AS INTEGER) AS elo_away_played,
      CAST((SELECT count(*) FROM met WHERE a = least(home_team_id, away_team_id)
        AND b = greatest(home_team_id, away_team_id) AND met.date < c.date) AS SMALLINT) AS h2h_matches
    FROM contests c LEFT JOIN counted h ON h.team = home_team_id LEFT JOIN counted a ON a.team = away_team_id
    WHERE date >= DATE '{_UPCOMING_SINCE}'""",
)
def upcoming_design_rows(spark, sf_dir):
    """Design rows of contests that have not been played, from the whole history."""
    played, upcoming = split_upcoming(contests(spark, sf_dir), _UPCOMING_SINCE)
    rows = builds.upcoming_rows(played, upcoming)
    return rows.select(
        KEY, "competition_id", "season", "date", "home_team", "away_team", "elo_home_played", "elo_away_played",
        "h2h_matches",
    )


# ---- probes ----------------------------------------------------------------------


def _team_history(df):
    return builds.features(df, ["team_history"])


def _h2h(df):
    return builds.features(df, ["head_to_head"])


def _elo(df):
    return elo.rate(df)


_ZERO_FEATURES = ", ".join(f"('{f.name}')" for f in FEATURES)


@query(
    "probe_prefix_invariance_features",
    f"SELECT col0 AS \"column\", CAST(0 AS BIGINT) AS moved FROM (VALUES {_ZERO_FEATURES}) AS v(col0)",
)
def probe_prefix_invariance_features(spark, sf_dir):
    """Cutting off the future moves no feature of an earlier row."""
    m = contests(spark, sf_dir)
    found = probes.prefix_invariance(builds.features, durable(m, "contests"))
    return found.groupBy("column").agg(F.sum("moved").alias("moved"))


@query(
    "probe_outcome_independence_features",
    f"SELECT col0 AS \"column\", CAST(0 AS BIGINT) AS moved FROM (VALUES {_ZERO_FEATURES}) AS v(col0)",
)
def probe_outcome_independence_features(spark, sf_dir):
    m = durable(contests(spark, sf_dir), "contests")
    found = probes.outcome_independence(builds.features, m)
    return found.groupBy("column").agg(F.sum("moved").alias("moved"))


@query(
    "probe_planted_leak",
    "SELECT 'whole_table_mean' AS \"column\", TRUE AS caught UNION ALL SELECT 'own_points', TRUE",
)
def probe_planted_leak(spark, sf_dir):
    """Two planted leaks: each is blind to one probe and caught by the other."""
    m = durable(contests(spark, sf_dir), "contests")

    def mean(df):
        total = df.select(F.avg("home_goals")).scalar()
        return df.select(KEY, total.alias("whole_table_mean"))

    def own(df):
        return df.select(KEY, points(F.col("home_goals"), F.col("away_goals")).alias("own_points"))

    found = probes.prefix_invariance(mean, m).select("column", "moved").unionByName(
        probes.outcome_independence(own, m).select("column", "moved")
    )
    return found.groupBy("column").agg((F.sum("moved") > 0).alias("caught"))


# What a rewrite within one competition must move, column by column.
_WHO_WHEN = ("away_team_id", "date", "home_team_id")
_SCORE = ("away_goals", "home_goals")


def _moved_by(column: str) -> tuple[str, ...]:
    if column in ELO_COLUMNS:
        return _WHO_WHEN if column.endswith("_played") else tuple(sorted((*_WHO_WHEN, *_SCORE, "season")))
    if column in GOAL_COLUMNS:
        return tuple(sorted((*_WHO_WHEN, *_SCORE)))
    reads = next(f.reads for f in FEATURES if f.name == column) - {KEY}
    if "_venue_" in column:  # a side's record at its own venue
        reads -= {"away_team_id" if column.startswith("home") else "home_team_id"}
    return tuple(sorted(reads))


_ELO_READS = ", ".join(f"('{i}', '{c}')" for c in ELO_COLUMNS for i in _moved_by(c))


@query(
    "probe_observed_reads_elo",
    f'SELECT col0 AS input, col1 AS "column" FROM (VALUES {_ELO_READS}) AS v(col0, col1)',
)
def probe_observed_reads_elo(spark, sf_dir):
    """Every column rewritten in turn: which of them the ratings of one competition move with."""
    m = durable(probes.sample_competition(contests(spark, sf_dir)), "sample")
    return probes.observed_reads(_elo, m, m.columns)


@query(
    "probe_split_boundaries",
    f"""{WITH_CONTESTS}, e AS (SELECT max(date) + 1 AS e FROM contests),
    f AS (SELECT CAST(i AS INTEGER) AS fold, e - CAST(365 * (5 - i) AS INTEGER) AS s FROM e,
      range(5) r(i))
    SELECT fold, (SELECT max(date) FROM contests c WHERE c.date < f.s) AS last_train,
      (SELECT min(date) FROM contests c WHERE c.date >= f.s) AS first_evaluate,
      CAST(0 AS BIGINT) AS shared, TRUE AS ok FROM f""",
)
def probe_split_boundaries(spark, sf_dir):
    m = contests(spark, sf_dir)
    parts = [
        probes.split_boundary(f.train(m), f.evaluate(m)).select(F.lit(f.index).alias("fold"), "*")
        for f in folds.walk_forward(m)
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _producers():
    """The four producers, each with its outputs' declared reads."""
    declared = {f.name: f.reads for f in FEATURES}
    h2h = {n: r for n, r in declared.items() if n.startswith("h2h")}
    return {
        "team_history": (_team_history, {n: r for n, r in declared.items() if n not in h2h}),
        "head_to_head": (_h2h, h2h),
        "elo": (_elo, {c: RATING_READS[c] for c in ELO_COLUMNS}),
        "goals": (goals.rate, {c: RATING_READS[c] for c in GOAL_COLUMNS}),
    }


def _audited():
    for name, (_, outputs) in _producers().items():
        for column, reads in outputs.items():
            seen = _moved_by(column)
            yield name, column, *(
                ",".join(sorted(part)) for part in (seen, reads, POST_MATCH & set(seen), set(seen) - reads)
            )


_AUDIT_ROWS = ", ".join(f"({', '.join(repr(v) for v in row)})" for row in _audited())


@query(
    "leakage_audit",
    f"""SELECT producer, "column", observed, declared, post_match, understated, FALSE AS benchmark_leak
    FROM (VALUES {_AUDIT_ROWS}) AS v(producer, "column", observed, declared, post_match, understated)""",
)
def leakage_audit(spark, sf_dir):
    """Observed against declared reads of every derived column, on one competition's rows."""
    m = durable(probes.sample_competition(contests(spark, sf_dir)), "sample")
    found = probes.audit(_producers(), m, m.columns, {"goals": 1e-6})
    lists = ("observed", "declared", "post_match", "understated")
    return found.withColumns({c: F.array_join(F.array_sort(c), ",") for c in lists})


@query(
    "systematic_sample",
    f"""{WITH_CONTESTS}, t AS (SELECT greatest(CAST(ceil(count(*) / 1000.0) AS BIGINT), 1) AS step FROM contests)
    SELECT match_id, date FROM contests, t
    WHERE CAST('0x' || substr(md5(match_id), 1, 15) AS BIGINT) % step = 0""",
)
def systematic_sample(spark, sf_dir):
    m = contests(spark, sf_dir)
    return history.systematic_sample(m, 1000, m.count()).select(KEY, "date")


@query(
    "verification_sample",
    f"""{WITH_CONTESTS}, s AS (SELECT competition_id FROM contests GROUP BY 1
      ORDER BY abs(count(*) - 4000), 1 LIMIT 1)
    SELECT match_id, competition_id FROM contests JOIN s USING (competition_id)""",
)
def verification_sample(spark, sf_dir):
    return probes.sample_competition(contests(spark, sf_dir)).select(KEY, "competition_id")
