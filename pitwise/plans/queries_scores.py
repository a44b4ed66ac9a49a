"""Registered queries: forecasts, scores, reliability, market, archive, quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitwise.functions import scoring as S
from pitwise.operators import archive, calibrate, quality
from pitwise.operators import evaluate as EV
from pitwise.operators import folds as FD
from pitwise.operators.quantiles import exact_quantile
from pitwise.plans import builds, reports
from pitwise.plans.contests import WITH_CONTESTS, contests, table
from pitwise.plans.queries_features import GOAL_FITS
from pitwise.plans.queries_scan import contest_registry
from pitwise.plans.registry import query, tidy
from pitwise.schema import CORE_COLUMNS, KEY, MATCH_SCHEMA, ODDS_COLUMNS, PROBS, TARGET
from pitwise.session import durable, scratch_path
from pitwise.sources import tables

FORECASTERS = ("home_always", "class_prior", "bookmaker")

_FOLDS = f"""{WITH_CONTESTS}, e AS (SELECT max(date) + 1 AS e FROM contests),
cuts AS (SELECT CAST(i AS INTEGER) AS fold, e - CAST(365 * (5 - i) AS INTEGER) AS s,
  e - CAST(365 * (4 - i) AS INTEGER) AS t FROM e, range(5) r(i)),
sized AS (SELECT fold, s, t, count(*) FILTER (date < s) AS train,
  count(*) FILTER (date >= s AND date < t) AS evaluate FROM cuts, contests GROUP BY ALL),
folds AS (SELECT * FROM sized WHERE train >= 380 AND evaluate > 0)"""

_FORECASTS = f"""{_FOLDS},
ev AS (SELECT c.*, f.fold, f.s FROM contests c JOIN folds f ON c.date >= f.s AND c.date < f.t),
priors AS (SELECT f.fold, count(*) FILTER (result = 'H') / count(*) AS h,
  count(*) FILTER (result = 'D') / count(*) AS d, count(*) FILTER (result = 'A') / count(*) AS a
  FROM folds f JOIN contests c ON c.date < f.s GROUP BY f.fold),
fc AS (
  SELECT fold, match_id, competition_id, result, 'home_always' AS forecaster,
    CAST(1 AS DOUBLE) AS ph, CAST(0 AS DOUBLE) AS pd, CAST(0 AS DOUBLE) AS pa FROM ev
  UNION ALL SELECT ev.fold, match_id, competition_id, result, 'class_prior', h, d, a
    FROM ev JOIN priors USING (fold)
  UNION ALL SELECT fold, match_id, competition_id, result, 'bookmaker',
    CASE WHEN least(odds_home, odds_draw, odds_away) > 1 THEN (1 / odds_home) /
      (1 / odds_home + 1 / odds_draw + 1 / odds_away) END,
    CASE WHEN least(odds_home, odds_draw, odds_away) > 1 THEN (1 / odds_draw) /
      (1 / odds_home + 1 / odds_draw + 1 / odds_away) END,
    CASE WHEN least(odds_home, odds_draw, odds_away) > 1 THEN (1 / odds_away) /
      (1 / odds_home + 1 / odds_draw + 1 / odds_away) END FROM ev),
terms AS (SELECT *, CASE result WHEN 'H' THEN ph WHEN 'D' THEN pd ELSE pa END AS p,
    count(ph) OVER (PARTITION BY match_id) = 3 AS common FROM fc),
scored AS (SELECT *, CASE WHEN p = 0 THEN CAST('Infinity' AS DOUBLE) ELSE -ln(p) END AS ll,
    (pow(ph - CASE WHEN result = 'H' THEN 1 ELSE 0 END, 2)
     + pow(ph + pd - CASE WHEN result IN ('H', 'D') THEN 1 ELSE 0 END, 2)) / 2 AS rps,
    CASE WHEN result = CASE WHEN ph >= pd AND ph >= pa THEN 'H' WHEN pd >= pa THEN 'D' ELSE 'A' END
      THEN 1.0 ELSE 0.0 END AS hit
  FROM terms WHERE ph IS NOT NULL)"""

_SCORES = f"""{_FORECASTS},
subsets AS (SELECT *, 'priced' AS subset FROM scored
  UNION ALL SELECT *, 'common' FROM scored WHERE common),
score AS (SELECT fold, CASE WHEN grouping(competition_id) = 1 THEN 'ALL' ELSE competition_id END
    AS competition_id, forecaster, subset, count(*) AS n, avg(ll) AS log_loss, avg(rps) AS rps,
    avg(hit) AS accuracy FROM subsets
  GROUP BY GROUPING SETS ((fold, competition_id, forecaster, subset), (fold, forecaster, subset)))"""


def _wide(spark, sf_dir):
    m = contests(spark, sf_dir)
    return EV.baselines(m, FD.walk_forward(m))


def _long(spark, sf_dir):
    return EV.to_long(_wide(spark, sf_dir))


def _scores(spark, sf_dir):
    return EV.score_table(EV.scored_terms(_wide(spark, sf_dir)))


@query(
    "fold_boundaries",
    f"{_FOLDS} SELECT fold, s AS start, t AS \"end\", train, evaluate FROM folds",
)
def fold_boundaries(spark, sf_dir):
    m = contests(spark, sf_dir)
    return FD.fold_sizes(m, FD.walk_forward(m))


@query(
    "fold_class_priors",
    f"""{_FORECASTS} SELECT fold, round(h, 6) AS prior_home, round(d, 6) AS prior_draw,
      round(a, 6) AS prior_away FROM priors""",
)
def fold_class_priors(spark, sf_dir):
    m = contests(spark, sf_dir)
    return tidy(FD.class_priors(m, FD.walk_forward(m)))


@query(
    "tuning_slice_rows",
    f"""{_FOLDS} SELECT match_id, date FROM contests WHERE date < (SELECT min(s) FROM folds)""",
)
def tuning_slice_rows(spark, sf_dir):
    m = contests(spark, sf_dir)
    return FD.tuning_slice(m, FD.walk_forward(m)).select(KEY, "date")


@query(
    "baseline_forecasts",
    f"""{_FORECASTS} SELECT fold, match_id, competition_id, result, forecaster,
      round(ph, 6) AS prob_home, round(pd, 6) AS prob_draw, round(pa, 6) AS prob_away FROM fc""",
)
def baseline_forecasts(spark, sf_dir):
    return tidy(_long(spark, sf_dir))


@query(
    "forecast_terms",
    f"""{_FORECASTS} SELECT fold, match_id, forecaster, common, round(ll, 6) + 0.0 AS log_loss,
      round(rps, 6) AS rps, CAST(hit AS DOUBLE) AS hit FROM scored""",
)
def forecast_terms(spark, sf_dir):
    terms = EV.scored_terms(_wide(spark, sf_dir))
    return tidy(terms.select("fold", KEY, "forecaster", "common", "log_loss", "rps", "hit"))


@query(
    "backtest_scores",
    f"""{_SCORES} SELECT CAST(fold AS SMALLINT) AS fold, competition_id, forecaster, subset,
      CAST(n AS INTEGER) AS n, round(log_loss, 6) AS log_loss, round(rps, 6) AS rps,
      round(accuracy, 6) AS accuracy FROM score""",
)
def backtest_scores(spark, sf_dir):
    """Both subsets at both grains, from one reduction of the contests."""
    return tidy(_scores(spark, sf_dir))


@query(
    "backtest_scores_from_long",
    f"""{_SCORES} SELECT CAST(fold AS SMALLINT) AS fold, competition_id, forecaster, subset,
      CAST(n AS INTEGER) AS n, round(log_loss, 6) AS log_loss, round(rps, 6) AS rps,
      round(accuracy, 6) AS accuracy FROM score""",
)
def backtest_scores_from_long(spark, sf_dir):
    long = _long(spark, sf_dir).filter(S.is_priced(PROBS))
    return tidy(EV.score_table(EV.scored_terms(EV.to_wide(long), len(FORECASTERS))))


@query(
    "backtest_pooled",
    f"""{_SCORES} SELECT forecaster, CAST(sum(n) AS BIGINT) AS n,
      round(sum(n * log_loss) / sum(n), 6) AS log_loss, round(sum(n * rps) / sum(n), 6) AS rps,
      round(sum(n * accuracy) / sum(n), 6) AS accuracy FROM score
    WHERE competition_id = 'ALL' AND subset = 'common' GROUP BY forecaster""",
)
def backtest_pooled(spark, sf_dir):
    return tidy(EV.pooled_table(_scores(spark, sf_dir)))


@query(
    "backtest_per_competition",
    f"""{_SCORES}, w AS (SELECT competition_id, forecaster, sum(n) AS n,
      sum(n * rps) / sum(n) AS v FROM score WHERE competition_id <> 'ALL' AND subset = 'common'
      GROUP BY 1, 2)
    SELECT competition_id, CAST(max(n) AS BIGINT) AS n,
      round(max(v) FILTER (forecaster = 'home_always'), 6) AS home_always,
      round(max(v) FILTER (forecaster = 'class_prior'), 6) AS class_prior,
      round(max(v) FILTER (forecaster = 'bookmaker'), 6) AS bookmaker FROM w GROUP BY 1""",
)
def backtest_per_competition(spark, sf_dir):
    return tidy(EV.per_competition_table(_scores(spark, sf_dir), FORECASTERS, metric="rps"))


@query(
    "forecaster_coverage",
    f"""{_SCORES} SELECT forecaster, round(sum(n) / (SELECT count(*) FROM ev), 6) AS coverage
    FROM score WHERE competition_id = 'ALL' AND subset = 'priced' GROUP BY forecaster""",
)
def forecaster_coverage(spark, sf_dir):
    m = contests(spark, sf_dir)
    folds = FD.walk_forward(m)
    total = FD.evaluation_rows(m, folds).select(F.count(F.lit(1))).scalar()
    scores = EV.score_table(EV.scored_terms(EV.baselines(m, folds)))
    return tidy(EV.coverage(scores, total))


@query(
    "finite_scores_only",
    f"""{_SCORES} SELECT forecaster, subset, count(*) AS rows FROM score
    WHERE log_loss < CAST('Infinity' AS DOUBLE) GROUP BY 1, 2""",
)
def finite_scores_only(spark, sf_dir):
    return EV.finite_only(_scores(spark, sf_dir)).groupBy("forecaster", "subset").agg(
        F.count(F.lit(1)).alias("rows")
    )


@query(
    "forecast_selection",
    f"""{_FORECASTS} SELECT match_id, round(ph, 6) AS prob_home FROM fc
    WHERE forecaster = 'bookmaker' AND competition_id = 'URG_1' AND fold = 3 AND ph IS NOT NULL""",
)
def forecast_selection(spark, sf_dir):
    return tidy(
        EV.select_forecasts(_long(spark, sf_dir), "bookmaker", "URG_1", 3).select(KEY, "prob_home")
    )


@query(
    "rejected_forecasts",
    f"""{_FORECASTS} SELECT forecaster, 'unpriced' AS reason, count(*) AS rows FROM fc
    WHERE ph IS NULL GROUP BY forecaster""",
)
def rejected_forecasts(spark, sf_dir):
    return EV.rejected(_long(spark, sf_dir)).groupBy("forecaster", "reason").agg(
        F.count(F.lit(1)).alias("rows")
    )


_EDGES = " ".join(f"WHEN stated < {e!r} THEN {i}" for i, e in enumerate(S.bin_edges(10)[1:-1]))
_RELIABILITY = f"""{_FORECASTS},
said AS (SELECT forecaster, competition_id, 'H' AS class, ph AS stated,
    CASE WHEN result = 'H' THEN 1.0 ELSE 0.0 END AS happened FROM fc WHERE ph IS NOT NULL
  UNION ALL SELECT forecaster, competition_id, 'D', pd, CASE WHEN result = 'D' THEN 1.0 ELSE 0.0 END
    FROM fc WHERE ph IS NOT NULL
  UNION ALL SELECT forecaster, competition_id, 'A', pa, CASE WHEN result = 'A' THEN 1.0 ELSE 0.0 END
    FROM fc WHERE ph IS NOT NULL),
binned AS (SELECT *, CAST(CASE {_EDGES} ELSE 9 END AS INTEGER) AS bin FROM said)"""


def _bins(keys):
    lead = "".join(f"{k}, " for k in keys)
    return f"""SELECT {lead}bin, count(*) AS n, avg(stated) AS predicted, avg(happened) AS observed,
      avg(happened) - avg(stated) AS gap FROM binned WHERE forecaster = 'bookmaker'
      GROUP BY {lead}bin"""


_ROUNDED = """bin, n, round(predicted, 6) AS predicted, round(observed, 6) AS observed,
  round(gap, 6) + 0.0 AS gap"""
_DROP = ("lower", "upper")


def _bookmaker(spark, sf_dir):
    return _long(spark, sf_dir).filter("forecaster = 'bookmaker'")


@query(
    "reliability_table",
    f"""{_RELIABILITY} SELECT {_ROUNDED}, round(bin * 0.1, 6) AS lower,
      round((bin + 1) * 0.1, 6) AS upper FROM ({_bins([])}) AS b""".replace(
        "round(bin * 0.1, 6)", "round(CAST(bin AS DOUBLE) / 10, 6)"
    ).replace("round((bin + 1) * 0.1, 6)", "round(CAST(bin + 1 AS DOUBLE) / 10, 6)"),
)
def reliability_table(spark, sf_dir):
    return tidy(EV.reliability(_bookmaker(spark, sf_dir)))


@query(
    "reliability_by_class",
    f"{_RELIABILITY} SELECT class, {_ROUNDED} FROM ({_bins(['class'])}) AS b",
)
def reliability_by_class(spark, sf_dir):
    return tidy(EV.reliability(_bookmaker(spark, sf_dir), by=["class"]).drop(*_DROP))


@query(
    "reliability_draws_only",
    f"""{_RELIABILITY} SELECT {_ROUNDED} FROM ({_bins(['class'])}) AS b WHERE class = 'D'""",
)
def reliability_draws_only(spark, sf_dir):
    return tidy(EV.reliability(_bookmaker(spark, sf_dir), classes=["D"]).drop(*_DROP))


@query(
    "reliability_per_forecaster",
    f"""{_RELIABILITY} SELECT forecaster, bin, count(*) AS n, round(avg(stated), 6) AS predicted,
      round(avg(happened), 6) AS observed, round(avg(happened) - avg(stated), 6) + 0.0 AS gap
    FROM binned GROUP BY forecaster, bin""",
)
def reliability_per_forecaster(spark, sf_dir):
    return tidy(EV.reliability(_long(spark, sf_dir), by=["forecaster"]).drop(*_DROP))


@query(
    "calibration_error",
    f"""{_RELIABILITY} SELECT CAST(sum(n) AS BIGINT) AS n,
      round(sum(n * abs(gap)) / sum(n), 6) AS calibration_error FROM ({_bins([])}) AS b""",
)
def calibration_error(spark, sf_dir):
    return tidy(EV.calibration_error(EV.reliability(_bookmaker(spark, sf_dir))))


@query(
    "reliability_by_competition",
    f"""{_RELIABILITY} SELECT competition_id, CAST(sum(n) / 3 AS BIGINT) AS matches,
      round(sum(n * abs(gap)) / sum(n), 6) AS calibration_error
    FROM ({_bins(['competition_id'])}) AS b GROUP BY competition_id HAVING sum(n) / 3 >= 200""",
)
def reliability_by_competition(spark, sf_dir):
    return tidy(EV.reliability_by_competition(_bookmaker(spark, sf_dir)))


@query(
    "worst_competitions",
    f"""{_RELIABILITY} SELECT competition_id, CAST(sum(n) / 3 AS BIGINT) AS matches,
      round(sum(n * abs(gap)) / sum(n), 6) AS calibration_error
    FROM ({_bins(['competition_id'])}) AS b GROUP BY competition_id HAVING sum(n) / 3 >= 200
    ORDER BY sum(n * abs(gap)) / sum(n) DESC LIMIT 5""",
)
def worst_competitions(spark, sf_dir):
    return tidy(EV.worst_competitions(_bookmaker(spark, sf_dir)))


_CLOSED = " ".join(
    f"WHEN ph <= {e!r} THEN {i}" for i, e in enumerate(S.bin_edges(10)[1:])
)


@query(
    "reliability_bin_lookup",
    f"""{_RELIABILITY}, t AS ({_bins([])}),
    asked AS (SELECT match_id, ph, CAST(CASE {_CLOSED} END AS INTEGER) AS bin FROM fc
      WHERE forecaster = 'bookmaker' AND ph IS NOT NULL)
    SELECT match_id, asked.bin, t.n, round(t.observed, 6) AS observed FROM asked LEFT JOIN t
      ON t.bin = asked.bin""",
)
def reliability_bin_lookup(spark, sf_dir):
    rows = _bookmaker(spark, sf_dir)
    table_ = EV.reliability(rows)
    asked = rows.filter("prob_home IS NOT NULL").select(KEY, F.col("prob_home").alias("stated"))
    return tidy(EV.bin_lookup(asked, table_).select(KEY, "bin", "n", "observed"))


@query(
    "error_correlations",
    f"""{_FORECASTS}, wide AS (SELECT match_id, max(ll) FILTER (forecaster = 'class_prior') AS cp,
      max(ll) FILTER (forecaster = 'bookmaker') AS b FROM scored WHERE common GROUP BY match_id)
    SELECT 'class_prior' AS one, 'bookmaker' AS other, round(corr(cp, b), 6) AS correlation
    FROM wide""",
)
def error_correlations(spark, sf_dir):
    terms = EV.scored_terms(_wide(spark, sf_dir))
    return tidy(EV.error_correlations(terms, ["class_prior", "bookmaker"]))


@query(
    "forecaster_ranking",
    f"""{_FORECASTS} SELECT forecaster, round(avg(ll), 6) AS log_loss FROM scored
    GROUP BY forecaster""",
)
def forecaster_ranking(spark, sf_dir):
    return tidy(EV.rank_forecasters(EV.scored_terms(_wide(spark, sf_dir))))


# ---- scalar functions over whole tables ------------------------------------------


@query(
    "market_probabilities",
    f"""{WITH_CONTESTS}, x AS (SELECT *, 1 / odds_home + 1 / odds_draw + 1 / odds_away AS book,
      least(odds_home, odds_draw, odds_away) > 1 AS ok FROM contests)
    SELECT match_id, round(CASE WHEN ok THEN (1 / odds_home) / book END, 6) AS prob_home,
      round(CASE WHEN ok THEN (1 / odds_draw) / book END, 6) AS prob_draw,
      round(CASE WHEN ok THEN (1 / odds_away) / book END, 6) AS prob_away,
      round(CASE WHEN ok THEN book - 1 END, 6) + 0.0 AS margin FROM x""",
)
def market_probabilities(spark, sf_dir):
    m = contests(spark, sf_dir)
    return tidy(
        m.select(
            KEY,
            *[p.alias(c) for p, c in zip(S.implied(ODDS_COLUMNS), PROBS, strict=True)],
            S.margin(ODDS_COLUMNS).alias("margin"),
        )
    )


@query(
    "tempered_and_blended",
    f"""{_FORECASTS}, b AS (SELECT b.match_id, b.result, (b.ph + c.ph) / 2 AS h,
        (b.pd + c.pd) / 2 AS d, (b.pa + c.pa) / 2 AS a
      FROM fc b JOIN fc c ON b.match_id = c.match_id AND b.forecaster = 'bookmaker'
        AND c.forecaster = 'class_prior'),
    t AS (SELECT match_id, pow(h, 1 / 1.3) AS h, pow(d, 1 / 1.3) AS d, pow(a, 1 / 1.3) AS a FROM b)
    SELECT match_id, round(h / (h + d + a), 6) AS prob_home, round(d / (h + d + a), 6) AS prob_draw,
      round(a / (h + d + a), 6) AS prob_away,
      CASE WHEN h IS NULL THEN NULL WHEN h >= d AND h >= a THEN 'H' WHEN d >= a THEN 'D' ELSE 'A' END
        AS modal FROM t""",
)
def tempered_and_blended(spark, sf_dir):
    """Mean of two forecasters, rescaled by a temperature, with its likeliest class."""
    wide = _wide(spark, sf_dir)

    def probs(name):
        entry = F.filter("forecasts", lambda f: f["forecaster"] == name)[0]
        return [entry[p] for p in PROBS]

    blend = wide.select(
        KEY,
        *[
            b.alias(p)
            for b, p in zip(S.blend([probs("bookmaker"), probs("class_prior")]), PROBS, strict=True)
        ],
    )
    out = blend.select(
        KEY, *[t.alias(p) for t, p in zip(S.temper(PROBS, 1.3), PROBS, strict=True)]
    )
    return tidy(out.withColumn("modal", S.confidence(PROBS)["outcome"]))


@query(
    "elo_formula",
    f"""{WITH_CONTESTS}, x AS (SELECT match_id, 1400.0 + home_goals * 50 AS rh,
        1400.0 + away_goals * 60 AS ra, abs(home_goals - away_goals) AS gd FROM contests)
    SELECT match_id, round(1 / (1 + pow(10, -(rh + 80 - ra) / 400)), 6) AS expected,
      round(CASE WHEN gd <= 1 THEN 1.0 WHEN gd = 2 THEN 1.5 ELSE (11 + gd) / 8 END
        * 2.2 / (0.001 * (rh + 80 - ra) + 2.2), 6) AS weight FROM x""",
)
def elo_formula(spark, sf_dir):
    home = F.lit(1400.0) + F.col("home_goals") * 50
    away = F.lit(1400.0) + F.col("away_goals") * 60
    gap = F.abs(F.col("home_goals") - F.col("away_goals"))
    return tidy(
        contests(spark, sf_dir).select(
            KEY,
            S.expected_score(home, away).alias("expected"),
            S.margin_multiplier(gap, home + 80.0 - away).alias("weight"),
        )
    )


_CELL = """h.p * a.p * CASE WHEN h.g = 0 AND a.g = 0 THEN 1 - l * m * r
  WHEN h.g = 0 AND a.g = 1 THEN 1 + l * r WHEN h.g = 1 AND a.g = 0 THEN 1 + m * r
  WHEN h.g = 1 AND a.g = 1 THEN 1 - r ELSE 1 END"""


@query(
    "score_grid_probabilities",
    f"""WITH rates AS (SELECT DISTINCT 0.4 + p_size / 20.0 AS l, 0.3 + p_retailprice / 1000 AS m,
        -0.05 AS r FROM part),
    g AS (SELECT CAST(i AS INTEGER) AS g FROM range(11) t(i)),
    h AS (SELECT l, m, r, g, exp(g * ln(l) - l) / gamma(g + 1.0) AS p FROM rates, g),
    a AS (SELECT l, m, r, g, exp(g * ln(m) - m) / gamma(g + 1.0) AS p FROM rates, g),
    cells AS (SELECT h.l, h.m, h.g AS hg, a.g AS ag,
        greatest({_CELL.replace('l *', 'h.l *').replace('* l', '* h.l').replace('m *', 'h.m *').replace('* m', '* h.m').replace('* r', '* h.r').replace('1 - r', '1 - h.r')}, 0) AS c
      FROM h JOIN a ON h.l = a.l AND h.m = a.m)
    SELECT round(l, 6) AS l, round(m, 6) AS m,
      round(sum(c) FILTER (hg > ag) / sum(c), 6) AS home,
      round(sum(c) FILTER (hg = ag) / sum(c), 6) AS draw FROM cells GROUP BY cells.l, cells.m""",
)
def score_grid_probabilities(spark, sf_dir):
    """Outcome probabilities from goal rates, against the plain 11 x 11 grid."""
    rates = table(spark, sf_dir, "part").select(
        (F.lit(0.4) + F.col("p_size") / 20.0).alias("l"),
        (F.lit(0.3) + F.col("p_retailprice") / 1000).alias("m"),
    ).distinct()
    p = S.score_grid(F.col("l"), F.col("m"), F.lit(-0.05))
    return tidy(
        rates.withColumn("p", p).select("l", "m", F.col("p.home").alias("home"),
                                        F.col("p.draw").alias("draw"))
    )


# ---- market and archive ----------------------------------------------------------


@query(
    "market_disagreement",
    f"""{_FORECASTS}, x AS (SELECT c.ph, c.ll AS model, b.ll AS market,
        (abs(c.ph - b.ph) + abs(c.pd - b.pd) + abs(c.pa - b.pa)) / 2 AS gap
      FROM scored c JOIN scored b ON c.match_id = b.match_id AND c.forecaster = 'class_prior'
        AND b.forecaster = 'bookmaker')
    SELECT CASE WHEN gap <= 0.02 THEN '<2%' WHEN gap <= 0.05 THEN '2-5%' WHEN gap <= 0.1 THEN '5-10%'
        WHEN gap <= 0.2 THEN '10-20%' ELSE '>20%' END AS band, count(*) AS n,
      round(avg(model), 6) AS model, round(avg(market), 6) AS market,
      round(avg(model) - avg(market), 6) + 0.0 AS model_minus_market,
      round(avg(CASE WHEN model < market THEN 1.0 ELSE 0.0 END), 6) AS model_better
    FROM x GROUP BY 1""",
)
def market_disagreement(spark, sf_dir):
    m = contests(spark, sf_dir)
    return tidy(reports.market_report(_long(spark, sf_dir), m, "class_prior"))


_LOG = f"""{_FORECASTS}, raw AS (SELECT match_id, CAST(substr(match_id, 2, 12) AS BIGINT) AS k, ph, pd,
    pa, forecaster AS model, CAST(fold AS VARCHAR) AS model_version FROM fc
    WHERE forecaster <> 'home_always' AND ph IS NOT NULL),
  log AS (SELECT *, TIMESTAMP '2024-01-01' + k * INTERVAL 1 MINUTE AS predicted_at, k * 2 AS id,
      k % 7 = 0 AS in_sample FROM raw
    UNION ALL SELECT match_id, k, pa, pd, ph, model, model_version,
      TIMESTAMP '2023-01-01' + k * INTERVAL 1 MINUTE, k * 2 + 1, k % 7 = 0 FROM raw WHERE k % 3 = 0),
  newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY match_id, model, model_version
      ORDER BY predicted_at DESC, id DESC) AS rn FROM log) AS r WHERE rn = 1),
  outcomes AS (SELECT match_id, result FROM contests
    WHERE CAST(substr(match_id, 2, 12) AS BIGINT) % 5 <> 0),
  joined AS (SELECT n.*, o.result, o.result IS NOT NULL AND NOT in_sample AS scorable
    FROM newest n LEFT JOIN outcomes o USING (match_id)),
  spread AS (SELECT stddev_samp(ll) AS s FROM scored WHERE forecaster = 'bookmaker')"""


def _log(spark, sf_dir):
    """A forecast log: every forecast once, a third of them twice with an older row."""
    raw = _long(spark, sf_dir).filter(
        (F.col("forecaster") != "home_always") & F.col("prob_home").isNotNull()
    ).withColumn("k", F.substring(KEY, 2, 12).cast("long"))

    def rows(df, start, odd, probs):
        return df.select(
            KEY,
            F.col("forecaster").alias("model"),
            F.col("fold").cast("string").alias("model_version"),
            *[F.col(a).alias(b) for a, b in zip(probs, PROBS, strict=True)],
            (F.lit(start).cast("timestamp") + F.make_dt_interval(mins=F.col("k").cast("int"))).alias(
                "predicted_at"
            ),
            (F.col("k") * 2 + odd).alias("id"),
            (F.col("k") % 7 == 0).alias("in_sample"),
        )

    return rows(raw, "2024-01-01", 0, PROBS).unionByName(
        rows(raw.filter("k % 3 = 0"), "2023-01-01", 1, PROBS[::-1])
    )


def _outcomes(spark, sf_dir):
    return contests(spark, sf_dir).filter(F.substring(KEY, 2, 12).cast("long") % 5 != 0)


@query(
    "archive_latest",
    f"""{_LOG} SELECT match_id, model, model_version, round(ph, 6) AS prob_home, predicted_at
    FROM newest""",
)
def archive_latest(spark, sf_dir):
    return tidy(
        archive.latest(_log(spark, sf_dir)).select(
            KEY, "model", "model_version", "prob_home", "predicted_at"
        )
    )


@query(
    "archive_drift_report",
    f"""{_LOG} SELECT model, model_version, count(*) AS logged,
      count(*) FILTER (in_sample) AS in_sample, count(*) FILTER (result IS NULL) AS unresolved,
      count(*) FILTER (scorable) AS n,
      round(avg(l) FILTER (scorable), 6) AS log_loss,
      round(avg(CASE WHEN result = m THEN 1.0 ELSE 0.0 END) FILTER (scorable), 6) AS accuracy,
      round(any_value(s), 6) AS spread,
      round(avg(l) FILTER (scorable) - 1.05, 6) + 0.0 AS drift,
      round(1.959963984540054 * any_value(s) / sqrt(count(*) FILTER (scorable)), 6) AS detectable,
      abs(avg(l) FILTER (scorable) - 1.05) > 1.959963984540054 * any_value(s)
        / sqrt(count(*) FILTER (scorable)) AS distinguishable,
      min(predicted_at) AS first_served, max(predicted_at) AS last_served
    FROM (SELECT j.*, s, -ln(CASE result WHEN 'H' THEN ph WHEN 'D' THEN pd WHEN 'A' THEN pa END) AS l,
      CASE WHEN ph >= pd AND ph >= pa THEN 'H' WHEN pd >= pa THEN 'D' ELSE 'A' END AS m
      FROM joined j, spread) AS x GROUP BY model, model_version""",
)
def archive_drift_report(spark, sf_dir):
    population = archive.reference_population(_long(spark, sf_dir).na.drop(), "bookmaker")
    spread = population.select("spread").scalar()
    out = archive.summarise(_log(spark, sf_dir), _outcomes(spark, sf_dir), spread, 1.05)
    return tidy(out.drop("rps", "baseline"))


@query(
    "reference_population",
    f"""{_FORECASTS} SELECT count(*) AS n, round(avg(ll), 6) AS log_loss,
      round(stddev_samp(ll), 6) AS spread FROM scored WHERE forecaster = 'bookmaker'""",
)
def reference_population(spark, sf_dir):
    return tidy(archive.reference_population(_long(spark, sf_dir).na.drop(), "bookmaker"))


@query(
    "samples_needed",
    f"""{_FORECASTS}, s AS (SELECT stddev_samp(ll) AS s FROM scored WHERE forecaster = 'bookmaker')
    SELECT CAST(d AS DOUBLE) AS difference,
      CAST(ceil(pow(1.959963984540054 * s / d, 2)) AS BIGINT) AS needed
    FROM s, (VALUES (0.05), (0.0163), (0.01)) AS v(d)""",
)
def samples_needed(spark, sf_dir):
    row = archive.reference_population(_long(spark, sf_dir).na.drop(), "bookmaker").first()
    return archive.horizon(spark, row["spread"], [0.05, 0.0163, 0.01])


def _temperature_sql(rounds: int = 6, steps: int = 16) -> str:
    """Rounds of a grid of temperatures around the best one so far, each a table of its own."""
    parts = [f"""{_FORECASTS},
      mine AS (SELECT forecaster, fold, ph, pd, pa, p FROM scored WHERE forecaster <> 'home_always'),
      s0 AS (SELECT forecaster, fold, count(*) AS n, CAST(0.2 AS DOUBLE) AS lo, CAST(5.0 AS DOUBLE) AS hi,
        CAST(1.0 AS DOUBLE) AS best FROM mine GROUP BY 1, 2)"""]
    for k in range(rounds):
        parts.append(f"""g{k} AS (SELECT forecaster, fold, i, any_value(lo) AS lo, any_value(hi) AS hi,
          avg(-ln(pow(p, 1 / (lo + (hi - lo) * i / {steps}.0::DOUBLE)) /
            (pow(ph, 1 / (lo + (hi - lo) * i / {steps}.0::DOUBLE)) + pow(pd, 1 / (lo + (hi - lo) * i / {steps}.0::DOUBLE))
             + pow(pa, 1 / (lo + (hi - lo) * i / {steps}.0::DOUBLE))))) AS loss
          FROM mine JOIN s{k} USING (forecaster, fold), range({steps + 1}) AS r(i) GROUP BY 1, 2, 3),
        b{k} AS (SELECT forecaster, fold, arg_min(i, (loss, i)) AS i, any_value(lo) AS lo, any_value(hi) AS hi
          FROM g{k} GROUP BY 1, 2),
        s{k + 1} AS (SELECT forecaster, fold, n, b.lo + (b.hi - b.lo) * greatest(i - 1, 0) / {steps}.0::DOUBLE AS lo,
          b.lo + (b.hi - b.lo) * least(i + 1, {steps}) / {steps}.0::DOUBLE AS hi,
          b.lo + (b.hi - b.lo) * i / {steps}.0::DOUBLE AS best FROM b{k} AS b JOIN s0 USING (forecaster, fold))""")
    return ",\n".join(parts) + f""" SELECT forecaster, CAST(fold AS INTEGER) AS fold,
      CASE WHEN n < 380 THEN 1.0 ELSE round(best, 3) END AS temperature, n FROM s{rounds}"""


@query("temperature_per_fold", _temperature_sql())
def temperature_per_fold(spark, sf_dir):
    """Temperature of each forecaster and fold over its evaluated year."""
    rows = durable(_long(spark, sf_dir).filter("forecaster <> 'home_always'"), "forecasts")
    return tidy(calibrate.fit_temperatures(rows, ["forecaster", "fold"]), 3)


@query(
    "calibrated_forecasts",
    f"""{_FORECASTS}, t AS (SELECT match_id, pow(ph, 1 / 1.25) AS h, pow(pd, 1 / 1.25) AS d,
      pow(pa, 1 / 1.25) AS a FROM fc WHERE forecaster = 'bookmaker')
    SELECT match_id, 'bookmaker-calibrated' AS forecaster, round(h / (h + d + a), 6) AS prob_home
    FROM t""",
)
def calibrated_forecasts(spark, sf_dir):
    rows = _bookmaker(spark, sf_dir)
    temps = rows.select("forecaster").distinct().withColumn("temperature", F.lit(1.25))
    out = calibrate.apply_temperatures(rows, temps, ["forecaster"])
    return tidy(out.select(KEY, "forecaster", "prob_home"))


# ---- quality ---------------------------------------------------------------------

_CORE_NULLS = " OR ".join(f"{c} IS NULL" for c in CORE_COLUMNS)


@query(
    "quality_null_profile",
    f"""{WITH_CONTESTS} SELECT 'home_shots' AS "column", count(*) - count(home_shots) AS nulls
      FROM contests
    UNION ALL SELECT 'referee', count(*) - count(referee) FROM contests
    UNION ALL SELECT 'match_id', count(*) - count(match_id) FROM contests
    UNION ALL SELECT 'odds_home', count(*) - count(odds_home) FROM contests""",
)
def quality_null_profile(spark, sf_dir):
    return quality.null_profile(
        contests(spark, sf_dir), ["home_shots", "referee", "match_id", "odds_home"]
    )


def _check_sql(name, value, failed, severity="error", min_rows=0):
    return f"""SELECT '{name}' AS "check", '{severity}' AS severity,
      CASE WHEN (SELECT count(*) FROM contests) < {min_rows} THEN 'skipped'
        WHEN {failed.format(v='v')} THEN 'failed' ELSE 'passed' END AS outcome,
      round(CAST(v AS DOUBLE), 6) AS value FROM (SELECT {value} AS v FROM contests) AS q"""


_BOOK = "1 / odds_home + 1 / odds_draw + 1 / odds_away"
_ROW_CHECKS = " UNION ALL ".join(
    [
        _check_sql("core_not_null", f"count(*) FILTER ({_CORE_NULLS})", "{v} > 0"),
        _check_sql(
            "no_self_play", "count(*) FILTER (home_team_id = away_team_id)", "{v} > 0"
        ),
        _check_sql(
            "result_matches_score",
            "count(*) FILTER (result <> CASE WHEN home_goals > away_goals THEN 'H' "
            "WHEN home_goals < away_goals THEN 'A' ELSE 'D' END)",
            "{v} > 0",
        ),
        _check_sql(
            "result_domain",
            "count(*) FILTER (result NOT IN ('H', 'D', 'A'))",
            "{v} > 0",
        ),
        _check_sql(
            "goal_range",
            "count(*) FILTER (least(home_goals, away_goals) < 0 "
            "OR greatest(home_goals, away_goals) > 15)",
            "{v} > 0",
        ),
        _check_sql(
            "half_time_within_full_time",
            "count(*) FILTER (ht_home_goals > home_goals) "
            "+ count(*) FILTER (ht_away_goals > away_goals)",
            "{v} > 0",
        ),
        _check_sql(
            "on_target_within_shots",
            "count(*) FILTER (home_shots_on_target > home_shots) "
            "+ count(*) FILTER (away_shots_on_target > away_shots)",
            "{v} > 0",
        ),
        _check_sql(
            "season_label_form",
            "count(*) FILTER (NOT regexp_full_match(season, '\\d{4}(-\\d{2})?'))",
            "{v} > 0",
        ),
        _check_sql(
            "team_country_prefix",
            "count(*) FILTER (split_part(home_team_id, ':', 1) <> lower(country)) "
            "+ count(*) FILTER (split_part(away_team_id, ':', 1) <> lower(country))",
            "{v} > 0",
        ),
        _check_sql(
            "home_win_share",
            "avg(CASE WHEN result = 'H' THEN 1.0 ELSE 0.0 END)",
            "{v} < 0.40 OR {v} > 0.52",
            min_rows=5000,
        ),
        _check_sql(
            "draw_share",
            "avg(CASE WHEN result = 'D' THEN 1.0 ELSE 0.0 END)",
            "{v} < 0.20 OR {v} > 0.32",
            min_rows=5000,
        ),
        _check_sql(
            "price_floor",
            "count(*) FILTER (least(odds_home, odds_draw, odds_away) <= 1)",
            "{v} > 0",
            min_rows=1000,
        ),
        _check_sql("book_floor", f"min({_BOOK})", "{v} < 0.99", min_rows=1000),
    ]
)


@query("quality_row_checks", f"{WITH_CONTESTS} {_ROW_CHECKS}")
def quality_row_checks(spark, sf_dir):
    """Thirteen rules about rows in one aggregate."""
    return tidy(quality.run(contests(spark, sf_dir), quality.match_checks()))


def _told(name, value="0", failed="FALSE", severity="error"):
    return f"""SELECT '{name}' AS "check", '{severity}' AS severity,
      CASE WHEN {failed} THEN 'failed' ELSE 'passed' END AS outcome, CAST({value} AS DOUBLE) AS value"""


def _group_check(name, value, failed, severity="error", min_rows=0):
    """A check over a small table of its own, skipped for small tables."""
    return f"""SELECT '{name}' AS "check", '{severity}' AS severity,
      CASE WHEN (SELECT count(*) FROM contests) < {min_rows} THEN 'skipped'
        WHEN {failed} THEN 'failed' ELSE 'passed' END AS outcome, round(CAST(v AS DOUBLE), 6) AS value
      FROM ({value}) AS q(v)"""


_SEASON_START = "make_date(CAST(substr(season, 1, 4) AS BIGINT), CASE WHEN length(season) > 4 THEN 7 ELSE 1 END, 1)"
_SEASON_END = """CASE WHEN length(season) > 4 THEN make_date(CAST(substr(season, 1, 4) AS BIGINT) + 1, 6, 30)
  ELSE make_date(CAST(season AS BIGINT), 12, 31) END"""
_MATCH_SUITE = " UNION ALL ".join([
    f"{WITH_CONTESTS} {_told('column_order')}", _told("column_types"), _told("column_known_side"),
    _group_check("unique_match_id", "SELECT count(*) FROM (SELECT match_id FROM contests GROUP BY 1 HAVING count(*) > 1) AS r", "v > 0"),
    _ROW_CHECKS,
    _group_check("one_competition_per_fixture", """SELECT count(*) FROM (SELECT date, home_team, away_team FROM contests
      GROUP BY 1, 2, 3 HAVING count(DISTINCT competition_id) > 1) AS r""", "v > 0"),
    _group_check("median_book_range", f"SELECT median({_BOOK}) FROM contests", "v <= 1.02 OR v >= 1.15", min_rows=1000),
    _group_check("single_season_share", """SELECT avg(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END) FROM (SELECT home_team_id,
      count(DISTINCT season) AS n FROM contests GROUP BY 1) AS r""", "v > 0.30", "warning", 5000),
    _told("competition_registered"), _told("registry_metadata"),
    _group_check("date_in_season", f"""SELECT count(*) FROM contests
      WHERE date < {_SEASON_START} - 60 OR date > {_SEASON_END} + 60""", "v > 0", "warning"),
    _group_check("recent_statistics", """SELECT CASE WHEN count(*) >= 1000 THEN avg(CASE WHEN home_shots IS NULL THEN 0.0
      ELSE 1.0 END) END FROM contests WHERE date >= DATE '2021-08-01' AND country <> 'LOW'""", "coalesce(v < 0.90, FALSE)",
      min_rows=5000),
    _group_check("competition_history_length", """SELECT count(*) FROM (SELECT competition_id FROM contests GROUP BY 1
      HAVING count(*) < 500) AS r""", "v > 0", "warning", 5000),
    """SELECT 'chronological' AS "check", 'error' AS severity, 'passed' AS outcome, CAST(0 AS DOUBLE) AS value""",
])


@query("quality_match_suite", _MATCH_SUITE)
def quality_match_suite(spark, sf_dir):
    """All rules over the written table: its rows, its groups, its registry and the order of its files."""
    m = contests(spark, sf_dir)
    path = scratch_path(spark, "matches")
    stored = tables.write_matches(m, path, MATCH_SCHEMA)
    return tidy(quality.check_matches(stored, contest_registry(stored), tables.date_spans(spark, path)))


@query(
    "quality_median_book",
    f"{WITH_CONTESTS} SELECT round(median({_BOOK}), 6) AS median_book FROM contests",
)
def quality_median_book(spark, sf_dir):
    value = quality.median_book(contests(spark, sf_dir))
    return tidy(spark.createDataFrame([(value,)], "median_book double"))


@query(
    "exact_price_quantiles",
    """SELECT round(quantile_cont(l_extendedprice, 0.1), 6) AS p10,
      round(quantile_cont(l_extendedprice, 0.5), 6) AS p50,
      round(quantile_cont(l_extendedprice, 0.99), 6) AS p99 FROM lineitem""",
)
def exact_price_quantiles(spark, sf_dir):
    prices = table(spark, sf_dir, "lineitem").select("l_extendedprice")
    values = [exact_quantile(prices, "l_extendedprice", q) for q in (0.1, 0.5, 0.99)]
    return tidy(spark.createDataFrame([tuple(values)], "p10 double, p50 double, p99 double"))


@query(
    "quality_duplicate_fixtures",
    f"""{WITH_CONTESTS} SELECT date, home_team, away_team,
      count(DISTINCT competition_id) AS competitions, min(competition_id) AS first,
      max(competition_id) AS last FROM contests GROUP BY 1, 2, 3
    HAVING count(DISTINCT competition_id) > 1""",
)
def quality_duplicate_fixtures(spark, sf_dir):
    return quality.duplicate_fixtures(contests(spark, sf_dir))


@query(
    "quality_repeated_ids",
    "SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS match_id, "
    "count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1",
)
def quality_repeated_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat_ws(
            "-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")
        ).alias(KEY)
    )
    return quality.repeated_ids(rows)


@query(
    "quality_metadata_drift",
    f"""{WITH_CONTESTS}, rows AS (SELECT competition_id, country,
        CASE WHEN season = '1998-99' AND country = 'HIG' THEN 'Renamed' ELSE competition END
          AS competition, tier FROM contests)
    SELECT DISTINCT competition_id, country, competition, tier FROM rows
    WHERE competition = 'Renamed'""",
)
def quality_metadata_drift(spark, sf_dir):
    m = contests(spark, sf_dir)
    renamed = (F.col("season") == "1998-99") & (F.col("country") == "HIG")
    drifted = m.withColumn(
        "competition", F.when(renamed, "Renamed").otherwise(F.col("competition"))
    )
    return quality.metadata_drift(drifted, contest_registry(m))


@query(
    "quality_outside_season",
    f"""{WITH_CONTESTS}, rows AS (SELECT date, competition_id,
        CASE WHEN CAST(substr(match_id, 2, 12) AS BIGINT) % 500 = 0 THEN '1990-91' ELSE season END AS season
      FROM contests)
    SELECT season, count(*) AS rows, max(date) AS last_date,
      array_to_string(list_sort(list_distinct(list(competition_id))), ',') AS competitions
    FROM rows WHERE season = '1990-91' GROUP BY season""",
)
def quality_outside_season(spark, sf_dir):
    m = contests(spark, sf_dir)
    wrong = F.substring(KEY, 2, 12).cast("long") % 500 == 0
    moved = m.withColumn("season", F.when(wrong, "1990-91").otherwise(F.col("season")))
    return quality.outside_season(moved).withColumn(
        "competitions", F.array_join("competitions", ",")
    )


@query(
    "quality_thin_competitions",
    f"""{WITH_CONTESTS} SELECT competition_id, count(*) AS n FROM contests GROUP BY 1
    HAVING count(*) < 1000""",
)
def quality_thin_competitions(spark, sf_dir):
    return quality.thin_competitions(contests(spark, sf_dir), 1000)


@query(
    "key_coverage",
    f"""{WITH_CONTESTS} SELECT count(*) FILTER (date >= DATE '2001-01-01') AS missing,
      CAST(0 AS BIGINT) AS extra, CAST(0 AS BIGINT) AS repeated FROM contests""",
)
def key_coverage(spark, sf_dir):
    from pitwise.operators.resolve import coverage

    m = contests(spark, sf_dir)
    return coverage(m, m.filter(F.col("date") < F.lit("2001-01-01").cast("date")))


_FEATURE_RULES = (
    "keys_agree", "unique_match_id", "feature_schema", "no_value_without_history", "count_sign", "points_range",
    "goal_rate_range", "rest_minimum", "fortnight_range",
)


@query(
    "quality_feature_suite",
    f"""{WITH_CONTESTS}, sides AS (SELECT home_team_id AS team, date FROM contests
        UNION ALL SELECT away_team_id, date FROM contests),
      firsts AS (SELECT team, min(date) AS first FROM sides GROUP BY 1),
      share AS (SELECT avg(CASE WHEN first < date THEN 1.0 ELSE 0.0 END) AS v FROM contests
        JOIN firsts ON team = home_team_id)
    {" UNION ALL ".join(map(_told, _FEATURE_RULES))}
    UNION ALL SELECT 'form_coverage', 'warning', CASE WHEN v < 0.9 THEN 'failed' ELSE 'passed' END,
      round(CAST(v AS DOUBLE), 6) FROM share""",
)
def quality_feature_suite(spark, sf_dir):
    m = contests(spark, sf_dir)
    return tidy(quality.check_features(durable(builds.features(m), "features"), m))


_RATING_RULES = (
    "keys_agree", "unique_match_id", "elo_present", "expected_score_range", "goal_probs_total", "goal_probs_range",
    "expected_goals_sign", "goal_columns_together",
)


@query(
    "quality_rating_suite",
    f"""{GOAL_FITS}, share AS (SELECT avg(CASE WHEN rated THEN 1.0 ELSE 0.0 END) AS v FROM covered)
    {" UNION ALL ".join(map(_told, _RATING_RULES))}
    UNION ALL SELECT 'goal_model_coverage', 'warning', CASE WHEN v < 0.5 THEN 'failed' ELSE 'passed' END,
      round(CAST(v AS DOUBLE), 4) FROM share""",
)
def quality_rating_suite(spark, sf_dir):
    m = contests(spark, sf_dir)
    return tidy(quality.check_ratings(durable(builds.ratings(m), "ratings"), m), 4)


@query(
    "target_classes",
    f"""{WITH_CONTESTS} SELECT CASE result WHEN 'H' THEN 0.0::DOUBLE WHEN 'D' THEN 1.0::DOUBLE
      ELSE 2.0::DOUBLE END AS label, count(*) AS n FROM contests GROUP BY 1""",
)
def target_classes(spark, sf_dir):
    from pitwise.operators.models import target

    return contests(spark, sf_dir).groupBy(target(TARGET).alias("label")).agg(
        F.count(F.lit(1)).alias("n")
    )

