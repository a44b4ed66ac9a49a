"""Registered queries: trained forecasters over walk-forward folds, and what they serve.

All thirty columns and all five folds. Fitted numbers depend on the optimiser, so what is compared
with SQL is what must hold of them: every contest of every fold is priced, probabilities sum to one,
and no forecaster is worse than the base rates by more than ``SLACK``. The outcomes of the given
tables are drawn from amounts that no feature knows, so none can be better by much either.

Settings are the shipped ones, with all trees and rounds; README says what they take.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitwise.functions import scoring as S
from pitwise.operators import attribution, calibrate
from pitwise.operators import evaluate as EV
from pitwise.operators import folds as FD
from pitwise.operators import models as M
from pitwise.operators.resolve import played_first
from pitwise.plans import builds, reports, serving
from pitwise.plans.contests import WITH_CONTESTS, contests, split_upcoming
from pitwise.plans.registry import query
from pitwise.schema import BLOCKS, DESIGN_COLUMNS, KEY, PROBS, TARGET
from pitwise.session import durable, scratch_path

SLACK = 0.05
_FRAMES: dict[tuple[str, str], DataFrame] = {}

#: The fold boundaries, and every contest with the fold that evaluates it.
_FOLDS = f"""{WITH_CONTESTS},
  ends AS (SELECT max(date) + 1 AS last FROM contests),
  planned AS (SELECT i AS fold, CAST(last - CAST(365 * (5 - i) AS INTEGER) AS DATE) AS start,
    CAST(last - CAST(365 * (4 - i) AS INTEGER) AS DATE) AS stop FROM ends, range(5) AS r(i)),
  folds AS (SELECT fold, start, stop FROM planned WHERE
    (SELECT count(*) FROM contests WHERE date < start) >= 380
    AND EXISTS (SELECT 1 FROM contests WHERE date >= start AND date < stop)),
  evaluated AS (SELECT CAST(fold AS INTEGER) AS fold, match_id, result FROM contests
    JOIN folds ON date >= start AND date < stop)"""


def _frame(spark, sf_dir) -> DataFrame:
    """The modelling frame with both rating models; built once for all queries of an application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FRAMES:
        m = contests(spark, sf_dir)
        _FRAMES[key] = durable(builds.modelling_frame(m, builds.ratings(m), builds.features(m)), "frame")
    return _FRAMES[key]


def _family(name, **kw):
    return M.build(name, **kw)


def _forecasts(spark, sf_dir, names) -> DataFrame:
    frame = _frame(spark, sf_dir)
    chosen = FD.walk_forward(frame)
    return durable(M.fold_forecasts(frame, chosen, [_family(n) for n in names]), "forecasts")


def _held_up(spark, sf_dir, long: DataFrame) -> DataFrame:
    """Per forecaster and fold: contests, those priced, sound probabilities, loss beside the base rates'."""
    frame = _frame(spark, sf_dir)
    priors = FD.class_priors(frame, FD.walk_forward(frame))
    rates = [f"prior_{c}" for c in ("home", "draw", "away")]
    total = sum((F.col(p) for p in PROBS), F.lit(0.0))
    sound = S.is_priced(PROBS) & (F.abs(total - 1) < 1e-9) & F.least(*PROBS).between(0, 1)
    return long.join(priors, "fold").groupBy("forecaster", "fold").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(S.is_priced(PROBS)).alias("priced"),
        F.bool_and(sound).alias("sound"),
        (F.avg(S.log_loss(PROBS, TARGET)) <= F.avg(S.log_loss(rates, TARGET)) + SLACK).alias("holds"),
    )


def _held_up_sql(*names: str) -> str:
    listed = ", ".join(f"('{n}')" for n in names)
    return f"""{_FOLDS} SELECT forecaster, fold, count(*) AS n, count(*) AS priced, TRUE AS sound,
      TRUE AS holds FROM evaluated, (VALUES {listed}) AS f(forecaster) GROUP BY 1, 2"""


def _one_family(name: str):
    @query(f"model_{name}", _held_up_sql(name))
    def run(spark, sf_dir):
        return _held_up(spark, sf_dir, _forecasts(spark, sf_dir, [name]))

    return run


for _name in M.FAMILIES:
    _one_family(_name)


@query(
    "model_blend_calibrated",
    _held_up_sql("logistic_regression", "mlp", "blend", "blend-calibrated"),
)
def model_blend_calibrated(spark, sf_dir):
    """Members chosen by how differently they err, blended and tempered, each fold by itself."""
    names = ["logistic_regression", "mlp"]
    long = _forecasts(spark, sf_dir, names)
    terms = EV.scored_terms(EV.to_wide(long), len(names))
    order = [r["forecaster"] for r in EV.rank_forecasters(terms).collect()]
    members = EV.select_members(EV.error_correlations(terms, names), order)
    mixed = M.blended(long, members).select(*long.columns)
    keys = ["forecaster", "fold"]
    scaled = calibrate.apply_temperatures(mixed, calibrate.fit_temperatures(mixed, keys), keys)
    return _held_up(spark, sf_dir, reduce(DataFrame.unionByName, [long, mixed, scaled]))


@query(
    "model_block_ablation",
    f"""{_FOLDS} SELECT block, (SELECT count(*) FROM evaluated) AS n, block = 'full' AS control,
      TRUE AS holds FROM (VALUES ('full'), {", ".join(f"('{b}')" for b in BLOCKS)}) AS b(block)""",
)
def model_block_ablation(spark, sf_dir):
    """Each of the five blocks withheld on every fold, against the whole model on the same rows."""
    frame = _frame(spark, sf_dir)
    rows = M.ablation(frame, FD.walk_forward(frame), M.logistic_regression)
    return rows.select(
        "block", "n", (F.col("delta_log_loss") == 0).alias("control"),
        (F.abs("delta_log_loss") < SLACK).alias("holds"),
    )


_SETTINGS = {
    "logistic_regression": [{}, {"C": 0.01}],
    "mlp": [{}, {"hidden": 16}],
    "random_forest": [{}, {"depth": 6}],
    "boosted_trees": [{}, {"depth": 2}],
}


@query(
    "model_setting_search",
    f"""SELECT family, CAST(setting AS INTEGER) AS setting, TRUE AS scored
    FROM (VALUES {", ".join(f"('{f}', {i})" for f, s in _SETTINGS.items() for i in range(len(s)))}) AS v(family, setting)""",
)
def model_setting_search(spark, sf_dir):
    """Two settings of every family, the shipped one first, on three folds before the evaluated ones."""
    frame = _frame(spark, sf_dir)
    early = FD.tuning_slice(frame, FD.walk_forward(frame))
    inner = FD.walk_forward(early, folds=3)
    rows = [
        (family, settings.index(one), float(loss))
        for family, settings in _SETTINGS.items()
        for one, loss in M.search(early, inner, M.FAMILIES[family], settings)
    ]
    found = spark.createDataFrame(rows, "family string, setting int, log_loss double")
    return found.select("family", "setting", F.col("log_loss").between(0.5, 1.5).alias("scored"))


def _last_fold(spark, sf_dir):
    frame = _frame(spark, sf_dir)
    fold = FD.walk_forward(frame)[-1]
    model = M.logistic_regression().fit(fold.train(frame))
    return model, durable(fold.evaluate(frame), "evaluated")


_BLOCK_ROWS = ", ".join(f"('{b}', {len(c)})" for b, c in BLOCKS.items())


@query(
    "model_permutation_importance",
    f"""SELECT block, CAST(n AS INTEGER) AS columns, TRUE AS holds FROM (VALUES {_BLOCK_ROWS}) AS b(block, n)""",
)
def model_permutation_importance(spark, sf_dir):
    """Five shuffles of every block over the whole of the last fold."""
    model, rows = _last_fold(spark, sf_dir)
    found = attribution.permutation_importance(model, rows)
    holds = (F.col("spread") >= 0) & (F.abs("delta_log_loss") < 1)
    return found.select("block", "columns", holds.alias("holds"))


@query(
    "permutation_ranks",
    f"""{WITH_CONTESTS} SELECT CAST(r AS INTEGER) AS repeat, count(*) AS n, count(*) AS places,
      CAST(0 AS BIGINT) AS low, count(*) - 1 AS high FROM contests, range(5) AS t(r) GROUP BY r""",
)
def permutation_ranks(spark, sf_dir):
    """The places that five shuffles of the whole table send its rows to: each one once."""
    m = contests(spark, sf_dir).select(KEY)
    n = m.count()
    ranked = attribution.dense_ranks(m, n)
    parts = [
        ranked.select(F.lit(r).alias("repeat"), attribution.scattered(F.col("_rank"), n, r).alias("at"))
        for r in range(attribution.REPEATS)
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("repeat").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("at").alias("places"),
        F.min("at").alias("low"), F.max("at").alias("high"),
    )


@query(
    "model_block_attribution",
    f"""SELECT block, CAST(n AS INTEGER) AS columns, CAST(1.0 AS DOUBLE) AS shares
    FROM (VALUES {_BLOCK_ROWS}) AS b(block, n)""",
)
def model_block_attribution(spark, sf_dir):
    """Exact Shapley values of the five blocks; their shares add up to one."""
    model, rows = _last_fold(spark, sf_dir)
    found = attribution.block_attribution(model, rows)
    total = found.agg(F.sum("share")).first()[0]
    return found.select("block", "columns", F.lit(round(total, 9)).alias("shares"))


@query(
    "served_model_reloaded",
    f"""{WITH_CONTESTS} SELECT count(*) AS rows, CAST(0 AS BIGINT) AS different, max(date) AS trained_through
    FROM contests""",
)
def served_model_reloaded(spark, sf_dir):
    """A blend of three kinds of model, saved and loaded: the same probabilities."""
    frame = _frame(spark, sf_dir)
    families = [M.logistic_regression(), M.boosted_trees(rounds=3), M.mlp(rounds=2)]
    model = serving.fit_served(frame, families, calibrated=False)
    path = scratch_path(spark, "served")
    model.save(spark, path)
    again = serving.Served.load(spark, path)
    rows = builds.served_columns(frame)
    after = again.predict(rows).select(KEY, *[F.col(p).alias(f"b_{p}") for p in PROBS])
    moved = ~reduce(lambda a, b: a & b, [F.abs(F.col(p) - F.col(f"b_{p}")) < 1e-12 for p in PROBS])
    return model.predict(rows).join(after, KEY).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(moved).alias("different"),
        F.lit(again.trained_through).alias("trained_through"),
    )


@query(
    "model_card_page",
    f"""{_FOLDS} SELECT title, (SELECT count(*) FROM evaluated) AS n
    FROM (VALUES ('# class_prior'), ('## Scores'), ('### H'), ('### D'), ('### A'), ('## Least reliable competitions')) AS t(title)""",
)
def model_card_page(spark, sf_dir):
    """The parts of a model's page and the contests behind it."""
    m = contests(spark, sf_dir)
    wide = EV.baselines(m, FD.walk_forward(m))
    long = EV.to_long(wide)
    page = reports.model_card(EV.score_table(EV.scored_terms(wide)), long, "class_prior")
    titles = [x for x in page.split("\n") if x.startswith("#") and "Reliability" not in x]
    n = long.filter("forecaster = 'class_prior'").count()
    return spark.createDataFrame([(t, n) for t in titles], "title string, n long")


@query(
    "model_blocks_beside_ablation",
    f"""SELECT block, CAST(n AS BIGINT) AS columns, block IN ('elo', 'form') AS withheld
    FROM (VALUES {_BLOCK_ROWS}) AS b(block, n)""",
)
def model_blocks_beside_ablation(spark, sf_dir):
    """Coefficients collapsed to blocks beside the loss of two blocks withheld on the last fold."""
    frame = _frame(spark, sf_dir)
    last = FD.walk_forward(frame)[-1:]
    fitted = M.logistic_regression().fit(last[0].train(frame))
    weights = abs(fitted.weights).sum(axis=0)
    per_column = spark.createDataFrame(
        [(c, float(w)) for c, w in zip(DESIGN_COLUMNS, weights)], "column string, attribution double"
    )
    lost = M.ablation(frame, last, M.logistic_regression, ("elo", "form"))
    both = attribution.loss_with_block(lost, attribution.by_block(per_column))
    return both.select("block", "columns", F.col("delta_log_loss").isNotNull().alias("withheld"))


@query(
    "design_matrix_nulls",
    f"""{WITH_CONTESTS} SELECT count(*) AS rows, CAST(0 AS BIGINT) AS goal_model_values,
      CAST(30 AS INTEGER) AS columns FROM contests""",
)
def design_matrix_nulls(spark, sf_dir):
    """Thirty ordered columns; a rating model left out stays null rather than zero."""
    m = contests(spark, sf_dir)
    frame = builds.modelling_frame(m, builds.ratings(m, models=("elo",)), builds.features(m))
    x = M.design_matrix(frame)
    return x.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("dc_prob_home").alias("goal_model_values"),
        F.lit(len(x.columns) - 1).alias("columns"),
    )


@query(
    "batch_pricing",
    f"""{WITH_CONTESTS} SELECT match_id, date <= DATE '2001-05-31' AS in_sample, TRUE AS valid
    FROM contests""",
)
def batch_pricing(spark, sf_dir):
    """Fit on what was played, price a request for every contest, stamp every forecast."""
    m = contests(spark, sf_dir)
    played, upcoming = split_upcoming(m, "2001-06-01")
    everything = played.unionByName(upcoming)
    frame = durable(
        builds.modelling_frame(everything, builds.ratings(everything), builds.features(everything)), "frame"
    )
    is_played = F.col("result").isNotNull()
    model = serving.fit_served(frame.filter(is_played), [M.logistic_regression()])
    rows = builds.served_columns(frame)
    keys = frame.select(KEY, is_played.alias("played"))
    tagged = rows.join(keys, KEY)
    served = played_first(tagged.filter("played").drop("played"),
                          tagged.filter("NOT played").drop("played"))
    requests = m.select(
        F.col(KEY).alias("request_id"), KEY, "competition_id", "home_team", "away_team", "date"
    )
    predictions, _ = serving.price(model, requests, served)
    total = sum((F.col(p) for p in PROBS), F.lit(0.0))
    return predictions.select(
        KEY, "in_sample", (F.abs(total - 1.0) < 1e-6).alias("valid")
    )
