"""Many logistic fits by the same jobs: the optimum, folds apart, classes and columns that are not there."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitwise.operators import logistic, models, quantiles
from pitwise.operators.folds import Fold
from pitwise.schema import KEY

COLUMNS = ("elo_home", "home_form_points_5")


@pytest.fixture(scope="module")
def frame(spark):
    n = F.col("id")
    x, y = (n * 37 % 101) / 101.0, (n * 53 % 89) / 89.0
    mixed = (n * 7919 % 1013) / 1013.0 + x
    return spark.range(900).select(
        F.format_string("m%05d", n).alias(KEY), F.lit("X_1").alias("competition_id"),
        F.date_add(F.lit("2020-01-01").cast("date"), (n / 3).cast("int")).alias("date"),
        F.when(n % 11 != 0, 1500 + 100 * x).alias(COLUMNS[0]), y.alias(COLUMNS[1]),
        F.when(mixed > 1.2, "H").when(mixed > 0.8, "D").otherwise("A").alias("result"),
    )


def _slope(fit, rows, c):
    """Of the penalised mean loss, at the fit's own weights, worked out by itself."""
    x = np.array([[np.nan if r[k] is None else r[k] for k in fit.columns] for r in rows])
    x = np.where(np.isnan(x), np.nanmedian(x, axis=0), x)
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    scores = z @ fit.weights.T + fit.intercepts
    p = np.exp(scores - scores.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    y = np.array([["HDA".index(r["result"]) == k for k in range(3)] for r in rows])
    return np.hstack([(p - y).T @ z / len(z) + fit.weights / (c * len(z)), (p - y).mean(axis=0)[:, None]])


def test_fits_of_folds_and_columns_are_each_at_their_own_optimum(frame):
    folds = [Fold(0, dt.date(2020, 6, 1), dt.date(2020, 8, 1)), Fold(3, dt.date(2020, 8, 1), dt.date(2020, 10, 1))]
    families = [
        logistic.LogisticFamily("both", COLUMNS, {"C": 0.1, "max_iter": 100}),
        logistic.LogisticFamily("one", COLUMNS[:1], {"C": 5.0, "max_iter": 100}),
    ]
    found = logistic.fit_folds(families, frame, folds)
    for family in families:
        for fold in folds:
            rows = fold.train(frame).collect()
            fit = found[family.name][fold.index]
            assert fit.columns == family.columns
            assert np.abs(_slope(fit, rows, family.settings["C"])).max() < 1e-5


def test_twelve_fits_take_few_jobs(spark, frame):
    """A job per step for all fits; a fit by itself took a job per step of its own."""
    folds = [Fold(i, dt.date(2020, 4 + i, 1), dt.date(2020, 5 + i, 1)) for i in range(4)]
    families = [logistic.LogisticFamily(f"c{c}", COLUMNS, {"C": c, "max_iter": 100}) for c in (0.1, 1.0, 10.0)]
    spark.sparkContext.setJobGroup("twelve", "fits")
    try:
        logistic.fit_folds(families, frame, folds)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("twelve")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(jobs) < 120


def test_a_class_never_seen_and_a_column_that_never_varies(spark, frame, tmp_path):
    train = frame.filter("result <> 'D'").withColumn("home_form_points_5", F.lit(2.0))
    fit = models.logistic_regression(COLUMNS).fit(train)
    assert fit.weights[:, 1].tolist() == [0.0, 0.0, 0.0]
    stated = fit.forecast(frame)
    assert stated.filter("prob_draw <> 0 OR abs(prob_home + prob_away - 1) > 1e-12").count() == 0
    fit.save(spark, str(tmp_path))
    again = logistic.LogisticFit.load(spark, str(tmp_path)).forecast(frame)
    assert again.exceptAll(stated).count() == 0


def test_medians_shuffle_only_the_values_near_them(spark, monkeypatch):
    kept = []
    real = quantiles.durable
    monkeypatch.setattr(quantiles, "durable", lambda df, name: kept.append(real(df, name)) or kept[-1])
    df = spark.range(20000).select((F.col("id") * 7919 % 20011).cast("double").alias("v"))
    values = sorted(i * 7919 % 20011 for i in range(20000))
    assert quantiles.exact_median(df, "v") == (values[9999] + values[10000]) / 2
    assert 0 < sum(k.count() for k in kept) < 400
