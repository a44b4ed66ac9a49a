"""Boosted trees against a plain booster on one array, on fixtures with and without a signal."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitwise.operators import boosting as B
from pitwise.operators import models
from pitwise.operators.folds import Fold, walk_forward
from pitwise.schema import CLASSES, KEY, PROBS, TARGET

COLUMNS = ("a", "b", "c")


@pytest.fixture(scope="module")
def signal(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(900):
        a, b, c = rng.normal(), rng.normal(), float(rng.integers(0, 4))
        p = np.exp([1.5 * a, 0.3 * b, -1.5 * a + (c > 2)])
        label = CLASSES[rng.choice(3, p=p / p.sum())]
        day = 1 + i % 28
        rows.append((f"m{i:04d}", f"2021-{1 + i % 12:02d}-{day:02d}", "E", None if i % 11 == 0 else a, b, c, label))
    df = spark.createDataFrame(rows, f"{KEY} string, d string, competition_id string, a double, b double, c double, {TARGET} string")
    return df.withColumn("date", F.to_date("d")).drop("d")


def _plain(df, s, edges, start):
    """The same algorithm by loops over one array."""
    rows = df.withColumn("mark", F.xxhash64(KEY)).orderBy(KEY).toPandas()
    x = np.zeros((len(rows), len(COLUMNS)), dtype=int)
    for k, c in enumerate(COLUMNS):
        v = rows[c].to_numpy(dtype=float)
        x[:, k] = np.where(np.isnan(v), 0, 1 + np.searchsorted(edges[k], v, side="left"))
    y = rows[TARGET].map({c: i for i, c in enumerate(CLASSES)}).to_numpy()
    f = np.tile(start, (len(rows), 1))
    for turn in range(s.rounds):
        use = B.sampled(rows["mark"].to_numpy(), turn, s.subsample)
        p = np.exp(f) / np.exp(f).sum(axis=1, keepdims=True)
        step = np.zeros_like(f)
        for k in range(3):
            g, h = p[:, k] - (y == k), 2 * p[:, k] * (1 - p[:, k])
            columns = B.tree_columns(len(COLUMNS), turn, k, s.columns)

            def split(learn, every, depth):
                G, H = g[learn].sum(), h[learn].sum()
                best = (1e-9, None, None)
                for c in columns if depth < s.depth else ():
                    for cut in range(B.BINS):
                        left = learn & (x[:, c] <= cut)
                        gl, hl = g[left].sum(), h[left].sum()
                        if hl >= s.leaf and H - hl >= s.leaf:
                            gain = gl**2 / (hl + s.l2) + (G - gl) ** 2 / (H - hl + s.l2) - G**2 / (H + s.l2)
                            if gain > best[0] + 1e-9:
                                best = (gain, c, cut)
                if best[1] is None:
                    step[every, k] = -s.rate * G / (H + s.l2)
                    return
                goes = x[:, best[1]] <= best[2]
                split(learn & goes, every & goes, depth + 1)
                split(learn & ~goes, every & ~goes, depth + 1)

            split(use, np.ones(len(rows), bool), 0)
        f += step
    p = np.exp(f) / np.exp(f).sum(axis=1, keepdims=True)
    return dict(zip(rows[KEY], p))


def test_equals_a_plain_booster(signal):
    s = B.Settings(rounds=12, depth=3, rate=0.2, subsample=0.7, columns=0.7, leaf=4.0, l2=0.5)
    family = B.BoostedFamily("boosted", COLUMNS, s.__dict__)
    fitted = family.fit(signal.repartition(5))
    want = _plain(signal, s, fitted.booster.edges, fitted.booster.start)
    for r in fitted.forecast(signal).collect():
        assert [r[p] for p in PROBS] == pytest.approx(want[r[KEY]], abs=1e-9)


def test_beats_the_prior_where_there_is_something_to_learn(signal, spark, tmp_path):
    family = models.boosted_trees(COLUMNS, rounds=25, depth=3, rate=0.1, leaf=5)
    train, rows = signal.filter("date < '2021-10-01'"), signal.filter("date >= '2021-10-01'")
    fitted = family.fit(train)
    prior = {r[TARGET]: r["n"] for r in train.groupBy(TARGET).agg(F.count("*").alias("n")).collect()}
    total = sum(prior.values())
    got = fitted.forecast(rows).collect()
    loss = np.mean([-np.log(r[PROBS[CLASSES.index(r[TARGET])]]) for r in got])
    base = np.mean([-np.log(prior[r[TARGET]] / total) for r in got])
    assert loss < base - 0.1
    assert all(sum(r[p] for p in PROBS) == pytest.approx(1) for r in got)
    fitted.save(spark, str(tmp_path / "m"))
    again = B.BoostedFit.load(spark, str(tmp_path / "m")).forecast(rows).collect()
    assert {r[KEY]: r[PROBS[0]] for r in again} == {r[KEY]: r[PROBS[0]] for r in got}


def test_folds_fitted_side_by_side_are_those_fitted_alone(signal):
    import datetime as dt

    folds = [Fold(0, dt.date(2021, 6, 1), dt.date(2021, 9, 1)), Fold(1, dt.date(2021, 9, 1), dt.date(2021, 12, 1))]
    family = models.boosted_trees(COLUMNS, rounds=4, depth=2, rate=0.1, leaf=5)
    both = family.fit_folds(signal, folds)
    for fold in folds:
        alone = family.fit(fold.train(signal))
        rows = fold.evaluate(signal)
        one = {r[KEY]: r[PROBS[0]] for r in both[fold.index].forecast(rows).collect()}
        two = {r[KEY]: r[PROBS[0]] for r in alone.forecast(rows).collect()}
        assert one == pytest.approx(two, abs=1e-12)


def test_odd_columns(signal):
    df = signal.withColumn("b", F.lit(None).cast("double")).withColumn("c", F.lit(1.0))
    family = models.boosted_trees(COLUMNS, rounds=2, depth=2, leaf=5)
    assert family.fit(df).forecast(df).filter(f"{PROBS[0]} IS NULL").count() == 0
    with pytest.raises(ValueError):
        family.fit(df.filter("false"))
    assert walk_forward(signal, folds=2, horizon_days=60)
