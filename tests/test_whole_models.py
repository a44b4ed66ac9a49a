"""Registered model queries fit all trees and rounds, and boosting by tasks is boosting by jobs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitwise.operators import boosting as B
from pitwise.operators import models as M
from pitwise.plans import queries_models as QM
from pitwise.schema import CLASSES, KEY, TARGET

COLUMNS = ("a", "b", "c")


@pytest.mark.parametrize("name", sorted(M.FAMILIES))
def test_queries_fit_the_shipped_settings(name):
    assert QM._family(name).settings == M.FAMILIES[name]().settings


def test_search_never_lowers_trees_or_rounds():
    for family, settings in QM._SETTINGS.items():
        shipped = M.FAMILIES[family]().settings
        assert settings[0] == {}
        for one in settings:
            made = M.FAMILIES[family](**one).settings
            assert all(made.get(n) == shipped.get(n) for n in ("trees", "rounds", "max_iter"))


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(9)
    made = []
    for i in range(700):
        a, b, c = rng.normal(), rng.normal(), float(rng.integers(0, 4))
        p = np.exp([1.5 * a, 0.3 * b, c - a])
        label = None if i % 50 == 0 else CLASSES[rng.choice(3, p=p / p.sum())]
        made.append((f"m{i:04d}", None if i % 7 == 0 else a, b, c, label))
    return spark.createDataFrame(made, f"{KEY} string, a double, b double, c double, {TARGET} string")


def test_sets_grown_in_a_task_are_those_grown_by_jobs(rows, monkeypatch):
    s = B.Settings(rounds=12, depth=3, rate=0.2, subsample=0.7, columns=0.7, leaf=4.0, l2=0.5)
    number = F.substring(KEY, 2, 4).cast("int")
    unit = F.when(number % 2 == 0, F.array(F.lit(0), F.lit(4))).otherwise(F.array(F.lit(4)))
    alone = B.fit(rows, COLUMNS, unit, s)
    monkeypatch.setattr(B, "ROWS_PER_TASK", 0)  # no set fits a task
    by_jobs = B.fit(rows, COLUMNS, unit, s)
    assert sorted(alone) == sorted(by_jobs) == [0, 4]
    for u, booster in alone.items():
        assert len(booster.rounds) == len(by_jobs[u].rounds) == s.rounds
        for mine, theirs in zip(booster.rounds, by_jobs[u].rounds, strict=True):
            for one, other in zip(mine, theirs, strict=True):
                assert one.column.tolist() == other.column.tolist()
                assert one.cut.tolist() == other.cut.tolist()
                assert one.value == pytest.approx(other.value, abs=1e-12)


def test_no_rounds_and_one_row_of_a_set(rows):
    s = B.Settings(rounds=2, depth=2, rate=0.2, subsample=1.0, columns=1.0, leaf=1.0, l2=0.5)
    first = F.when(F.col(KEY) == "m0001", F.array(F.lit(7))).otherwise(F.array().cast("array<int>"))
    assert len(B.fit(rows, COLUMNS, first, s)[7].rounds) == 2
    none = B.Settings(**{**s.__dict__, "rounds": 0})
    assert B.fit(rows, COLUMNS, F.array(F.lit(0)), none)[0].rounds == []
