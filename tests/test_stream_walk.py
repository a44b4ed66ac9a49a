"""The streamed walk holds late contests at no time and works on slices; the results stay."""

import datetime as dt

import pandas as pd

from pitwise.operators.elo import DEFAULT
from pitwise.streaming import elo as stream_elo


class _Value:
    def __init__(self, value=None):
        self.value = value

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class _Map(dict):
    containsKey = dict.__contains__
    getValue = dict.__getitem__
    updateValue = dict.__setitem__


def _chunk(start, n, day):
    return pd.DataFrame({
        "date": [dt.date(2020, 1, 1) + dt.timedelta(days=day + i % 5) for i in range(n)], "competition_id": "X_1",
        "match_id": [f"m{start + i:06d}" for i in range(n)], "season": ["2020"] * n,
        "home_team_id": [f"x:{i % 7}" for i in range(n)], "away_team_id": [f"x:{7 + i % 5}" for i in range(n)],
        "home_goals": [None if i % 9 == 0 else i % 4 for i in range(n)], "away_goals": [i % 3 for i in range(n)],
    })


def _walk(reached=None):
    walk = stream_elo._Walk(DEFAULT)
    walk.teams, walk.reached = _Map(), _Value(reached)
    return walk


def test_late_contests_leave_before_the_next_are_read():
    taken = []

    def rows():
        for i in range(6):
            taken.append(i)
            yield _chunk(1000 * i, 1000, 0)

    out = _walk((dt.date(2021, 1, 1), "X_1", "m")).handleInputRows(("x",), rows(), None)
    assert len(next(out)) == 1000 and taken == [0]
    assert sum(len(x) for x in out) == 5000 and len(taken) == 6


def test_slices_walk_as_one(monkeypatch):
    chunks = [_chunk(1000, 400, 3), _chunk(0, 300, 0), _chunk(5000, 50, 9)]
    whole, parts = _walk(), _walk()
    one = pd.concat([*whole.handleInputRows(("x",), iter(chunks), None)])
    monkeypatch.setattr(stream_elo, "_SLICE", 64)
    many = [*parts.handleInputRows(("x",), iter(chunks), None)]
    assert max(len(x) for x in many) == 64
    pd.testing.assert_frame_equal(one.reset_index(drop=True), pd.concat(many).reset_index(drop=True))
    assert whole.teams == parts.teams and whole.reached.value == parts.reached.value
    assert whole.reached.value == (dt.date(2020, 1, 14), "X_1", "m005049")
