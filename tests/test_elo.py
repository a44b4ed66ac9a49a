"""The rating walk: arithmetic, resumption in blocks, splitting a busy day."""

import math

import pytest
from pyspark.sql import functions as F

from pitwise.operators import elo


def plain(rows, s=elo.DEFAULT):
    rating, played, season, out = {}, {}, {}, {}
    for r in sorted(rows, key=lambda r: (r["date"], r["competition_id"], r["match_id"])):
        for t in (r["home_team_id"], r["away_team_id"]):
            if t not in rating:
                rating[t], played[t], season[t] = s.initial, 0, r["season"]
            elif season[t] != r["season"]:
                season[t] = r["season"]
                rating[t] = s.initial + s.season_carry * (rating[t] - s.initial)
        h, a = r["home_team_id"], r["away_team_id"]
        edge = rating[h] + s.home_advantage - rating[a]
        e = 1 / (1 + 10 ** (-edge / s.scale))
        out[r["match_id"]] = (rating[h], rating[a], e, played[h], played[a])
        if r["home_goals"] is None:
            continue
        d = r["home_goals"] - r["away_goals"]
        g = 1.0 if abs(d) <= 1 else 1.5 if abs(d) == 2 else (11 + abs(d)) / 8
        lead = 0 if d == 0 else edge if d > 0 else -edge
        move = s.k * g * s.damping / (0.001 * lead + s.damping) * ((d > 0) + 0.5 * (d == 0) - e)
        rating[h] += move
        rating[a] -= move
        played[h] += 1
        played[a] += 1
    return out


def _table(df):
    return {r["match_id"]: tuple(r)[1:] for r in df.collect()}


def test_walk_equals_plain_rewrite(league):
    got, want = _table(elo.rate(league)), plain(league.collect())
    assert got.keys() == want.keys()
    for k in want:
        assert all(math.isclose(x, y, abs_tol=1e-9) for x, y in zip(got[k], want[k], strict=True))


def test_blocks_and_split_days_change_nothing(league):
    whole = _table(elo.rate(league))
    assert _table(elo.rate(league, max_rows_per_task=90)) == whole
    ends = [sorted(elo.final_state(league, max_rows_per_task=n).collect()) for n in (90, 10**6)]
    assert ends[0] == ends[1]


def test_single_day_over_the_limit_is_split_into_groups(make):
    rows = [("m1", 0, "a", "b", 1, 0), ("m2", 0, "c", "d", 2, 0), ("m3", 0, "b", "e", 0, 0),
            ("m4", 1, "a", "c", 1, 1), ("m5", 1, "f", "g", 0, 4), ("m6", 2, "d", "e", 3, 0)]
    m = make(rows)
    blocks = elo.plan_blocks(elo._rows(m), 1)
    assert any(over for _, _, over in blocks)
    assert _table(elo.rate(m, max_rows_per_task=1)) == _table(elo.rate(m))


def test_components_join_chains(spark):
    pairs = spark.createDataFrame(
        [(f"t{i:02d}", f"t{i + 1:02d}") for i in range(20)] + [("x", "y")], "home string, away string"
    )
    groups = {r["team"]: r["group"] for r in elo.components(pairs).collect()}
    assert {groups[f"t{i:02d}"] for i in range(21)} == {"t00"}
    assert groups["x"] == groups["y"] == "x"


def test_zero_sum_and_null_scores(make):
    m = make([("m1", 0, "a", "b", 3, 0), ("m2", 7, "b", "a", None, None), ("m3", 8, "a", "b", 0, 0)])
    got = _table(elo.rate(m))
    assert got["m3"][0] == got["m2"][1] and got["m3"][3] == 1
    state = elo.final_state(m).agg(F.sum("rating")).first()[0]
    assert math.isclose(state, 3000.0)


def test_grid_contains_default_error(league):
    early = league.filter("home_goals IS NOT NULL")
    grid = elo.grid_search(early, (14.0, 20.0), (80.0,), (0.97,))
    mine = grid.filter("k = 14.0").first()["mse"]
    direct = elo.squared_error(elo.rate(early), early).first()["mse"]
    assert math.isclose(mine, direct, rel_tol=1e-9)


def test_grid_does_not_depend_on_how_the_calendar_is_cut(league):
    chosen = {"k_values": (10.0, 20.0), "home_values": (40.0, 80.0), "carry_values": (0.8, 1.0)}
    whole = {tuple(r)[:3]: tuple(r)[3:] for r in elo.grid_search(league, **chosen).collect()}
    cut = {tuple(r)[:3]: tuple(r)[3:] for r in elo.grid_search(league, **chosen, max_rows_per_task=30).collect()}
    assert len(whole) == 8 and whole.keys() == cut.keys()
    for key, (mse, n) in whole.items():
        assert cut[key] == (pytest.approx(mse, abs=1e-12), n)
        settings = elo.EloSettings(k=key[0], home_advantage=key[1], season_carry=key[2])
        assert elo.squared_error(elo.rate(league, settings), league).first()["mse"] == pytest.approx(mse, abs=1e-12)
