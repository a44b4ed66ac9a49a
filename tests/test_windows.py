"""Point-in-time features against a plain rewrite over lists."""

import math

from pitwise.operators import features
from pitwise.schema import FEATURE_COLUMNS


def _mean(values):
    known = [v for v in values if v is not None]
    return sum(known) / len(known) if known else None


def _points(a, b):
    return None if a is None else 3.0 if a > b else 1.0 if a == b else 0.0


def brute(rows):
    sides = []
    for r in rows:
        for venue, own, other in (("home", "home", "away"), ("away", "away", "home")):
            sides.append(
                {
                    "id": r["match_id"], "date": r["date"], "venue": venue,
                    "team": r[f"{own}_team_id"], "gf": r[f"{own}_goals"], "ga": r[f"{other}_goals"],
                    "sf": r[f"{own}_shots"], "sa": r[f"{other}_shots"],
                    "pts": _points(r[f"{own}_goals"], r[f"{other}_goals"]),
                }
            )
    sides.sort(key=lambda s: (s["date"], s["id"]))
    out = {r["match_id"]: {} for r in rows}
    for s in sides:
        past = [p for p in sides if p["team"] == s["team"] and p["date"] < s["date"]]
        here = [p for p in past if p["venue"] == s["venue"]][-5:]
        values = {
            "matches_played": len(past),
            "rest_days": (s["date"] - past[-1]["date"]).days if past else None,
            "matches_14d": sum((s["date"] - p["date"]).days <= 14 for p in past),
            "venue_points_5": _mean([p["pts"] for p in here]),
        }
        for name, key in (("form_points_5", "pts"), ("goals_for_5", "gf"), ("goals_against_5", "ga"),
                          ("shots_for_5", "sf"), ("shots_against_5", "sa")):
            values[name] = _mean([p[key] for p in past[-5:]])
        for k, v in values.items():
            out[s["id"]][f"{s['venue']}_{k}"] = v
    ordered = sorted(rows, key=lambda r: (r["date"], r["match_id"]))
    for r in rows:
        pair = {r["home_team_id"], r["away_team_id"]}
        met = [p for p in ordered
               if {p["home_team_id"], p["away_team_id"]} == pair and p["date"] < r["date"]]
        mine = [
            _points(p["home_goals"], p["away_goals"])
            if p["home_team_id"] == r["home_team_id"]
            else _points(p["away_goals"], p["home_goals"])
            for p in met[-5:]
        ]
        out[r["match_id"]]["h2h_matches"] = len(met)
        out[r["match_id"]]["h2h_home_points"] = _mean(mine)
    return out


def _same(a, b):
    return a is b or (a is not None and b is not None and math.isclose(a, b, abs_tol=1e-12))


def test_features_equal_brute_force(league):
    want = brute(league.collect())
    got = {r["match_id"]: r for r in features.build(league).collect()}
    assert got.keys() == want.keys()
    for mid, row in got.items():
        for c in FEATURE_COLUMNS:
            assert _same(row[c], want[mid][c]), (mid, c, row[c], want[mid][c])


def test_same_day_rows_do_not_see_each_other(make):
    rows = [("m1", 0, "a", "b", 1, 0), ("m2", 5, "a", "c", 0, 2), ("m3", 5, "d", "a", 0, 3),
            ("m4", 19, "a", "b", 1, 1)]
    got = {r["match_id"]: r for r in features.build(make(rows)).collect()}
    assert got["m2"]["home_matches_played"] == got["m3"]["away_matches_played"] == 1
    assert got["m2"]["home_form_points_5"] == got["m3"]["away_form_points_5"] == 3.0
    assert got["m1"]["home_matches_played"] == 0 and got["m1"]["home_rest_days"] is None
    assert got["m4"]["home_matches_14d"] == 2  # fourteen days earlier still counts
    assert got["m4"]["h2h_matches"] == 1 and got["m4"]["h2h_home_points"] == 3.0


def test_one_busy_day_and_one_busy_team(make):
    """One team on one day in most of the rows: the tail keeps only what a window can need."""
    rows = [(f"m{i:03d}", 3, "a", f"t{i % 40}", i % 3, 1) for i in range(200)]
    rows.append(("z", 4, "a", "b", 1, 0))
    got = features.build(make(rows)).filter("match_id = 'z'").first()
    assert got["home_matches_played"] == 200 and got["home_matches_14d"] == 200
    last = [_points(i % 3, 1) for i in range(195, 200)]
    assert got["home_form_points_5"] == sum(last) / 5
