"""Ragged files, ingest, manifests, sinks and the feed."""

import datetime as dt
import hashlib
import statistics

import pytest
from pyspark.sql import functions as F

from pitwise.operators import clean, quantiles
from pitwise.schema import MATCH_SCHEMA
from pitwise.sources import catalog, feed, landing, lines, manifest, predictions, registry, tables

HEAD = "Div,Date,HomeTeam,AwayTeam,FTHG,FTAG,FTR,HS,HST,AvgH,AvgD,AvgA,,"


@pytest.fixture()
def files(tmp_path):
    main = tmp_path / "main" / "2021"
    main.mkdir(parents=True)
    (main / "E0.csv").write_bytes(
        b"\xef\xbb\xbf" + "\n".join(
            [
                HEAD,
                "E0,12/09/2020,Arsenal,Fulham,3,0,H,10,5,2.0,3.4,3.5,,",
                "E0,13/09/20,Leeds,Spurs,1.0,1",  # short
                "E0,14/09/2020,Wolves,Leeds,0,2,A,0,5,2.39,5.72,10.84,,,extra",  # long
                ",,,,,,,,,,,,,",
                "SP1,14/09/2020,Real,Betis,2,2,D,1,1,2,3,4,,",
                ",15/09/2020,\"Spurs, The\",Wolves,1,0,H,3,3,2,3,4,,",
                "E0,16/09/2020,Leeds,Arsenal,,,,,,,,,,",
                "E0,16/09/2020,Leeds,Leeds,1,1,D,,,,,,,",
                "E0,16/09/2020,Fulham,Arsenal,1,1,H,,,,,,,",
            ]
        ).encode()
    )
    (main / "D1.csv").write_bytes(
        "Div,Date,HomeTeam,AwayTeam,FTHG,FTAG\nD1,12/09/2020,K\xf6ln,Bayern,1,2\n".encode("cp1252")
    )
    (main / "I1.csv").write_text("<!DOCTYPE html><html>, not here</html>")
    (main / "F1.csv").write_text("Div,Date,HomeTeam,AwayTeam,FTHG,FTAG\nF1,soon,Lyon,Nice,1,2\n")
    extra = tmp_path / "extra"
    extra.mkdir()
    (extra / "ARG.csv").write_text(
        "Country,League,Season,Date,Home,Away,HG,AG,Res\n"
        "Argentina, Liga Profesional ,2020/2021,01/11/2020,Boca,River,2,1,H\n"
        "Argentina,Copa De La Liga Profesional,2021,01/03/2021,Boca,Lanus,0,0,D\n"
        "Argentina,Other,2021,01/03/2021,Boca,Lanus,0,0,D\n"
    )
    return str(tmp_path)


def test_ingest_cleans_every_case(spark, files):
    landed = landing.ingest(spark, files, registry.load(spark))
    assert landed.matches.schema.simpleString() == MATCH_SCHEMA.simpleString()
    rows = {(r["competition_id"], r["home_team"], r["away_team"]): r
            for r in landed.matches.collect()}
    assert set(rows) == {
        ("ENG_1", "Arsenal", "Fulham"), ("ENG_1", "Leeds", "Spurs"), ("ENG_1", "Wolves", "Leeds"),
        ("ENG_1", "Spurs, The", "Wolves"), ("GER_1", "Köln", "Bayern"),
        ("ARG_1", "Boca", "River"), ("ARG_CUP", "Boca", "Lanus"),
    }
    short = rows[("ENG_1", "Leeds", "Spurs")]
    assert short["home_goals"] == 1 and short["date"] == dt.date(2020, 9, 13)
    assert short["home_shots"] is None and short["result"] == "D"
    bad = rows[("ENG_1", "Wolves", "Leeds")]
    assert bad["odds_home"] is None and bad["home_shots"] is None
    assert rows[("GER_1", "Köln", "Bayern")]["home_team_id"] == "ger:koln"
    assert rows[("ARG_1", "Boca", "River")]["season"] == "2020-21"
    assert rows[("ARG_CUP", "Boca", "Lanus")]["tier"] is None
    reasons = {r["outcome"]: r["rows"] for r in clean.cleaning_counts(landed.shaped).collect()}
    assert reasons == {"kept": 7, "unplayed": 1, "self_play": 1, "result_disagrees": 1}
    assert [r["reason"] for r in lines.unusable(landed.files).collect()] == ["not csv"]
    repairs = {r["path"].rsplit("/", 1)[1]: r for r in lines.repairs(landed.rows).collect()}
    assert repairs["E0.csv"]["short"] == 1 and repairs["E0.csv"]["discarded"] == 1


def test_large_files_are_split_over_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        path = tmp_path / "big.csv"
        path.write_text("a,b\n" + "".join(f"{i},x\n" for i in range(5000)))
        files, rows = lines.scan_files(spark, str(tmp_path))
        assert rows.count() == 5000 and files.count() == 1
        total = rows.agg(F.sum(lines.field("a").cast("int"))).first()[0]
        assert total == sum(range(5000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_catalog_scan(spark, league, tmp_path):
    path = str(tmp_path / "m")
    tables.write_matches(league, path, MATCH_SCHEMA)
    cat = catalog.Catalog(spark).open_matches(path)
    assert cat.views() == ["matches"] and cat.count() == league.count()
    day = dt.date(2020, 9, 1)
    got = cat.matches(since="2020-09-01", until="2020-09-01", columns=["date", "match_id"])
    assert got.columns == ["match_id", "date"]
    assert {r["date"] for r in got.collect()} <= {day}
    assert cat.matches(competitions=[]).count() == 0
    with pytest.raises(ValueError):
        cat.matches(columns=["nope"])
    with pytest.raises(LookupError):
        cat.ratings()
    with pytest.raises(FileNotFoundError):
        catalog.Catalog(spark).open_matches(path, ratings=str(tmp_path / "none"))
    with pytest.raises(ValueError):
        cat.attach_parquet("Bad Name", path)
    plan = cat.matches(since="2020-09-01", columns=["match_id"])._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(date), GreaterThanOrEqual(date" in plan
    assert catalog.read_report(spark, str(tmp_path / "absent")) is None


def test_manifest_states(spark, tmp_path):
    for name, text in (("a", "1"), ("b", "2"), ("c", "3")):
        (tmp_path / f"{name}.csv").write_text(text)
    before = manifest.build(spark, str(tmp_path)).collect()
    recorded = spark.createDataFrame(before)
    assert {r["path"][-5]: r["sha256"] for r in before} == {
        name: hashlib.sha256(text.encode()).hexdigest() for name, text in (("a", "1"), ("b", "2"), ("c", "3"))
    }
    (tmp_path / "b.csv").write_text("changed")
    (tmp_path / "d.csv").write_text("new")
    now = manifest.build(spark, str(tmp_path)).filter(~F.col("path").endswith("c.csv"))
    states = {r["path"][-5]: r["state"] for r in manifest.verify(recorded, now).collect()}
    assert states == {"a": "unchanged", "b": "changed", "c": "missing", "d": "new"}


def test_prediction_log_appends(spark, tmp_path):
    path = str(tmp_path / "log")
    for day in (1, 2):
        rows = [(f"m{i}", dt.datetime(2024, 1, day, i)) for i in range(3)]
        predictions.record(
            spark.createDataFrame(rows, "match_id string, predicted_at timestamp"), path
        )
    log = predictions.read(spark, path)
    assert log.select("id").distinct().count() == 6
    assert [r["match_id"] for r in predictions.recent(log, 2).collect()] == ["m2", "m1"]


def test_registry_and_feed(spark):
    dims = registry.load(spark)
    assert dims.count() == 39
    with pytest.raises(ValueError):
        registry.load(spark, registry.COMPETITIONS[:1] * 2)
    codes = {r["code"] for r in registry.fixture_divisions(dims).collect()}
    assert "BRA" in codes and "ARG" not in codes and "E0" in codes
    docs = spark.createDataFrame(
        [('{"id": 1, "utcDate": "2026-07-01T23:30:00Z", "status": "TIMED", "competition": '
          '{"code": "PL"}, "homeTeam": {"shortName": "Leeds"}, "score": {"fullTime": {}}}',),
         ('{"id": 2, "status": "21:00", "score": {"fullTime": {"home": null}}}',),
         ('{"id": 3, "status": "POSTPONED"}',)], "json string")
    rows = {r["feed_id"]: r for r in feed.fixtures(docs).collect()}
    assert rows[1]["date"] == dt.date(2026, 7, 2) and rows[1]["kickoff"] == "00:30"
    assert rows[1]["competition_id"] == "ENG_1" and rows[1]["away_short"] is None
    assert rows[2]["upcoming"] and rows[2]["status"] == "scheduled"
    assert not rows[3]["upcoming"] and rows[3]["status"] == "unknown"


def test_season_follows_the_latest_played_row(spark):
    from pitwise.functions.text import season_for

    rows = spark.createDataFrame(
        [("2020-07-20", "2020-07-01", "2019-20", "2019-20"),
         ("2020-09-12", "2020-07-26", "2019-20", "2020-21"),
         ("2026-04-01", "2025-12-01", "2025", "2026"),
         ("2021-05-01", None, None, "2020-21")], "d string, p string, s string, want string")
    got = rows.select(season_for(F.to_date("d"), F.to_date("p"), F.col("s")).alias("x"), "want")
    assert all(r["x"] == r["want"] for r in got.collect())


def test_a_header_that_comes_again_is_a_row(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\nx,y\n3,4\n")
    _, rows = lines.scan_files(spark, str(tmp_path))
    got = sorted((r["fields"]["x"], r["fields"]["y"]) for r in rows.collect())
    assert got == [("1", "2"), ("3", "4"), ("x", "y")]


def test_exact_quantiles_of_several_columns(spark):
    values = [(float(i % 7), None if i % 3 else i * 1e6) for i in range(100)]
    df = spark.createDataFrame([(*v, None) for v in values], "a double, b double, c double")
    got = quantiles.exact_quantiles(df, ["a", "b", "c"])
    assert got == {
        "a": statistics.median(a for a, _ in values),
        "b": statistics.median(b for _, b in values if b is not None),
        "c": None,
    }
