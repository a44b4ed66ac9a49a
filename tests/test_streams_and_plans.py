"""Streams on landed files, exact quantiles under skew, and the shape of plans."""

import datetime as dt

import __spark_entry__ as entry
import pytest
from pyspark.sql import functions as F

from pitwise.operators import attribution, calibrate, features, models
from pitwise.operators.quantiles import exact_median, exact_quantile
from pitwise.schema import KEY
from pitwise.session import scratch_path
from pitwise.streaming import live, log


def _land(spark, rows, schema):
    root = scratch_path(spark, "looks")
    for row in rows:
        spark.createDataFrame([row] if isinstance(row, tuple) else row, schema).coalesce(
            1).write.mode("append").parquet(root)
    return root


def test_live_events(spark):
    t = dt.datetime(2026, 9, 5, 15)

    def look(minute, *matches):
        return [(t + dt.timedelta(minutes=minute), m, "ENG_1", f"H{m}", f"A{m}", "live", hg, ag)
                for m, hg, ag in matches]

    looks = [look(0, ("old", 1, 0)), look(1, ("old", 1, 0), ("new", 0, 0)), look(2, ("new", 1, 0)),
             look(10, ("other", 0, 0)), look(20, ("other", 0, 0)), look(30, ("other", 0, 0))]
    root = _land(spark, looks, live.LOOK)
    stream = log.read_files(spark, root, live.LOOK, per_trigger=1)
    out, offsets = scratch_path(spark, "events"), scratch_path(spark, "offsets")
    log.append_to(live.events(stream, t, 120), out, offsets).awaitTermination()
    got = {(r[KEY], r["kind"]) for r in spark.read.parquet(out).collect()}
    assert got == {("new", "kick_off"), ("new", "goal"), ("old", "full_time"),
                   ("new", "full_time"), ("other", "kick_off"), ("other", "full_time")}


def _seen(spark, minutes, per_trigger, gone=300):
    """Events of one contest looked at in these minutes, cut into micro-batches of some looks."""
    t = dt.datetime(2026, 9, 5, 15)
    looks = [(t + dt.timedelta(minutes=m), "x", "E", "H", "A", "live", g, 0) for m, g in minutes]
    root = _land(spark, [looks[k:k + per_trigger] for k in range(0, len(looks), per_trigger)], live.LOOK)
    stream = live.events(log.read_files(spark, root, live.LOOK, per_trigger=1), "2000-01-01", gone)
    out, offsets = scratch_path(spark, "events"), scratch_path(spark, "offsets")
    query = log.append_to(stream, out, offsets)
    query.awaitTermination()
    rows = spark.read.schema(live.EVENT).parquet(out).orderBy("seen_at", "kind").collect()
    return [(r["kind"], (r["seen_at"] - t).seconds // 60, r["home_goals"]) for r in rows], query


def test_live_events_do_not_depend_on_how_looks_fall_into_batches(spark):
    minutes = [(0, 0), (1, 0), (2, 1), (2, 1), (9, 1), (10, 2), (11, 1), (30, 0)]
    want = [("kick_off", 0, 0), ("full_time", 2, 1), ("goal", 2, 1), ("kick_off", 9, 1),
            ("goal", 10, 2), ("full_time", 11, 1), ("goal", 11, 1), ("kick_off", 30, 0)]
    for size in (1, 3, 8):
        got, query = _seen(spark, minutes, size)
        assert got == want, size
    held = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert held <= 3  # the contest in play and its timer; those that are over left nothing


def test_late_contests_are_refused_and_move_nothing(spark, league):
    from pitwise.operators import elo
    from pitwise.streaming import elo as stream_elo

    day = dt.date(2020, 11, 1)
    root = scratch_path(spark, "arrivals")
    early, after = league.filter(F.col("date") < F.lit(day)), league.filter(F.col("date") >= F.lit(day))
    late = early.limit(7).withColumn(KEY, F.concat(F.lit("late"), KEY))
    for part in (early, after, late):
        part.coalesce(1).write.mode("append").parquet(root)
    out, offsets = scratch_path(spark, "rated"), scratch_path(spark, "offsets")
    stream = stream_elo.rate_stream(log.read_files(spark, root, league.schema, per_trigger=1))
    log.append_to(stream, out, offsets).awaitTermination()
    got = {r[KEY]: r for r in spark.read.parquet(out).collect()}
    assert sum(r["late"] for r in got.values()) == 7 and len(got) == league.count() + 7
    for r in elo.rate(league).collect():
        assert got[r[KEY]]["elo_home"] == r["elo_home"] and got[r[KEY]]["elo_away_played"] == r["elo_away_played"]


def test_unsettled_forecasts_come_out_without_a_result(spark):
    t = dt.datetime(2026, 1, 1)
    told = [(f"m{k}", t + dt.timedelta(days=k)) for k in range(40)]
    left, right = scratch_path(spark, "told"), scratch_path(spark, "settled")
    spark.createDataFrame(told, f"{KEY} string, predicted_at timestamp").write.parquet(left)
    spark.createDataFrame([(m, "H", at + dt.timedelta(days=2)) for m, at in told[::3]],
                          f"{KEY} string, result string, settled_at timestamp").write.parquet(right)
    joined = log.resolve_stream(
        log.read_files(spark, left, f"{KEY} string, predicted_at timestamp"),
        log.read_files(spark, right, f"{KEY} string, result string, settled_at timestamp"))
    out, offsets = scratch_path(spark, "out"), scratch_path(spark, "offsets")
    log.append_to(joined, out, offsets).awaitTermination()
    got = {r[KEY]: r["result"] for r in spark.read.parquet(out).collect()}
    assert {m for m, r in got.items() if r} == {m for m, _ in told[::3]}
    assert {m for m, r in got.items() if not r} == {f"m{k}" for k in range(28) if k % 3}


def test_exact_quantiles_with_a_hot_value(spark):
    values = [7.0] * 500 + [float(i) / 3 for i in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    ordered = sorted(values)
    n = len(ordered)
    for q in (0.0, 0.1, 0.5, 0.9, 1.0):
        place = q * (n - 1)
        low = int(place)
        want = ordered[low] + (ordered[min(low + 1, n - 1)] - ordered[low]) * (place - low)
        assert exact_quantile(df, "v", q) == pytest.approx(want, abs=1e-12)
    assert exact_median(df.limit(0), "v") is None


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_feature_plan_has_no_pairwise_join_and_reduces_before_the_shuffle(league):
    plan = _plan(features.build(league))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert plan.count("WindowGroupLimit") >= 2  # one before and one after the exchange


def test_registered_queries_and_oracles_agree_on_names(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 90
    out = entry.entry(spark)
    assert out.count() == 1500


def test_temperature_recovers_a_known_flattening(spark):
    n = 3000
    df = spark.range(n).select(
        F.lit("m").alias("forecaster"),
        F.lit(0.7).alias("prob_home"), F.lit(0.2).alias("prob_draw"), F.lit(0.1).alias("prob_away"),
        F.when(F.col("id") < n * 0.5, "H").when(F.col("id") < n * 0.78, "D").otherwise("A").alias(
            "result"),
    )
    got = calibrate.fit_temperatures(df, ["forecaster"]).first()["temperature"]
    direct = min((sum(-w * __import__("math").log(p ** (1 / t) / sum(x ** (1 / t) for x in
                  (0.7, 0.2, 0.1))) for w, p in ((0.5, 0.7), (0.28, 0.2), (0.22, 0.1))), t)
                 for t in [0.2 + i * 0.001 for i in range(4800)])[1]
    assert got == pytest.approx(direct, abs=2e-3)
    assert calibrate.fit_temperatures(df.limit(100), ["forecaster"]).first()["temperature"] == 1.0


@pytest.fixture(scope="module")
def frame(spark):
    """A table where only the first block decides the outcome."""
    n = F.col("id")
    x = (n * 37 % 101) / 101.0
    cols = ["elo_home", "home_form_points_5"]
    return spark.range(1200).select(
        F.format_string("m%05d", n).alias(KEY), F.lit("X_1").alias("competition_id"),
        F.date_add(F.lit("2020-01-01").cast("date"), (n / 4).cast("int")).alias("date"),
        x.alias(cols[0]), ((n * 53 % 89) / 89.0).alias(cols[1]),
        F.when(x > 0.6, "H").when(x > 0.4, "D").otherwise("A").alias("result"),
    )


def test_models_learn_and_attributions_find_the_block(frame):
    columns = ("elo_home", "home_form_points_5")
    fitted = models.logistic_regression(columns, C=100.0, max_iter=50).fit(frame)
    stated = fitted.forecast(frame)
    assert stated.filter("prob_home + prob_draw + prob_away BETWEEN 0.999999 AND 1.000001").count() == 1200
    blocks = {"elo": ("elo_home",), "form": ("home_form_points_5",)}
    table = {r["block"]: r["delta_log_loss"]
             for r in attribution.permutation_importance(fitted, frame, blocks, 2).collect()}
    assert table["elo"] > 0.3 and abs(table["form"]) < 0.05
    shares = {r["block"]: r["share"]
              for r in attribution.block_attribution(fitted, frame, blocks).collect()}
    assert shares["elo"] > 0.9
    mixed = attribution.shuffle_block(frame, ["elo_home"], 7, bucket_rows=100)
    assert mixed.count() == 1200
    assert mixed.agg(F.sum("elo_home")).first()[0] == pytest.approx(
        frame.agg(F.sum("elo_home")).first()[0])


def test_class_missing_from_training_gets_zero(frame):
    fitted = models.random_forest(("elo_home",), trees=3, depth=3, leaf=5).fit(
        frame.filter("result <> 'A'"))
    assert fitted.forecast(frame).filter("prob_away <> 0").count() == 0


def test_temperatures_are_tried_by_compiled_code(spark, monkeypatch):
    """One loss a row and temperature, none of them in a function over arrays; with and without groups."""
    seen, wrapped = [], calibrate.S.log_loss
    monkeypatch.setattr(calibrate.S, "log_loss", lambda *a: seen.append(1) or wrapped(*a))
    monkeypatch.setattr(calibrate.F, "transform", lambda *a: pytest.fail("interpreted"))
    df = spark.range(800).select(
        F.lit("f").alias("forecaster"), F.lit(0.6).alias("prob_home"), F.lit(0.3).alias("prob_draw"),
        F.lit(0.1).alias("prob_away"), F.when(F.col("id") % 2 == 0, "H").otherwise("D").alias("result"),
    )
    grouped = calibrate.fit_temperatures(df, ["forecaster"]).first()
    alone = calibrate.fit_temperatures(df).first()
    assert grouped["temperature"] == alone["temperature"] and alone["n"] == 800
    assert len(seen) == 12  # one for each round
