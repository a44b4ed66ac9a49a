"""Column functions on small hand-written rows."""

import math

import pytest
from pyspark.sql import functions as F

from pitwise.functions import scoring as S
from pitwise.functions import text as X
from pitwise.operators import clean

P = ["h", "d", "a"]


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or ["id"])
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "p, result, loss, rps, hit",
    [
        ((1 / 3, 1 / 3, 1 / 3), "H", math.log(3), 5 / 18, 1.0),
        ((1.0, 0.0, 0.0), "H", 0.0, 0.0, 1.0),
        ((1.0, 0.0, 0.0), "A", math.inf, 1.0, 0.0),
        ((0.0, 0.5, 0.5), "A", math.log(2), 0.125, 0.0),
    ],
)
def test_terms(spark, p, result, loss, rps, hit):
    v = dict(zip(P, p), r=result)
    assert one(spark, S.log_loss(P, "r"), **v) == pytest.approx(loss)
    assert one(spark, S.rps(P, "r"), **v) == pytest.approx(rps)
    assert one(spark, S.hit(P, "r"), **v) == hit


@pytest.mark.parametrize("p, want", [(0.0, 0), (0.3, 2), (0.6, 5), (0.1, 1), (1.0, 9), (0.95, 9)])
def test_bins_follow_the_edges(spark, p, want):
    assert one(spark, S.reliability_bin(F.col("p")), p=p) == want


@pytest.mark.parametrize(
    "gap, want", [(0.0, "<2%"), (0.02, "<2%"), (0.0201, "2-5%"), (0.2, "10-20%"), (0.9, ">20%"),
                  (math.inf, None), (math.nan, None)],
)
def test_bands_are_closed_on_the_right(spark, gap, want):
    assert one(spark, S.band(F.col("g")), g=gap) == want


def test_market_and_blend(spark):
    odds = {"o1": 2.0, "o2": 3.4, "o3": 3.5}
    got = [one(spark, c, **odds) for c in S.implied(list(odds))]
    assert sum(got) == pytest.approx(1.0)
    assert one(spark, S.implied(list(odds))[0], o1=1.0, o2=3.0, o3=3.0) is None
    mixed = S.blend([P, ["x", "y", "z"]])
    assert one(spark, mixed[0], h=0.5, d=0.3, a=0.2, x=None, y=0.1, z=0.2) is None


def test_temper_keeps_nulls_and_sums(spark):
    got = [one(spark, c, h=0.7, d=0.2, a=0.1) for c in S.temper(P, 2.0)]
    assert sum(got) == pytest.approx(1.0) and got[0] < 0.7


def test_sample_sizes(spark):
    want = {0.05: 243, 0.0163: 2286, 0.01: 6073}
    for d, n in want.items():
        assert one(spark, S.needed(F.lit(0.3976), F.lit(d))) in (n - 1, n, n + 1)
    assert one(spark, S.detectable(F.lit(0.4), F.lit(0))) == math.inf


@pytest.mark.parametrize(
    "text, want",
    [("03/09/93", "1993-09-03"), ("03/09/2021", "2021-09-03"), ("3/9/68", "2068-09-03"),
     ("01/01/69", "1969-01-01"), ("", None), ("31/02/2020", None), ("2020-01-01", None)],
)
def test_dates(spark, text, want):
    got = one(spark, X.parse_date(F.col("t")), t=text)
    assert (got.isoformat() if got else None) == want


@pytest.mark.parametrize(
    "text, want", [("2.0", 2), ("x", None), ("", None), (" 7 ", 7), ("2d", None), ("1e1", 10)]
)
def test_integers(spark, text, want):
    assert one(spark, X.parse_int(F.col("t")), t=text) == want


@pytest.mark.parametrize(
    "text, want",
    [("2024", "2024"), ("2024/2025", "2024-25"), ("2024/25", "2024-25"), ("1999/00", "1999-00"),
     ("2024/26", None), ("24/25", None)],
)
def test_seasons(spark, text, want):
    assert one(spark, X.normalise_season(F.col("t")), t=text) == want


def test_season_codes(spark):
    assert one(spark, X.season_code_to_label(F.lit("2425"))) == "2024-25"
    assert one(spark, X.season_code_to_label(F.lit("9394"))) == "1993-94"
    assert one(spark, X.season_code_to_label(F.lit("2426"))) is None
    assert one(spark, X.season_label_to_code(F.lit("2024-25"))) == "2425"


def test_names_and_ids(spark):
    assert one(spark, X.slugify(F.lit(" Beşiktaş "))) == "besiktas"
    assert one(spark, X.slugify(F.lit("1. FC Köln"))) == "1-fc-koln"
    assert one(spark, X.slugify(F.lit("--"))) is None
    assert one(spark, X.team_id(F.lit("ENG_1"), F.lit("Man United"))) == "eng:man-united"
    assert one(spark, X.club_words(F.lit("Brighton & Hove Albion FC"))) == [
        "brighton", "hove", "albion"]
    assert one(spark, X.feed_words(F.lit("Nott'm Forest"))) == ["nottm", "forest"]
    import hashlib

    key = "p|ENG_1|2024-25|2024-08-17|A|B"
    got = one(
        spark,
        X.match_id(F.lit("p"), F.lit("ENG_1"), F.lit("2024-25"), F.lit("2024-08-17").cast("date"),
                   F.lit("A"), F.lit("B")),
    )
    assert got == hashlib.blake2b(key.encode(), digest_size=8).hexdigest()


def test_odds_triples_stay_whole(spark):
    best = S.best_triple([[F.lit(2.0), F.lit(None).cast("double"), F.lit(3.0)],
                          [F.lit(2.1), F.lit(3.1), F.lit(3.9)]])
    assert tuple(one(spark, best)) == (2.1, 3.1, 3.9)
    bad = F.struct(F.lit(2.39).alias("home"), F.lit(5.72).alias("draw"), F.lit(10.84).alias("away"))
    assert one(spark, S.plausible_triple(bad)) is None


def test_first_per_key_is_by_order(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", 5)], "k string, v int")
    got = {r["k"]: r["v"] for r in clean.first_per_key(df, ["k"], [F.col("v")]).collect()}
    assert got == {"a": 1, "b": 5}
