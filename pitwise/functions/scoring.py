"""Per-row scoring of three-class forecasts, and the market arithmetic."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class order, tolerance, bands.
SUM_TOLERANCE = 1e-6 + 1e-5  # absolute plus relative part, against a total of one
BAND_EDGES = (0.02, 0.05, 0.10, 0.20)
BAND_LABELS = ("<2%", "2-5%", "5-10%", "10-20%", ">20%")
MIN_PLAUSIBLE_BOOK = 0.99
CONFIDENCE = 0.95


def _cols(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def log_loss(probs, result) -> Column:
    """Minus log of the stated probability of what happened; certain and wrong is infinite."""
    h, d, a = _cols(probs)
    res = F.col(result) if isinstance(result, str) else result
    p = F.when(res == "H", h).when(res == "D", d).when(res == "A", a)
    return F.when(p == 0.0, F.lit(math.inf)).otherwise(-F.log(p))


def rps(probs, result) -> Column:
    """Ranked probability score over the ordered classes H, D, A."""
    h, d, _ = _cols(probs)
    res = F.col(result) if isinstance(result, str) else result
    first = F.when(res == "H", 1.0).otherwise(0.0)
    second = F.when(res.isin("H", "D"), 1.0).otherwise(0.0)
    value = ((h - first) * (h - first) + (h + d - second) * (h + d - second)) / 2.0
    return F.when(res.isNotNull(), value)


def modal_class(probs) -> Column:
    """The likeliest class; a tie goes to the earlier of H, D, A."""
    h, d, a = _cols(probs)
    return F.when(h.isNull() | d.isNull() | a.isNull(), F.lit(None).cast("string")).otherwise(
        F.when((h >= d) & (h >= a), "H").when(d >= a, "D").otherwise("A")
    )


def hit(probs, result) -> Column:
    res = F.col(result) if isinstance(result, str) else result
    return F.when(modal_class(probs) == res, 1.0).when(
        modal_class(probs).isNotNull() & res.isNotNull(), 0.0
    )


def confidence(probs) -> Column:
    """The modal class and the probability stated for it."""
    return F.when(
        modal_class(probs).isNotNull(),
        F.struct(
            modal_class(probs).alias("outcome"), F.greatest(*_cols(probs)).alias("probability")
        ),
    )


def is_priced(probs) -> Column:
    h, d, a = _cols(probs)
    return h.isNotNull() & d.isNotNull() & a.isNotNull()


def is_valid_forecast(probs) -> Column:
    """All three present, each within [0, 1], together one within the tolerance."""
    cols = _cols(probs)
    inside = is_priced(cols)
    for c in cols:
        inside = inside & (c >= 0.0) & (c <= 1.0)
    total = cols[0] + cols[1] + cols[2]
    return F.coalesce(inside & (F.abs(total - 1.0) <= SUM_TOLERANCE), F.lit(False))


def _usable_prices(odds) -> Column:
    ok = F.lit(True)
    for c in _cols(odds):
        ok = ok & c.isNotNull() & ~F.isnan(c) & (c > 1.0) & (c < math.inf)
    return F.coalesce(ok, F.lit(False))


def implied(odds) -> list[Column]:
    """Decimal prices as probabilities with the margin removed in proportion.

    One missing or impossible price makes the whole triple null.
    """
    h, d, a = _cols(odds)
    total = 1.0 / h + 1.0 / d + 1.0 / a
    ok = _usable_prices(odds)
    return [F.when(ok, (1.0 / c) / total) for c in (h, d, a)]


def margin(odds) -> Column:
    """How far a book's prices add up beyond certainty."""
    h, d, a = _cols(odds)
    return F.when(_usable_prices(odds), 1.0 / h + 1.0 / d + 1.0 / a - 1.0)


def best_triple(candidates) -> Column:
    """The first complete triple of prices, as a struct; null when none is complete."""
    out = []
    for triple in candidates:
        h, d, a = _cols(triple)
        out.append(
            F.when(
                h.isNotNull() & d.isNotNull() & a.isNotNull(),
                F.struct(h.alias("home"), d.alias("draw"), a.alias("away")),
            )
        )
    return F.coalesce(*out)


def plausible_triple(triple: Column) -> Column:
    """Null a triple whose implied sum falls below a real book's."""
    h, d, a = triple["home"], triple["draw"], triple["away"]
    nonzero = (h != 0.0) & (d != 0.0) & (a != 0.0)
    book = F.when(nonzero, F.try_divide(F.lit(1.0), h) + F.try_divide(F.lit(1.0), d)
                  + F.try_divide(F.lit(1.0), a))
    return F.when(book >= MIN_PLAUSIBLE_BOOK, triple)


def distance(left, right) -> Column:
    """Total-variation distance between two forecasts of one match."""
    parts = [F.abs(x - y) for x, y in zip(_cols(left), _cols(right), strict=True)]
    return (parts[0] + parts[1] + parts[2]) / 2.0


def band(gap: Column) -> Column:
    """Right-closed band of a distance; not a finite number gives null."""
    expr = F.when(gap.isNull() | F.isnan(gap) | (F.abs(gap) == math.inf), F.lit(None))
    for edge, label in zip(BAND_EDGES, BAND_LABELS, strict=False):
        expr = expr.when(gap <= edge, F.lit(label))
    return expr.otherwise(F.lit(BAND_LABELS[-1]))


def bin_edges(bins: int) -> list[float]:
    """Equal-width edges of [0, 1] computed as ``i * (1 / bins)``, last one exact."""
    step = 1.0 / bins
    return [i * step for i in range(bins)] + [1.0]


def reliability_bin(p: Column, bins: int = 10) -> Column:
    """Zero-based bin of a stated probability; the last bin is closed at one."""
    interior = bin_edges(bins)[1:-1]
    if not interior:
        return F.when(p.isNotNull(), F.lit(0))
    expr = F.when(p.isNull(), F.lit(None).cast("int"))
    for i, edge in enumerate(interior):
        expr = expr.when(p < F.lit(edge), F.lit(i))
    return expr.otherwise(F.lit(len(interior)))


def temper(probs, temperature) -> list[Column]:
    """``p ** (1/T)`` renormalised; nulls stay null."""
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    powered = [F.pow(c, 1.0 / t) for c in _cols(probs)]
    total = powered[0] + powered[1] + powered[2]
    return [p / total for p in powered]


def blend(members) -> list[Column]:
    """Mean of several forecasts of one row; any missing member leaves it unpriced."""
    members = [_cols(m) for m in members]
    out = []
    ready = F.lit(True)
    for m in members:
        ready = ready & is_priced(m)
    for i in range(3):
        total = members[0][i]
        for m in members[1:]:
            total = total + m[i]
        out.append(F.when(ready, total / float(len(members))))
    return out


def z_value(level: float = CONFIDENCE) -> float:
    return NormalDist().inv_cdf(1.0 - (1.0 - level) / 2.0)


def detectable(spread: Column, n: Column, level: float = CONFIDENCE) -> Column:
    """Smallest shift of a mean loss ``n`` forecasts tell from noise."""
    return F.when(n <= 0, F.lit(math.inf)).otherwise(
        F.when(spread.isNotNull() & ~F.isnan(spread), z_value(level) * spread / F.sqrt(n))
    )


def needed(spread: Column, difference: Column, level: float = CONFIDENCE) -> Column:
    """How many scored forecasts show a shift of ``difference``."""
    return F.ceil(F.pow(z_value(level) * spread / difference, F.lit(2.0))).cast("bigint")


def points(goals_for: Column, goals_against: Column) -> Column:
    """Three, one or none; null where there is no score."""
    return (
        F.when(goals_for.isNull() | goals_against.isNull(), F.lit(None).cast("double"))
        .when(goals_for > goals_against, 3.0)
        .when(goals_for == goals_against, 1.0)
        .otherwise(0.0)
    )


def outcome(home: Column, away: Column) -> Column:
    """H, D or A from a score; null without one."""
    return (
        F.when(home.isNull() | away.isNull(), F.lit(None).cast("string"))
        .when(home > away, "H")
        .when(home < away, "A")
        .otherwise("D")
    )


def letter(result: Column, is_home: Column) -> Column:
    """W, D or L from one side's view; no result reads as D."""
    return (
        F.when(result == "D", "D")
        .when(((result == "H") & is_home) | ((result == "A") & ~is_home), "W")
        .when(result.isin("H", "A"), "L")
        .otherwise("D")
    )


def expected_score(home: Column, away: Column, advantage=80.0, scale=400.0) -> Column:
    """Expected home score on the 1 / 0.5 / 0 scale."""
    return 1.0 / (1.0 + F.pow(F.lit(10.0), -(home + advantage - away) / scale))


def margin_multiplier(diff: Column, winner_edge: Column, damping=2.2) -> Column:
    """Weight of a result for its margin, damped by the winner's own edge."""
    base = F.when(diff <= 1, 1.0).when(diff == 2, 1.5).otherwise((11.0 + diff) / 8.0)
    return base * (damping / (0.001 * winner_edge + damping))


def decay_weight(as_of: Column, date: Column, rate: float = 0.002) -> Column:
    return F.exp(-F.lit(rate) * F.datediff(as_of, date))


MAX_GOALS = 10


def score_grid(home_rate: Column, away_rate: Column, rho: Column) -> Column:
    """Home, draw and away probabilities from two goal rates and the low-score term.

    Equal to summing the 11 x 11 grid of scores with its four low cells corrected
    and floored at zero: the independent part needs only running sums along the
    two Poisson masses, the correction only four cells. The masses are bound once
    per row, so nothing is evaluated twice.
    """
    factorials = F.array(*[F.lit(math.lgamma(g + 1)) for g in range(MAX_GOALS + 1)])
    goals = F.sequence(F.lit(0), F.lit(MAX_GOALS))

    def mass(rate):
        log_rate = F.log(rate)
        return F.zip_with(goals, factorials, lambda g, lf: F.exp(g * log_rate - rate - lf))

    bound = F.array(
        F.struct(
            F.arrays_zip(mass(home_rate).alias("h"), mass(away_rate).alias("a")).alias("m"),
            home_rate.alias("lam"),
            away_rate.alias("mu"),
            rho.alias("rho"),
        )
    )
    zero = F.struct(*[F.lit(0.0).alias(n) for n in ("below", "win", "draw", "total")])

    def sums(masses):
        return F.aggregate(
            masses,
            zero,
            lambda acc, m: F.struct(
                (acc["below"] + m["a"]).alias("below"),
                (acc["win"] + m["h"] * acc["below"]).alias("win"),
                (acc["draw"] + m["h"] * m["a"]).alias("draw"),
                (acc["total"] + m["h"]).alias("total"),
            ),
        )

    def moved(h, a, factor):
        """What the correction adds to one cell."""
        return F.greatest(h * a * factor, F.lit(0.0)) - h * a

    def corrected(x):
        s, m = x["s"], x["b"]["m"]
        lam, mu, r = x["b"]["lam"], x["b"]["mu"], x["b"]["rho"]
        h0, h1, a0, a1 = m[0]["h"], m[1]["h"], m[0]["a"], m[1]["a"]
        d00 = moved(h0, a0, 1.0 - lam * mu * r)
        d01 = moved(h0, a1, 1.0 + lam * r)
        d10 = moved(h1, a0, 1.0 + mu * r)
        d11 = moved(h1, a1, 1.0 - r)
        return F.struct(
            (s["win"] + d10).alias("win"),
            (s["draw"] + d00 + d11).alias("draw"),
            (s["total"] * s["below"] + d00 + d01 + d10 + d11).alias("total"),
        )

    summed = F.transform(bound, lambda b: F.struct(b.alias("b"), sums(b["m"]).alias("s")))
    cells = F.transform(summed, corrected)
    return F.transform(
        cells,
        lambda c: F.struct(
            (c["win"] / c["total"]).alias("home"),
            (c["draw"] / c["total"]).alias("draw"),
            (1.0 - c["win"] / c["total"] - c["draw"] / c["total"]).alias("away"),
        ),
    )[0]
