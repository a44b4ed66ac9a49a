"""Mixing sources by temperature, in DataFrame operations only.

A source with token share p gets the weight p^a / sum(p^a). The exponent a lies in [0, 1]: 1 keeps
the corpus as it is, 0 makes sources equal. It is found by bisection, six halvings at a time: one
aggregation over the source table evaluates all points that six halvings can visit.

The weights are realised by a token budget for each source. A source is walked in passes; a pass is
a permutation of blocks (ranges of a hash) and of the documents in each block. Whole passes take all
rows, and the last takes the head of its permutation up to the budget. Only block totals are ever
put in order, in two levels; documents are ordered inside their block, however large their source is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitwise.llm.common import words
from pitwise.session import durable

HALVINGS = 6
ROUNDS = 6
#: Tokens that a block holds on average.
BLOCK_TOKENS = 1 << 16
#: Ranges of the block order that are summed before blocks are.
LANES = 1024
NO_SOURCE = ""


def token_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def _with_total(each: DataFrame) -> DataFrame:
    """Token shares added to (source, docs, tokens)."""
    total = each.agg(F.sum("tokens").alias("t")).first().t or 0
    return each.withColumn("share", F.col("tokens") / F.lit(float(max(total, 1))))


def measures(sources: DataFrame, exponents: list[float]) -> list[tuple[float, float, float]]:
    """(exponent, entropy, repetition) at each exponent, in one aggregation over the sources.

    Repetition is how often the most repeated source is passed when the largest need is passed
    once: the ratio of the largest to the smallest weight per token.
    """
    points = F.explode(F.array(*[F.lit(float(a)) for a in exponents])).alias("a")
    grown = sources.where("share > 0").select("share", points).withColumn("w", F.pow("share", "a"))
    rows = grown.groupBy("a").agg(
        F.sum("w").alias("z"),
        F.sum(F.col("w") * F.log("w")).alias("wl"),
        F.max(F.col("w") / F.col("share")).alias("most"),
        F.min(F.col("w") / F.col("share")).alias("least"),
    ).select(
        "a", (F.log("z") - F.col("wl") / F.col("z")).alias("entropy"), (F.col("most") / F.col("least")).alias("repeat"),
    ).collect()
    return sorted((r.a, r.entropy, r.repeat) for r in rows)


def solve_exponent(sources: DataFrame, entropy: float | None = None, repetition: float | None = None) -> float:
    """The exponent at which the mixture has ``entropy`` (in nats) or ``repetition``.

    Both fall as the exponent rises. A target that even equal weights do not exceed gives 0; one
    that the corpus itself exceeds gives 1. Without any token the exponent is 1.
    """
    if (entropy is None) == (repetition is None):
        raise ValueError("give either a target entropy or a repetition limit")
    at = 1 if entropy is not None else 2
    target = entropy if entropy is not None else repetition
    ends = measures(sources, [0.0, 1.0])
    if not ends or ends[1][at] >= target:
        return 1.0
    if ends[0][at] <= target:
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        step = (high - low) / (1 << HALVINGS)
        inner = measures(sources, [low + step * k for k in range(1, 1 << HALVINGS)])
        above = [a for a, *m in inner if m[at - 1] > target]
        low, high = (max(above), max(above) + step) if above else (low, low + step)
    return high


def plan(docs: DataFrame, entropy: float | None = None, repetition: float | None = None,
         budget: int | None = None) -> DataFrame:
    """(source, docs, tokens, weight, budget, passes, rest) for rows (source, tokens).

    ``budget`` is the number of tokens of the mixture; without one it is the smallest that leaves
    no document out. ``passes`` are whole passes and ``rest`` the tokens of the last one.
    """
    sources = durable(_with_total(
        docs.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"))
    ), "mix-sources")
    a = solve_exponent(sources, entropy, repetition)
    grown = sources.withColumn("w", F.when(F.col("share") > 0, F.pow("share", F.lit(a))).otherwise(0.0))
    sums_ = grown.agg(F.sum("w").alias("z"), F.max(F.col("tokens") / F.when(F.col("w") > 0, F.col("w"))).alias("need")).first()
    z = sums_.z or 1.0
    whole = float(budget) if budget is not None else z * (sums_.need or 0.0)
    return (
        grown.withColumn("weight", F.col("w") / z)
        .withColumn("budget", F.greatest(
            F.round(F.col("weight") * whole).cast("long"), F.col("tokens") if budget is None else F.lit(0)
        ))
        .withColumn("exponent", F.lit(a))
        .withColumn("passes", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(
            F.lit(1 if budget is None else 0)).cast("long"))
        .withColumn("rest", F.col("budget") - F.col("passes") * F.col("tokens"))
        .select("source", "docs", "tokens", "weight", "exponent", "budget", "passes", "rest")
    )


def mix(docs: DataFrame, entropy: float | None = None, repetition: float | None = None,
        budget: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 11) -> DataFrame:
    """The rows of the mixture: every column of ``docs``, and these.

    ``mix_pass`` (0, 1, ...: which pass of its source), ``mix_block`` (place of the block in that
    pass), ``mix_key`` (0 to 1: ordering by it interleaves the sources by weight, and every part
    of the order holds about the target shares), ``mix_weight`` and ``mix_tokens``.

    A document belongs to the last pass if the tokens before it in the permutation are fewer than
    the rest of the budget, so a source exceeds its budget by less than one document. Sources with
    no tokens are taken once if no budget is given, else left out. A null source is a source of
    its own, as is the empty one; null and empty texts have no tokens and follow the document they are
    next to in the permutation. Repeated rows count as rows of their own. An empty table gives
    none. Columns named like the added ones, in any case, are replaced.
    """
    added = ("mix_pass", "mix_block", "mix_key", "mix_weight", "mix_tokens")
    columns = [c for c in docs.columns if c.lower() not in added]
    name = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(NO_SOURCE))
    base = durable(docs.select(
        F.struct(*columns).alias("row"), name.alias("source"), token_count(F.col("text")).alias("tokens"),
        F.xxhash64(F.lit(seed), F.col("doc_id")).alias("h"), F.xxhash64(F.col("text")).alias("tie"),
    ), "mix-rows")
    sized = base.select("source", "tokens")
    quotas = durable(plan(sized, entropy, repetition, budget), "mix-quotas")
    parts = F.greatest(F.ceil(F.col("q_tokens") / F.lit(float(block_tokens))), F.lit(1))
    quota = quotas.select(
        F.col("source").alias("q_source"), F.col("tokens").alias("q_tokens"), "weight", "budget", "passes", "rest"
    ).withColumn("parts", parts.cast("long"))
    block = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("h")), F.col("parts"))
    last = F.col("passes")
    placed = base.join(quota, F.col("source") == F.col("q_source")).withColumn("block", block)
    # one row per block; every pass, the last part of one too, has an order of its own
    sizes_ = durable(placed.groupBy("source", "block").agg(
        F.sum("tokens").alias("b_tokens"), F.max("passes").alias("passes"), F.max("rest").alias("rest")
    ), "mix-blocks")
    rounds = F.col("passes") + F.when(F.col("rest") > 0, 1).otherwise(0)
    totals = (
        sizes_.where(rounds > 0)
        .select("source", "block", "b_tokens", F.explode(F.sequence(F.lit(0).cast("long"), rounds - 1)).alias("pass"))
        .withColumn("turn", F.xxhash64(F.lit(seed + 2), F.col("source"), F.col("block"), F.col("pass")))
        .withColumn("lane", F.pmod("turn", F.lit(LANES)))
    )
    ahead = Window.rowsBetween(Window.unboundedPreceding, -1)
    lanes = totals.groupBy("source", "pass", "lane").agg(F.sum("b_tokens").alias("l_tokens"), F.count("*").alias("l_blocks"))
    by_lane = ahead.partitionBy("source", "pass").orderBy("lane")
    lanes = lanes.select(
        "source", "pass", "lane", F.coalesce(F.sum("l_tokens").over(by_lane), F.lit(0)).alias("l_before"),
        F.coalesce(F.sum("l_blocks").over(by_lane), F.lit(0)).alias("l_place"),
        F.sum("l_blocks").over(Window.partitionBy("source", "pass")).alias("b_count"),
    )
    by_turn = Window.partitionBy("source", "pass", "lane").orderBy("turn", "block")
    # written, so that its size is known before documents meet it
    heads = durable(totals.join(lanes, ["source", "pass", "lane"]).select(
        F.col("source").alias("b_source"), F.col("block").alias("b_block"), F.col("pass").alias("b_pass"), "b_count",
        (F.col("l_place") + F.row_number().over(by_turn) - 1).alias("b_place"),
        (F.col("l_before") + F.sum("b_tokens").over(by_turn) - F.col("b_tokens")).alias("b_before"),
    ), "mix-heads")
    here = (F.col("source") == F.col("b_source")) & (F.col("block") == F.col("b_block"))
    # blocks that begin beyond the budget need no order inside
    partial = placed.where("rest > 0").join(heads, here & (F.col("passes") == F.col("b_pass"))).where("b_before < rest")
    inside = Window.partitionBy("source", "block").orderBy(
        F.xxhash64(F.lit(seed + 3), F.col("h"), F.col("passes")), "h", "tie"
    ).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("b_before") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))
    tail = partial.withColumn("before", before).where("before < rest").select(
        "row", last.alias("mix_pass"), F.col("b_place").alias("mix_block"),
        ((F.col("passes") * F.col("q_tokens") + F.col("before")) / F.greatest("budget", F.lit(1))).alias("mix_key"),
        F.col("weight").alias("mix_weight"), F.col("tokens").alias("mix_tokens"),
    )
    # whole passes: each document once in each, in its block's place and at a point in it drawn by hash
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes") - 1)).alias("mix_pass")
    full = placed.where("passes > 0").select("row", "source", "block", "h", "q_tokens", "budget", "weight", "tokens", each)
    full = full.join(heads, here & (F.col("mix_pass") == F.col("b_pass")))
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed + 4), F.col("h"), F.col("mix_pass")), 11)).cast("double") / float(1 << 53)
    whole = full.select(
        "row", "mix_pass", F.col("b_place").alias("mix_block"),
        ((F.col("mix_pass") + (F.col("b_place") + u) / F.col("b_count")) * F.col("q_tokens") / F.greatest("budget", F.lit(1))).alias("mix_key"),
        F.col("weight").alias("mix_weight"), F.col("tokens").alias("mix_tokens"),
    )
    return whole.unionByName(tail).select(*[F.col("row")[c].alias(c) for c in columns], *added)
