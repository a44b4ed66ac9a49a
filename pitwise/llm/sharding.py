"""Balanced label propagation over groups of linked documents, in DataFrame operations only.

Documents with equal texts are linked. Every document starts in a shard drawn by hash. In a round,
each linked group asks to gather in the shard where most of it already lies; the shards admit
groups, those first that would leave most links uncut, up to the rows they have room for. A group
that has been refused asks its next best shard. Rounds repeat until no group asks. A last step makes the counts exact: documents are lined up by
shard and group, and the line is cut at equal counts, so only groups at a cut, or larger than a
shard, are in two shards.

Groups are held as (group, shard, rows), never as members or pairs. The line is counted in three
levels (cells of a hash range, sub-cells of a group, rows), so no shard or group is put in order by
one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitwise.session import durable

SHARDS = 24
#: Hash ranges that a shard's queue is counted in, and cells of the line.
LANES = 32
CELLS = 512
#: Rows of the table for each part that a group's rows are numbered in, beyond the first parts.
SALT_ROWS = 1 << 18
LEAST_SALTS = 64
LAW = "rows"


def _hash_to(column, n: int, seed: int):
    return F.pmod(F.xxhash64(F.lit(seed), column), F.lit(n)).cast("int")


def _admit(offers: DataFrame, room: float, load: list[float]) -> tuple[list[DataFrame], list[float]]:
    """Tables of (group, home, total) that shards admit, and the rows each shard then holds.

    ``offers`` holds (group, shard, n, total): the labels a group may take, those of most rows first.
    A group that its best label has no room for is offered its next; one that only stands too far
    back in a queue asks again. The head of a queue always fits, so every round settles something.
    """
    left, homes, load = durable(offers, "shard-offers"), [], list(load)
    while not left.isEmpty():
        free = F.array(*[F.lit(float(max(0.0, room - x))) for x in load])
        asked = left.groupBy("group").agg(
            F.max_by("shard", F.struct("n", -F.col("shard"))).alias("to"), F.max("n").alias("there"),
            F.max("total").alias("total"),
        ).withColumn("free", F.element_at(free, F.col("to") + 1))
        # those first that would cut most links: by powers of two, by hash within, then in order
        asked = durable(asked.withColumn("level", -F.floor(F.log2(F.col("there") + 1))).withColumn(
            "lane", _hash_to(F.col("group"), LANES, 5)
        ), "shard-asked")
        fit = asked.where("total <= free")
        before = Window.partitionBy("to").orderBy("level", "lane").rowsBetween(Window.unboundedPreceding, -1)
        lanes = fit.groupBy("to", "level", "lane").agg(F.sum("total").alias("lane_n"))
        starts = lanes.select("to", "level", "lane", F.coalesce(F.sum("lane_n").over(before), F.lit(0)).alias("start"))
        queue = Window.partitionBy("to", "level", "lane").orderBy(F.desc("there"), "group").rowsBetween(Window.unboundedPreceding, 0)
        moves = durable(
            fit.withColumn("upto", F.sum("total").over(queue)).join(starts, ["to", "level", "lane"])
            .where(F.col("start") + F.col("upto") <= F.col("free"))
            .select("group", F.col("to").alias("home"), "total"), "shard-moves",
        )
        homes.append(moves)
        for r in moves.groupBy("home").agg(F.sum("total").alias("n")).collect():
            load[r.home] += r.n
        refused = asked.where("total > free").select("group", F.col("to").alias("shard"))
        left = durable(
            left.join(moves.select("group"), "group", "left_anti").join(refused, ["group", "shard"], "left_anti"), "shard-offers"
        )
    return homes, load


def propagate(cells: DataFrame, room: float, shards: int = SHARDS) -> DataFrame:
    """(group, home) after label propagation over (group, shard, n) rows of linked groups.

    ``room`` is the linked rows that a shard may hold. A group takes the label of most of its rows
    that has room, else any shard that has; one that fits in none stays with its first label, and
    the cut at equal counts splits it.
    """
    cells = durable(cells, "shard-cells")
    totals = durable(cells.groupBy("group").agg(
        F.sum("n").alias("total"), F.max_by("shard", F.struct("n", -F.col("shard"))).alias("first")
    ), "shard-groups")
    homes, load = _admit(cells.join(totals.select("group", "total"), "group"), room, [0.0] * shards)
    settled = reduce(DataFrame.unionByName, homes, totals.select("group", F.col("first").alias("home"), "total").where("false"))
    rest = totals.join(settled.select("group"), "group", "left_anti")
    free = F.array(*[F.lit(float(max(0.0, room - x))) for x in load])
    anywhere = rest.select("group", "total", F.posexplode(free).alias("shard", "free")).where("total <= free")
    ranked = anywhere.select("group", "shard", F.pmod(F.xxhash64("group", "shard"), F.lit(1 << 20)).alias("n"), "total")
    more, _ = _admit(ranked, room, load)
    settled = reduce(DataFrame.unionByName, more, settled)
    return totals.join(settled.select("group", "home"), "group", "left").select("group", F.coalesce("home", "first").alias("home"))


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row.

    Shards differ by one row at most; ``slot`` counts a shard's rows from 0; ``grown_shard`` is
    null, as this law does not keep rows in place when a shard is added. ``size`` is the bytes of
    the text and 8. A null text counts as empty. Rows of equal text are one group whatever their
    ids, and rows that agree in id and text are interchangeable. An empty table gives no row. Only ``doc_id`` and
    ``text`` are read.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = durable(docs.select(
        "doc_id", (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        F.unhex(F.sha2(raw, 256)).alias("group"),
    ), "shard-rows")
    n = rows.count()
    rows = rows.withColumn("salt", _hash_to(F.col("doc_id"), LEAST_SALTS + n // SALT_ROWS, 3))
    drawn = _hash_to(F.col("doc_id"), shards, 1)
    cells = rows.groupBy("group", drawn.alias("shard")).agg(F.count("*").alias("n"))
    linked = rows.groupBy("group").agg(F.count("*").alias("members")).where("members > 1")
    homes = propagate(cells.join(linked.select("group"), "group", "left_semi"), 1.02 * n / shards * _share(linked, n), shards)
    # sub-cells: the rows of a group under one salt, in the order of the line
    parts = rows.groupBy("group", "salt").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"))
    placed = parts.join(homes, "group", "left").withColumn(
        "home", F.coalesce("home", _hash_to(F.col("low"), shards, 1))
    ).withColumn("cell", _hash_to(F.col("group"), CELLS, 7)).select("group", "salt", "n", "home", "cell")
    totals = placed.groupBy("home", "cell").agg(F.sum("n").alias("cell_n"))
    line = Window.orderBy("home", "cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("home", "cell", F.coalesce(F.sum("cell_n").over(line), F.lit(0)).alias("cell_start"))
    within = Window.partitionBy("home", "cell").orderBy("group", "salt").rowsBetween(Window.unboundedPreceding, -1)
    heads = placed.withColumn("before", F.coalesce(F.sum("n").over(within), F.lit(0))).join(starts, ["home", "cell"]).select(
        "group", "salt", (F.col("cell_start") + F.col("before")).alias("start")
    )
    own = Window.partitionBy("group", "salt").orderBy("doc_id")
    at = rows.withColumn("k", F.row_number().over(own) - 1).join(heads, ["group", "salt"]).withColumn(
        "position", F.col("start") + F.col("k")
    )
    exact = F.expr(f"cast((position * {shards}L) div {max(n, 1)}L as int)")
    first = F.expr(f"(shard * {max(n, 1)}L + {shards - 1}L) div {shards}L")
    return at.withColumn("shard", exact).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard",
        (F.col("position") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def _share(linked: DataFrame, n: int) -> float:
    """The part of all rows that belongs to linked groups."""
    return (linked.agg(F.sum("members").alias("m")).first().m or 0) / max(n, 1)
