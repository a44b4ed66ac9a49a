"""Near-duplicate vectors by NN-descent.

Equal vectors are one node with a multiplicity. Every node keeps a list of its nearest nodes. Lists
start from blocks of nodes with equal signs on random projections, and are refined: the neighbours
of a node are compared with each other, and whoever is nearer than the last of a list enters it.
Pairs at or above the threshold are links.

A node whose list holds nothing but links is saturated: there may be more. Its connected component
is then searched completely, in pairs of blocks, where links are counted and not listed. In the
end some nodes are compared with all others; while too few of their links were found, lists are
doubled, new blocks drawn and all refined again. If recall stays too low there is an error, no result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitwise.llm.components import components
from pitwise.session import durable

THRESHOLD = 0.9
LIST = 12
TABLES = 12
#: Nodes that a starting block holds about, and at most after splitting; nodes in a block of pairs.
BLOCK, SPLIT, PAIR_BLOCK = 256, 768, 2048
ROUNDS = 5
#: A round that changes a smaller part of all list places is the last.
SETTLED = 0.002
AUDITED, RECALL, ATTEMPTS = 400, 0.97, 6
#: Recall below which there is no result, and the links that a node with few has at most.
LEAST_RECALL, FEW = 0.9, 8


def _unit(raws: list[bytes]) -> np.ndarray:
    """Rows of equal length as unit vectors in double precision."""
    x = np.frombuffer(b"".join(raws), dtype="<f8").reshape(len(raws), -1)
    big = np.abs(x).max(axis=1, keepdims=True)
    x = x / big
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_length(raws: list[bytes]) -> list[np.ndarray]:
    """Positions of vectors of each length; different lengths are never compared."""
    size = np.fromiter(map(len, raws), np.int64, len(raws))
    return [np.flatnonzero(size == s) for s in np.unique(size)]


def packed(vectors: DataFrame) -> DataFrame:
    """(vec_id, raw): components as little-endian doubles, null unless they make a direction."""

    def run(batches):
        for batch in batches:
            out = []
            for values in batch.column("v").to_pylist():
                raw = None
                if values and None not in values:
                    x = np.array(values, dtype="<f8")
                    if np.isfinite(x).all() and x.any():
                        raw = (x + 0.0).tobytes()
                out.append(raw)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.binary())], names=["vec_id", "raw"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).mapInArrow(
        run, f"vec_id {kind}, raw binary"
    )


def tables_for(bits: int) -> int:
    """So many tables that a pair at the threshold misses all blocks in one case of twenty at most."""
    meet = (1 - math.acos(THRESHOLD) / math.pi) ** bits
    return max(TABLES, math.ceil(math.log(0.05) / math.log(1 - meet)))


def _codes(nodes: DataFrame, bits: int, attempt: int) -> DataFrame:
    """(node, t, code): signs of each node on ``bits`` random directions, for every table t.

    Every attempt has directions of its own.
    """
    tables = tables_for(bits)

    def run(batches):
        directions: dict[int, np.ndarray] = {}
        for batch in batches:
            raws = batch.column("raw").to_pylist()
            out = np.zeros((len(raws), tables), dtype=np.int64)
            for rows in _by_length(raws):
                x = _unit([raws[r] for r in rows])
                d = x.shape[1]
                if d not in directions:
                    directions[d] = np.random.default_rng([d, attempt]).normal(size=(d, tables * bits))
                signs = (x @ directions[d] > 0).reshape(len(rows), tables, bits)
                out[rows] = signs @ (1 << np.arange(bits, dtype=np.int64)) * 4099 + d
            n = len(raws)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column("node").to_numpy(), tables)),
                 pa.array(np.tile(np.arange(tables, dtype=np.int32), n)), pa.array(out.reshape(-1))],
                names=["node", "t", "code"],
            )

    return nodes.select("node", "raw").mapInArrow(run, "node long, t int, code long")


def _best_in_block(size: int):
    """For every node of a block its nearest ``size`` others there."""

    def run(block: pa.Table) -> pa.Table:
        raws, ids = block.column("raw").to_pylist(), block.column("node").to_numpy()
        a, b, s = [], [], []
        for rows in _by_length(raws):
            if len(rows) < 2:
                continue
            x, own = _unit([raws[r] for r in rows]), ids[rows]
            k = min(size, len(rows) - 1)
            for at in range(0, len(rows), 1024):
                sim = x[at : at + 1024] @ x.T
                sim[np.arange(len(sim)), at + np.arange(len(sim))] = -2
                top = np.argpartition(-sim, k - 1, axis=1)[:, :k]
                a.append(np.repeat(own[at : at + 1024], k))
                b.append(own[top].reshape(-1))
                s.append(np.take_along_axis(sim, top, axis=1).reshape(-1))
        return _pairs(a, b, s)

    return run


def _pairs(a: list, b: list, s: list) -> pa.Table:
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return pa.table({"a": pa.array(join(a, np.int64)), "b": pa.array(join(b, np.int64)), "sim": pa.array(join(s, np.float64))})


def _among_neighbours(group: pa.Table) -> pa.Table:
    """Pairs among one node's neighbours that enter the list of their first node."""
    raws, ids = group.column("raw").to_pylist(), group.column("v").to_numpy()
    fresh, last = group.column("fresh").to_numpy(), group.column("last").to_numpy()
    a, b, s = [], [], []
    for rows in _by_length(raws):
        if len(rows) < 2:
            continue
        x = _unit([raws[r] for r in rows])
        sim = x @ x.T
        enters = (sim > last[rows][:, None]) & (fresh[rows][:, None] | fresh[rows][None, :])
        np.fill_diagonal(enters, False)
        i, j = np.nonzero(enters)
        a.append(ids[rows][i])
        b.append(ids[rows][j])
        s.append(sim[i, j])
    return _pairs(a, b, s)


def _top(edges: DataFrame, size: int) -> DataFrame:
    """The ``size`` best of each node's list; rows (a, b, sim, fresh)."""
    order = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    return edges.withColumn("place", F.row_number().over(order)).where(F.col("place") <= size).drop("place")


def start_lists(nodes: DataFrame, n: int, size: int, attempt: int = 0) -> DataFrame:
    """First lists from blocks of equal signs; large blocks are split, anew in each table and attempt."""
    bits = max(1, int(np.ceil(np.log2(max(n, 2) / BLOCK))))
    codes = _codes(nodes, bits, attempt)
    counts = codes.groupBy("t", "code").agg(F.count("*").alias("n"))
    salt = F.pmod(F.xxhash64(F.col("node"), F.col("t"), F.lit(attempt)), F.ceil(F.col("n") / SPLIT)).cast("int").alias("salt")
    placed = codes.join(counts, ["t", "code"]).select("t", "code", salt, "node")
    found = placed.join(nodes.select("node", "raw"), "node").groupBy("t", "code", "salt").applyInArrow(
        _best_in_block(size), "a long, b long, sim double"
    )
    return _top(found.groupBy("a", "b").agg(F.max("sim").alias("sim")).withColumn("fresh", F.lit(True)), size)


def refine(nodes: DataFrame, lists: DataFrame, n: int, size: int) -> DataFrame:
    """Rounds of comparing neighbours of neighbours, until lists hardly change."""
    for _ in range(ROUNDS):
        ends = lists.groupBy("a").agg(F.when(F.count("*") >= size, F.min("sim")).otherwise(-2.0).alias("last"))
        back = Window.partitionBy("b").orderBy(F.desc("sim"), "a")
        reverse = lists.withColumn("place", F.row_number().over(back)).where(F.col("place") <= size)
        around = (
            lists.select(F.col("a").alias("u"), F.col("b").alias("v"), "fresh")
            .unionByName(reverse.select(F.col("b").alias("u"), F.col("a").alias("v"), "fresh"))
            .unionByName(lists.select("a").distinct().select(F.col("a").alias("u"), F.col("a").alias("v"), F.lit(False).alias("fresh")))
            .groupBy("u", "v").agg(F.max("fresh").alias("fresh"))
        )
        known = nodes.join(ends, F.col("node") == F.col("a"), "left").select(
            F.col("node").alias("v"), "raw", F.coalesce("last", F.lit(-2.0)).alias("last")
        )
        found = around.join(known, "v").groupBy("u").applyInArrow(_among_neighbours, "a long, b long, sim double")
        both = lists.select("a", "b", "sim", F.lit(False).alias("fresh")).unionByName(
            found.withColumn("fresh", F.lit(True))
        )
        lists = durable(
            _top(both.groupBy("a", "b").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh")), size), "nn-lists"
        )
        if lists.where("fresh").count() <= SETTLED * n * size:
            break
    return lists


def _count_between(group: pa.Table) -> pa.Table:
    """Links between the two blocks of a pair (or inside one), counted for each node."""
    raws, ids = group.column("raw").to_pylist(), group.column("node").to_numpy()
    side, m = group.column("blk").to_numpy(), group.column("m").to_numpy()
    i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
    found = np.zeros(len(ids), dtype=np.int64)
    for rows in _by_length(raws):
        x = _unit([raws[r] for r in rows])
        left, right = np.flatnonzero(side[rows] == i), np.flatnonzero(side[rows] == j)
        for at in range(0, len(left), 1024):
            part = left[at : at + 1024]
            near = x[part] @ x[right].T >= THRESHOLD
            if i == j:
                near[np.arange(len(part)), at + np.arange(len(part))] = False
            found[rows[part]] += near @ m[rows[right]]
            if i != j:
                found[rows[right]] += near.T @ m[rows[part]]
    return pa.table({"node": pa.array(ids), "found": pa.array(found)})


def resolve(nodes: DataFrame, lists: DataFrame, size: int) -> DataFrame:
    """(node, root, found): component and linked vectors outside the node, for nodes with links."""
    links = durable(
        lists.where(F.col("sim") >= THRESHOLD).select(F.explode(F.array(
            F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
        )).alias("x")).select("x.*").distinct(), "nn-links",
    )
    roots = durable(components(links, "nn-components"), "nn-roots")
    full = lists.where(F.col("sim") >= THRESHOLD).groupBy("a").count().where(F.col("count") >= size)
    wide = roots.join(full, F.col("node") == F.col("a"), "left_semi").select("root").distinct()
    sizes = roots.groupBy("root").agg(F.count("*").alias("members")).join(wide, "root")
    inside = roots.join(sizes, "root").withColumn("parts", F.ceil(F.col("members") / PAIR_BLOCK).cast("int"))
    inside = inside.withColumn("blk", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("o")
    pairs = inside.select("root", "node", "blk", other).select(
        "root", "node", "blk", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j")
    )
    counted = (
        pairs.join(nodes.select("node", "raw", "m"), "node").groupBy("root", "i", "j")
        .applyInArrow(_count_between, "node long, found long")
        .groupBy("node").agg(F.sum("found").alias("counted"))
    )
    listed = links.join(nodes.select(F.col("node").alias("b"), "m"), "b").groupBy("a").agg(F.sum("m").alias("listed"))
    return (
        roots.join(listed, F.col("node") == F.col("a"), "left").join(counted, "node", "left")
        .select("node", "root", F.coalesce("counted", "listed", F.lit(0)).alias("found"))
    )


def audit(nodes: DataFrame, found: DataFrame) -> float:
    """Recall of ``AUDITED`` nodes against all nodes: the mean over nodes of the part of their links found.

    Every node counts alike, and nodes with few links (``FEW`` at most) and with many are judged by
    themselves: the result is the lower mean, so that a crowd does not hide lone pairs. The nodes are
    those with the smallest hash: a bounded number of vectors is sent to the tasks.
    """
    chosen = nodes.withColumn("h", F.xxhash64(F.col("node"), F.lit(17))).orderBy("h", "node").limit(AUDITED)
    asked = chosen.select("node", "raw").toArrow()
    raws, ids = asked.column("raw").to_pylist(), asked.column("node").to_numpy()
    groups = [(len(raws[rows[0]]), rows, _unit([raws[r] for r in rows])) for rows in _by_length(raws)] if raws else []

    def run(batches):
        total = np.zeros(len(ids), dtype=np.int64)
        for batch in batches:
            own, m = batch.column("raw").to_pylist(), batch.column("m").to_numpy()
            here = batch.column("node").to_numpy()
            for rows in _by_length(own):
                for length, asked_rows, q in groups:
                    if length == len(own[rows[0]]):
                        near = q @ _unit([own[r] for r in rows]).T >= THRESHOLD
                        near &= ids[asked_rows][:, None] != here[rows][None, :]
                        total[asked_rows] += near @ m[rows]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["node", "n"])

    true = nodes.select("node", "raw", "m").mapInArrow(run, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))
    part = F.least("n", F.coalesce("found", F.lit(0))) / F.col("n")
    judged = true.join(found.select("node", "found"), "node", "left").where("n > 0")
    means = judged.groupBy(F.col("n") <= FEW).agg(F.avg(part).alias("recall")).collect()
    return min((r.recall for r in means), default=1.0)


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of (vec_id, embedding).

    Null and zero vectors, and those with a null or non-finite component, link with nothing. So do
    vectors of different lengths with each other. Equal vectors are linked whatever their ids;
    a component whose ids are all null has a null id and keeps its rows. Rows that repeat an id are
    rows of their own. An empty table gives none; labels and other columns are not read.
    """
    rows = durable(packed(vectors), "nn-rows")
    nodes = durable(
        rows.where("raw is not null").groupBy("raw").agg(F.count("*").alias("m"), F.min("vec_id").alias("low"))
        .select(F.monotonically_increasing_id().alias("node"), "raw", "m", "low"), "nn-nodes",
    )
    n = nodes.count()
    size = LIST
    lists = durable(start_lists(nodes, n, size), "nn-start")
    for attempt in range(ATTEMPTS):
        lists = refine(nodes, lists, n, size)
        found = durable(resolve(nodes, lists, size), "nn-found")
        recall = audit(nodes, found)
        if recall >= RECALL:
            break
        if attempt == ATTEMPTS - 1:
            if recall < LEAST_RECALL:
                raise RuntimeError(f"recall {recall:.3f} after {ATTEMPTS} attempts; {LEAST_RECALL} is the least")
            break
        size *= 2
        lists = durable(start_lists(nodes, n, size, attempt + 1).unionByName(lists.withColumn("fresh", F.lit(True)))
                        .groupBy("a", "b").agg(F.max("sim").alias("sim"), F.max("fresh").alias("fresh")), "nn-start")
    homed = nodes.join(found, "node", "left").select(
        "raw", "m", "low", F.coalesce("root", "node").alias("root"), F.coalesce("found", F.lit(0)).alias("found")
    )
    lows = homed.groupBy("root").agg(F.min("low").alias("component_id"))
    placed = homed.join(lows, "root").select("raw", (F.col("found") + F.col("m") - 1).alias("links"), "component_id")
    single = F.col("raw").isNull()
    return rows.join(placed, "raw", "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.when(single, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(single, True).otherwise(F.col("vec_id").eqNullSafe(F.col("component_id"))).alias("kept"),
    )
