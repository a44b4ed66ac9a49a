"""SimHash near-duplicates through a generalised pigeonhole.

Bits that vary together are put into one block, so that skew gathers in few blocks. Two
fingerprints within ``radius`` bits differ by at most T[i] bits in some block i whenever the
thresholds T sum to radius - blocks + 1 (a threshold of -1 leaves a block unprobed). The number of
blocks and their thresholds are those with the smallest estimated number of probes and candidates,
found by dynamic programming. Candidates are verified on all 64 bits.

A probe key that too many fingerprints share is not paired up. Its members meet through the
fingerprints one bit away instead: two of them are within two bits exactly if they share such a
fingerprint, and distinct fingerprints make at most 65 members there. So every link is found and no
group is expanded into all pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitwise.llm.common import pieces, unused
from pitwise.llm.components import components
from pitwise.session import durable

BITS = 64
SHINGLE = 3
RADIUS = 2
#: Shingles whose bits are unpacked at once.
CHUNK = 1 << 15


def digests(text: bytes | None, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """Hashes of all shingles of one text, in pieces; fewer words are one shingle, none gives none."""
    found = (text or b"").lower().split()
    if not found:
        return
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(found) - shingle + 1)
    first, last = starts[:n].tolist(), ends[len(found) - n :].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        yield np.array(
            [digest(line[s:e], 42) for s, e in zip(first[at : at + CHUNK], last[at : at + CHUNK])],
            dtype="<u8",
        )


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of one text; a text without words has zero."""
    return folded(digests(text, shingle))


def folded(parts: Iterable[np.ndarray]) -> int:
    """The SimHash of shingles given by their hashes."""
    count, n = np.zeros(BITS, dtype=np.int64), 0
    for hashes in parts:
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.int64)
        n += len(hashes)
    packed = np.packbits(count * 2 > n, bitorder="little")
    return int(packed.view("<i8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """``docs`` with the signed fingerprint of each whole text; null counts as empty."""
    columns = list(docs.columns)
    # a kept text column is read where it is; a batch does not hold it twice
    kept_text = docs.schema[text].dataType.simpleString() in ("string", "binary")
    raw = text if kept_text else unused("raw", [*columns, out])

    def add(batches):
        for batch in batches:
            for part in pieces(batch, raw):
                fps = [fingerprint(t) for t in part.column(raw).cast(pa.binary()).to_pylist()]
                kept = [part.column(i) for i in range(len(columns))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(fps, pa.int64())], names=[*columns, out])

    schema = docs.select(*columns, F.lit(0).cast("long").alias(out)).schema
    extra = [] if kept_text else [F.col(text).cast("binary").alias(raw)]
    return docs.select(*columns, *extra).mapInArrow(add, schema)


@dataclass(frozen=True)
class Plan:
    """Blocks of bit positions, the threshold of each, and the estimated cost."""

    blocks: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]
    cost: float


def _bit_pairs(codes: DataFrame) -> tuple[int, np.ndarray]:
    """How often each two bits are set together: at most 2,080 rows reach the driver."""

    def count(batches):
        joint, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            raw = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            for at in range(0, len(raw), 1 << 16):
                block = raw[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
                bits = np.unpackbits(block, axis=1, bitorder="little").astype(np.float32)
                joint += bits.T @ bits
                n += len(bits)
        i, j = np.triu_indices(BITS)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*i.tolist(), -1]), pa.array([*j.tolist(), -1]),
             pa.array([*joint[i, j].astype(np.int64).tolist(), n])], names=["i", "j", "n"],
        )

    rows = (
        codes.select("fp").mapInArrow(count, "i long, j long, n long")
        .groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    )
    joint, total = np.zeros((BITS, BITS)), 0
    for r in rows:
        if r.i < 0:
            total = r.n
        else:
            joint[r.i, r.j] = joint[r.j, r.i] = r.n
    return total, joint


def group_bits(total: int, joint: np.ndarray, parts: int) -> list[tuple[int, ...]]:
    """``parts`` blocks of near equal width; each grows by the bit most correlated with it."""
    p = np.diag(joint) / max(total, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(joint / max(total, 1) - np.outer(p, p)) / np.outer(spread, spread)
    left, blocks = set(range(BITS)), []
    for k in range(parts):
        width = len(left) // (parts - k)
        seed = min(left, key=lambda b: (p[b] * (1 - p[b]), b))
        block = [seed]
        left.remove(seed)
        while len(block) < width:
            nxt = max(left, key=lambda b: (corr[b, block].mean(), -b))
            block.append(nxt)
            left.remove(nxt)
        blocks.append(tuple(sorted(block)))
    return blocks


def _cut(fp, block):
    """The bits of one block, in place."""
    mask = sum(1 << b for b in block)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask).cast("long"))


def _signed(bit: int) -> int:
    return (1 << bit) - (1 << 64) if bit == 63 else 1 << bit


def allocate(costs: list[dict[int, float]], budget: int) -> tuple[float, list[int]]:
    """Thresholds summing to ``budget`` with the smallest total cost, block by block."""
    best = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (c, chosen) in best.items():
            for t, more in cost.items():
                here = (c + more, [*chosen, t])
                if spent + t not in step or here[0] < step[spent + t][0]:
                    step[spent + t] = here
        best = step
    return best[budget]


def plan_probes(codes: DataFrame, radius: int = RADIUS, choices: tuple[int, ...] = (2, 3, 4)) -> Plan:
    """The cheapest blocks and thresholds, from statistics over all fingerprints."""
    total, joint = _bit_pairs(codes)
    p = np.diag(joint) / max(total, 1)
    options = {m: group_bits(total, joint, m) for m in choices}
    layout = sorted({b for blocks in options.values() for b in blocks})
    values = codes.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), _cut(F.col("fp"), b).alias("v")) for k, b in enumerate(layout)
    ])).alias("x")).select("x.*")
    mass = {
        r.k: r.s for r in values.groupBy("k", "v").count()
        .groupBy("k").agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1)).alias("s")).collect()
    }
    best = None
    for m, blocks in options.items():
        costs = []
        for block in blocks:
            equal = mass.get(layout.index(block), 0.0)
            # a block one bit away is as full as the bit is balanced; at least as by chance
            odds = sum(2 * p[b] * (1 - p[b]) / (p[b] ** 2 + (1 - p[b]) ** 2) for b in block)
            w = len(block)
            costs.append({
                -1: 0.0,
                0: total + equal,
                1: total * (w + 2.0) + (equal + total * total / 2.0**w) * (1 + odds),
            })
        cost, thresholds = allocate(costs, radius - m + 1)
        if best is None or cost < best.cost:
            best = Plan(tuple(blocks), tuple(thresholds), cost)
    return best


def links(codes: DataFrame, plan: Plan, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b) that connect exactly what all pairs within ``radius`` (at most 2) connect.

    ``codes`` holds distinct fingerprints in ``fp``. Pairs of an overfull key are replaced by
    links through shared neighbours at one bit, which join the same fingerprints.
    """
    if radius > 2:
        raise ValueError("neighbours one bit away cover a radius of 2 at most")
    fp, keys = F.col("fp"), []
    for k, (block, t) in enumerate(zip(plan.blocks, plan.thresholds)):
        if t < 0:
            continue
        own = _cut(fp, block)
        keys.append(F.struct(F.lit(k).alias("k"), own.alias("v"), F.lit(True).alias("own")))
        if t == 1:
            keys += [
                F.struct(F.lit(k).alias("k"), own.bitwiseXOR(F.lit(_signed(b)).cast("long")).alias("v"),
                         F.lit(False).alias("own"))
                for b in block
            ]
    rows = codes.select("fp", F.explode(F.array(*keys)).alias("x")).select("fp", "x.*")
    ball = BITS + 1
    loads = rows.groupBy("k", "v").agg(
        F.sum(F.col("own").cast("long")).alias("held"), F.count("*").alias("asked")
    ).where("held > 0 and asked > 1")
    # held x asked pairs against 65 neighbours for each that asks
    loads = loads.withColumn("full", F.col("held") > ball)
    rows = durable(rows.join(loads.select("k", "v", "full"), ["k", "v"]), "simhash-keys")
    thin = rows.where("not full")
    left = thin.where("own").select("k", "v", F.col("fp").alias("a"))
    right = thin.select("k", "v", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    pairs = left.join(right, ["k", "v"]).where((F.col("a") != F.col("b")) & near).select("a", "b")
    around = F.array(fp, *[fp.bitwiseXOR(F.lit(_signed(b)).cast("long")) for b in range(BITS)])
    met = (
        rows.where("full").select("fp").distinct()
        .select("fp", F.explode(around).alias("at"))
        .groupBy("at").agg(F.collect_list("fp").alias("m")).where("size(m) > 1")
        .select(F.explode("m").alias("a"), F.array_min("m").alias("b")).where("a != b")
    )
    return pairs.unionByName(met)


def classes(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root, component_id) for rows (doc_id, fp): the smallest doc_id reachable by links.

    Null ids take part but never become a component's id, unless a component has no other.
    """
    codes = durable(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-codes")
    plan = plan_probes(codes, radius)
    roots = components(links(codes, plan, radius), "simhash-links")
    homed = codes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root")
    )
    lows = homed.groupBy("root").agg(F.min("low").alias("component_id"))
    return homed.join(lows, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs``.

    Null and empty texts share the zero fingerprint and link like others; repeated rows are rows
    of their own; an empty table gives none. Only ``doc_id`` and ``text`` are read, whatever other
    columns there are.
    """
    fps = durable(with_fingerprint(docs.select("doc_id", "text")).select("doc_id", "fp"), "simhash")
    return fps.join(classes(fps, radius), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_per_group(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each near-duplicate group: the one with the smallest doc_id.

    Rows that share that id are told apart by their other columns in order. A group without any
    id keeps its smallest row.
    """
    columns = docs.columns
    packed = docs.select("doc_id", "text", F.struct(*columns).alias("row"))
    fps = durable(with_fingerprint(packed).select("doc_id", "row", "fp"), "simhash-docs")
    groups = classes(fps.select("doc_id", "fp"), radius)
    return lowest_rows(fps.join(groups, "fp"), columns)


def lowest_rows(homed: DataFrame, columns: list[str]) -> DataFrame:
    """The smallest row of each root, from (doc_id, row, root, component_id)."""
    low = homed.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    order = ["doc_id", *[c for c in columns if c != "doc_id"]]
    first = F.min(F.struct(*[F.col("row")[c].alias(c) for c in order])).alias("r")
    return low.groupBy("root").agg(first).select(*[F.col("r")[c].alias(c) for c in columns])
