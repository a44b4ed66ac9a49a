"""Groups of documents whose five-word shingles have a Jaccard likeness of 0.8 or more, all of them.

Two sets of shingles of that likeness share one of the first fifth (and one more) of their shingles
under any order that is the same for all texts (prefix filter). Those are the keys of a text, so
every pair that is alike meets under some key, and all that meet are verified on the whole sets:
no link is left to chance. The order puts shingles common in a sample last, so a line that many
texts hold is a key of few; the sample decides what is compared, never what is found.

A group of many copies is not expanded into its pairs. SimHash over the five-word shingles, with the
pigeonhole of ``simhash``, and a leader for each key join most of a group first; afterwards only
texts in different groups meet. Shingles and texts are known by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitwise.llm import simhash
from pitwise.llm.common import pieces
from pitwise.llm.components import components
from pitwise.session import durable

SHINGLE = 5
#: Texts sampled for common shingles at least, and one in how many; in how many of them one is common, and how many
#: are held. A share of the texts, so that a shingle of few sampled texts is one of few texts, however many there are.
SAMPLE = 1 << 11
ONE_IN = 16
COMMON = 4
MOST_COMMON = 1 << 20
#: Rounds in which a key's texts meet its leader, before all that are still apart meet.
LED = 2
#: Longs of a text's parity sketch.
PARITY = 8
#: The longest list of row numbers that is broadcast: 16 MB of them.
SENT = 1 << 21


def shingle_set(text: bytes | None) -> np.ndarray:
    """The hashes of a text's five-word shingles, each once, in order; no word gives none."""
    parts = list(simhash.digests(text, SHINGLE))
    return np.unique(np.concatenate(parts)).view("<i8") if parts else np.zeros(0, "<i8")


def key_count(size: int) -> int:
    """How many shingles a set of ``size`` shows, so that none of 0.8 or more is missed."""
    return size - (4 * size + 4) // 5 + 1 if size else 0


def keys_of(shingles: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set: rare ones first, then by hash. ``common`` is sorted."""
    rank = np.zeros(len(shingles), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        rank = np.where(common[at] == shingles, counts[at], 0)
    return shingles[np.lexsort((shingles, rank))[: key_count(len(shingles))]]


def _texts(column: str, schema: str, row):
    """A function for mapInArrow: columns but the text, then what ``row`` gives for the text."""
    names = [x.split()[0] for x in schema.split(", ")]
    known = {"long": pa.int64(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "binary": pa.binary()}
    kinds = [known[x.split()[1]] for x in schema.split(", ")]

    def add(batches):
        for batch in batches:
            for part in pieces(batch, column):
                made = [row(t) for t in part.column(column).cast(pa.binary()).to_pylist()]
                kept = {c: part.column(c) for c in part.schema.names if c != column}
                new = {n: pa.array([m[i] for m in made], kinds[i]) for i, n in enumerate(names)}
                yield pa.RecordBatch.from_pydict({**kept, **new})

    return add


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of several sampled texts, sorted, and in how many each is."""
    rows = docs.count()
    every = max(1, rows // max(SAMPLE, rows // ONE_IN))
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    sample = docs.select(text.alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).distinct()
    found = sample.mapInArrow(_texts("text", "s array<long>", lambda t: (shingle_set(t),)), "s array<long>")
    often = found.select(F.explode("s").alias("s")).groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    often = durable(often, "likeness-common")
    least, held = COMMON, 0  # as many of the most common as are held
    for r in sorted(often.groupBy("n").agg(F.count("*").alias("held")).collect(), reverse=True):
        held += r.held
        if held > MOST_COMMON:
            least = r.n + 1
            break
    got = often.where(F.col("n") >= least).toPandas().sort_values("s")
    return got["s"].to_numpy(np.int64), got["n"].to_numpy(np.int64)


def _alike(shared, one, other):
    """Whether a Jaccard likeness of 0.8 is reached with so many shared shingles."""
    return 9 * shared >= 4 * (one + other)


def _could(a, b):
    """Whether two texts that meet first at these keys can be alike; a pair's first key says so."""
    return _alike(F.least(a["size"] - a["pos"], b["size"] - b["pos"]), a["size"], b["size"])


def among(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The ``rows`` whose ``at`` is among ``wanted``, a written table of distinct numbers.

    A list of at most ``SENT`` numbers goes to the rows, whose texts then stay where they are; a
    longer one meets them by a shuffle.
    """
    few = wanted.limit(SENT + 1).count() <= SENT
    return rows.join(F.broadcast(wanted) if few else wanted, "at", "left_semi")


def raw_texts(pairs: DataFrame, texts: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, raw) of the texts in the pairs (a, b)."""
    held = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = durable(texts.join(held, "node", "left_semi").select("at"), "likeness-wanted")
    return among(rows.select("at", "node", F.col("row.text").cast("binary").alias("raw")), wanted).select("node", "raw")


def verified(pairs: DataFrame, texts: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) with a likeness of 0.8 or more; only sets of texts in a pair are made.

    Few parities are as good as random for sets of thousands, so each text of a pair first gets as
    many as it has shingles; sets are made and moved for the pairs that these leave. They are compared
    by the upper 32 bits of their hashes, which halves what moves; two shingles that fall together,
    one pair in four billion, may move a count by one.
    """

    def sketch(text):
        found = shingle_set(text)
        return len(found), parities(found, longs_for(len(found))).tobytes()

    def upper(text):
        return (np.unique(shingle_set(text).view("<u8") >> np.uint64(32)).astype("<u4").view("<i4"),)

    made = raw_texts(pairs, texts, rows).mapInArrow(
        _texts("raw", "size long, par binary", sketch), "node long, size long, par binary"
    )
    left = durable(fine_enough(pairs, durable(made, "likeness-parities")), "likeness-left")
    made = raw_texts(left, texts, rows).mapInArrow(_texts("raw", "s array<int>", upper), "node long, s array<int>")
    sets = durable(made, "likeness-sets")
    one, other = (sets.select(F.col("node").alias(c), F.col("s").alias(f"{c}s")) for c in "ab")
    shared = F.size(F.array_intersect("as", "bs"))
    return left.join(one, "a").join(other, "b").where(_alike(shared, F.size("as"), F.size("bs"))).select("a", "b")


def longs_for(size: int) -> int:
    """Longs of parities for a set of ``size``: a bit for each shingle at least, and a power of two."""
    return max(PARITY, 1 << max(0, (size - 1) // 64).bit_length())


def parities(shingles: np.ndarray, longs: int = PARITY) -> np.ndarray:
    """For each of 64 buckets a long whether an odd number of a set's shingles falls into it."""
    odd = np.bincount(shingles.view("<u8") % np.uint64(64 * longs), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def unlike(one: bytes, other: bytes) -> int:
    """Buckets of unlike parities. The longer row, of a power of two as well, is folded to the shorter's buckets."""
    x, y = np.frombuffer(one, "<u8"), np.frombuffer(other, "<u8")
    while len(x) != len(y):
        x, y = sorted((x, y), key=len)
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def near_enough(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs whose parities do not rule a likeness of 0.8 out.

    A bucket of unlike parities holds a shingle of one text alone, so the texts differ in as many
    shingles at least; sets that are alike differ in a ninth of their sizes' sum at most. Exact, and
    done on 64 bytes a text before any set is moved.
    """
    one, other = (
        sketches.select(F.col("node").alias(c), F.col("size").alias(f"{c}_size"), F.col("par").alias(f"{c}_par")) for c in "ab"
    )
    unlike = sum(
        (F.bit_count(F.get("a_par", F.lit(i)).bitwiseXOR(F.get("b_par", F.lit(i)))) for i in range(PARITY)), F.lit(0)
    )
    met = pairs.join(one, "a").join(other, "b")
    return met.where(9 * unlike <= F.col("a_size") + F.col("b_size")).select("a", "b")


def fine_enough(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs that parities as many as the sets' shingles do not rule out: exact, as in ``near_enough``."""
    one, other = (
        sketches.select(F.col("node").alias(c), F.col("size").alias(f"{c}_size"), F.col("par").alias(f"{c}_par")) for c in "ab"
    )

    def keep(batches):
        for batch in batches:
            known = [batch.column(c).to_pylist() for c in ("a_par", "b_par", "a_size", "b_size")]
            stay = [9 * unlike(x, y) <= m + n for x, y, m, n in zip(*known)]
            yield batch.select(["a", "b"]).filter(pa.array(stay, pa.bool_()))

    # sizes alone rule out pairs of which one text has less than four fifths of the other's shingles
    met = pairs.join(one, "a").join(other, "b").where(_alike(F.least("a_size", "b_size"), F.col("a_size"), F.col("b_size")))
    return met.mapInArrow(keep, "a long, b long")


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def close_pairs(texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes whose fingerprints SimHash's pigeonhole links, as candidates."""
    codes = durable(texts.groupBy("fp").agg(F.min("node").alias("first")), "likeness-codes")
    met = simhash.links(codes.select("fp"), simhash.plan_probes(codes))
    of = lambda c: codes.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_first"))
    across = met.join(of("a"), "a").join(of("b"), "b").select(F.col("a_first").alias("a"), F.col("b_first").alias("b"))
    same = texts.join(codes, "fp").where("node != first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    return _pairs(across.unionByName(same))


def links(texts: DataFrame, keyed: DataFrame, rows: DataFrame, sketches: DataFrame) -> DataFrame:
    """(node, root) of all texts that are like another, over all pairs alike.

    ``keyed`` holds (key, node, size, pos) of the keys that several texts have.
    """
    found = tried = None
    me = F.struct("node", "size", "pos")
    for turn in range(LED + 1):
        if turn:
            roots = components(found, "likeness-parts")
            placed = keyed.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
            apart = durable(placed, "likeness-placed")
        else:
            apart = keyed.withColumn("root", F.col("node"))
        split = apart.groupBy("key").agg(
            F.min("root").alias("lo"), F.max("root").alias("hi"),
            F.min_by(F.struct("node", "size", "pos", "root"), F.xxhash64("root", "node", F.lit(turn))).alias("lead"),
        ).where("lo != hi")
        if turn:  # keys whose texts are one group by now stay out of later rounds
            split = durable(split, "likeness-split")
            keyed = apart.join(split.select("key"), "key", "left_semi").drop("root")
        if turn < LED:
            here = apart.join(split.select("key", "lead"), "key").where("root != lead.root")
            met = here.where(_could(me, F.col("lead"))).select(F.col("node").alias("a"), F.col("lead.node").alias("b"))
        else:
            cells = apart.join(split.select("key"), "key", "left_semi")
            parts = cells.groupBy("key", F.col("root").alias("other")).agg(F.collect_list(me).alias("them"))
            met = cells.join(parts, "key").where("root < other").select(
                F.col("node").alias("a"),
                F.explode(F.filter("them", lambda x: _could(me, x))).alias("x"),
            ).select("a", F.col("x.node").alias("b"))
        if turn:
            new = durable(_pairs(met).join(tried, ["a", "b"], "left_anti"), "likeness-pairs")
        else:
            close = close_pairs(texts).join(keyed.select(F.col("node").alias("a")).distinct(), "a", "left_semi")
            new = durable(_pairs(met.unionByName(close)), "likeness-pairs")
        hopeful = durable(near_enough(new, sketches), "likeness-hopeful")
        alike = durable(verified(hopeful, texts, rows), "likeness-links")
        tried = tried.unionByName(new) if turn else new
        found = found.unionByName(alike) if turn else alike
    return components(found, "likeness-parts")


def one_per_group(docs: DataFrame) -> DataFrame:
    """One row of each group of documents that are alike: the one with the smallest doc_id.

    Groups are connected over pairs with a likeness of 0.8 or more. Words are lower-cased and cut at
    white space; texts of the same words are alike, null and empty ones too; fewer than five words
    are one shingle. Rows that share the smallest id are told apart by their other columns in order.
    A group without any id keeps its smallest row.
    """
    columns = docs.columns
    common, counts = common_shingles(docs)

    def sketch(text):
        line = b" ".join((text or b"").lower().split())
        parts = list(simhash.digests(line, SHINGLE))
        found = np.unique(np.concatenate(parts)).view("<i8") if parts else np.zeros(0, "<i8")
        node = int(np.uint64(xxhash.xxh64_intdigest(line)).view(np.int64))
        return node, simhash.folded(parts), len(found), keys_of(found, common, counts), parities(found)

    made = "node long, fp long, size long, keys array<long>, par array<long>"
    packed = docs.select(
        "doc_id", F.monotonically_increasing_id().alias("at"), F.struct(*columns).alias("row"),
        F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("raw"),
    )
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, at long, row {docs.select(F.struct(*columns)).schema[0].dataType.simpleString()}, {made}"
    rows = durable(packed.mapInArrow(_texts("raw", made, sketch), schema), "likeness-docs", "zstd")
    texts = durable(rows.groupBy("node").agg(
        F.min("doc_id").alias("low"), F.min("at").alias("at"), F.min("fp").alias("fp")
    ), "likeness-texts")
    shown = rows.select("at", "node", "size", "keys").join(texts.select("at"), "at", "left_semi").select(
        "node", F.col("size").cast("int").alias("size"), F.posexplode("keys").alias("pos", "key")
    )
    several = shown.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    keyed = durable(shown.join(several, "key", "left_semi"), "likeness-keys")
    sketches = durable(
        rows.select("at", "node", "size", "par").join(texts.select("at"), "at", "left_semi").drop("at"), "likeness-sketches"
    )
    roots = links(texts, keyed, rows, sketches)
    homed = texts.select("node", "low").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    low = homed.groupBy("root").agg(F.min("low").alias("low"))
    # rows of the smallest id of each group are told apart by their columns; only they move
    order = ["doc_id", *[c for c in columns if c != "doc_id"]]
    nodes = homed.join(low.withColumnRenamed("low", "component_id"), "root").select("node", "root", "component_id")
    owner = rows.select("at", "node", "doc_id").join(nodes, "node").where(
        F.col("doc_id").eqNullSafe(F.col("component_id"))
    ).select("at", "root")
    owner = durable(owner, "likeness-owners")
    sizes = durable(owner.groupBy("root").agg(F.count("*").alias("n"), F.min("at").alias("at")), "likeness-first")
    alone = among(rows.select("at", "row"), sizes.where("n = 1").select("at")).select(
        *[F.col("row")[c].alias(c) for c in columns]
    )
    least = F.min(F.struct(*[F.col("row")[c].alias(c) for c in order])).alias("r")
    several = durable(owner.join(sizes.where("n > 1").select("root"), "root", "left_semi"), "likeness-tied")
    ties = among(rows.select("at", "row"), several.select("at")).join(several, "at")
    chosen = ties.groupBy("root").agg(least).select(*[F.col("r")[c].alias(c) for c in columns])
    return alone.unionByName(chosen)
