"""One-permutation MinHash fingerprints, in DataFrame operations only.

Every shingle is hashed once; the top bits of the hash choose a bin, and a bin keeps its smallest
hash. An empty bin takes the value of a non-empty one, chosen by probing bins in an order of its own
(a random permutation per bin) until one is not empty, the same order for every text. Of each bin the
lowest four bits are stored, one hex digit each. Equal digits by chance are taken off the likeness:
(m - 1/16) / (1 - 1/16) for a part m of equal digits.

Each text's work stays inside its row: an array of hashes is sorted together with one sentinel for
each bin, so the first value of each bin follows without any shuffle.
"""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitwise.llm.common import words

BIN_BITS = 8
BINS = 1 << BIN_BITS
SHINGLE = 5
STORED_BITS = 4
#: Probes tried one by one before the whole order is searched.
TRIES = 32
#: Quantile ranges of the key at most, for finding the next row.
RANGES = 4096


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _longs(values) -> Column:
    """An array of integers as one constant."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _orders(seed: int = 5) -> list[list[int]]:
    """For every bin a fixed random order of the other bins."""
    rng = random.Random(seed)
    out = []
    for b in range(BINS):
        others = [x for x in range(BINS) if x != b]
        rng.shuffle(others)
        out.append(others)
    return out


def shingle_hashes(text: Column) -> Column:
    """Hashes of the runs of five words; fewer words are one shingle, none is the empty one."""
    def of_words(found: Column) -> Column:
        return _let(F.transform(found, lambda w: F.xxhash64(w)), lambda h: F.when(
            F.size(h) < SHINGLE, F.array(F.xxhash64(F.array_join(found, " ")))
        ).otherwise(F.transform(
            F.slice(h, 1, F.size(h) - (SHINGLE - 1)),
            lambda first, i: F.xxhash64(first, *[F.get(h, i + k) for k in range(1, SHINGLE)]),
        )))

    return _let(words(F.lower(text)), of_words)


def bins(hashes: Column) -> Column:
    """The smallest hash of every bin in order of bins; null where a bin is empty."""
    width = 64 - BIN_BITS
    tops = [((b - BINS // 2) << width) + (1 << width) - 1 for b in range(BINS)]
    mixed = F.sort_array(F.concat(hashes, _longs(tops)))
    first = _let(mixed, lambda a: F.filter(
        a, lambda x, i: (i == 0) | (F.shiftright(x, width) != F.shiftright(F.get(a, i - 1), width))
    ))
    empty = F.lit((1 << width) - 1)
    return F.transform(first, lambda x: F.when(x.bitwiseAND(empty) != empty, x))


def densify(found: Column) -> Column:
    """Empty bins filled from the first non-empty one in their own order."""
    orders = _orders()
    tries = [_longs(o[k] for o in orders).cast("array<int>") for k in range(TRIES)]
    whole = F.split(F.lit(";".join(",".join(map(str, o)) for o in orders)), ";")

    def fill(a: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            probes = [F.get(a, F.get(t, i)) for t in tries]
            order = F.split(F.get(whole, i), ",")
            rest = F.get(a, F.filter(order, lambda j: F.get(a, j.cast("int")).isNotNull())[0].cast("int"))
            return F.coalesce(x, *probes, rest)

        return F.transform(a, one)

    return _let(found, fill)


def fingerprint(text: Column) -> Column:
    """256 hex digits of one text; equal texts have equal ones. Null counts as empty."""
    mask = (1 << STORED_BITS) - 1
    filled = densify(bins(shingle_hashes(text)))
    return F.lower(F.array_join(F.transform(filled, lambda x: F.hex(x.bitwiseAND(F.lit(mask)))), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of two fingerprints, 0 to 1, corrected for chance."""
    chance = 1 / (1 << STORED_BITS)
    left, right = F.split(a, ""), F.split(b, "")
    same = F.aggregate(
        F.zip_with(left, right, lambda x, y: F.when((x == y) & (x != ""), 1).otherwise(0)), F.lit(0), lambda s, x: s + x
    )
    return F.greatest(F.lit(0.0), (same / float(BINS) - chance) / (1 - chance))


def with_next(docs: DataFrame, text: str = "text", key: str = "doc_id",
              derived: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """key, text and derived columns with next_<text>, next_<derived>: those of the next row by key.

    The last row has the first as its next. Equal keys follow the order of their texts, null keys
    come first. The key's range is cut at quantiles; rows are ordered inside a range, and only the
    first row of each range crosses over to the range before. ``derived`` are functions of the
    text, computed once a row.
    """
    derived = derived or {}
    parts = min(RANGES, 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    edges = docs.approxQuantile(key, [k / parts for k in range(1, parts)], 0.25 / parts)
    edges = sorted({int(e) for e in edges}) or [0]
    steps = [1 << k for k in reversed(range(len(edges).bit_length()))]

    def halve(at: Column, step: Column) -> Column:
        return F.when(F.get(_longs(edges), (at + step - 1).cast("int")) < F.col(key), at + step).otherwise(at)

    place = F.aggregate(_longs(steps), F.lit(0).cast("bigint"), halve)
    placed = docs.select(key, text, F.when(F.col(key).isNull(), F.lit(-1)).otherwise(place).cast("int").alias("_range"))
    low = placed.groupBy("_range").agg(F.min(key).alias("_low"))
    # one row of two numbers per range, at most RANGES + 1: texts need not move to meet it
    first = placed.join(F.broadcast(low), "_range").where(F.col(key).eqNullSafe(F.col("_low")))
    heads = first.groupBy("_range").agg(F.min(text).alias(text))
    heads = heads.select("_range", F.struct(F.col(text), *[f(F.col(text)).alias(c) for c, f in derived.items()]).alias("head"))
    by_range = Window.orderBy("_range")
    start = F.first("head").over(by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = heads.select(F.col("_range").alias("_r"), F.coalesce(F.lead("head").over(by_range), start).alias("_head"))
    inside = Window.partitionBy("_range").orderBy(key, text)
    carried = [text, *derived]
    led = placed.select("*", *[f(F.col(text)).alias(c) for c, f in derived.items()]).withColumn(
        "_next", F.lead(F.struct(*carried)).over(inside)
    )
    return led.join(after, F.col("_range") == F.col("_r")).select(
        key, *carried,
        *[F.when(F.col("_next").isNull(), F.col("_head")[c]).otherwise(F.col("_next")[c]).alias(f"next_{c}") for c in carried],
    )


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.

    The edited text is the text with its last quarter (floor of code points / 4) replaced by the
    start of the next document's text. Null texts count as empty; an empty text has the
    fingerprint of the empty shingle. Repeated ids follow each other in order of text. A single row
    is its own next; an empty table gives none. Only ``doc_id`` and ``text`` are read.
    """
    base = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    done = with_next(base, derived={"fp": fingerprint})
    n = F.length("text")
    moved = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - moved), F.substring(F.col("next_text"), F.lit(1), moved))
    return (
        done.select("doc_id", n.cast("long").alias("n_chars"), "fp", "next_fp", edited.alias("edited"))
        .withColumn("efp", fingerprint(F.col("edited")))
        .select(
            "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
            F.col("fp").alias("fingerprint"), F.col("efp").alias("edited_fingerprint"),
            likeness(F.col("fp"), F.col("efp")).alias("near_edited"),
            likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        )
    )
