"""Pieces the operators share: tables, word splitting over Arrow buffers, batch slicing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as a character class body.
BLANKS = r"\x20\x09-\x0D"
BLANK_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Hand texts to Python workers in batches of at most ``rows``: both sides hold a batch whole."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


def unused(name: str, columns: list[str]) -> str:
    """``name``, with underscores before it until no column has it, whatever the case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def words(text: Column) -> Column:
    """The words of a text as an array, in the JVM; no word gives an empty array."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANK_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(
        F.split(bare, f"[{BLANKS}]+")
    )


def pieces(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch whose texts hold about ``limit`` bytes each.

    A slice has one row at least, so a single long text is a slice of its own.
    """
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < len(sizes):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def word_lists(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Word counts per text, and all words one after the other. Null counts as empty."""
    text = pc.fill_null(texts.cast(pa.binary()), b"").view(pa.string())  # no decoding
    split = pc.ascii_split_whitespace(text)
    flat = split.flatten().view(pa.binary())
    counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    real = pc.not_equal(pc.binary_length(flat), 0)
    if pc.all(real).as_py() is False:  # white space at either end leaves empty words
        owner = np.repeat(np.arange(len(counts)), counts)
        counts = np.bincount(owner[real.to_numpy(zero_copy_only=False)], minlength=len(counts))
        flat = flat.filter(real)
    return counts.astype(np.int64), flat


def spread_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start+1, ... of every range, one range after the other."""
    lengths = np.asarray(lengths, dtype=np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    shift = np.asarray(starts, dtype=np.int64) - (np.cumsum(lengths) - lengths)
    return np.repeat(shift, lengths) + np.arange(total, dtype=np.int64)


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums over consecutive groups of the given sizes; an empty group sums to zero."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def crc_remainder(spark_id: Column, modulus: int) -> Column:
    """crc32 of an id written as decimal text, modulo ``modulus``; a null id is text ''."""
    return F.crc32(F.coalesce(spark_id.cast("string"), F.lit("")).cast("binary")) % modulus
