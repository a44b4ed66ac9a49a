"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased and cut at white space; every word, between two marks for its edges, gives its
n-grams of one to four code points, and each is hashed to a bucket. Training sums the n-grams of all
learnt documents by language and bucket; the matrix of log-probabilities, whose size is set by the
number of languages alone, goes to all workers. A batch is scored as a sparse product: the sum of
matrix rows is made once for each different word and then added up along the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitwise.llm.common import crc_remainder, pieces, sums, unused, word_lists

GRAMS = (1, 2, 3, 4)
#: Buckets of n-grams, and the most cells (languages x buckets) that the matrix may have.
BUCKETS = 1 << 16
CELLS = 1 << 22
SMOOTHING = 0.5
#: N-grams hashed at a time; bounds the memory that one long word takes.
SPAN = 1 << 19
PIECE_BYTES = 2 << 20
UNKNOWN = "und"
HELD_OUT_OF, HELD_OUT_AT = 4, 2
_ODD = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: Column | None = None) -> Column:
    """Rows that the model never learns from: crc32 of the id as text leaves 2 modulo 4."""
    return crc_remainder(F.col("doc_id") if doc_id is None else doc_id, HELD_OUT_OF) == HELD_OUT_AT


def buckets_for(languages: int) -> int:
    """Buckets per language, a power of two, so that the matrix has at most ``CELLS`` cells."""
    if languages > CELLS >> 8:
        raise ValueError(f"{languages} languages; at most {CELLS >> 8} can be told apart")
    buckets = BUCKETS
    while buckets * max(languages, 1) > CELLS:
        buckets >>= 1
    return buckets


def grams(words: pa.Array, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word index, bucket) of every n-gram, in spans of positions."""
    if not len(words):
        return
    size = pc.utf8_length(words.view(pa.string())).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    ends = np.cumsum(size)
    text = pa.array([b"<" + w + b">" for w in words.to_pylist()], pa.binary())
    line = np.frombuffer(b"".join(text.to_pylist()).decode().encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    for start in range(0, len(line), SPAN):
        stop = min(start + SPAN, len(line))
        at = np.arange(start, stop)
        whose = np.searchsorted(ends, at, side="right")
        h = np.zeros(len(at), dtype=np.uint64)
        for width in range(1, max(GRAMS) + 1):
            inside = at + width <= ends[whose]
            at, whose, h = at[inside], whose[inside], h[inside]
            h = (h + line[at + width - 1] + np.uint64(1)) * _ODD
            h ^= h >> np.uint64(31)
            if width in GRAMS:
                yield whose, ((h * _ODD) >> np.uint64(40)).astype(np.int64) & (buckets - 1)


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words per text, index of every word among the different ones, and those."""
    lowered = pc.utf8_lower(pc.fill_null(texts.cast(pa.binary()), b"").view(pa.string()))
    counts, flat = word_lists(lowered)
    coded = flat.dictionary_encode()
    return counts, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.cast(pa.binary())


@dataclass
class Model:
    """Languages in order, the log of their share of learnt documents, and log-probabilities of buckets."""

    languages: list[str]
    prior: np.ndarray
    weights: np.ndarray  # buckets x languages


def train(docs: DataFrame) -> Model:
    """Learn from every row that is not held out and whose ``lang`` and ``text`` are not null.

    Counts are summed over all of them: a task keeps one array per language, and only sums by
    language and bucket, at most ``CELLS`` rows, are shuffled and read back. Repeated rows count as
    often as they are there; without any such row the model knows no language.
    """
    learnt = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("binary").alias("text")
    )
    share = learnt.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit((CELLS >> 8) + 1).collect()
    buckets = buckets_for(len(share))
    languages = [r.lang for r in share]
    if not languages:
        return Model([], np.zeros(0), np.zeros((buckets, 0), np.float32))

    def run(batches):
        place = {w: k for k, w in enumerate(languages)}
        total = np.zeros((len(languages), buckets), dtype=np.int64)
        for batch in batches:
            for part in pieces(batch, "text", PIECE_BYTES):
                counts, index, words = _words(part.column("text"))
                spoken = np.array([place[w] for w in part.column("lang").to_pylist()], dtype=np.int64)
                of_word = np.repeat(spoken, counts)
                found = {k: np.bincount(index[of_word == k], minlength=len(words)) for k in np.unique(of_word)}
                for whose, bucket in grams(words, buckets):
                    for k, n in found.items():
                        total[k] += np.bincount(bucket, weights=n[whose], minlength=buckets).astype(np.int64)
        at, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at), pa.array(bucket), pa.array(total[at, bucket])], names=["k", "bucket", "n"]
        )

    summed = learnt.mapInArrow(run, "k long, bucket long, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n"))
    got = summed.toArrow()
    table = np.full((buckets, len(languages)), SMOOTHING)
    table[got.column("bucket").to_numpy(), got.column("k").to_numpy()] += got.column("n").to_numpy()
    table = np.log(table) - np.log(table.sum(axis=0))
    seen = np.array([r.n for r in share], dtype=np.float64)
    return Model(languages, np.log(seen / seen.sum()), table.astype(np.float32))


def posteriors(texts: pa.Array, model: Model) -> np.ndarray:
    """Probability of every language for each text."""
    counts, index, words = _words(texts)
    k, buckets = len(model.languages), len(model.weights)
    of_word = np.zeros((len(words), k))
    for whose, bucket in grams(words, buckets):
        for c in range(k):
            of_word[:, c] += np.bincount(whose, weights=model.weights[bucket, c], minlength=len(words))
    total = np.stack([sums(of_word[index, c], counts) for c in range(k)], axis=1) + model.prior
    e = np.exp(total - total.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the probability of that language.

    A text that is null or has no letter is ``und`` with score 0, and so is every text of a model
    without languages. Equally likely languages give the first in order. Every row is kept, with
    equal answers for equal texts up to the order of sums; columns of the names ``lang_pred`` and
    ``score`` in any case are replaced. An empty table stays empty.
    """
    columns = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    raw = unused("raw", columns)
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.prior, model.weights))

    def run(batches):
        learnt = Model(*shared.value)
        for batch in batches:
            for part in pieces(batch, raw, PIECE_BYTES):
                texts = part.column(raw)
                spoken = pc.fill_null(pc.match_substring_regex(texts.cast(pa.binary()).view(pa.string()), r"\pL"), False)
                sure = np.zeros(len(texts))
                names = np.full(len(texts), UNKNOWN, dtype=object)
                at = np.flatnonzero(spoken.to_numpy(zero_copy_only=False))
                if len(at) and learnt.languages:
                    p = posteriors(texts.take(pa.array(at)), learnt)
                    best = p.argmax(axis=1)
                    sure[at] = p[np.arange(len(at)), best]
                    names[at] = np.array(learnt.languages, dtype=object)[best]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(len(columns))), pa.array(names, pa.string()), pa.array(sure)],
                    names=[*columns, "lang_pred", "score"],
                )

    schema = docs.select(*columns, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return docs.select(*columns, F.col(text).cast("binary").alias(raw)).mapInArrow(run, schema)


def classify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row; the model learns from ``docs`` if none is given."""
    model = train(docs) if model is None else model
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
