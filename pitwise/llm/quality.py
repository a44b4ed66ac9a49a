"""A text classifier of averaged subword vectors, trained in numpy.

A text is the bag of its words, the byte n-grams inside each word and the pairs of following words,
each hashed to a row of one table of learned vectors. Their average goes through a softmax over two
classes. A pair is hashed by the difference of its words' hashes, so that a repeated word has one
row whatever the word is.

For two classes the trained model is a weight per row: scoring needs only that column, which is as
large as the number of buckets whatever the corpus. A batch is scored by its different words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitwise.llm.common import crc_remainder, pieces, spread_ranges, sums, unused, word_lists

BUCKET_BITS = 18
GRAMS = (2, 3, 4)
DIMENSIONS = 8
EPOCHS = 4
RATE = 0.3
BATCH = 32
#: Labelled rows that the model is fitted on at most, and the longest text among them in characters.
SAMPLE_ROWS = 4000
SAMPLE_CHARS = 1 << 16
THRESHOLD = 0.7
HELD_OUT_OF, HELD_OUT_AT = 4, 2
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(1099511628211)


def _bucket(hashes: np.ndarray, kind: int) -> np.ndarray:
    h = hashes * _ODD + np.uint64(kind * 0x632BE59BD9B4E019 % 2**64)
    h ^= h >> np.uint64(29)
    return ((h * _ODD) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def word_rows(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, rows of its own features one word after the other, rows per word)."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(words.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    size = np.diff(offsets) + 2
    ends = np.cumsum(size)
    heads = ends - size
    line = np.full(int(ends[-1]), ord("<"), dtype=np.uint64)
    line[ends - 1] = ord(">")
    line[spread_ranges(heads + 1, size - 2)] = raw
    powers = np.cumprod(np.full(int(size.max()), _BASE, dtype=np.uint64))
    hashes = np.add.reduceat(line * powers[spread_ranges(np.zeros(n, np.int64), size)], heads)
    found = [_bucket(hashes, 1)]
    owner = [np.arange(n)]
    whose = np.repeat(np.arange(n), size)
    for width in GRAMS:
        at = np.flatnonzero(np.arange(len(line)) + width <= ends[whose])
        h = np.zeros(len(at), dtype=np.uint64)
        for k in range(width):
            h = h * _BASE + line[at + k]
        found.append(_bucket(h, width + 1))
        owner.append(whose[at])
    owners = np.concatenate(owner)
    order = np.argsort(owners, kind="stable")
    return hashes, np.concatenate(found)[order], np.bincount(owners, minlength=n)


def text_rows(texts: pa.Array):
    """(words per text, index of every word among the different ones, those words' rows, pair rows, pairs per text)."""
    counts, flat = word_lists(texts)
    coded = flat.dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    hashes, rows, per_word = word_rows(coded.dictionary)
    inner = np.ones(max(len(index) - 1, 0), dtype=bool)
    stops = np.cumsum(counts)
    stops = stops[(stops > 0) & (stops < len(index))]
    inner[stops - 1] = False
    h = hashes[index]
    pairs = _bucket((h[:-1] - h[1:])[inner], 0)
    return counts, index, rows, per_word, pairs, np.maximum(counts - 1, 0)


@dataclass
class Model:
    """Vectors of the buckets, softmax weights (dimensions x 2) and biases."""

    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def per_bucket(self) -> np.ndarray:
        return (self.vectors @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float32)


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(texts: pa.Array, labels: np.ndarray, seed: int = 7) -> Model:
    """Stochastic gradient descent with per-parameter rates over batches of texts."""
    rng = np.random.default_rng(seed)
    size = 1 << BUCKET_BITS
    vectors = rng.uniform(-1, 1, (size, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    weights, bias = np.zeros((DIMENSIONS, 2)), np.zeros(2)
    if not len(texts):
        return Model(vectors, weights, bias)
    share = np.clip(np.bincount(labels, minlength=2) / len(labels), 1e-3, 1)
    bias = np.log(share)
    v_seen = np.full(size, 1e-8, dtype=np.float32)
    w_seen, b_seen = np.full((DIMENSIONS, 2), 1e-8), np.full(2, 1e-8)
    order = rng.permutation(len(texts))
    batches = []
    for at in range(0, len(order), BATCH):
        chosen = order[at : at + BATCH]
        counts, index, rows, per_word, pairs, pair_counts = text_rows(texts.take(pa.array(chosen)))
        places = np.cumsum(per_word) - per_word
        flat = rows[spread_ranges(places[index], per_word[index])]
        owner = np.repeat(np.repeat(np.arange(len(chosen)), counts), per_word[index])
        flat = np.concatenate([flat, pairs])
        owner = np.concatenate([owner, np.repeat(np.arange(len(chosen)), pair_counts)])
        total = np.maximum(np.bincount(owner, minlength=len(chosen)), 1)
        key, n = np.unique(owner * size + flat, return_counts=True)
        used, column = np.unique(key % size, return_inverse=True)
        # held for all epochs, so as narrow as can be: nine bytes a text's feature
        share_ = (n / total[key // size]).astype(np.float32)
        batches.append(((key // size).astype(np.uint8), column.astype(np.int32), share_, used.astype(np.int32), labels[chosen]))
    for epoch in range(EPOCHS):
        for b in rng.permutation(len(batches)):
            row, column, share_, used, y = batches[b]
            own = vectors[used]
            mean = np.stack([
                np.bincount(row, weights=share_ * own[column, d], minlength=len(y)) for d in range(DIMENSIONS)
            ], axis=1)
            error = _softmax(mean @ weights + bias)
            error[np.arange(len(y)), y] -= 1
            error /= len(y)
            back = error @ weights.T
            step_w, step_b = mean.T @ error, error.sum(axis=0)
            step_v = np.stack([
                np.bincount(column, weights=share_ * back[row, d], minlength=len(used)) for d in range(DIMENSIONS)
            ], axis=1)
            w_seen += step_w**2
            b_seen += step_b**2
            weights -= RATE * step_w / np.sqrt(w_seen)
            bias -= 0.1 * RATE * step_b / np.sqrt(b_seen)
            v_seen[used] += (step_v**2).mean(axis=1)
            vectors[used] -= RATE * step_v / np.sqrt(v_seen[used])[:, None]
    return Model(vectors, weights, bias)


def scores(texts: pa.Array, per_bucket: np.ndarray, bias: float) -> np.ndarray:
    """Probability of class 1 for each text; a text without words has the bias alone."""
    counts, index, rows, per_word, pairs, pair_counts = text_rows(texts)
    of_word = sums(per_bucket[rows].astype(np.float64), per_word)
    total = sums(of_word[index], counts) + sums(per_bucket[pairs].astype(np.float64), pair_counts)
    n = sums(per_word[index], counts) + pair_counts
    return 1 / (1 + np.exp(-(total / np.maximum(n, 1) + bias)))


def held_out(doc_id=None):
    return crc_remainder(F.col("doc_id") if doc_id is None else doc_id, HELD_OUT_OF) == HELD_OUT_AT


@dataclass
class Weights:
    """All that scoring needs of a model: one weight per bucket and the difference of the biases."""

    per_bucket: np.ndarray
    bias: float


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Weights:
    """Fit on at most ``rows`` labelled documents that are not held out.

    The sample is the rows with the smallest hash of doc_id among texts of up to ``SAMPLE_CHARS``
    characters. One task fits it; texts never come to the driver, only the weights do (1 MB at any
    size). Null labels, ids and texts are left out; without any label the model gives one half.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("quality"))
    usable = docs.where(F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS) & ~held_out())
    order = ["draw", "doc_id", "quality"]
    # the sample is drawn from ids alone, so only its own texts move
    ids = (
        usable.select("doc_id").join(known, "doc_id").withColumn("draw", F.xxhash64("doc_id"))
        .distinct().orderBy(*order).limit(rows)
    )
    chosen = (
        usable.select("doc_id", "text").join(F.broadcast(ids), "doc_id").orderBy(*order, "text").limit(rows)
        .select(F.col("text").cast("binary").alias("text"), "quality")
    )

    def run(batches):
        got = pa.Table.from_batches(batches, pa.schema([("text", pa.binary()), ("quality", pa.int32())]))
        labels_ = got.column("quality").to_numpy().astype(np.int64)
        model = fit(pa.chunked_array(got.column("text").chunks, pa.binary()).combine_chunks(), labels_)
        yield pa.RecordBatch.from_pydict({
            "weights": pa.array([model.per_bucket().tobytes()], pa.binary()),
            "bias": pa.array([float(model.bias[1] - model.bias[0])]),
        })

    fitted = chosen.coalesce(1).mapInArrow(run, "weights binary, bias double").first()
    if fitted is None:  # no partition at all, so nothing to learn from
        return Weights(np.zeros(1 << BUCKET_BITS, np.float32), 0.0)
    return Weights(np.frombuffer(fitted.weights, np.float32), fitted.bias)


def score(docs: DataFrame, model: Weights, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) of each whole text.

    Null and empty texts have the score of the bias; equal texts have equal scores up to the order
    of sums; every row is kept, and an empty table stays empty.
    """
    columns = [c for c in docs.columns if c != "score"]
    # a kept text column is read where it is; a batch does not hold it twice
    kept_text = text in columns and docs.schema[text].dataType.simpleString() in ("string", "binary")
    raw = text if kept_text else unused("raw", columns)
    weights, bias = model.per_bucket, model.bias

    def run(batches):
        for batch in batches:
            for part in pieces(batch, raw, 2 << 20):
                got = scores(part.column(raw), weights, bias)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(len(columns))), pa.array(got, pa.float64())],
                    names=[*columns, "score"],
                )

    schema = docs.select(*columns, F.lit(0.0).alias("score")).schema
    extra = [] if kept_text else [F.col(text).cast("binary").alias(raw)]
    return docs.select(*columns, *extra).mapInArrow(run, schema)


def classify(docs: DataFrame, model: Weights, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, model: Weights, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score at least ``threshold``, with their columns."""
    columns = docs.columns
    scored = score(docs.select(F.struct(*columns).alias("row"), F.col("text").alias("_text")), model, "_text")
    return scored.where(F.col("score") >= threshold).select(*[F.col("row")[c].alias(c) for c in columns])
