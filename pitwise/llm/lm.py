"""A log-bilinear language model over word classes, trained by noise-contrastive estimation.

There are as many classes as the square root of the number of different words (64 at least). The commonest words, those with
at least a class's share of all tokens, have one each; the others share classes by a hash of their
last three bytes. Classes lie in groups, about the square root of their number. The context vector
of a token is a sum of position matrices times vectors of the two classes before it; its products
with output vectors give the probability of the group and, inside the group, of the class, each
normalised. Inside a class a word has its share of the counts.

A part of the probability, as large as the share of tokens seen once, is kept for unknown words and
spread evenly over as many words as are estimated to be unseen, so that an unknown word has the
probability of one word and those of all next tokens sum to one. Where nothing is learnt, words are
strings of equally likely bytes.

Training runs where the tokens are. In each round every task starts from the same parameters, takes
steps over the training tokens of its blocks of that round, and the parameters are averaged row by
row, weighted by how often a task saw the row's class. So all contexts are learnt from once, in tasks
whose number grows with the corpus, and only parameters leave a task.

Documents are held in blocks, each with a list of its different words. Counts of the ``TOP``
commonest words go to all workers, a bounded list; those of rarer words come by a join on the word.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitwise.llm.common import crc_remainder, pieces, sums, word_lists
from pitwise.llm.tokenfile import grow, shrink
from pitwise.session import durable

LEAST_CLASSES = 64
DIMENSIONS = 16
ROUNDS = 2
BATCH = 8192
NOISE = 8
RATE = 0.2
BLOCK_BYTES = 2 << 20
#: Words whose counts go to all workers.
TOP = 1 << 18
HELD_OUT_OF, HELD_OUT_AT = 7, 2
END = b""
_AT_BITS = 26  # place of a word in its block, beside its count in one number
_BYTE = np.log10(257.0)  # a byte or the end of a word
_NEVER = -1e30


def blocks(docs: DataFrame) -> DataFrame:
    """Rows of (block, doc_ids, held, counts, tokens, words, train).

    ``words`` are the different words of a block (lower-cased, the end of a text is the empty word),
    ``train`` how often each occurs in training documents; ``counts`` are tokens per document and
    ``tokens`` indexes into the words, one document after the other, as :func:`shrink` packs them.
    """

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text", BLOCK_BYTES):
                text = part.column("text")
                lowered = [t.lower() + b" " if t is not None else b"" for t in text.to_pylist()]
                counts, flat = word_lists(pa.array(lowered, pa.binary()))
                coded = flat.dictionary_encode()
                n = len(coded.dictionary)
                tokens = np.insert(coded.indices.to_numpy(zero_copy_only=False), np.cumsum(counts), n).astype("<i4")
                held = part.column("held").to_numpy(zero_copy_only=False)
                learnt = tokens[np.repeat(~held, counts + 1)]
                words = pa.concat_arrays([coded.dictionary.cast(pa.binary()), pa.array([END], pa.binary())])
                yield pa.RecordBatch.from_pydict({
                    "doc_ids": pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                    "held": pa.array([held.tolist()], pa.list_(pa.bool_())),
                    "counts": pa.array([(counts + 1).tolist()], pa.list_(pa.int64())),
                    "tokens": pa.array([shrink(tokens)], pa.binary()),
                    "words": pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words),
                    "train": pa.array([np.bincount(learnt, minlength=n + 1).tolist()], pa.list_(pa.int64())),
                })

    held = crc_remainder(F.col("doc_id"), HELD_OUT_OF) == HELD_OUT_AT
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held"),
                      F.col("text").cast("binary").alias("text"))
    out = raw.mapInArrow(
        run, "doc_ids array<long>, held array<boolean>, counts array<long>, tokens binary, words array<binary>, train array<long>"
    )
    return out.select(F.monotonically_increasing_id().alias("block"), "*")


def word_counts(held: DataFrame) -> DataFrame:
    """(word, c) over the training documents; words of held-out documents alone are left out."""
    pairs = held.select(F.explode(F.arrays_zip("words", "train")).alias("x")).select(
        F.col("x.words").alias("word"), F.col("x.train").alias("n")
    )
    return pairs.where("n > 0").groupBy("word").agg(F.sum("n").alias("c"))


@dataclass
class Classes:
    """The words with a class of their own, by class; all others share the classes after them."""

    single: dict[bytes, int]
    shared: int

    @property
    def size(self) -> int:
        return len(self.single) + self.shared

    @property
    def groups(self) -> int:
        return max(1, round(self.size**0.5))

    def of(self, words: list[bytes]) -> np.ndarray:
        get, crc, first, shared = self.single.get, zlib.crc32, len(self.single), self.shared
        return np.array(
            [k if (k := get(w)) is not None else first + crc(w[-3:]) % shared for w in words], dtype=np.int32
        )


def classes_for(counts: DataFrame, n: int, v: int) -> Classes:
    """Classes for ``v`` different words and ``n`` tokens: the square root of ``v``, or the least number."""
    size = max(LEAST_CLASSES, round(v**0.5))
    own = counts.where((F.length("word") > 0) & (F.col("c") * size >= n))
    top = own.orderBy(F.desc("c"), "word").limit(size - 1).collect()
    single = {END: 0} | {bytes(r.word): k + 1 for k, r in enumerate(top)}
    return Classes(single, max(1, size - len(single)))


def class_counts(counts: DataFrame, classes: Classes) -> np.ndarray:
    """Training tokens of every class; zero where no training word falls into it."""

    def run(batches):
        total = np.zeros(classes.size, dtype=np.int64)
        for batch in batches:
            kinds = classes.of(batch.column("word").to_pylist())
            np.add.at(total, kinds, batch.column("c").to_numpy())
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["k", "s"])

    out = np.zeros(classes.size, dtype=np.int64)
    for r in counts.mapInArrow(run, "k long, s long").groupBy("k").agg(F.sum("s").alias("s")).collect():
        out[r.k] = r.s
    return out


def _context(kinds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes here, one back and two back; before a text lie ends of text."""
    edge = np.array([end], dtype=kinds.dtype)
    back = np.concatenate([edge, kinds[:-1]])
    far = np.concatenate([edge, back[:-1]])
    far[back == end] = end
    return kinds, back, far


class Model:
    """Context vectors of the classes, a matrix for each position, output vectors and biases.

    The parameters are rows of one matrix, in that order; a bias is the last number of its row.
    Class ``k`` lies in group ``k % groups``.
    """

    def __init__(self, in_class: np.ndarray, groups: int, rows: np.ndarray | None = None):
        self.k, self.g, d = len(in_class), groups, DIMENSIONS
        self.member = np.arange(self.k) % groups
        in_group = np.bincount(self.member, weights=in_class, minlength=groups)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.class_share = np.where(in_class > 0, in_class / in_group[self.member], 0.0)
            self.group_share = in_group / max(in_group.sum(), 1)
            self.log_class = np.where(self.class_share > 0, np.log(self.class_share), _NEVER).astype(np.float32)
            self.log_group = np.where(self.group_share > 0, np.log(self.group_share), _NEVER).astype(np.float32)
        self.class_noise, self.group_noise = self.class_share.astype(np.float32), self.group_share.astype(np.float32)
        if rows is None:
            rng = np.random.default_rng(3)
            rows = np.zeros((2 * self.k + 2 * d + groups, d + 1), dtype=np.float32)
            rows[: self.k, :d] = rng.normal(0, 0.3, (self.k, d))
            rows[self.k : self.k + 2 * d, :d] = np.concatenate([np.eye(d), 0.5 * np.eye(d)])
        self.rows = rows
        at = np.cumsum([0, self.k, d, d, groups, self.k])
        self.context, self.near, self.far, self.by_group, self.by_class = (
            rows[a:b] for a, b in zip(at[:-1], at[1:])
        )

    def hidden(self, back: np.ndarray, far: np.ndarray) -> np.ndarray:
        d = DIMENSIONS
        return self.context[back, :d] @ self.near[:, :d] + self.context[far, :d] @ self.far[:, :d]

    def log_probabilities(self, here: np.ndarray, back: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Natural log of P(class here | classes before it), normalised over groups and inside each."""
        d, out = DIMENSIONS, np.empty(len(here))
        group_bias = self.by_group[:, d] + self.log_group
        class_bias = self.by_class[:, d] + self.log_class
        for start in range(0, len(here), 1 << 15):
            part = np.arange(start, min(start + (1 << 15), len(here)))
            part = part[np.argsort(self.member[here[part]], kind="stable")]
            h, k = self.hidden(back[part], far[part]), here[part]
            own = self.member[k]
            value = _normalised(h @ self.by_group[:, :d].T + group_bias, own)
            ends = np.searchsorted(own, np.arange(self.g + 1))
            for g in np.unique(own):
                at = slice(ends[g], ends[g + 1])
                scores = h[at] @ self.by_class[g :: self.g, :d].T + class_bias[g :: self.g]
                value[at] += _normalised(scores, k[at] // self.g)
            out[part] = value
        return out


def _normalised(scores: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Log-softmax of the chosen column of each row; ``scores`` are used up."""
    scores -= scores.max(axis=1, keepdims=True)
    value = scores[np.arange(len(chosen)), chosen]
    np.exp(scores, out=scores)
    return value - np.log(scores.sum(axis=1))


class Trainer:
    """Steps of noise-contrastive estimation from given parameters.

    A token's group is told from noise groups and its class from noise classes of its group, which
    come ``NOISE`` times as often and in their own shares. The noise is not drawn: its part of the
    gradient is summed over all groups and over all classes of the group, by matrix products.
    """

    def __init__(self, model: Model, seed: int):
        self.m, self.rng = model, np.random.default_rng(seed)
        self.seen = np.full(model.rows.shape, 1e-6, dtype=np.float32)
        self.uses = np.zeros(len(model.rows))
        at = np.cumsum([0, model.k, DIMENSIONS, DIMENSIONS, model.g, model.k])
        self.parts = list(zip(at[:-1], at[1:]))
        self.seen_of = [self.seen[a:b] for a, b in self.parts]

    @staticmethod
    def _error(hidden: np.ndarray, vectors: np.ndarray, share: np.ndarray, true: np.ndarray) -> np.ndarray:
        """Gradient of the loss in every score; the share is part of score and noise, so it cancels."""
        real = 1 / (1 + NOISE * np.exp(-(hidden @ vectors.T)))  # how likely each is no noise
        error = real * (NOISE * share)
        rows = np.arange(len(true))
        error[rows, true] += real[rows, true] - 1
        return error

    def _apply(self, table: np.ndarray, seen: np.ndarray, grad: np.ndarray) -> None:
        seen += grad**2
        table -= RATE * grad / np.sqrt(seen)

    def step(self, here: np.ndarray, back: np.ndarray, far: np.ndarray) -> None:
        m, d, n = self.m, DIMENSIONS, len(here)
        order = np.argsort(m.member[here], kind="stable")
        here, back, far = here[order], back[order], far[order]
        own = m.member[here]
        c1, c2 = m.context[back, :d], m.context[far, :d]
        hidden = np.ones((n, d + 1), dtype=np.float32)
        hidden[:, :d] = c1 @ m.near[:, :d] + c2 @ m.far[:, :d]
        error = self._error(hidden, m.by_group, m.group_noise, own)
        g_hidden = error @ m.by_group[:, :d]
        g_group, g_class = error.T @ hidden, np.zeros_like(m.by_class)
        ends = np.searchsorted(own, np.arange(m.g + 1))
        for g in np.unique(own):
            part = slice(ends[g], ends[g + 1])
            vectors = m.by_class[g :: m.g]
            error = self._error(hidden[part], vectors, m.class_noise[g :: m.g], here[part] // m.g)
            g_hidden[part] += error @ vectors[:, :d]
            g_class[g :: m.g] = error.T @ hidden[part]
        g_context = np.zeros((m.k, d), dtype=np.float32)
        for kinds, place in ((back, m.near), (far, m.far)):
            change = g_hidden @ place[:, :d].T
            for i in range(d):
                g_context[:, i] += np.bincount(kinds, weights=change[:, i], minlength=m.k)
        for i, grad in ((1, c1.T @ g_hidden), (2, c2.T @ g_hidden), (0, g_context)):
            table = (m.context, m.near, m.far)[i]
            self._apply(table[:, :d], self.seen_of[i][:, :d], grad)
        self._apply(m.by_group, self.seen_of[3], g_group)
        self._apply(m.by_class, self.seen_of[4], g_class)
        for i, rows in ((0, back), (0, far), (3, own), (4, here)):
            first, last = self.parts[i]
            self.uses[first:last] += np.bincount(rows, minlength=last - first)
        self.uses[self.parts[1][0] : self.parts[2][1]] += n


def train(held: DataFrame, classes: Classes, in_class: np.ndarray) -> Model:
    """Parameters learnt from the training tokens of all blocks, each in one of ``ROUNDS`` rounds."""
    model = Model(in_class, classes.groups)
    slim = held.select("block", "words", "tokens", "counts", "held")
    of_round = F.pmod(F.xxhash64("block"), F.lit(ROUNDS))
    for turn in range(ROUNDS):
        now = held.sparkSession.sparkContext.broadcast(model.rows)

        def run(batches):
            trainer = None
            for batch in batches:
                for row in range(batch.num_rows):
                    get = lambda c: batch.column(c)[row].as_py()  # noqa: E731,B023
                    if trainer is None:
                        trainer = Trainer(Model(in_class, classes.groups, now.value.copy()), get("block") * ROUNDS + turn)
                    kinds = classes.of(get("words"))[grow(get("tokens"))]
                    use = np.repeat(~np.array(get("held"), dtype=bool), np.array(get("counts"), dtype=np.int64))
                    here, back, far = (x[use] for x in _context(kinds, classes.single[END]))
                    order = trainer.rng.permutation(len(here))
                    for at in range(0, len(order), BATCH):
                        pick = order[at : at + BATCH]
                        trainer.step(here[pick], back[pick], far[pick])
            if trainer is not None:
                used = np.flatnonzero(trainer.uses)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used), pa.array(trainer.uses[used]),
                     pa.array(trainer.m.rows[used].astype(np.float64).tolist(), pa.list_(pa.float64()))],
                    names=["row", "weight", "vector"],
                )

        found = slim.where(of_round == turn).mapInArrow(run, "row long, weight double, vector array<double>").select(
            "row", "weight", array_to_vector("vector").alias("vector")
        ).groupBy("row").agg(Summarizer.mean(F.col("vector"), F.col("weight")).alias("vector"))
        rows = model.rows.copy()
        for r in found.collect():  # as many as there are parameters' rows
            rows[r.row] = r.vector.toArray()
        model = Model(in_class, classes.groups, rows)
    return model


def unseen(once: int, twice: int) -> float:
    """How many words were not seen: Chao's estimate from those seen once and twice, one at least."""
    return max(1.0, once * (once - 1) / (2 * (twice + 1)))


def rare_counts(held: DataFrame, counts: DataFrame, top) -> DataFrame:
    """(block, found): places and counts of a block's training words that are not among ``top``."""

    def run(batches):
        known = pa.array(top.value[0], pa.binary())
        for batch in batches:
            for row in range(batch.num_rows):
                words = batch.column("words")[row].values
                rare = np.flatnonzero(pc.is_null(pc.index_in(words, value_set=known)).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rare), batch.column("block")[row].as_py())), pa.array(rare), words.take(pa.array(rare))],
                    names=["block", "at", "word"],
                )

    asked = held.select("block", "words").mapInArrow(run, "block long, at long, word binary")
    packed = F.shiftleft("c", _AT_BITS) + F.col("at")
    return asked.join(counts, "word").select("block", packed.alias("x")).groupBy("block").agg(
        F.collect_list("x").alias("found")  # a block's own words at most
    )


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Null and empty texts are one end token. Without training documents all counts are 0, and every
    token is unknown. Every row is scored by itself, so equal texts have equal scores; repeated rows
    of training documents count as often as they are there. An empty table gives none. Only
    ``doc_id`` and ``text`` are read.
    """
    held = durable(blocks(docs), "lm-blocks")
    counts = durable(word_counts(held), "lm-counts")
    total = counts.agg(
        F.sum("c").alias("n"), F.count("*").alias("v"), F.count_if(F.col("c") == 1).alias("once"),
        F.count_if(F.col("c") == 2).alias("twice"),
    ).first()
    n, v = total.n or 0, total.v
    unknown = min(max(total.once / n, 1e-9), 0.5) if n else 1.0
    classes = classes_for(counts, n, v)
    in_class = class_counts(counts, classes)
    model = train(held, classes, in_class) if n else Model(in_class, classes.groups)
    common = counts.orderBy(F.desc("c"), "word").limit(TOP).toArrow()
    spark = held.sparkSession.sparkContext
    top = spark.broadcast((common.column("word").to_pylist(), common.column("c").to_numpy()))
    fitted = spark.broadcast(model.rows)
    groups = classes.groups
    joined = held.join(rare_counts(held, counts, top), "block", "left").drop("block", "train")
    base_n = np.log10(float(n + v + 1))
    log_known = np.log10(1 - unknown) if unknown < 1 else 0.0
    log_unknown = np.log10(unknown / unseen(total.once, total.twice))

    def run(batches):
        known_words, known_counts = pa.array(top.value[0], pa.binary()), top.value[1]
        learnt = Model(in_class, groups, fitted.value)
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda c: batch.column(c)[row].as_py()  # noqa: E731,B023
                tokens = grow(get("tokens"))
                per_doc = np.array(get("counts"), dtype=np.int64)
                words = batch.column("words")[row].values
                place = pc.index_in(words, value_set=known_words)
                common_at = np.flatnonzero(pc.is_valid(place).to_numpy(zero_copy_only=False))
                c = np.zeros(len(words), dtype=np.int64)
                c[common_at] = known_counts[place.drop_null().to_numpy()]
                if batch.column("found")[row].is_valid:
                    packed = batch.column("found")[row].values.to_numpy()
                    c[packed & ((1 << _AT_BITS) - 1)] = packed >> _AT_BITS
                names = words.to_pylist()
                kinds, known = classes.of(names), c > 0
                base = np.log10(c + 1.0) - base_n
                share = np.empty(len(c))
                share[known] = np.log10(c[known] / in_class[kinds[known]]) + log_known
                share[~known] = log_unknown if n else [-(len(w) + 1) * _BYTE for w in names]
                here, back, far = _context(kinds[tokens], classes.single[END])
                seen = known[tokens]
                value = share[tokens]
                value[seen] += learnt.log_probabilities(here[seen], back[seen], far[seen]) / np.log(10)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(get("doc_ids"), pa.int64()),
                    "held_out": pa.array(get("held"), pa.bool_()),
                    "n_tokens": pa.array(per_doc),
                    "n_known": pa.array(sums(seen.astype(np.int64), per_doc)),
                    "train_tokens": pa.array(np.full(len(per_doc), n, dtype=np.int64)),
                    "base_score": pa.array(sums(base[tokens], per_doc)),
                    "score": pa.array(sums(value, per_doc)),
                })

    return joined.mapInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
