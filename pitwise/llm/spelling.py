"""Groups of spelling variants: words one edit apart, found by walking a trie kept as a table.

The trie is path-compressed: its nodes are the prefixes at which words end or part, its edges a
table (node, first letter, label, child). A search state is (word, position, node, edits). With no
edit a state lies on the word's own path, so those states are the word's own nodes; two words that
differ by one edit part at such a node. From there one letter is replaced or left out, and states
that have their edit move on by joins with the edge table, one edge per round, until the word is
used up: a node where a word ends is then a neighbour. A letter put in is a letter left out of the
other word, so pairs of unequal length are found from the longer word and mirrored.

Words part near the root far more often than further down. Each word is therefore walked twice:
edits in its latter half in the trie of the words, edits in its former half in the trie of the
words read backwards. The top of neither trie is ever walked, and no state meets more edges than
the alphabet has letters.

Nodes are named by a 64-bit hash of their prefix; the pairs found are checked on the words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitwise.llm.common import pieces
from pitwise.session import durable

LEAST_LENGTH = 7
LEAST_COUNT = 2
#: A form occurs at least so many times as often as the word it stands for.
TIMES = 10
#: One of so many runs of a document loses a letter.
DAMAGE = 31
RUN = "[A-Za-zÀ-ÿ]"
_BASE = np.uint64(0x9E3779B97F4A7C15)


def damaged(doc_id: str, run: str, modulus: int = DAMAGE) -> str:
    """The run, or the run without one of its code points if the hash of id and run says so."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    return run if h % modulus else run[: h % len(run)] + run[h % len(run) + 1 :]


def vocabulary(docs: DataFrame, length: int = LEAST_LENGTH, count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words of at least ``length`` code points with ``count`` occurrences or more.

    Words are maximal runs of letters of whole texts, A-Z in lower case, damaged by :func:`damaged`.
    A null text has none; the id of a null id is the empty text. A task hands on one row for each
    different word of a batch, so a word in every row is summed before it is shuffled.
    """
    find = re.compile(RUN + "{%d,}" % max(length, 1)).findall
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text", 8 << 20):
                total: Counter[str] = Counter()
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    if not text:
                        continue
                    head = zlib.crc32(f"{doc_id}:".encode())
                    for word, n in Counter(find(text)).items():
                        word = word.lower() if word.isascii() else word.translate(low)
                        h = zlib.crc32(word.encode(), head)
                        if h % DAMAGE == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < length:
                                continue
                        total[word] += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"]
                )

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= count)


def _half(words: pa.Array, back: bool) -> pa.RecordBatch:
    """(word, back, pos, node, next) of the latter halves of words, which are read as they are given.

    A node is the hash of a prefix; each direction has a trie of its own. A word with an empty half
    has no row.
    """
    sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), dtype="<u4")
    owner = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.cumsum(sizes) - sizes
    pos = np.arange(len(codes)) - starts[owner] + 1
    powers = np.cumprod(np.full(int(sizes.max(initial=0)) + 1, _BASE, dtype=np.uint64))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers[pos - 1], dtype=np.uint64)])
    node = sums[1:] - sums[starts][owner] + np.uint64(back)
    node ^= node >> np.uint64(29)
    node = (node * _BASE).view(np.int64)
    first = (sizes + 1 - back) // 2
    kept = np.flatnonzero((pos >= first[owner]) & (first[owner] > 0))
    letters, at = np.unique(codes, return_inverse=True)
    names = pa.array([chr(c) for c in letters] + [""], pa.string())
    following = np.append(at[1:], len(letters))
    following[pos == sizes[owner]] = len(letters)
    return pa.RecordBatch.from_arrays(
        [words.take(pa.array(owner[kept])), pa.array(np.full(len(kept), back)), pa.array(pos[kept].astype(np.int32)),
         pa.array(node[kept]), names.take(pa.array(following[kept]))],
        names=["word", "back", "pos", "node", "next"],
    )


def prefixes(words: DataFrame) -> DataFrame:
    """(word, back, pos, node, next): the nodes of the latter half of every word, in both directions.

    ``back`` marks words read backwards; ``next`` is '' at a word's end. The halves of the two
    directions meet, and a word one letter shorter reaches as far up as its longer partner's half.
    """

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "word", 1 << 20):
                forward = part.column("word").cast(pa.string())
                yield _half(forward, False)
                yield _half(pc.utf8_reverse(forward), True)

    return words.select("word").mapInArrow(run, "word string, back boolean, pos int, node long, next string")


def _bit(letter: Column) -> Column:
    """One bit for a letter; a few letters may share one, so a set of bits never misses a letter."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), (F.ascii(letter) % 63).cast("int"))


def trie(steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(own, edges) of the words' prefixes.

    ``own`` (word, back, pos, node, whole) are the nodes on each word's path at which words part
    (``whole`` where one of them ends); ``edges`` (node, first, label, size, child, ends, onward)
    lead from each such node to the next one or to the end of a word. ``onward`` has the bits of the
    letters that the child goes on with.
    """
    code = F.ascii("next")  # 0 at an end; numbers are aggregated without sorting
    parting = steps.groupBy("node").agg(
        F.min(code).alias("low"), F.max(code).alias("high"),
        F.bit_or(F.when(code > 0, _bit(F.col("next"))).otherwise(0)).alias("onward"),
    ).where("low != high").select("node", (F.col("low") == 0).alias("whole"), "onward")
    inner = steps.where("next != ''").join(parting, "node").select("word", "back", "pos", "node", "whole", "onward")
    last = steps.where("next = ''").join(parting.select("node", "onward"), "node", "left").select(
        "word", "back", "pos", "node", F.lit(True).alias("whole"), F.coalesce("onward", F.lit(0)).alias("onward")
    )
    # a window holds the nodes of one word
    along = Window.partitionBy("word", "back").orderBy("pos")
    following = F.lead(F.struct("pos", "node", "whole", "onward")).over(along)
    walked = durable(
        inner.unionByName(last).withColumn("to", following).where("to is not null").drop("onward"), "spelling-paths"
    )
    label = F.substring("word", F.col("pos") + 1, F.col("to.pos") - F.col("pos"))
    edges = (
        walked.groupBy("node", F.col("to.node").alias("child"), label.alias("label"))
        .agg(F.max("to.whole").alias("ends"), F.bit_or("to.onward").alias("onward"))
        .select("node", F.substring("label", 1, 1).alias("first"), "label", F.length("label").alias("size"), "child", "ends", "onward")
    )
    return walked.drop("to"), durable(edges, "spelling-edges")


def _rest(word: str, start: Column, size: Column) -> Column:
    """``size`` code points of a word from the 0-based place ``start``."""
    return F.substring(F.col(word), start + 1, size)


def frontier(own: DataFrame, edges: DataFrame) -> DataFrame:
    """(word, back, node): ends of words that one replaced or left out letter of ``word`` leads to."""
    pos, size = F.col("pos"), F.col("size")
    letter = F.substring("word", pos + 1, F.lit(1))
    here = own.join(edges, "node").where(F.col("first") != letter)
    replaced = F.substring("label", F.lit(2), size) == _rest("word", pos + 1, size - 1)
    dropped = F.col("label") == _rest("word", pos + 1, size)
    # a label may fit both ways, as in a run of one letter
    fits = F.when(replaced & dropped, F.array(pos + size, pos + 1 + size)).when(
        replaced, F.array(pos + size)).otherwise(F.array(pos + 1 + size))
    begun = here.where(replaced | dropped).select(
        "word", "back", F.explode(fits).alias("pos"), F.col("child").alias("node"), "ends", "onward"
    )
    length = F.length("word")
    shorter = own.where((pos == length - 1) & F.col("whole")).select("word", "back", "node")  # the last letter left out
    leads = F.col("onward").bitwiseAND(_bit(F.substring("word", pos + 1, F.lit(1)))) != 0
    alive = ((pos < length) & leads) | ((pos == length) & F.col("ends"))
    now = durable(begun.where(alive).drop("onward"), "spelling-states")
    done = shorter
    while True:
        done = done.unionByName(now.where(F.col("pos") == length).select("word", "back", "node"))
        going = now.where(F.col("pos") < length).drop("ends")
        if going.isEmpty():
            return done
        moved = (
            going.withColumn("first", F.substring("word", pos + 1, F.lit(1))).join(edges, ["node", "first"])
            .where(F.col("label") == _rest("word", pos, size))
            .select("word", "back", (pos + size).alias("pos"), F.col("child").alias("node"), "ends", "onward")
        )
        now = durable(moved.where(alive).drop("onward"), "spelling-states")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, near): all pairs of different words one inserted, deleted or replaced code point apart, both ways.

    ``words`` holds each word once. A word of one code point has no node above the empty prefix;
    pairs need at least two.
    """
    steps = durable(prefixes(words), "spelling-prefixes")
    own, edges = trie(steps)
    ends = steps.where("next = ''").select("node", F.col("word").alias("near"))
    met = frontier(own, edges).join(ends, "node").where(F.levenshtein("word", "near", 1) == 1)
    turned = met.select(*[F.when(F.col("back"), F.reverse(c)).otherwise(F.col(c)).alias(c) for c in ("word", "near")])
    pair = F.array(F.struct("word", "near"), F.struct(F.col("near").alias("word"), F.col("word").alias("near")))
    both = turned.select(F.explode(pair).alias("p")).select("p.word", "p.near")
    return durable(both.distinct(), "spelling-pairs")


def forms(words: DataFrame, pairs: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, n, n_near, form_n): the near word of largest n, if that is ``times`` the word's own."""
    near = pairs.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    fits = -F.col("best.less") >= times * F.col("n")
    return words.join(best, "word", "left").select(
        "word", F.when(fits, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(fits, -F.col("best.less")).alias("form_n"),
    )


def rooted(formed: DataFrame) -> DataFrame:
    """``formed`` with ``root``: the end of each word's chain of forms.

    A form is more frequent than its word, so chains end; every round doubles the steps.
    """
    chain = durable(formed.where("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = chain.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = chain.join(on, "root")
        if longer.isEmpty():
            break
        chain = durable(
            chain.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-roots"
        )
    return formed.join(chain, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the documents' vocabulary.

    Only ``doc_id`` and ``text`` are read. Null and empty texts have no words, repeated rows count
    again, ties of n go to the smaller word in code-point order; an empty table gives no row.
    """
    words = durable(vocabulary(docs), "spelling-words")
    return rooted(forms(words, neighbours(words))).select("word", "form", "root", "n", "n_near", "form_n")
