"""Token ids in sorted binary shards: ids ranked by frequency, variable-length bytes, control bytes.

A shard is the magic ``PWIDS1\\n\\0`` and blocks. A block holds whole documents: a header of four
little-endian unsigned 32-bit integers (documents, tokens, control bytes, data bytes), one validity
byte per doc_id, the doc_ids (signed 64-bit), the token counts (unsigned 32-bit), the control bytes
and the data bytes. Every id is replaced by its frequency rank, so common ids take one byte; a
control byte holds the lengths less one of four ranks, two bits each. A decoder turns control bytes
into lengths by a table of 256 rows and gathers the data in numpy.

Beside the shards lie two Parquet tables: ``ids`` (rank, id) and ``shards`` (shard, file, docs,
tokens).
"""

from __future__ import annotations

import os
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitwise.llm.common import pieces, spread_ranges
from pitwise.session import durable

MAGIC = b"PWIDS1\n\0"
HEADER, HEADER_BYTES = "<4I", 16
BLOCK_TOKENS = 1 << 16
END_ID = 2
#: Lengths of the four integers of every control byte.
LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], dtype=np.uint8)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit integers."""
    v = np.asarray(values, dtype=np.uint32)
    code = ((v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)).astype(np.uint8)
    padded = np.zeros(-(-len(v) // 4) * 4, dtype=np.uint8)
    padded[: len(v)] = code
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    size = code.astype(np.int64) + 1
    place = np.cumsum(size) - size
    data = np.zeros(int(size.sum()), dtype=np.uint8)
    for k in range(4):
        some = size > k
        data[place[some] + k] = (v[some] >> np.uint32(8 * k)).astype(np.uint8)
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The integers of :func:`pack`, by table lookup of the control bytes."""
    size = LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:n].astype(np.int64)
    place = np.cumsum(size) - size
    raw = np.frombuffer(data, dtype=np.uint8)
    out = np.zeros(n, dtype=np.uint32)
    for k in range(4):
        some = size > k
        if some.any():
            out[some] |= raw[place[some] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def write_block(out, doc_ids: list[int | None], counts: np.ndarray, ranks: np.ndarray) -> None:
    control, data = pack(ranks)
    valid = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    out.write(struct.pack(HEADER, len(doc_ids), len(ranks), len(control), len(data)))
    out.write(valid.tobytes())
    out.write(np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes())
    out.write(np.asarray(counts, dtype="<u4").tobytes())
    out.write(control)
    out.write(data)


def read_blocks(source):
    """(doc_ids, counts, ranks) of every block of an open shard."""
    if source.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a token shard")
    while head := source.read(HEADER_BYTES):
        docs, tokens, controls, size = struct.unpack(HEADER, head)
        valid = np.frombuffer(source.read(docs), dtype=np.uint8)
        raw = np.frombuffer(source.read(8 * docs), dtype="<i8")
        counts = np.frombuffer(source.read(4 * docs), dtype="<u4").astype(np.int64)
        ranks = unpack(source.read(controls), source.read(size), tokens)
        yield [int(d) if v else None for d, v in zip(raw, valid)], counts, ranks

LATIN_END = "\u0250"


def _byte_letters() -> dict[int, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for letters from 256."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in plain)}


BYTE_LETTERS = _byte_letters()


@lru_cache(maxsize=1)
def _zstd():
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def shrink(ids: np.ndarray) -> bytes:
    """Ids of one document for the way between tasks: their width in bytes, then compressed."""
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    return bytes([width]) + _zstd()[0].compress(ids.astype(f"<u{width}").tobytes())


def grow(raw: bytes) -> np.ndarray:
    return np.frombuffer(_zstd()[1].decompress(raw[1:]), dtype=f"<u{raw[0]}").astype("<u4")


class WordEncoder:
    """The tokenizer library with a memory of pieces between white space.

    For vocabularies that drop white space and never join across it, the ids of a text are those of
    its pieces in order. A piece is also cut where ASCII punctuation follows an ASCII letter: the
    pre-tokenizer cuts there anyway, and fewer different pieces remain. Apostrophes and the marks
    of special tokens are never cut at.
    """

    KEPT = 3 << 18

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known: dict[bytes, bytes] = {}
        kind = np.zeros(256, dtype=np.uint8)
        kind[list(b" \t\n\x0b\x0c\r")] = 1
        kind[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 2
        kind[list(b".,%&*#$!;:?)")] = 3
        self.kind = kind

    def _new(self, pieces_: list[bytes]) -> list[list[int]]:
        """Ids of pieces not met before.

        A piece of Latin letters alone is one word to the normaliser and pre-tokenizer, so the
        library's model is asked directly; all others go through the whole library.
        """
        out: list[list[int] | None] = []
        rest = []
        for k, piece in enumerate(pieces_):
            word = piece.decode("utf-8").lower()
            if word.isalpha() and max(word) < LATIN_END:
                if not piece.isascii():
                    word = word.encode("utf-8").decode("latin-1").translate(BYTE_LETTERS)
                out.append([t.id for t in self.model.tokenize(word)])
            else:
                out.append(None)
                rest.append(k)
        texts = [pieces_[k].decode("utf-8") for k in rest]
        for at in range(0, len(texts), 4096):
            got = self.tokenizer.encode_batch(texts[at : at + 4096], add_special_tokens=False)
            for k, e in zip(rest[at : at + 4096], got):
                out[k] = e.ids
        return out

    def _lookup(self, found: list[bytes]) -> list[bytes]:
        get = self.known.get
        out = [get(p) for p in found]
        missed = [k for k, ids in enumerate(out) if ids is None]
        if missed:
            new = [found[k] for k in missed]
            if len(self.known) + len(new) > self.KEPT:
                self.known.clear()
            keys = [p.lower() if p.isascii() and b"<" not in p else p for p in new]
            fresh = [k for k in dict.fromkeys(keys) if k not in self.known]
            for key, ids in zip(fresh, self._new(fresh)):
                self.known[key] = struct.pack(f"<{len(ids)}I", *ids)
            for k, p, key in zip(missed, new, keys):
                out[k] = self.known[p] = self.known[key]
        return out

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and how many belong to each text."""
        data = b" ".join(texts) + b" "
        kind = self.kind[np.frombuffer(data, dtype=np.uint8)]
        blank = kind == 1
        cut = np.ones(len(data), dtype=bool)
        cut[1:] = (blank[1:] != blank[:-1]) | ((kind[:-1] == 2) & (kind[1:] == 3))
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        heads = np.cumsum(sizes) - sizes
        cut[heads] = True
        cuts = np.flatnonzero(cut)
        pieces_ = pa.BinaryArray.from_buffers(
            pa.binary(), len(cuts),
            [None, pa.py_buffer(np.append(cuts, len(data)).astype(np.int32)), pa.py_buffer(data)],
        ).dictionary_encode()
        found = self._lookup(pieces_.dictionary.to_pylist())
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        index = pieces_.indices.to_numpy()
        each = lengths[index]
        places = np.cumsum(lengths) - lengths
        ids = np.frombuffer(b"".join(found), dtype="<u4")[spread_ranges(places[index], each)]
        upto = np.concatenate([[0], np.cumsum(each)])
        bounds = upto[np.searchsorted(cuts, np.append(heads, len(data)))]
        return ids, np.diff(bounds)


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def tokenize(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids): the ids of each document as :func:`shrink` packs them, the end id last.

    Null and empty texts have the end id alone.
    """

    def run(batches):
        own = word_encoder(path)
        for batch in batches:
            for part in pieces(batch, "text", 4 << 20):
                ids, counts = own.encode([t or b"" for t in part.column("text").to_pylist()])
                full = np.insert(ids, np.cumsum(counts), end_id).astype("<u4")
                each = np.split(full, np.cumsum(counts + 1)[:-1])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([shrink(x) for x in each], pa.binary())], names=["doc_id", "ids"]
                )

    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return raw.mapInArrow(run, "doc_id long, ids binary")


def id_counts(tokens: DataFrame) -> DataFrame:
    """(id, n) over all documents; a task sums its own rows first."""

    def run(batches):
        total = np.zeros(1, dtype=np.int64)
        for batch in batches:
            for part in pieces(batch, "ids"):
                got = np.bincount(np.concatenate([grow(x) for x in part.column("ids").to_pylist()]))
                if len(got) > len(total):
                    total = np.pad(total, (0, len(got) - len(total)))
                total[: len(got)] += got
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    return tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_tokens(tokens: DataFrame, folder: str) -> None:
    """Write (doc_id, shrunk ids) as shards in ascending doc_id order under ``folder``.

    Rows of equal doc_id follow the order of their packed ids; null doc_ids come first. The rank table is
    as large as the vocabulary. A task writes its shard under a name of its own attempt and moves
    it into place when it is whole, so a task that runs again does no harm.
    """
    spark = tokens.sparkSession
    ordered = id_counts(tokens).orderBy(F.desc("n"), "id").collect()
    by_rank = np.array([r.id for r in ordered], dtype="<u4")
    spark.createDataFrame([(k, int(i)) for k, i in enumerate(by_rank)], "rank long, id long").coalesce(1).write.parquet(f"{folder}/ids")
    rank_of = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, dtype=np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)

    def run(batches):
        context = TaskContext.get()
        shard = context.partitionId()
        store, base = arrow_fs.FileSystem.from_uri(folder)
        name = f"shard-{shard:06d}.ids"
        draft = f"{base}/_{name}.{context.taskAttemptId()}"
        docs = tokens_ = 0
        held: list = []
        waiting = 0
        out = None

        def flush():
            nonlocal held, waiting
            raw = [x for _, x in held]
            write_block(out, [d for d, _ in held], np.array([len(x) for x in raw]), rank_of[np.concatenate(raw)])
            held, waiting = [], 0

        for batch in batches:
            for part in pieces(batch, "ids"):
                if out is None:
                    out = store.open_output_stream(draft)
                    out.write(MAGIC)
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), part.column("ids").to_pylist()):
                    held.append((doc_id, grow(ids)))
                    waiting += len(held[-1][1])
                    docs += 1
                    tokens_ += len(held[-1][1])
                    if waiting >= BLOCK_TOKENS:
                        flush()
        if out is None:
            return
        if held:
            flush()
        out.close()
        store.move(draft, f"{base}/{name}")
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int64()), pa.array([name]), pa.array([docs], pa.int64()), pa.array([tokens_], pa.int64())],
            names=["shard", "file", "docs", "tokens"],
        )

    store, base = arrow_fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    placed = tokens.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    placed.mapInArrow(run, "shard long, file string, docs long, tokens long").write.parquet(f"{folder}/shards")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the shards; ``start`` counts all tokens before.

    Two tables of one row per shard and per id are all that is gathered.
    """
    table = spark.read.parquet(f"{folder}/ids").orderBy("rank").collect()
    by_rank = np.array([r.id for r in table], dtype="<u4")
    shards = spark.read.parquet(f"{folder}/shards")
    before = F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    listed = shards.select("shard", "file", F.coalesce(before, F.lit(0)).alias("base"))

    def run(batches):
        store, base = arrow_fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                start = row["base"]
                with store.open_input_stream(f"{base}/{row['file']}") as source:
                    for doc_ids, counts, ranks in read_blocks(source):
                        flat = by_rank[ranks]
                        ends = np.cumsum(counts)
                        cuts = np.concatenate([[0], ends]) * 4
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(doc_ids, pa.int64()), pa.array(start + ends - counts), pa.array(counts),
                             pa.BinaryArray.from_buffers(pa.binary(), len(counts), [
                                 None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(flat.tobytes())])],
                            names=["doc_id", "start", "n_tokens", "ids"],
                        )
                        start += int(counts.sum())

    each = listed.repartition(max(1, shards.count()), "shard")
    return each.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, path: str, folder: str, end_id: int = END_ID) -> DataFrame:
    """Tokenise ``docs``, write the shards, and read them back.

    Only ``doc_id`` and ``text`` are read. Every row gives a row, repeated ones too; an empty table
    writes no shard and gives none.
    """
    tokens = durable(tokenize(docs, path, end_id), "token-ids")
    write_tokens(tokens, folder)
    return read_tokens(docs.sparkSession, folder)
