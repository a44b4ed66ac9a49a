"""Byte-level BPE: pre-tokens found by scans over arrays, merged by rank, decoded by table.

The pre-tokeniser is a small automaton over classes of code points. Each class is a function from
state to state. Functions compose associatively and only a few dozen different ones arise, so they
are numbered and composed by a product table. The states of a whole batch come from one scan over
blocks: prefixes are composed inside every block at once, block results are scanned, and the states
follow. Boundaries are read off states and classes; no regular expression is run. The
resulting slices of the UTF-8 buffer are dictionary-encoded, and only slices not met before are
merged. A long text is read in segments that start at a pre-token, so that the arrays beside it stay
small however long it is.
"""

from __future__ import annotations

import base64
import heapq
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitwise.llm.common import pieces, spread_ranges, unused

# Classes of code points. The letters are those that contractions are made of.
OTHER, APOSTROPHE, SPACE, BLANK, NUMBER, LETTER, L_STMD, L_RV, L_E, L_L, BREAK = range(11)
# States after a code point. NEW is also the state at the start of a text.
NEW, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_BLANKS, AFTER_SPACE, QUOTE, QUOTE_RV, QUOTE_L, ENDED = range(10)
STATES, CLASSES = 10, 11
BLOCK = 64
#: Bytes of one text whose classes and states are held at once.
SEGMENT = 1 << 20


def _transitions() -> np.ndarray:
    """table[class, state] = next state."""
    t = np.zeros((CLASSES, STATES), dtype=np.uint8)
    t[BREAK] = NEW
    t[SPACE] = AFTER_SPACE
    t[BLANK] = IN_BLANKS
    t[NUMBER] = IN_NUMBERS
    t[OTHER] = IN_OTHER
    # an apostrophe opens a contraction only where a token starts with it
    t[APOSTROPHE] = QUOTE
    t[APOSTROPHE, [IN_OTHER, AFTER_SPACE, QUOTE]] = IN_OTHER
    for letter in (LETTER, L_STMD, L_RV, L_E, L_L):
        t[letter] = IN_LETTERS
    t[L_STMD, QUOTE] = ENDED
    t[L_RV, QUOTE] = QUOTE_RV
    t[L_L, QUOTE] = QUOTE_L
    t[L_E, QUOTE_RV] = ENDED
    t[L_L, QUOTE_L] = ENDED
    return t


TRANSITIONS = _transitions()


@lru_cache(maxsize=1)
def functions() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All compositions of the classes' functions: (number of each class, products, values).

    products[f, g] is "first f, then g"; values[f, state] is the state that f leads to.
    """
    start = tuple(range(STATES))
    number, todo = {start: 0}, [start]
    steps = [tuple(row) for row in TRANSITIONS.tolist()]
    while todo:
        f = todo.pop()
        for g in steps:
            h = tuple(g[x] for x in f)
            if h not in number:
                number[h] = len(number)
                todo.append(h)
    every = list(number)
    products = [[number[tuple(g[x] for x in f)] for g in every] for f in every]
    return (
        np.array([number[g] for g in steps], dtype=np.intp),
        np.array(products, dtype=np.intp),
        np.array(every, dtype=np.uint8),
    )


@lru_cache(maxsize=1)
def code_classes() -> np.ndarray:
    """The class of every code point, by Unicode's letter, number and white space properties."""
    kinds = np.full(0x110000, OTHER, dtype=np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", BLANK)):
        kinds[[ord(c) for c in regex.findall(pattern, every)]] = kind
    for letters, kind in (("stmd", L_STMD), ("rv", L_RV), ("e", L_E), ("l", L_L), (" ", SPACE),
                          ("'", APOSTROPHE)):
        for c in letters:
            kinds[ord(c)] = kind
    return kinds


def scan_states(kinds: np.ndarray) -> np.ndarray:
    """The state after every symbol, starting from NEW, by composing transition functions."""
    n = len(kinds)
    if not n:
        return np.zeros(0, dtype=np.uint8)
    number, products, values = functions()
    count, flat = len(products), products.ravel()
    rows = -(-n // BLOCK)
    padded = np.full(rows * BLOCK, BREAK, dtype=np.uint8)
    padded[:n] = kinds
    grid = np.ascontiguousarray(number.astype(np.uint16)[padded.reshape(rows, BLOCK).T])
    for k in range(1, BLOCK):  # prefix compositions inside every block
        grid[k] = flat[grid[k - 1].astype(np.intp) * count + grid[k]]
    whole, step = grid[-1].astype(np.intp), 1
    while step < rows:  # prefix compositions of the blocks, doubling the reach
        whole[step:] = flat[whole[:-step] * count + whole[step:]]
        step *= 2
    state = np.full(rows, NEW, dtype=np.intp)
    state[1:] = values[whole[:-1], NEW]
    out = np.empty((rows, BLOCK), dtype=np.uint8)
    for k in range(BLOCK):
        out[:, k] = values.ravel()[grid[k].astype(np.intp) * STATES + state]
    return out.reshape(-1)[:n]


def token_starts(kinds: np.ndarray) -> np.ndarray:
    """True where a pre-token starts. A BREAK separates texts and is a token of its own."""
    n = len(kinds)
    state = scan_states(kinds)
    prev_kind = np.concatenate([[BREAK], kinds[:-1]]).astype(np.uint8)
    prev = np.concatenate([[NEW], state[:-1]]).astype(np.uint8)
    blank = (kinds == SPACE) | (kinds == BLANK)
    prev_blank = (prev_kind == SPACE) | (prev_kind == BLANK)
    # a run goes on where the state says so
    run = np.zeros(n, dtype=bool)
    letters = kinds >= LETTER
    letters &= kinds != BREAK
    run |= letters & ((prev == IN_LETTERS) | (prev == AFTER_SPACE))
    run |= (kinds == NUMBER) & ((prev == IN_NUMBERS) | (prev == AFTER_SPACE))
    mark = (kinds == OTHER) | (kinds == APOSTROPHE)
    run |= mark & ((prev == IN_OTHER) | (prev == AFTER_SPACE) | (prev == QUOTE))
    # letters after a quote: joined if the contraction is completed
    run |= (state == ENDED) & letters
    ahead = np.concatenate([state[1:], [NEW]])
    opened = (state == QUOTE_RV) | (state == QUOTE_L)
    run |= opened & (ahead == ENDED)
    # the letter after an opened one that was not completed goes on with the letters
    run |= letters & ((prev == QUOTE_RV) | (prev == QUOTE_L)) & (state == IN_LETTERS)
    # white space: all but the last before something else stay together
    next_kind = np.concatenate([kinds[1:], [BREAK]])
    last = blank & ~((next_kind == SPACE) | (next_kind == BLANK) | (next_kind == BREAK))
    run |= blank & prev_blank & ~last
    return ~run


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token: the pair of lowest rank first, the leftmost among equals."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n <= 48:
        return _merge_short(piece, ranks)
    ends = list(range(1, n + 1))  # of the part that starts at i; 0 once merged away
    before = list(range(-1, n - 1))
    heap = []

    def offer(i: int) -> None:
        j = ends[i]
        if j < n:
            rank = ranks.get(piece[i : ends[j]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, ends[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = ends[i]
        if not j or j >= n or ends[j] != stop:
            continue
        ends[i], ends[j] = stop, 0
        if stop < n:
            before[stop] = i
            offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [ranks[piece[i : ends[i]]] for i in range(n) if ends[i]]


def _merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for a short piece: the smallest of a plain list is quicker than a heap."""
    none, find = 1 << 40, ranks.get
    cuts = list(range(len(piece) + 1))
    pairs = [find(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while pairs:
        low = min(pairs)
        if low == none:
            break
        i = pairs.index(low)
        del cuts[i + 1], pairs[i]
        if i < len(pairs):
            pairs[i] = find(piece[cuts[i] : cuts[i + 2]], none)
        if i:
            pairs[i - 1] = find(piece[cuts[i - 1] : cuts[i + 1]], none)
    return [ranks[piece[a:b]] for a, b in zip(cuts, cuts[1:])]


class Codec:
    """Ranks of one vocabulary with the slices merged so far; one for each Python worker."""

    KEPT = 1 << 18

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        top = max(self.ranks.values()) + 1
        tokens = [b""] * top
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.lengths = np.fromiter(map(len, tokens), np.int64, top)
        self.places = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.known: dict[bytes, bytes] = {}

    def _ids(self, piece: bytes) -> bytes:
        found = self.known.get(piece)
        if found is None:
            out = merge(piece, self.ranks)
            found = struct.pack(f"<{len(out)}I", *out)
            if len(piece) <= 64:
                if len(self.known) >= self.KEPT:
                    self.known.clear()
                self.known[piece] = found
        return found

    def _cuts(self, data: bytes, sizes: np.ndarray) -> np.ndarray:
        """The byte at which each pre-token starts; texts of the given sizes are kept apart."""
        codes = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), dtype="<u4")
        width = (codes > 0x7F).astype(np.int8) + (codes > 0x7FF) + (codes > 0xFFFF) + np.int8(1)
        place = np.cumsum(width, dtype=np.int64) - width
        kinds = code_classes()[codes]
        # a BREAK goes before each text
        heads = np.cumsum(sizes) - sizes
        at = np.searchsorted(place, heads[sizes > 0])
        starts = token_starts(np.insert(kinds, at, BREAK))
        return place[np.delete(starts, at + np.arange(len(at)))]

    def _merged(self, data: bytes, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pre-tokens that start at ``cuts``, and how many belong to each."""
        offsets = np.append(cuts, len(data)).astype(np.int32)
        slices = pa.BinaryArray.from_buffers(
            pa.binary(), len(cuts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]
        ).dictionary_encode()
        ids = [self._ids(p) for p in slices.dictionary.to_pylist()]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        places = np.cumsum(lengths) - lengths
        index = slices.indices.to_numpy()
        each = lengths[index]
        return np.frombuffer(b"".join(ids), dtype="<u4")[spread_ranges(places[index], each)], each

    def _encode_long(self, text: bytes) -> np.ndarray:
        """Ids of one text, segment by segment.

        The end of a segment may cut a contraction or a run, which touches its last two pre-tokens
        at most. These are left to the next segment; no pre-token depends on what is before it.
        """
        out, at, reach = [np.zeros(0, "<u4")], 0, SEGMENT
        while at < len(text):
            stop = min(at + reach, len(text))
            while stop < len(text) and text[stop] & 0xC0 == 0x80:
                stop -= 1
            part = text[at:stop]
            cuts = self._cuts(part, np.array([len(part)]))
            if stop < len(text):
                if len(cuts) < 3:
                    reach *= 2
                    continue
                part, cuts = part[: cuts[-2]], cuts[:-2]
            out.append(self._merged(part, cuts)[0])
            at, reach = at + len(part), SEGMENT
        return np.concatenate(out)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and how many belong to each text."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        if sizes.max(initial=0) > SEGMENT:
            each = [self._encode_long(t) for t in texts]
            return np.concatenate(each), np.fromiter(map(len, each), np.int64, len(each))
        data = b"".join(texts)
        if not data:
            return np.zeros(0, "<u4"), np.zeros(len(texts), np.int64)
        cuts = self._cuts(data, sizes)
        out, each = self._merged(data, cuts)
        upto = np.concatenate([[0], np.cumsum(each)])
        heads = np.cumsum(sizes) - sizes
        bounds = upto[np.searchsorted(cuts, np.append(heads, len(data)))]
        return out, np.diff(bounds)

    def offsets(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The byte at which each token starts in its text."""
        size = self.lengths[ids]
        place = np.cumsum(size) - size
        first = np.cumsum(counts) - counts
        base = place[np.minimum(first, max(len(ids) - 1, 0))] if len(ids) else first
        return (place - np.repeat(base, counts)).astype("<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(
            self.flat[spread_ranges(self.places[some], self.lengths[some])].tobytes()
            for some in (ids[at : at + SEGMENT // 4] for at in range(0, len(ids), SEGMENT // 4))
        )


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def _cut_bytes(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    """One binary value (little-endian unsigned 32 bits) per text."""
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64) * 4
    return pa.BinaryArray.from_buffers(
        pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat.astype("<u4").tobytes())]
    )


def encode(docs: DataFrame, path: str, text: str = "text", verify: bool = False) -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids`` and ``offsets``; with ``verify`` also ``decodes``.

    ``ids`` and ``offsets`` are binary, one little-endian unsigned 32-bit integer per token: its id
    and the byte of the text where it starts. Null and empty texts have no token. Every row is
    encoded by itself, so ties and repeats give equal results; an empty table stays empty. ``path``
    is a rank file that every worker can open. ``decodes`` says whether the ids, decoded where they
    were made, are the bytes of the whole text; so neither ids nor texts move for the comparison.
    """
    added = ["n_tokens", "ids", "offsets", *(["decodes"] if verify else [])]
    columns = [c for c in docs.columns if c not in added]
    # a kept text column is read where it is; a batch does not hold it twice
    kept_text = text in columns and docs.schema[text].dataType.simpleString() in ("string", "binary")
    raw = text if kept_text else unused("raw", columns)

    def run(batches):
        own = codec(path)
        for batch in batches:
            for part in pieces(batch, raw, SEGMENT):
                texts = [t or b"" for t in part.column(raw).cast(pa.binary()).to_pylist()]
                ids, counts = own.encode(texts)
                out = [*(part.column(i) for i in range(len(columns))), pa.array(counts),
                       _cut_bytes(ids, counts), _cut_bytes(own.offsets(ids, counts), counts)]
                if verify:
                    each = np.split(ids, np.cumsum(counts)[:-1])
                    out.append(pa.array([own.decode(i) == t for i, t in zip(each, texts)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(out, names=[*columns, *added])

    values = {"n_tokens": F.lit(0).cast("long"), "ids": F.lit(b""), "offsets": F.lit(b""), "decodes": F.lit(True)}
    schema = docs.select(*columns, *[values[c].alias(c) for c in added]).schema
    extra = [] if kept_text else [F.col(text).cast("binary").alias(raw)]
    return docs.select(*columns, *extra).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``: the bytes its ids stand for. Null ids decode to nothing."""
    columns = [c for c in encoded.columns if c != "decoded"]
    here = columns.index(ids)

    def run(batches):
        own = codec(path)
        for batch in batches:
            for part in pieces(batch, ids, 1 << 20):
                held = part.column(here).to_pylist()
                out = [own.decode(np.frombuffer(r or b"", dtype="<u4")) for r in held]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(out, pa.binary())], names=[*columns, "decoded"]
                )

    schema = encoded.select(*columns, F.lit(b"").alias("decoded")).schema
    return encoded.select(*columns).mapInArrow(run, schema)
