"""Repair of conversation structure by the cheapest edits, found with the auction algorithm for shortest paths.

A repaired conversation is empty or an optional system turn and then pairs of user and assistant.
Its edits are a path through a lattice of nodes (turn, state of that grammar); arcs keep, rerole or
delete a turn or insert one, at integer costs. The auction holds a price for every node and a path
from the origin: where a node's price is below the best arc's cost plus the price at its other end,
the price is raised and the path loses the node, otherwise the path grows along that arc. When it
reaches the goal the prices are dual optimal, so every cheapest path runs along tight arcs only;
those from which the goal is reached are traced from the origin, the least letter first.

Conversations are cut into blocks of ``BLOCK`` different turns. A block's costs from state to state
are a 4 x 4 matrix; prices at block ends come from a stream over the matrices of a conversation from
its end, and the states at which blocks are entered from a stream from its start. Both hold one
small vector. So no task ever holds a conversation, and the lattice is walked block by block
in parallel. Equal turns in a row are one counted row.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitwise.llm.common import BLANKS
from pitwise.session import durable

BLOCK = 64
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
#: States: nothing yet, after the system turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
#: What remains to be paid after the last turn: a pair, or the missing answer.
CLOSING = (0, 2 * INSERT, INSERT, 0)
_KEEPS = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
_NEEDED = ((USER, "user"), (USER, "user"), (ASSISTANT, "assistant"), (USER, "user"))
#: States from which a state can be reached.
_SOURCES = ((START,), (START, SYSTEM), range(STATES), range(STATES))
NEVER = 1 << 60


def lattice(turns: list[tuple[str, bool, bool, int]], exits, states=range(STATES)) -> list[list[tuple[str, int, int]]]:
    """Arcs (letter, cost, node) of every node (turn x 4 + state); the goal is the last node.

    A turn is (initial of its role, must go, cut short, copies that must go). Arcs come in the order
    of their letters. ``exits`` are the costs from the states after the last turn to the goal.
    """
    goal = STATES * (len(turns) + 1)
    arcs: list[list[tuple[str, int, int]]] = []
    for k, (initial, must, cut, copies) in enumerate(turns):
        extra, here, there = DELETE * copies, STATES * k, STATES * (k + 1)
        for state in range(STATES):
            need = _NEEDED[state][0]
            out = [("D", DELETE + extra, there + state)]
            if need in states:
                out.append(("I", INSERT, here + need))
            if not must:
                kept = _KEEPS.get((initial, state))
                if kept is not None and kept in states:
                    out.append(("K", CUT * cut + extra, there + kept))
                if need in states:
                    out.append(("R", REROLE + CUT * cut + extra, there + need))
            arcs.append(out)
    arcs.extend([("", exits[state], goal)] if exits[state] < NEVER else [] for state in range(STATES))
    arcs.append([])
    return arcs


def first_prices(turns, exits) -> list[int]:
    """Prices no arc undercuts: what the turns ahead cost at least."""
    at, prices = min(exits), []
    for _, must, cut, copies in reversed(turns):
        prices.append(at)
        at += (DELETE if must else CUT * cut) + DELETE * copies
    prices.append(at)
    return [p for p in reversed(prices) for _ in range(STATES)] + [0]


def auction(arcs, prices: list[int], origin: int) -> int:
    """The least cost from ``origin`` to the goal; ``prices`` are raised until they are dual optimal."""
    goal, path = len(arcs) - 1, [origin]
    while path[-1] != goal:
        node = path[-1]
        best, to = NEVER, -1
        for _, cost, end in arcs[node]:
            if cost + prices[end] < best:
                best, to = cost + prices[end], end
        if prices[node] < best:  # contract
            prices[node] = best
            if len(path) > 1:
                path.pop()
        elif to < 0:  # nothing leads on from the origin
            return NEVER
        else:  # extend
            path.append(to)
    return prices[origin]


def trace(arcs, prices: list[int], origin: int) -> tuple[str, int]:
    """(letters, state after the last turn) of the least path of tight arcs that reaches the goal."""
    goal = len(arcs) - 1
    tight = [[a for a in out if a[1] + prices[a[2]] == prices[node]] for node, out in enumerate(arcs)]
    leads = [False] * goal + [True]
    for start in range(goal - STATES, -1, -STATES):
        for _ in range(STATES):  # inserted turns lead to nodes of the same turn
            for node in range(start, start + STATES):
                leads[node] = leads[node] or any(leads[end] for _, _, end in tight[node])
    node, letters = origin, []
    while node < goal - STATES:
        letter, _, node = next(a for a in tight[node] if leads[a[2]])
        letters.append(letter)
    return "".join(letters), node % STATES


def matrix(turns) -> list[int]:
    """Least costs from each state before the turns to each state after them, row by row."""
    found = [NEVER] * (STATES * STATES)
    for end in range(STATES):
        exits = [0 if state == end else NEVER for state in range(STATES)]
        arcs, prices = lattice(turns, exits, _SOURCES[end]), first_prices(turns, exits)
        for start in _SOURCES[end]:
            found[STATES * start + end] = auction(arcs, prices, start)
    return found


def edits_of(turns, letters: str, state: int, last: bool) -> list[list[tuple[str, str | None, int, bool]]]:
    """For each turn the edits (letter, role that it gives, times, of its copies), from the state before the block."""
    per_turn, mine = [], []
    for letter in letters:
        need, role = _NEEDED[state]
        if letter == "I":
            mine.append(("I", role, 1, False))
            state = need
            continue
        initial, _, _, copies = turns[len(per_turn)]
        mine.append((letter, role if letter == "R" else None, 1, False))
        state = need if letter == "R" else _KEEPS[initial, state] if letter == "K" else state
        if copies:
            mine.append(("D", None, copies, True))
        per_turn.append(mine)
        mine = []
    while last and state in (SYSTEM, USER):
        state, role = _NEEDED[state]
        per_turn[-1].append(("I", role, 1, False))
    return per_turn


def damage(conversations: DataFrame) -> DataFrame:
    """The rows after damage by a hash of id and turn; a null anywhere counts as one space.

    Returns (conv_id, turn, role, text, times): equal rows of one turn are one counted row.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    return (
        conversations.where(fate != 0)
        .select("conv_id", "turn", F.when(fate == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"),
                F.when(fate == 3, 2).otherwise(1).alias("times"))
        .groupBy("conv_id", "turn", "role", "text").agg(F.sum("times").alias("times"))
    )


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` of (conv_id, turn, role, text, times) with the first fault of each: blank, duplicate, truncated or null.

    A row is a duplicate if its role and text occur at an earlier turn; copies at its own turn are
    in ``times``.
    """
    last = F.regexp_extract("text", f"([^{BLANKS}])[{BLANKS}]*\\z", 1)
    held = durable(rows.withColumn("mark", F.md5(F.col("text").cast("binary"))).withColumn("last", last), "repair-rows")
    when = F.struct(F.col("turn").isNotNull().alias("given"), F.col("turn"))
    first = (
        held.groupBy("conv_id", "role", "mark").agg(F.min(when).alias("first"), F.count("*").alias("n"))
        .where("n > 1").select(*[F.col(c).alias(f"f_{c}") for c in ("conv_id", "role", "mark")], "first")
    )
    met = held.join(first, (
        held["conv_id"].eqNullSafe(F.col("f_conv_id")) & (held["role"] == F.col("f_role")) & (held["mark"] == F.col("f_mark"))
    ), "left")
    fault = (
        F.when(F.col("last") == "", "blank").when(F.col("first") < when, "duplicate")
        .when(~F.col("last").isin(".", "!", "?"), "truncated")
    )
    return met.select("conv_id", "turn", "role", "text", "times", fault.alias("fault"))


def blocked(rows: DataFrame) -> DataFrame:
    """``rows`` in the order of (conv_id, turn, role, text), nulls first, with (block, at).

    Blocks are cut inside range partitions, so that a conversation may lie in many of them; their
    numbers rise along a conversation, and ``at`` counts the rows of a block.
    """
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role")]
    spread = rows.repartitionByRange(*order, F.substring("text", 1, 32)).sortWithinPartitions(*order, "text")
    names = rows.columns

    def run(batches):
        number, at, now = TaskContext.get().partitionId() << 32, -1, ()
        for batch in batches:
            blocks, places = [], []
            for conv in batch.column("conv_id").to_pylist():
                if (conv,) != now or at + 1 == BLOCK:
                    number, at, now = number + 1, -1, (conv,)
                at += 1
                blocks.append(number)
                places.append(at)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(blocks, pa.int64()), pa.array(places, pa.int32())], names=[*names, "block", "at"]
            )

    schema = rows.withColumn("block", F.lit(0).cast("long")).withColumn("at", F.lit(0)).schema
    return durable(spread.mapInArrow(run, schema), "repair-placed")


def _turns(value) -> list[tuple[str, bool, bool, int]]:
    return [(t["initial"], t["must"], t["cut"], t["copies"]) for t in value]


def _streamed(rows: DataFrame, order: list, begin, step, name: str, made: str) -> DataFrame:
    """(block, ``name``): one value handed along the blocks of each conversation by ``step(value, row)``.

    ``step`` returns the result for the row and the value for the next; only that value is held.
    """
    kind = pa.int64() if made == "long" else pa.list_(pa.int64())

    def run(batches):
        now, value = (), None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if (r["conv_id"],) != now:
                    now, value = (r["conv_id"],), begin
                result, value = step(value, r)
                out.append(result)
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(out, kind)], names=["block", name])

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *order).mapInArrow(run, f"block long, {name} {made}")


def _mapped(rows: DataFrame, columns: list[str], make, name: str, kind: pa.DataType, made: str) -> DataFrame:
    """``columns`` of ``rows`` and a column ``name`` of ``make(row)``."""

    def run(batches):
        for batch in batches:
            new = pa.array([make(r) for r in batch.to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), new], names=[*columns, name])

    kept = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)
    return rows.mapInArrow(run, f"{kept}, {name} {made}")


def plans(placed: DataFrame) -> DataFrame:
    """(block, edits): for each turn of a block its part of the cheapest repair of the conversation."""
    gone = F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False))
    turn = F.struct(
        "at", F.substring("role", 1, 1).alias("initial"), gone.alias("must"),
        F.coalesce(F.col("fault") == "truncated", F.lit(False)).alias("cut"), (F.col("times") - 1).alias("copies"),
    )
    # a block holds BLOCK rows at most
    cut = durable(
        placed.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(turn)).alias("turns")), "repair-blocks"
    )
    ends = cut.groupBy("conv_id").agg(F.max("block").alias("final"), F.min("block").alias("initial"))
    several = ends.where("final != initial").select(F.col("conv_id").alias("k"))
    long = cut.join(several, F.col("conv_id").eqNullSafe(F.col("k")), "left_semi")
    costs = _mapped(
        long, ["conv_id", "block"], lambda r: matrix(_turns(r["turns"])), "costs", pa.list_(pa.int64()), "array<long>"
    )

    def back(exits, r):
        m = r["costs"]
        return exits, [min(m[STATES * s + e] + exits[e] for e in range(STATES)) for s in range(STATES)]

    exits = _streamed(costs, [F.desc("block")], list(CLOSING), back, "exits", "array<long>")

    def ways(r):
        turns, ahead = _turns(r["turns"]), r["exits"] or list(CLOSING)
        arcs, prices = lattice(turns, ahead), first_prices(turns, ahead)
        entries = range(STATES) if r["exits"] else [START]
        for s in entries:
            auction(arcs, prices, s)
        found = [trace(arcs, prices, s) for s in entries]
        return {"letters": [w[0] for w in found], "states": [w[1] for w in found]}

    kind = pa.struct([("letters", pa.list_(pa.string())), ("states", pa.list_(pa.int64()))])
    traced = durable(_mapped(
        cut.join(exits, "block", "left"), ["conv_id", "block", "turns"], ways, "ways", kind,
        "struct<letters:array<string>,states:array<long>>",
    ), "repair-ways")

    def on(state, r):
        return state, r["states"][state]

    met = traced.select("conv_id", "block", F.col("ways.states").alias("states")).where(F.size("states") > 1)
    entry = _streamed(met, ["block"], START, on, "entry", "long")
    last = ends.select(F.col("final").alias("block"), F.lit(True).alias("last"))

    def edits(r):
        state = r["entry"] or START
        per_turn = edits_of(_turns(r["turns"]), r["ways"]["letters"][state], state, bool(r["last"]))
        return [[dict(zip(("edit", "given", "n", "copy"), e)) for e in mine] for mine in per_turn]

    kind = pa.list_(pa.list_(pa.struct(
        [("edit", pa.string()), ("given", pa.string()), ("n", pa.int64()), ("copy", pa.bool_())]
    )))
    return _mapped(
        traced.join(entry, "block", "left").join(last, "block", "left"), ["block"], edits, "edits", kind,
        "array<array<struct<edit:string,given:string,n:long,copy:boolean>>>",
    )


def repair(rows: DataFrame) -> DataFrame:
    """The cheapest repair of every conversation, edit by edit.

    ``rows`` are (conv_id, turn, role, text, times) as :func:`damage` gives them. Returns
    (conv_id, block, at, sub, turn, role, text, fault, edit, n, new_role, new_text); block, at and
    sub order the edits of a conversation: Keep, Rerole, Delete or Insert, ``n`` times. Deleted rows
    have no new role and text, inserted ones no turn, role, text and fault. Rows of one turn are
    taken by role and text. Among the cheapest repairs it is the one whose letters come first. An
    empty table gives no row.
    """
    placed = blocked(faults(rows))
    met = placed.join(plans(placed), "block").select(
        *placed.columns, F.posexplode(F.get("edits", F.col("at"))).alias("sub", "e")
    )
    added, gone = F.col("e.edit") == "I", F.col("e.edit") == "D"
    own = lambda c: F.when(~added, F.col(c)).alias(c)
    fault = F.when(F.col("e.copy") & (F.coalesce("fault", F.lit("")) != "blank"), "duplicate").when(~added, F.col("fault"))
    return met.select(
        "conv_id", "block", "at", "sub", own("turn"), own("role"), own("text"), fault.alias("fault"),
        F.col("e.edit").alias("edit"), F.col("e.n").alias("n"),
        F.when(~gone, F.coalesce("e.given", "role")).alias("new_role"),
        F.when(added, "").when(~gone, F.col("text")).alias("new_text"),
    )


class _Digest:
    """What is reported of one conversation, from its edits in order."""

    def __init__(self):
        self.sha, self.lines, self.audit = hashlib.sha256(), 0, []
        self.low = self.high = self.before = None
        self.turns = self.illegal = self.cost = 0
        self.seen = {"blank": 0, "duplicate": 0, "truncated": 0}

    def add(self, turn, initial, fault, edit, n, line):
        self.audit.append(edit * n)
        if edit != "I":
            if turn is not None and turn != self.high:
                self.low = turn if self.low is None else self.low
                self.high, self.turns = turn, self.turns + 1
            legal = ("su", "ua", "au")
            self.illegal += (self.before is not None and self.before + initial not in legal) + (n - 1)
            self.before = initial
            if fault is not None:
                self.seen[fault] += n
        self.cost += n * {"I": INSERT, "R": REROLE, "D": DELETE, "K": 0}[edit]
        if line is not None:
            self.cost += CUT * (fault == "truncated")
            self.sha.update(("\n" if self.lines else "").encode() + line.encode())
            self.lines += 1

    def row(self):
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (gaps, self.seen["blank"], self.seen["duplicate"], self.seen["truncated"], self.illegal, self.cost,
                "".join(self.audit), self.sha.hexdigest())


_REPORT = (
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)


def digest(edits: DataFrame) -> DataFrame:
    """One row per conversation of ``edits``: faults, illegal neighbours, cost, letters, hash of the repaired lines.

    A hash over a whole conversation can only be made in its order, so its edits go through one task,
    as a sorted stream of which only the counts, the letters and the hash are held.
    """
    line = F.concat("new_role", F.lit(":"), "new_text")
    rows = edits.select("conv_id", "block", "at", "sub", "turn", F.substring("role", 1, 1).alias("initial"),
                        "fault", "edit", "n", line.alias("line"))
    names = [c.split()[0] for c in _REPORT.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.string()] * 2

    def run(batches):
        now, one = (), None
        key = pa.null()

        def given(done):
            return pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in done], key), *(pa.array([r[i] for _, r in done], t) for i, t in enumerate(kinds))],
                names=["conv_id", *names],
            )

        for batch in batches:
            key, done = batch.schema.field("conv_id").type, []
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "fault", "edit", "n", "line")]
            for conv, *rest in zip(*columns):
                if (conv,) != now:
                    if one is not None:
                        done.append((now[0], one.row()))
                    now, one = (conv,), _Digest()
                one.add(*rest)
            if done:
                yield given(done)
        if one is not None:
            yield given([(now[0], one.row())])

    streamed = rows.repartition("conv_id").sortWithinPartitions("conv_id", "block", "at", "sub")
    return streamed.mapInArrow(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {_REPORT}")


def report(conversations: DataFrame) -> DataFrame:
    """The digest of every original conversation, one without rows after damage included.

    Those have zeros, no letters and the hash of nothing. A null id is a conversation of its own,
    columns beside conv_id, turn, role and text are not read, and an empty table gives no row.
    """
    found = digest(repair(damage(conversations))).withColumnRenamed("conv_id", "k")
    met = conversations.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("k")), "left")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    return met.select(
        "conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
    )
