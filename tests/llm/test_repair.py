"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import re
import zlib

from pitwise.llm import repair

STEPS = {"s": {"": "s"}, "u": {"": "u", "s": "u", "a": "u"}, "a": {"u": "a"}}


def _next(state, initial):
    return STEPS.get(initial, {}).get(state)


def _best(rows):
    """(cost, letters, lines) of the cheapest repair: a table from the last row back, letters compared whole."""
    memo = {}
    for i in range(len(rows), -1, -1):
        plain = {}
        for state in ("", "s", "u", "a"):
            ways = []
            if i == len(rows):
                if state in ("", "a"):
                    ways.append((0, "", ()))
            else:
                role, text, fault = rows[i]
                cut = fault == "truncated"
                c, w, lines = memo[i + 1, state]
                ways.append((c + 3, "D" + w, lines))
                if fault in (None, "truncated"):
                    to = _next(state, role[:1])
                    if to:
                        c, w, lines = memo[i + 1, to]
                        ways.append((c + cut, "K" + w, (f"{role}:{text}", *lines)))
                    for given in ("user", "assistant"):
                        to = _next(state, given[0])
                        if to:
                            c, w, lines = memo[i + 1, to]
                            ways.append((c + 2 + cut, "R" + w, (f"{given}:{text}", *lines)))
            plain[state] = min(ways, default=None)
        best = dict(plain)
        for _ in range(4):  # inserted turns, by rounds
            for state in ("", "s", "u", "a"):
                for given in ("user", "assistant"):
                    to = _next(state, given[0])
                    if to and best[to] is not None:
                        way = (best[to][0] + 2, "I" + best[to][1], (f"{given}:", *best[to][2]))
                        if best[state] is None or way[:2] < best[state][:2]:
                            best[state] = way
        for state in best:
            memo[i, state] = best[state]
    return memo[0, ""]


def plain_report(rows):
    """The whole contract by one loop over the rows of a small table."""
    convs = {}
    for conv, turn, role, text in rows:
        kept = convs.setdefault(conv, [])
        show = lambda v: " " if v is None else str(v)
        fate = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        role = "user" if fate == 4 else role
        kept += [(turn, role, text)] * (2 if fate == 3 else 1)
    out = {}
    for conv, kept in convs.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2].encode()))
        seen, marked, count = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for turn, role, text in kept:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = (
                "blank" if not bare else "duplicate" if (role, text) in seen
                else "truncated" if bare[-1] not in ".!?" else None
            )
            seen.add((role, text))
            marked.append((role, text, fault))
            if fault:
                count[fault] += 1
        turns = {t for t, _, _ in kept if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        cost, letters, lines = _best(marked)
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, *count.values(), illegal, cost, letters, sha)
    return out


def _same(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r[0]: tuple(r)[1:] for r in repair.report(df).collect()}
    want = plain_report(rows)
    assert len(got) == len(want)
    for conv in want:
        assert got[conv] == want[conv], conv


def _talk(rng, conv, size, odd=True):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "assistant", "umpire"]
    texts = ["Yes.", "No!", "How so?", "cut off", "", " \n", None, "Fine. ", "Well", "a.\n", "漢字。", "…", "é."]
    rows = []
    for k in range(size):
        role = "user" if k % 2 == 0 else "assistant"
        if odd and rng.random() < 0.3:
            role = rng.choice(roles)
        text = f"Turn {k}." if rng.random() < 0.6 else rng.choice(texts)
        turn = None if odd and rng.random() < 0.05 else k + (rng.random() < 0.1)
        rows.append((conv, turn, role, text))
    return rows


def test_small_conversations_as_the_plain_search(spark):
    rng = random.Random(5)
    rows = []
    for conv in range(300):
        rows += _talk(rng, conv, rng.randrange(1, 12))
    rows += _talk(rng, None, 9)
    rows += [(900, 3, "user", "Same.")] * 5 + [(901, k, "user", "Same.") for k in range(6)]
    _same(spark, rows)


def test_conversations_of_many_blocks(spark):
    rng = random.Random(8)
    rows = _talk(rng, 1, 700) + _talk(rng, 2, 3) + _talk(rng, 3, 150, odd=False) + _talk(rng, 4, 400)
    rows += [(5, k, "assistant", f"x{k}") for k in range(200)] + [(6, 1, "user", "Again.")] * 300
    _same(spark, rows)


def test_every_row_dropped_and_no_row_at_all(spark):
    lost = next(k for k in range(1000) if zlib.crc32(f"{k}:1".encode()) % 20 == 0)
    _same(spark, [(lost, 1, "user", "Hello.")])
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string, block string, at int")
    assert repair.report(empty).count() == 0


def test_prices_are_optimal_and_matrices_are_shortest_paths():
    rng = random.Random(2)
    for _ in range(200):
        turns = [
            (rng.choice("suat"), rng.random() < 0.2, rng.random() < 0.3, rng.choice([0, 0, 0, 2]))
            for _ in range(rng.randrange(1, 6))
        ]
        costs = repair.matrix(turns)
        for start in range(4):
            for end in range(4):
                exits = [0 if s == end else repair.NEVER for s in range(4)]
                arcs = repair.lattice(turns, exits)
                far = [0 if n == start else repair.NEVER for n in range(len(arcs))]
                for _ in range(len(arcs)):
                    for n, out in enumerate(arcs):
                        for _, c, to in out:
                            far[to] = min(far[to], far[n] + c)
                assert min(far[-1], repair.NEVER) == costs[4 * start + end]
