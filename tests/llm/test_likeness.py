"""The pipeline's near-duplicate stage against all pairs."""

import numpy as np

import corpus_pipeline as cp
from pitwise.llm import likeness


def _shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _kept(texts):
    """The smallest id of each group, over all pairs with a likeness of 0.8 or more."""
    sets, root = [_shingles(t) for t in texts], list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if (not a and not b) or 5 * len(a & b) >= 4 * len(a | b):
                hi, lo = sorted((top(i), top(j)), reverse=True)
                root[hi] = lo
    return sorted({top(i) for i in range(len(texts))})


def test_stage_keeps_one_of_all_that_are_alike(spark):
    rng = np.random.default_rng(8)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    line, texts = words(40), ["", None, " \n", "one", "One ", "one two", "a b c d", "a b c d e"]
    for _ in range(60):  # families with edits up to beyond the limit, some with a line in common
        base = words(int(rng.integers(5, 300))) + (line if rng.random() < 0.5 else [])
        for _ in range(4):
            copy = list(base)
            for at in rng.integers(0, len(copy), int(rng.integers(0, max(2, len(copy) // 30)))):
                copy[at] = words(1)[0]
            texts.append(" ".join(copy[: int(len(copy) * rng.uniform(0.75, 1)) + 1]))
    base = words(200)
    for _ in range(120):  # one large group of near copies, most pairs of which are not alike
        copy = list(base)
        for at in rng.integers(0, len(copy), int(rng.integers(0, 7))):
            copy[at] = words(1)[0]
        texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = cp.one_of_each(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == _kept(texts)


def test_stage_on_odd_rows_and_none(spark, odd, none):
    kept = likeness.one_per_group(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "5", "7", "9", "None"]
    assert likeness.one_per_group(none).count() == 0


def test_parities_never_rule_out_sets_that_are_alike():
    rng = np.random.default_rng(6)
    ruled = 0
    for _ in range(400):
        n = int(rng.integers(1, 600))
        one = np.unique(rng.integers(-(2**62), 2**62, n))
        kept = one[rng.random(len(one)) < rng.choice([0.5, 0.85, 0.95, 1.0])]
        other = np.unique(np.concatenate([kept, rng.integers(-(2**62), 2**62, int(rng.integers(0, n // 8 + 1)))]))
        shared = len(np.intersect1d(one, other))
        bits = sum(int(x).bit_count() for x in (likeness.parities(one) ^ likeness.parities(other)).view("<u8"))
        passed = 9 * bits <= len(one) + len(other)
        assert bits <= len(one) + len(other) - 2 * shared
        assert passed or shared / (len(one) + len(other) - shared) < 0.8
        ruled += not passed
    assert ruled > 100


def test_as_many_parities_as_shingles_rule_out_long_texts_that_eight_longs_let_pass(spark):
    rng = np.random.default_rng(7)
    made = lambda n: np.unique(rng.integers(-(2**62), 2**62, n))
    row = lambda s: likeness.parities(s, likeness.longs_for(len(s))).tobytes()
    few = ruled = 0
    for _ in range(200):
        n = int(rng.integers(1, 6000))
        one = made(n)
        kept = one[rng.random(len(one)) < rng.choice([0.3, 0.6, 0.85, 0.95, 1.0])]
        other = np.unique(np.concatenate([kept, made(int(rng.integers(0, n // 8 + 1)))]))
        shared, both = len(np.intersect1d(one, other)), len(one) + len(other)
        bits = likeness.unlike(row(one), row(other))
        assert bits == likeness.unlike(row(other), row(one)) <= both - 2 * shared
        passed = 9 * bits <= both
        assert passed or 5 * shared < 4 * (both - shared)
        if shared / (both - shared) < 0.6 and n > 2000:
            few, ruled = few + 1, ruled + (not passed)
    assert few > 10 and ruled == few
    assert [likeness.longs_for(n) for n in (0, 1, 512, 513, 1024, 1025)] == [8, 8, 8, 16, 16, 32]
    words = [f"w{x}" for x in rng.integers(0, 9000, 4000)]
    half = words[:2400] + [f"v{x}" for x in rng.integers(0, 9000, 1600)]
    near = [*words[:-100], *["x"] * 100]
    docs = spark.createDataFrame(list(enumerate(map(" ".join, (words, half, near)))), "doc_id long, text string")
    rows = docs.selectExpr("doc_id AS node", "doc_id AS at", "struct(text) AS row")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "a long, b long")
    sets = rows.select("node", "row.text").collect()
    held = [(r.node, len(likeness.shingle_set(r.text.encode())), row(likeness.shingle_set(r.text.encode()))) for r in sets]
    left = likeness.fine_enough(pairs, spark.createDataFrame(held, "node long, size long, par binary"))
    assert [(r.a, r.b) for r in left.collect()] == [(0, 2)]
    found = likeness.verified(pairs, rows.select("node", "at"), rows)
    assert [(r.a, r.b) for r in found.collect()] == [(0, 2)]


def test_common_shingles_are_the_most_common_that_are_held(spark, monkeypatch):
    line = " ".join(f"line{i}" for i in range(5))
    often = " ".join(f"often{i}" for i in range(5))
    texts = [f"{line} {often}" if i % 2 else f"{line} u{i}" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known, counts = likeness.common_shingles(docs)
    assert likeness.shingle_set(line.encode())[0] in known and np.all(np.diff(known) > 0)
    monkeypatch.setattr(likeness, "MOST_COMMON", 1)
    monkeypatch.setattr(likeness, "COMMON", 2)
    few, n = likeness.common_shingles(docs)
    assert few.tolist() == likeness.shingle_set(line.encode()).tolist() and n.tolist() == [21]
