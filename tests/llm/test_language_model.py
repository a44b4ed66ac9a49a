"""The language model: a plain sum over its parameters, probabilities that sum to one, small tables."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from pitwise.llm import lm


def _learnt(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 != 2


def _scored(spark, rows, monkeypatch):
    """Scores by the operator, and its classes and model as they were used."""
    used = {}
    train = lm.train

    def kept(held, classes, in_class):
        used["model"] = train(held, classes, in_class)
        used["classes"] = classes
        return used["model"]

    monkeypatch.setattr(lm, "train", kept)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return lm.score(df).collect(), used


def _plain(rows, used):
    """Every score by loops over whole sums."""
    tokens = [(d, (t or "").encode().lower().split() + [b""]) for d, t in rows]
    counts = Counter(w for d, ws in tokens if _learnt(d) for w in ws)
    n, once, twice = sum(counts.values()), sum(c == 1 for c in counts.values()), sum(c == 2 for c in counts.values())
    u = min(max(once / n, 1e-9), 0.5)
    new = math.log10(u / max(1.0, once * (once - 1) / (2 * (twice + 1))))
    model, classes = used["model"], used["classes"]
    of = lambda w: int(classes.of([w])[0])
    in_class = Counter()
    for w, c in counts.items():
        in_class[of(w)] += c
    d = lm.DIMENSIONS
    out = []
    for doc, words in tokens:
        total, back, far = 0.0, of(b""), of(b"")
        for w in words:
            k = of(w)
            if counts[w]:
                h = model.context[back, :d] @ model.near[:, :d] + model.context[far, :d] @ model.far[:, :d]
                groups = {g: sum(c for j, c in in_class.items() if j % model.g == g) for g in range(model.g)}
                e = {g: math.exp(h @ model.by_group[g, :d] + model.by_group[g, d]) * s for g, s in groups.items()}
                own = k % model.g
                f = {
                    j: math.exp(h @ model.by_class[j, :d] + model.by_class[j, d]) * c
                    for j, c in in_class.items() if j % model.g == own
                }
                p = e[own] / sum(e.values()) * f[k] / sum(f.values()) * counts[w] / in_class[k]
                total += math.log10((1 - u) * p)
            else:
                total += new
            far, back = back, k
        out.append((doc, total, len(words)))
    return out


def test_scores_are_the_plain_sums(spark, monkeypatch):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcde", k=rng.randrange(1, 5))) for _ in range(120)]
    rows = [(k, " ".join(rng.choices(words, weights=range(1, 121), k=rng.randrange(0, 40)))) for k in range(150)]
    rows += [(1000, None), (1001, ""), (1002, "Never seen BEFORE"), (5, rows[5][1]), (None, "abc")]
    got, used = _scored(spark, rows, monkeypatch)
    want = _plain(rows, used)
    key = lambda r: (str(r[0]), round(r[1], 3), r[2])
    assert sorted(key((r.doc_id, r.score, r.n_tokens)) for r in got) == sorted(map(key, want))


def test_probabilities_sum_to_one():
    in_class = np.array([5, 0, 3, 1, 9, 2, 0])
    model = lm.Model(in_class, 3)
    model.rows += np.random.default_rng(1).normal(0, 0.5, model.rows.shape).astype(np.float32)
    for back, far in ((0, 0), (2, 6), (5, 1)):
        each = np.exp(model.log_probabilities(np.arange(7), np.full(7, back), np.full(7, far)))
        assert each.sum() == pytest.approx(1, abs=1e-5) and (each[[1, 6]] < 1e-30).all()


def test_gain_over_counts_on_held_out_text(spark, monkeypatch):
    rng = random.Random(3)
    after = {w: rng.sample(range(60), 3) for w in range(60)}
    rows = []
    for k in range(700):
        w, line = rng.randrange(60), []
        for _ in range(60):
            line.append(f"w{w}")
            w = rng.choice(after[w])
        rows.append((k, " ".join(line)))
    got, _ = _scored(spark, rows, monkeypatch)
    for held in (True, False):
        mine = [r for r in got if r.held_out == held]
        size = sum(r.n_tokens for r in mine)
        assert sum(r.score - r.base_score for r in mine) / size > 0.1
    junk = spark.createDataFrame(rows + [(900, " ".join(f"x{i}q" for i in range(60)))], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in lm.score(junk).collect()}
    assert scores[900] < min(v for k, v in scores.items() if k != 900)


@pytest.mark.parametrize("texts", [
    ["the dog"], ["the the the dog dog cat cat"], ["a"], [""], [None], ["the dog", "the dog", ""],
])
def test_tiny_tables_have_finite_scores(spark, texts):
    learnt = [k for k in range(50) if _learnt(k)]
    held = next(k for k in range(50) if not _learnt(k))
    rows = list(zip(learnt, texts)) + [(held, "the cat sat")]
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert math.isfinite(r.score) and r.score <= 0
        assert r.score > -20 * r.n_tokens


def test_without_training_rows_texts_are_strings_of_bytes(spark):
    held = next(k for k in range(50) if not _learnt(k))
    df = spark.createDataFrame([(held, "ab c")], "doc_id long, text string")
    (r,) = lm.score(df).collect()
    assert r.train_tokens == 0 and r.n_known == 0 and r.score == pytest.approx(-6 * math.log10(257))
    assert lm.score(df.where("false")).count() == 0
