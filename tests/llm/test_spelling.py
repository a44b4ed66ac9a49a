"""Spelling variants against all pairs of the vocabulary."""

import random
import re
from collections import Counter

import pytest

from pitwise.llm import spelling


def _near(a, b):
    """Whether two different words are one inserted, deleted or replaced code point apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _plain(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            counts[spelling.damaged("" if doc_id is None else str(doc_id), run)] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: [v for v in words if v != w and _near(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 10 * words[w]:
            form[w] = best
    out = {}
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, words[w], len(near[w]), words[form[w]] if w in form else None)
    return out


def _same(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(df).collect()}
    assert got == _plain(rows)
    return got


def _edited(rng, word, letters):
    k, c = rng.randrange(len(word)), rng.choice(letters)
    return rng.choice([word[:k] + word[k + 1 :], word[:k] + c + word[k:], word[:k] + c + word[k + 1 :], word + c])


@pytest.mark.parametrize("letters", ["ab", "abcdeéÿ×À", "xyzÄä"])
def test_against_all_pairs(spark, letters):
    rng = random.Random(len(letters))
    bases = ["".join(rng.choices(letters, k=rng.randrange(6, 12))) for _ in range(25)]
    rows = []
    for doc in range(120):
        words = []
        for base in rng.choices(bases, k=25):
            word = base if rng.random() < 0.7 else _edited(rng, base, letters)
            if rng.random() < 0.1:
                word = _edited(rng, word, letters)
            words.append(word.upper() if rng.random() < 0.1 else word)
        rows.append((doc if doc % 9 else None, rng.choice([" ", "-", "1"]).join(words)))
    got = _same(spark, rows)
    assert any(form for form, *_ in got.values()) and any(n > 3 for *_, n, _ in got.values())


def test_chains_of_forms_ties_and_odd_texts(spark):
    chain = ["aaaaaaa", "aaaaaab", "aaaaabb", "aaaabbb", "aaabbbb"]
    rows = [(k, " ".join([w] * 3 * 11**k)) for k, w in enumerate(reversed(chain[:4]))]
    rows += [(50, "likeness " * 30 + "likenest " * 30 + "likenes likenes"), (51, None), (52, ""), (None, "zzzzzzz " * 4),
             (53, "Q" * 3000 + " " + "Q" * 3000 + " " + ("Q" * 2999 + " ") * 40), (54, "short but thereof"), (54, "short but thereof")]
    got = _same(spark, rows)
    assert len({root for _, root, *_ in got.values()}) < len(got)


def test_empty_table_and_clashing_columns(spark, odd, none):
    assert spelling.variants(none).count() == 0
    assert spelling.variants(odd.withColumnRenamed("fp", "WORD")).columns == ["word", "form", "root", "n", "n_near", "form_n"]
