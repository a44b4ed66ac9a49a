"""Language identification: held-out accuracy, a plain rewrite, odd rows."""

import math
import random
import zlib
from collections import Counter

import pytest

from pitwise.llm import language

SYLLABLES = {
    "en": ["the", "ing", "wh", "ough", "and", "st", "er"], "de": ["sch", "ung", "ein", "ü", "ich", "tz", "er"],
    "fr": ["eau", "é", "oi", "que", "ment", "ç", "er"], "zz": ["漢", "字", "書", "本"],
}


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(4)
    rows = []
    for doc in range(400):
        lang = rng.choice(["en", "en", "de", "fr", "zz"])
        text = " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(3, 60)))
        rows.append((doc, text, None if doc % 17 == 0 else lang))
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_documents_are_told_apart(spoken):
    rows, df = spoken
    lang = {d: x for d, _, x in rows}
    got = [r for r in language.classify(df).collect() if r.held_out and lang[r.doc_id]]
    assert len(got) > 60 and all(0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == lang[r.doc_id] for r in got) / len(got) > 0.95


def _grams(word):
    line = f"<{word}>"
    return [line[i : i + n] for n in language.GRAMS for i in range(len(line) - n + 1)]


def test_as_a_plain_naive_bayes(spoken):
    rows, df = spoken
    learnt = [(t, x) for d, t, x in rows if x and zlib.crc32(str(d).encode()) % 4 != 2]
    share, counts = Counter(x for _, x in learnt), {x: Counter() for _, x in learnt}
    for text, x in learnt:
        for w in text.lower().split():
            counts[x].update(_grams(w))
    size = {x: sum(c.values()) + language.SMOOTHING * language.BUCKETS for x, c in counts.items()}
    for r in language.classify(df).collect():
        text = rows[r.doc_id][1]
        total = {
            x: math.log(share[x] / len(learnt))
            + sum(math.log((counts[x][g] + language.SMOOTHING) / size[x]) for w in text.lower().split() for g in _grams(w))
            for x in counts
        }
        best = max(total, key=total.get)
        top = 1 / sum(math.exp(v - total[best]) for v in total.values())
        # a few n-grams may share a bucket
        assert r.lang_pred == best and abs(r.score - top) < 0.02


def test_odd_rows(spark, odd, none):
    got = language.classify(odd)
    assert got.count() == odd.count()
    pred = {r.doc_id: r for r in got.collect()}
    assert pred[3].lang_pred == pred[4].lang_pred == pred[6].lang_pred == "und" and pred[3].score == 0.0
    assert pred[2].lang_pred in ("en", "de") and pred[5].lang_pred == "en"
    assert language.classify(none).count() == 0
    # nothing to learn from
    quiet = odd.selectExpr("doc_id", "text", "cast(null as string) as lang", "1 as LANG_PRED")
    assert {r.lang_pred for r in language.classify(quiet).collect()} == {"und"}
    full = language.identify(quiet, language.train(odd))
    assert full.columns == ["doc_id", "text", "lang", "lang_pred", "score"] and full.count() == odd.count()


def test_one_word_longer_than_a_span(spark, monkeypatch):
    rows = [(d, "ab" * 400 if d % 2 else "cd " * 300, "x" if d % 2 else "y") for d in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole = {r.doc_id: r.lang_pred for r in language.classify(df).collect()}
    assert whole == {d: x for d, _, x in rows}
    words = __import__("pyarrow").array([b"abcabc" * 50, b"", "ça".encode(), b"q"])
    far = Counter((int(w), int(b)) for ws, bs in language.grams(words, 1 << 16) for w, b in zip(ws, bs))
    monkeypatch.setattr(language, "SPAN", 7)
    near = Counter((int(w), int(b)) for ws, bs in language.grams(words, 1 << 16) for w, b in zip(ws, bs))
    assert far == near


def test_matrix_size_is_bounded():
    assert language.buckets_for(4) == language.BUCKETS
    assert language.buckets_for(1000) * 1000 <= language.CELLS
    with pytest.raises(ValueError):
        language.buckets_for(1 << 15)
