"""Every operator on documents, over odd rows and against plain rewrites."""

import hashlib
import math
import os
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pitwise.llm import bytebpe, lm, minhash, mixing, quality, sharding, simhash, tokenfile
from pitwise.llm.components import components
from pitwise.llm.queries import vocabulary
from pitwise.session import scratch_path


def _rows(df):
    return [r.asDict() for r in df.collect()]


def _plain_simhash(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    n = Counter(b for s in shingles for b in range(64) if xxhash.xxh64_intdigest(s, 42) >> b & 1)
    return sum(1 << b for b in range(64) if 2 * n[b] > len(shingles))


def test_simhash_links_like_all_pairs(spark, odd):
    got = _rows(simhash.near_duplicates(odd))
    rows = odd.select("doc_id", "text").collect()
    fps = [(r.doc_id, _plain_simhash(r.text)) for r in rows]
    assert sorted((str(r["doc_id"]), r["fingerprint"]) for r in got) == sorted((str(d), f"{f:016x}") for d, f in fps)
    assert {r["component_id"] for r in got if r["doc_id"] in (3, 4, 6)} == {3}
    assert all(r["component_id"] == 1 for r in got if r["doc_id"] in (1, 2))


def test_simhash_overfull_keys_connect_what_pairs_connect(spark):
    rng = np.random.default_rng(0)
    base = int(rng.integers(0, 1 << 62))
    codes = {base}
    for _ in range(400):  # one dense ball, walks away from it, and strangers
        c = base
        for b in rng.integers(0, 64, int(rng.integers(1, 5))):
            c ^= 1 << int(b)
        codes.add(c)
    codes |= {int(x) for x in rng.integers(0, 1 << 63, 200)}
    signed = [c - (1 << 64) if c >= 1 << 63 else c for c in codes]
    df = spark.createDataFrame([(c,) for c in signed], "fp long")
    pairs = simhash.links(df, simhash.plan_probes(df))
    found = {r.node: r.root for r in components(pairs).collect()}
    parent = {c: c for c in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(signed):
        for b in signed[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {c: root(c) for c in signed} == {c: found.get(c, c) for c in signed}


def test_simhash_allocation_is_the_cheapest():
    costs = [{-1: 0.0, 0: 5.0, 1: 9.0}, {-1: 0.0, 0: 2.0, 1: 30.0}, {-1: 0.0, 0: 50.0, 1: 90.0}]
    assert simhash.allocate(costs, 0) == (11.0, [1, 0, -1])


def test_one_row_of_each_group_stays_with_its_columns(odd):
    kept = simhash.one_per_group(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "5", "7", "8", "9", "None"]


def test_mixing_meets_the_repetition_and_keeps_every_document(odd):
    out = mixing.mix(odd, repetition=1.5, block_tokens=50)
    plain = [c for c in odd.columns if not c.startswith("mix_")]
    assert out.columns[: len(plain)] == plain
    ids = Counter(str(r.doc_id) for r in out.select("doc_id").collect())
    plain = Counter(str(r.doc_id) for r in odd.select("doc_id").collect())
    assert all(ids[d] >= n for d, n in plain.items())


def test_mixing_budget_entropy_and_weights(spark):
    rows = [(i, "w " * 10, "big" if i % 10 else "small") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs, entropy=0.6, budget=10_000, block_tokens=200)
    got = {r.source: (r.t, r.w) for r in out.groupBy("source").agg(F.sum("mix_tokens").alias("t"), F.max("mix_weight").alias("w")).collect()}
    p = got["small"][1]
    assert -(p * math.log(p) + (1 - p) * math.log(1 - p)) == pytest.approx(0.6, abs=1e-6)
    assert got["small"][0] == pytest.approx(p * 10_000, abs=10) and got["big"][0] == pytest.approx((1 - p) * 10_000, abs=10)
    head = out.where("mix_key < 0.5").groupBy("source").agg(F.sum("mix_tokens").alias("t")).collect()
    assert {r.source: r.t / 5000 for r in head}["small"] == pytest.approx(p, abs=0.05)
    passes = out.groupBy("doc_id", "mix_pass").count()
    assert passes.where("count > 1").count() == 0


def test_exponent_at_its_ends(spark):
    s = spark.createDataFrame([("a", 0.9), ("b", 0.1)], "source string, share double")
    assert mixing.solve_exponent(s, entropy=10.0) == 0.0
    assert mixing.solve_exponent(s, entropy=0.0) == 1.0
    assert mixing.solve_exponent(s, repetition=3.0) == pytest.approx(0.5, abs=1e-6)


def _shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_minhash_fingerprints_and_edits(spark, odd):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(map(str, rng.integers(0, 40, int(rng.integers(0, 500)))))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in _rows(minhash.fingerprint_pairs(docs))}
    errors = []
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b = _shingles(text), _shingles(edited)
        errors.append(got[i]["near_edited"] - len(a & b) / len(a | b))
        assert len(got[i]["fingerprint"]) == minhash.BINS
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.06
    out = _rows(minhash.fingerprint_pairs(odd))
    assert len(out) == odd.count()
    same = {r["fingerprint"] for r in out if r["doc_id"] in (1, 2)}
    assert len(same) == 1 and {r["fingerprint"] for r in out if r["doc_id"] in (3, 4, 6)}.__len__() == 1


def test_token_files_round_trip(spark, odd):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    back = tokenfile.round_trip(odd, path, scratch_path(spark, "t"))
    got = sorted(_rows(back), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got][1:] == sorted(r["doc_id"] for r in got if r["doc_id"] is not None)
    plain, at = Tokenizer.from_file(path), 0
    texts = sorted((r.text or "") for r in odd.collect())
    seen = []
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        seen.append(r["ids"])
    want = [np.array([*plain.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes() for t in texts]
    assert sorted(map(bytes, seen)) == sorted(want)


def test_pack_and_unpack():
    v = np.array([0, 255, 256, 65535, 65536, 2**24, 2**32 - 1, 7, 300], dtype=np.uint32)
    control, data = tokenfile.pack(v)
    assert len(control) == 3 and (tokenfile.unpack(control, data, len(v)) == v).all()
    assert len(tokenfile.unpack(*tokenfile.pack(v[:0]), 0)) == 0


def test_byte_bpe_is_the_library(odd, monkeypatch):
    import random

    import public_tokenizers as public
    import tiktoken

    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    own = bytebpe.Codec(path)
    plain = tiktoken.Encoding("t", pat_str=public.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    rng = random.Random(4)
    parts = ["'", "s", "re", "ve", "ll", "'ll", "m", "d", " ", "  ", "\n", "\t", "3", "!", "é", "漢", "\x85", "x"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(3000)] + ["ab" * 3000]
    ids, counts = own.encode([t.encode() for t in texts])
    for text, part in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
        assert part.tolist() == plain.encode_ordinary(text)
        assert own.decode(part) == text.encode()
    monkeypatch.setattr(bytebpe, "SEGMENT", 8)  # every longer text is read in segments
    long = ["".join(texts[i : i + 20]) for i in range(0, 3000, 20)] + [texts[-1], "x" * 50 + " y"]
    ids, counts = own.encode([t.encode() for t in long])
    for text, part in zip(long, np.split(ids, np.cumsum(counts)[:-1])):
        assert part.tolist() == plain.encode_ordinary(text)
        assert own.decode(part) == text.encode()
    monkeypatch.undo()

    coded = bytebpe.decode(bytebpe.encode(odd, path, verify=True), path).collect()
    assert all(r.decodes for r in coded) and len(coded) == odd.count()
    for r in coded:
        assert bytes(r.decoded) == (r.text or "").encode()
        ids, offsets = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.offsets, "<u4")
        assert len(ids) == len(offsets) == r.n_tokens
        if len(ids):
            assert (offsets == np.concatenate([[0], np.cumsum(own.lengths[ids])[:-1]])).all()


def test_quality_learns_and_scores_odd_rows(spark, odd, none):
    good = [(i, f"the {i} quiet rivers of town {i % 7} run to a sea", 1) for i in range(300)]
    junk = [(1000 + i, f"BUY!! {i}!! NOW!! " * 5, 0) for i in range(150)]
    docs = spark.createDataFrame([r[:2] for r in good + junk], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], 0) for r in good + junk] + [(None, 1, 0), (5, None, 0)],
                                   "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = {r.doc_id: r for r in quality.classify(docs, model).collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items())
    assert np.mean([got[d].predicted == y for d, _, y in good + junk if got[d].held_out]) > 0.98
    out = quality.classify(odd, model).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id in (3, 4, 6)}) == 1
    assert quality.keep_good(odd, model, 0.0).columns == odd.columns
    empty = quality.train(docs, labels.where("false"))
    assert {r.score for r in quality.classify(docs, empty).collect()} == {0.5}
    assert quality.classify(none, model).count() == 0


def test_language_model_counts_and_normalisation(spark, odd):
    got = _rows(lm.score(odd))
    rows = [(r.doc_id, (r.text or "").encode().lower().split() + [b""]) for r in odd.collect()]
    training = [t for d, w in rows if zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2 for t in w]
    c, n = Counter(training), len(training)
    want = sorted(
        (str(d), len(w), sum(c[x] > 0 for x in w), round(sum(math.log10((c[x] + 1) / (n + len(c) + 1)) for x in w), 4))
        for d, w in rows
    )
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {n}


def test_shards_are_even_and_gapless(odd):
    got = _rows(sharding.shard(odd, shards=5))
    counts = Counter(r["shard"] for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(5))
    for k in counts:
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(counts[k]))
    sizes = {str(r.doc_id): len((r.text or "").encode()) + 8 for r in odd.collect()}
    assert all(r["size"] == sizes[str(r["doc_id"])] and r["grown_shard"] is None for r in got)


def test_groups_of_equal_texts_stay_together(spark):
    rows = [(i, f"text {i // 4}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard(docs).join(docs, "doc_id").groupBy("text").agg(F.countDistinct("shard").alias("n"))
    assert got.where("n > 1").count() <= 24


@pytest.mark.parametrize("run", [
    simhash.near_duplicates, simhash.one_per_group, minhash.fingerprint_pairs, sharding.shard, lm.score,
    lambda d: mixing.mix(d, repetition=2.0),
    lambda d: bytebpe.encode(d, vocabulary("byte_bpe_multi_50k.tiktoken")),
    lambda d: tokenfile.round_trip(d, vocabulary("word_bpe_49k.json"), scratch_path(d.sparkSession, "none")),
])
def test_empty_tables(none, run):
    assert run(none).count() == 0


def test_vocabulary_folder_can_be_named(monkeypatch):
    monkeypatch.setenv("PITWISE_TOKENIZERS", os.sep + "elsewhere")
    assert vocabulary("a.json") == "/elsewhere/a.json"
