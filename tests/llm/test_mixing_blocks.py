"""Block permutations of the mixture."""

import pytest
from pyspark.sql import functions as F

from pitwise.llm import mixing


def test_every_pass_is_a_permutation_of_the_same_blocks(spark):
    rows = [(i, "w " * (1 + i % 7), "big" if i % 10 else "small") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs, entropy=0.6, budget=30_000, block_tokens=100).cache()
    groups = {}
    for r in out.select("source", "doc_id", "mix_pass", "mix_block").collect():
        groups.setdefault((r.source, r.mix_pass), {}).setdefault(r.mix_block, set()).add(r.doc_id)
    whole = {s: max(p for t, p in groups if t == s) for s in ("big", "small")}
    assert whole["small"] >= 2
    for (source, turn), blocks in groups.items():
        if turn == whole[source]:
            continue  # only the last pass may be a part
        first = groups[source, 0]
        assert sorted(blocks) == list(range(len(first)))  # every place once
        assert sorted(map(sorted, blocks.values())) == sorted(map(sorted, first.values()))  # the same blocks
        if turn:
            assert any(blocks[k] != first[k] for k in blocks)  # in another order
    # the last pass is the beginning of a permutation: its places have no gap either
    last = groups["small", whole["small"]]
    assert sorted(last) == list(range(len(last)))


def test_order_by_key_goes_pass_by_pass_and_block_by_block(spark):
    rows = [(i, "w " * 5, "one") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, budget=5000, entropy=0.0, block_tokens=100).orderBy("mix_key").collect()
    places = [(r.mix_pass, r.mix_block) for r in got]
    assert places == sorted(places) and len(got) == 1000


@pytest.mark.parametrize("name", ["MIX_KEY", "Mix_Pass"])
def test_clashing_names_in_any_case(spark, name, tmp_path):
    docs = spark.createDataFrame([(1, "a b", "s"), (2, None, None)], "doc_id long, text string, source string")
    out = mixing.mix(docs.withColumn(name, F.lit("x")), repetition=1.5)
    assert sum(c.lower() == name.lower() for c in out.columns) == 1
    out.write.parquet(str(tmp_path / "m"))
