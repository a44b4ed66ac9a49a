"""The subpackage's registered queries, each over its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitwise.llm import (
    bytebpe, language, lm, maintext, minhash, mixing, neighbours, quality, repair, sharding, simhash, spelling, tokenfile,
)
from pitwise.llm.common import table
from pitwise.session import scratch_path

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file; PITWISE_TOKENIZERS names another folder."""
    folder = os.environ.get("PITWISE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_simhash_near_dedup")
def op1(spark, sf_dir) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


#: Passes of the most repeated source for one of the least repeated.
REPETITION = 1.5


@query("op2_temperature_mixing")
def op2(spark, sf_dir) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), repetition=REPETITION)
    return mixed.select("doc_id", "source", *[c for c in mixed.columns if c.startswith("mix_")])


@query("op4_minhash_fingerprints")
def op4(spark, sf_dir) -> DataFrame:
    return minhash.fingerprint_pairs(table(spark, sf_dir, "documents"))


@query("op5_token_files")
def op5(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    back = tokenfile.round_trip(docs, vocabulary("word_bpe_49k.json"), scratch_path(spark, "token-files"))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op6_byte_bpe")
def op6(spark, sf_dir) -> DataFrame:
    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    coded = bytebpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    back = bytebpe.decode(coded.select("doc_id", "n_tokens", "ids"), path)
    return back.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@query("op7_quality_classifier")
def op7(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@query("op9_label_propagation_shards")
def op9(spark, sf_dir) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


@query("op3_main_text")
def op3(spark, sf_dir) -> DataFrame:
    return maintext.extract(table(spark, sf_dir, "pages"))


@query("op10_embedding_near_dedup")
def op10(spark, sf_dir) -> DataFrame:
    return neighbours.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op8_log_bilinear_lm")
def op8(spark, sf_dir) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


@query("op11_language_id")
def op11(spark, sf_dir) -> DataFrame:
    return language.classify(table(spark, sf_dir, "documents"))


@query("op12_spelling_variants")
def op12(spark, sf_dir) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


@query("op13_conversation_repair")
def op13(spark, sf_dir) -> DataFrame:
    return repair.report(table(spark, sf_dir, "conversations"))
