"""The registered queries of this subpackage: each applies one operator, with its
production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_replay, decontaminate, html_text, langid, near_vectors, quality, simhash, suffix_dedup, token_file, warc
from .common import crc32_of, settle, table


def tokenizer_file(name: str, path: str | None = None) -> bytes:
    """A public tokenizer file, or the one at ``path``."""
    with open(path or public_tokenizers.path(name), "rb") as f:
        return f.read()


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near(table(spark, sf_dir, "embeddings"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return simhash.classes(docs, own=settle(simhash.fingerprints(docs)))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove(table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=2)


def op8_bpe_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe_replay.encode(docs, tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs.withColumn("held_out", F.pmod(crc32_of("doc_id"), F.lit(4)) == 2)
    model = langid.train(docs.where(~F.col("held_out")))
    out = langid.identify(docs, model)
    return out.select("doc_id", (F.pmod(crc32_of("doc_id"), F.lit(4)) == 2).alias("held_out"), "lang_pred", "score")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


QUERIES = {
    "op1_quality": op1_quality,
    "op2_near_vectors": op2_near_vectors,
    "op3_warc": op3_warc,
    "op4_simhash": op4_simhash,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_html_text": op6_html_text,
    "op7_token_file": op7_token_file,
    "op8_bpe_replay": op8_bpe_replay,
    "op9_langid": op9_langid,
    "op10_decontaminate": op10_decontaminate,
}

ORACLE: dict[str, str] = {}
