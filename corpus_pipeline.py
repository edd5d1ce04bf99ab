"""The corpus pipeline: stages over ``documents``, each written and read again.

Each stage takes (spark, docs, sf_dir).  Documents lose rows in the quality stage
(rejected documents), the near-duplicate stage (all of a group but the one with the
smallest id; groups link texts whose five-word shingles have a Jaccard similarity of
0.8 or more) and the decontamination stage (documents with a benchmark passage), and
bytes in the repeated-string stage.  Stages decide by row: documents with a null or
repeated id are judged and cut like any other.  The last stage returns token counts and digests.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparkbags.llm import bpe_replay, decontaminate, near_texts, quality, suffix_dedup
from sparkbags.llm.common import scratch, settle, table
from sparkbags.llm.queries import tokenizer_file
from sparkbags.session import ship


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts, and texts without a word, are rejected; the columns
    ``text``, ``doc_id``, ``source`` and ``lang`` are read, others pass."""
    return quality.kept(docs, table(ship(spark), sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal ids one row stays, rows without an id come last; texts without words are
    one group."""
    ship(spark)
    return near_texts.without_copies(docs)


def cut_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """No row leaves, even if nothing is left of its text; null texts become empty."""
    ship(spark)
    return suffix_dedup.without_repeats(docs, n_chars="n_chars")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with equal texts share their lot, whatever their ids; null texts stay."""
    return decontaminate.clean(docs, table(ship(spark), sf_dir, "benchmark"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each row; null texts have no tokens."""
    ship(spark)
    return bpe_replay.encode(docs, tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_classifier", classify_quality),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeated_strings),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe_encoding", encode_tokens),
]

#: SQL can't express the stages.  Tests compare the near-duplicate stage with a
#: brute-force version; run() as a whole has no plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between them the documents are tables, and what a
    stage wrote for itself goes when it is done."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch(spark):
            docs = settle(stage(spark, docs, sf_dir), outer=True)
    return STAGES[-1][1](spark, docs, sf_dir)
