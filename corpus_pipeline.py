"""Documents through the stages of a training corpus: language, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before has kept. All but the last return the columns of
documents: the first two drop rows, the third cuts texts, and the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillon.llm import languages, near_copies, packing, suffixes
from quillon.llm.common import written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose language isn't known: no letter, or no language that is likelier than all others together."""
    return languages.keep_known(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return near_copies.one_of_each(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the passages that an earlier one or an earlier place has."""
    return suffixes.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its sequence and its place there."""
    special = packing.special_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, special=special)


STAGES = [("language", language), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("pack", pack)]

#: SQL can't express the model, the signatures, the cuts or the fit. tests/llm compares near_dedup and suffix_dedup with plain versions,
#: the ids that pack takes with another library's, and holds language to a bound on rows that it hasn't seen.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on the table documents; what each returns is a table in the shared folder and the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs)
    return docs
