"""A corpus pipeline of the training-data operators; each stage is written as Parquet and read again by the next.

Each stage takes all that the one before it kept: language ID drops documents in no language, the Jaccard join keeps one document of
each class of near copies, suffix-array dedup cuts later copies of long passages out of the texts, mixing repeats and thins
documents to the sources' target weights, and BPE turns texts into token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, jaccard_join, langid, mixing, suffix_dedup
from lectern.llm.common import table, written

TOKENIZER = "word_bpe_49k.json"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.in_a_language(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.first_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows stay, even if nothing is left of a text; n_chars follows the text."""
    cut = suffix_dedup.dedup(docs, mode="later")
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path(TOKENIZER), keep=("doc_id", "lang", "source"))


STAGES = [("language", language), ("near_copies", near_copies), ("repeated_passages", repeated_passages), ("mixture", mixture), ("tokens", tokens)]

#: SQL can express neither the language profiles nor BPE; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
