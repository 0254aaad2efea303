"""A training corpus from raw documents: five stages, each written as Parquet and read again as the next one's input.

All columns of documents go along, whatever their names; ids may be null or repeat, and tables may be empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafwright.llm.common import durable
from leafwright.llm.decontaminate import decontaminate
from leafwright.llm.mixing import mix_documents
from leafwright.llm.queries import table, tokenizer_path
from leafwright.llm.simhash import drop_near_copies
from leafwright.llm.tokens import tokens_of
from leafwright.llm.toxicity import drop_toxic, train_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects (0.7 or more) go; null and empty texts are scored as texts without words."""
    return drop_toxic(docs, train_toxicity(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (0.8 of their five-word shingles or more) the document with the smallest id stays, as one
    row. Null and empty texts are copies of each other; a null id stays only where the whole group has none."""
    return drop_near_copies(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark items make up a twentieth go; shorter leaked passages are cut out. Null and empty texts
    stay."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row stands as often as the mix takes it: not at all, once or twice. Texts without words are not taken; a null source
    is one of its own."""
    return mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token files in ascending order of ids, and a row of what the files hold for each document of them."""
    return tokens_of(docs, tokenizer_path())


STAGES = [("toxicity", toxicity), ("simhash_near_dedup", near_dedup), ("decontamination", leaks), ("mixing", mixing), ("token_output", tokens)]

# No SQL: trained models, XXH64 fingerprints and the tokenizer are beyond it. tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
