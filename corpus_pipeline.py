"""From ``documents`` to encoded text in stages, each written as a table and read by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from logweir.llm.bpe import round_trip
from logweir.llm.common import Scratch, documents, temporary
from logweir.llm.exact_dedup import drop_copies
from logweir.llm.mixing import mixed_documents
from logweir.llm.near_dedup import CORPUS, drop_near_duplicates
from logweir.llm.toxicity import drop_toxic, learn_from


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that a lexicon learned from ``labels`` does not predict toxic."""
    return drop_toxic(docs, learn_from(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for the case of A-Z."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts with a similarity of 0.80 or more, the one with the smallest id."""
    return drop_near_duplicates(docs, layout=CORPUS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: whole documents, as often as it takes them."""
    return mixed_documents(docs, whole=True)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids; the text is the one decoded from these."""
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("bpe", bpe)]

#: The stages learn and tokenize, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage has read or written for itself goes when its result is written."""
    scratch = Scratch(spark)
    docs, before = documents(spark, sf_dir), []
    for name, stage in STAGES:
        with temporary():
            docs = scratch.keep(stage(spark, docs, sf_dir), name)
        scratch.drop(*before)
        before = [name]
    return docs
