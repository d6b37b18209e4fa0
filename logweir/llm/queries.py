"""The operators of this subpackage as queries over whole test tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.llm import chat_view, quality, toxicity
from logweir.llm.bpe import token_digests
from logweir.llm.chat_format import format_chat
from logweir.llm.common import documents
from logweir.llm.exact_dedup import find_copies
from logweir.llm.filter_audit import audit_filters
from logweir.llm.fingerprints import fingerprint_documents
from logweir.llm.hard_negatives import mine_hard_negatives
from logweir.llm.html_text import extract_main_text
from logweir.llm.mixing import mix
from logweir.llm.near_dedup import near_duplicates
from logweir.llm.oracles import ORACLES  # noqa: F401
from logweir.llm.quality_rules import quality_rules
from logweir.llm.token_counts import count_tokens

Query = Callable[[SparkSession, str], DataFrame]


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    lexicon = toxicity.learn_from(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _scored(toxicity.score_toxicity(docs, lexicon))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_copies(documents(spark, sf_dir))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = quality.learn_from(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _scored(quality.score_quality(docs, model))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = chat_view.messages(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return format_chat(messages, chat_view.parameters(spark))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(documents(spark, sf_dir))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(vectors, F.col("vec_id") % 100 == 0, label=label)


def _scored(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", toxicity.held_out().alias("held_out"), F.col("score"), F.col("predicted"))


QUERIES: dict[str, Query] = {
    query.__name__: query for query in (
        op1_near_dedup, op2_toxicity, op3_exact_dedup, op4_bpe, op5_quality, op6_token_counts, op7_mixing,
        op8_html_text, op9_chat_format, op10_fingerprints, op11_filter_audit, op12_quality_rules, op13_hard_negatives,
    )
}
