"""The registered queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gneiss.llm import alignment, bpe, chat, jaccard, mixing, pii, quality, secrets, suffixes, topk, toxicity, warc, whitening


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.scan(documents(spark, sf_dir)))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(documents(spark, sf_dir)))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(suffixes.deduplicate(documents(spark, sf_dir)))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(*mixing.mix(documents(spark, sf_dir)))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(documents(spark, sf_dir))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe, formatted, every reply expanded to an example with its context, and read back from their texts and masks."""
    return chat.read_examples(chat.expanded(chat.format_turns(chat.with_probe(spark.read.parquet(f"{sf_dir}/conversations.parquet")))))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight leading whitened components of every vector."""
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of both tokenizers' tokens in every text."""
    return alignment.digest(alignment.align(documents(spark, sf_dir)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pii, op2_suffix_dedup, op3_mixing, op4_quality_rules, op5_warc, op6_jaccard_join, op7_bpe, op8_exact_top_k, op9_toxicity, op10_secret_scans, op11_chat_formatting, op12_whitening, op13_alignment)
}
SQL: dict[str, str] = {"op4_quality_rules": quality.SQL, "op6_jaccard_join": jaccard.SQL, "op5_warc": warc.SQL, "op8_exact_top_k": topk.SQL}
