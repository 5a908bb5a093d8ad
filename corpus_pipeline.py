"""The corpus pipeline: five stages over documents, each a DataFrame in and out, written as Parquet in between.

Null texts are kept as empty ones are by every stage but the mix, which draws no text without words; an empty table passes through all
stages as an empty table; repeated rows stay rows of their own, near copies aside, where rows of one id stay or go together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gneiss.llm import bpe, jaccard, mixing, pii, toxicity
from gneiss.session import delete_at_end, scratch_path


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by sets of five-word shingles with a similarity of 0.8 or more, that with the smallest id stays."""
    return jaccard.one_of_each(docs, n=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities and terms that disclose them are replaced in the text."""
    return pii.sanitise(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to target weights draws them."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its token ids and what they decode to."""
    return bpe.encode(docs, keep=tuple(c for c in docs.columns if c != "doc_id"))


STAGES = [("toxicity", toxic), ("near copies", near_copies), ("personal data", personal_data), ("mix", mix), ("tokens", tokens)]
#: Learning, hashing and encoding have no SQL; the tests hold the operators of the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        delete_at_end(spark, path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
