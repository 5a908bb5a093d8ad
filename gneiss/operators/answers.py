"""Handing unresolved references to an outside resolver: one of each, in chunks, and its answers back to all of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gneiss.functions import text as X

KEY = ["file", "raw", "kind", "source"]
CHUNK = 30
ANSWER = "struct<ref_index:int,target:string,reasoning:string>"


def distinct_refs(refs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The first of equal references, numbered within chunks: KEY, ord, chunk, ref_index. Chunks go by file, so that numbering needs no total order."""
    first = refs.groupBy(*KEY).agg(F.min("ord").alias("ord"))
    n = F.row_number().over(W.partitionBy("file").orderBy("ord", *KEY)) - 1
    return first.withColumn("n", n).select(*KEY, "ord", F.concat_ws("#", "file", F.floor(F.col("n") / chunk)).alias("chunk"), (F.col("n") % chunk).cast("int").alias("ref_index"))


def parse_answers(replies: DataFrame) -> DataFrame:
    """chunk, ref_index, target, reasoning from free text (chunk, ord, text): the last answer to an index counts."""
    rows = replies.select("chunk", "ord", F.posexplode(X.json_rows(F.col("text"), ANSWER)).alias("at", "x"))
    last = rows.filter("x.ref_index is not null").groupBy("chunk", F.col("x.ref_index").alias("ref_index")).agg(F.max_by(F.col("x"), F.struct("ord", "at")).alias("x"))
    return last.select("chunk", "ref_index", "x.target", "x.reasoning")


def fan_out(refs: DataFrame, numbered: DataFrame, answers: DataFrame) -> DataFrame:
    """Every reference with the target of its first equal; null where there is no answer."""
    told = numbered.join(answers, ["chunk", "ref_index"], "left").select(*KEY, "target", "reasoning")
    return refs.join(told, KEY, "left")


def resolve_rest(refs: DataFrame, resolver: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """With a resolver (chunks in, answers out) its answers; without one every reference stays unresolved."""
    numbered = distinct_refs(refs)
    if resolver is None:
        return refs.withColumns({"target": F.lit(None).cast("string"), "reasoning": F.lit(None).cast("string")})
    return fan_out(refs, numbered, resolver(numbered))
