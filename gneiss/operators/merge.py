"""Incremental maintenance: diffs split into stale and fresh files, and merged into a stored tree by anti-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.functions import text as X


def split_diff(changes: DataFrame) -> DataFrame:
    """path, side: added files are fresh, deleted ones stale, modified ones both; a rename is stale under its old path and fresh under its new."""
    row = lambda p, s: F.struct(F.col(p).alias("path"), F.lit(s).alias("side"))
    none = F.array().cast("array<struct<path:string,side:string>>")
    sides = F.when(F.col("status") == "A", F.array(row("path", "fresh"))).when(F.col("status") == "D", F.array(row("path", "stale"))).when(F.col("status") == "M", F.array(row("path", "stale"), row("path", "fresh"))).when(F.col("status") == "R", F.array(row("old_path", "stale"), row("path", "fresh"))).otherwise(none)
    return changes.select(F.explode(sides).alias("x")).select("x.path", "x.side")


def merge_tree(nodes: DataFrame, edges: DataFrame, stale: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of stale files (column path) are replaced by the new ones. An edge goes if its source is removed, or if its target
    is removed and doesn't come back; so edges of unchanged files into a returning node stay."""
    removed = nodes.join(stale.select(F.col("path").alias("file")).distinct(), "file", "left_semi").select("id")
    gone = removed.join(new_nodes.select("id"), "id", "left_anti")
    kept = nodes.join(stale.select(F.col("path").alias("file")).distinct(), "file", "left_anti")
    left = edges.join(removed.withColumnRenamed("id", "source"), "source", "left_anti").join(gone.withColumnRenamed("id", "target"), "target", "left_anti")
    return kept.unionByName(new_nodes, allowMissingColumns=True), left.unionByName(new_edges, allowMissingColumns=True)


def merge_stats(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row from two: counters take the greater, languages are summed by name, errors follow each other."""
    b = new.select(*[F.col(c).alias(f"{c}_") for c in new.columns])
    languages = F.map_zip_with("languages", "languages_", lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))
    return old.join(F.broadcast(b)).select(F.greatest("files_parsed", "files_parsed_").alias("files_parsed"), F.greatest("files_skipped", "files_skipped_").alias("files_skipped"), languages.alias("languages"), F.concat("errors", "errors_").alias("errors"))


def deltas(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """added, removed: how many keys appear and vanish."""
    a, b = before.select(*keys).distinct().withColumn("old", F.lit(1)), after.select(*keys).distinct().withColumn("new", F.lit(1))
    both = a.join(b, keys, "full")
    return both.agg(F.count_if(F.col("old").isNull()).alias("added"), F.count_if(F.col("new").isNull()).alias("removed"))


def touched_files(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """side, n: nodes in stale and fresh files."""
    return nodes.withColumn("path", X.file_of(F.col("id"))).join(split_diff(changes), "path").groupBy("side").agg(F.count("*").alias("n"))
