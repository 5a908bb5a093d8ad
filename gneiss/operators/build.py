"""Assembling a graph: edge types checked, attributes filled, missing ends added as external nodes, repeated ids collapsed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.functions import text as X


def collapse_nodes(nodes: DataFrame) -> DataFrame:
    """One row per id: the last row's attributes at the first row's place."""
    rest = [c for c in nodes.columns if c not in ("id", "ord")]
    # ids seldom repeat, so sorting what a task scans to collapse it ahead of the shuffle saves next to nothing and holds all of it
    one = nodes.repartition("id").groupBy("id").agg(F.min("ord").alias("ord"), F.max(F.struct("ord", *rest)).alias("x"))
    return one.select("ord", "id", *[F.col(f"x.{c}").alias(c) for c in rest])


def valid_edges(edges: DataFrame, types: tuple[str, ...] = X.EDGE_TYPES) -> DataFrame:
    """Edges of known types with confidence and weight filled in; parallel edges stay."""
    e = edges.filter(F.col("type").isin(*types))
    confidence = F.coalesce("confidence", F.lit("EXTRACTED")) if "confidence" in edges.columns else F.lit("EXTRACTED")
    weight = F.coalesce("weight", F.lit(1.0)) if "weight" in edges.columns else F.lit(1.0)
    return e.withColumns({"confidence": confidence, "weight": weight})


def external_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, type, name of ends of valid edges that no node has; nodes may repeat ids."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    out = ends.join(nodes.select("id"), "id", "left_anti")
    return out.select("id", F.lit("external").alias("type"), F.col("id").alias("name"), F.lit("").alias("file"))


def build(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    own = collapse_nodes(nodes)
    kept = valid_edges(edges)
    return own.unionByName(external_nodes(nodes, kept), allowMissingColumns=True), kept


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes, externals, edges and dropped edges, one row."""
    all_nodes, kept = build(nodes, edges)
    n = all_nodes.agg(F.count("*").alias("n_nodes"), F.count_if(F.col("type") == "external").alias("n_external"))
    e = edges.agg(F.count_if(F.col("type").isin(*X.EDGE_TYPES)).alias("n_edges"), F.count_if(~F.coalesce(F.col("type").isin(*X.EDGE_TYPES), F.lit(False))).alias("n_dropped"))
    return n.join(F.broadcast(e))
