"""Ranked retrieval over graph nodes: BM25 with weighted fields, structural multipliers and neighbours of the hits.

Statistics of the whole corpus come from one pass over tokens: document lengths and frequencies of the question's terms, which are
written; the statistics are one row, which is broadcast. ``index`` answers questions without reading the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gneiss.functions import text as X
from gneiss.session import materialise

#: Field weights.
WEIGHTS = {"name": 3.0, "id": 2.0, "file": 1.0, "type": 1.0, "neighbours": 1.0}
TOP_K, NEIGHBOUR_NAMES, HIT_NEIGHBOURS = 8, 10, 15


#: How a node's edges are ordered. One place is an edge's way, so beside it the other end tells as much as source and target do.
ADJACENT = ("adj_ord", "type", "other", "weight")


def adjacency(edges: DataFrame) -> DataFrame:
    """Both directions of each edge: node, other, direction, type, adj_ord, weight; an edge counts for its source before its target."""
    weight = F.col("weight") if "weight" in edges.columns else F.lit(None).cast("double").alias("weight")
    out = edges.select(F.col("source").alias("node"), F.col("target").alias("other"), F.lit("out").alias("direction"), "type", (F.col("ord") * 2).alias("adj_ord"), weight)
    back = edges.select(F.col("target").alias("node"), F.col("source").alias("other"), F.lit("in").alias("direction"), "type", (F.col("ord") * 2 + 1).alias("adj_ord"), weight)
    return out.unionByName(back)


def _with_neighbours(nodes: DataFrame, edges: DataFrame | None, most: int = NEIGHBOUR_NAMES) -> DataFrame:
    if edges is None:
        return nodes.withColumn("neighbours", F.lit(""))
    # ids often begin alike; sorted by their hash first, most of them needn't be compared
    rank = F.row_number().over(W.partitionBy(F.xxhash64("node"), "node").orderBy(*ADJACENT))
    near = adjacency(edges).withColumn("r", rank).filter(F.col("r") <= most)
    names = nodes.select(F.col("id").alias("other"), F.col("name").alias("other_name")).dropDuplicates(["other"])
    near = near.join(names, "other", "left").groupBy("node").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("r", F.coalesce("other_name", "other").alias("n")))), lambda x: x["n"])).alias("neighbours"))
    return nodes.join(near, nodes["id"] == near["node"], "left").drop("node")


def _fields(nodes: DataFrame, edges: DataFrame | None) -> tuple[DataFrame, dict[str, Column]]:
    """(ord, id, type, m (structural multiplier), dl (weight of all tokens) and the tokens of each field of each node; the fields' tokens)."""
    corpus = _with_neighbours(nodes, edges)
    fields = {f: F.col(f"{f}_tokens") for f in WEIGHTS if f in corpus.columns}
    god = F.col("is_god") if "is_god" in corpus.columns else F.lit(False)
    orphan = F.col("is_orphan") if "is_orphan" in corpus.columns else F.lit(False)
    kind = F.col("type") if "type" in corpus.columns else F.lit(None).cast("string")
    m = X.structural(F.coalesce(god, F.lit(False)), F.coalesce(orphan, F.lit(False))).alias("m")
    docs = corpus.select("ord", "id", kind.alias("type"), m, *[X.identifier_tokens(F.col(f)).alias(f"{f}_tokens") for f in fields])
    return docs.withColumn("dl", sum((F.size(t) * WEIGHTS[f] for f, t in fields.items()), F.lit(0.0))), fields


def documents(nodes: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """ord, id, type, m (structural multiplier), tokens (t with its field's weight w) and dl (their weight) of each node."""
    docs, fields = _fields(nodes, edges)

    def weighed(f: str) -> Column:
        return F.transform(fields[f], lambda x: F.struct(x.alias("t"), F.lit(WEIGHTS[f]).alias("w")))

    return docs.select("ord", "id", "type", "m", F.flatten(F.array(*map(weighed, fields))).alias("tokens"), "dl")


def scores(nodes: DataFrame, query: str, edges: DataFrame | None = None, node_type: str | None = None, stop: tuple[str, ...] = X.STOP_WORDS) -> DataFrame:
    """ord, id and score of every node that holds a term; the type filter comes first, so it shrinks the corpus statistics too.

    Texts are cut into tokens once: what is written is each document's length and its frequencies of the question's terms.
    """
    counts: dict[str, int] = {}
    for t in X.query_terms(query, stop):
        counts[t] = counts.get(t, 0) + 1
    corpus, fields = _fields(nodes if node_type is None else nodes.filter(F.col("type") == node_type), edges)
    mine = [F.filter(c, lambda x: x.isin(*counts)).alias(f"{f}_tokens") for f, c in fields.items()]

    def frequency(t: str) -> Column:
        return sum((F.size(F.filter(c, lambda x: x == t)) * WEIGHTS[f] for f, c in fields.items()), F.lit(0.0))

    held = corpus.select("ord", "id", "m", "dl", *mine).select("ord", "id", "m", "dl", F.array(*map(frequency, counts)).alias("tf"))
    held = materialise(held, "lengths")
    number = [F.count_if(F.get("tf", F.lit(i)) > 0).alias(f"df{i}") for i in range(len(counts))]
    stats = held.agg(F.count("*").alias("n"), F.avg("dl").alias("average"), *number)  # one row
    score = sum((F.lit(float(k)) * F.when(F.get("tf", F.lit(i)) > 0, X.bm25(F.get("tf", F.lit(i)), F.col(f"df{i}"), F.col("n"), F.col("dl"), F.col("average"))).otherwise(0.0) for i, k in enumerate(counts.values())), F.lit(0.0))
    hits = held.filter(F.exists("tf", lambda x: x > 0)).join(F.broadcast(stats))
    return hits.select("ord", "id", (score * F.col("m")).alias("score"))


def search(nodes: DataFrame, query: str, edges: DataFrame | None = None, top_k: int = TOP_K, node_type: str | None = None) -> DataFrame:
    """rank, ord, id and score (9 decimals) of the best nodes; ties keep the nodes' order."""
    best = scores(nodes, query, edges, node_type).select("ord", "id", F.round("score", 9).alias("score")).orderBy(F.desc("score"), "ord").limit(top_k)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "ord"))).select("rank", "ord", "id", "score")


def search_with_neighbours(nodes: DataFrame, edges: DataFrame, query: str, top_k: int = TOP_K, node_type: str | None = None, most: int = HIT_NEIGHBOURS) -> DataFrame:
    """The hits with the first ``most`` neighbours of each in adjacency order; a neighbour's name falls back to its id."""
    hits = search(nodes, query, edges, top_k, node_type)
    near = adjacency(edges).join(F.broadcast(hits.select(F.col("id").alias("node"), "rank")), "node")  # at most top_k rows
    near = near.withColumn("place", F.row_number().over(W.partitionBy("node").orderBy(*ADJACENT))).filter(F.col("place") <= most)
    names = nodes.select(F.col("id").alias("other"), F.col("name").alias("other_name"))
    return near.join(names, "other", "left").select("rank", F.col("node").alias("id"), "place", "other", F.coalesce("other_name", "other").alias("other_name"), "direction", "type")


def seeds(nodes: DataFrame, hits: DataFrame, top_k: int) -> DataFrame:
    """rank, ord, id of the hits, or of the first ``top_k`` gods where there is none."""
    none = hits.agg((F.count("*") == 0).alias("none"))
    gods = nodes.filter("is_god").orderBy("ord").limit(top_k).withColumn("rank", F.row_number().over(W.orderBy("ord")))  # top_k rows
    return hits.select("rank", "ord", "id").unionByName(gods.join(F.broadcast(none)).filter("none").select("rank", "ord", "id"))
