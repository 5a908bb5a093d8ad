"""Neighbourhoods, communities, filtered views, ancestor chains and call paths.

All are joins against a bounded set of seeds; every capped list is ranked by a key that ends in the row's place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gneiss.functions import text as X
from gneiss.operators.search import ADJACENT, adjacency
from gneiss.session import hashed, materialise

MAX_NEIGHBOURS, MAX_MEMBERS, MAX_HOPS = 25, 20, 10
PATH_HOPS, PATH_CHILDREN, PATH_CAP = 4, 3, 8


def resolve_id(nodes: DataFrame, text: str) -> DataFrame:
    """The node of that id, else the first whose id or name contains the text; one row at most."""
    low = text.lower()
    exact = F.col("id") == text
    like = F.contains(F.lower("id"), F.lit(low)) | F.contains(F.lower("name"), F.lit(low))
    return nodes.filter(exact | F.coalesce(like, F.lit(False))).orderBy(F.when(exact, 0).otherwise(1), "ord").limit(1)


def neighbours(nodes: DataFrame, edges: DataFrame, ids: DataFrame, most: int = MAX_NEIGHBOURS, edge_type: str | None = None) -> DataFrame:
    """For each id (column id): direction, place, other, other_name, type; half of ``most`` each way. A self-loop comes inbound only."""
    kept = edges if edge_type is None else edges.filter(F.col("type") == edge_type)
    near = adjacency(kept).filter((F.col("node") != F.col("other")) | (F.col("direction") == "in"))
    near = near.join(ids.select(F.col("id").alias("node")), "node", "left_semi")
    place = F.row_number().over(W.partitionBy("node", "direction").orderBy(*ADJACENT))
    near = near.withColumn("place", place).filter(F.col("place") <= most // 2)
    names = nodes.select(F.col("id").alias("other"), F.col("name").alias("other_name"))
    return near.join(names, "other", "left").select(F.col("node").alias("id"), "direction", "place", "other", F.coalesce("other_name", "other").alias("other_name"), "type")


def community(nodes: DataFrame, ids: DataFrame, most: int = MAX_MEMBERS) -> tuple[DataFrame, DataFrame]:
    """(summary, members) of the communities of some ids: gods first, then others, orphans last, capped."""
    own = nodes.join(hashed(ids.select("id")), "id", "left_semi").select("community").filter("community is not null").distinct()
    members = nodes.join(own, "community", "left_semi")
    summary = members.groupBy("community").agg(F.count("*").alias("members"), F.count_if("is_god").alias("gods"), F.count_if("is_orphan").alias("orphans")).withColumn("truncated", F.col("members") > most)
    rank = F.row_number().over(W.partitionBy("community").orderBy(F.when(F.col("is_god"), 0).when(F.col("is_orphan"), 2).otherwise(1), "ord"))
    return summary, members.withColumn("place", rank).filter(F.col("place") <= most).select("community", "place", "id", "name")


def leading_members(nodes: DataFrame, edges: DataFrame, most: int = MAX_MEMBERS) -> DataFrame:
    """community, place, id, degree of each community's first members: hubs, then by degree."""
    own = nodes.filter("community is not null").join(degrees(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    rank = F.row_number().over(W.partitionBy("community").orderBy(F.desc("is_god"), F.desc("degree"), "ord"))
    return own.withColumn("place", rank).filter(F.col("place") <= most).select("community", "place", "id", "degree")


def first_communities(nodes: DataFrame, hits: DataFrame, most: int = 4) -> DataFrame:
    """place, community: the communities of some hits (rank, id), in the order in which they are first met."""
    met = hits.join(nodes.select("id", "community"), "id").filter("community is not null").groupBy("community").agg(F.min("rank").alias("first"))
    first = met.orderBy("first", "community").limit(most)  # a few rows
    return first.select(F.row_number().over(W.orderBy("first", "community")).alias("place"), "community")


def view(nodes: DataFrame, edges: DataFrame, types: tuple[str, ...] = (), gods_only: bool = False, orphans_only: bool = False, clusters: tuple[int, ...] = (), query: str = "") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) that pass all filters, both ends of an edge surviving; with a query, its matches and their direct neighbours."""
    n = nodes
    if types:
        n = n.filter(F.col("type").isin(*types))
    if gods_only:
        n = n.filter("is_god")
    if orphans_only:
        n = n.filter("is_orphan")
    if clusters:
        n = n.filter(F.col("community").isin(*clusters))
    ends = lambda of, c: of.select(F.col("id").alias(c))
    # an id is a node once, so the side of ids, by far the smaller, is hashed and edges needn't be sorted
    within = lambda e, of: e.join(hashed(ends(of, "source")), "source", "left_semi").join(hashed(ends(of, "target")), "target", "left_semi")
    e = within(edges, n)
    q = query.strip().lower()
    if q:
        e = materialise(e, "within")  # matches are looked for from both ends, and then edges among all that is seen
        match = n.filter(F.contains(F.lower("name"), F.lit(q)) | F.contains(F.lower("file"), F.lit(q))).select("id")
        out = e.join(hashed(match.withColumnRenamed("id", "source")), "source", "left_semi").select(F.col("target").alias("id"))
        back = e.join(hashed(match.withColumnRenamed("id", "target")), "target", "left_semi").select(F.col("source").alias("id"))
        seen = match.unionByName(out).unionByName(back).distinct()
        n = n.join(seen, "id", "left_semi")
        e = within(e, materialise(seen, "seen"))
    return n, e


def breadcrumb(edges: DataFrame, ids: DataFrame, hops: int = MAX_HOPS) -> DataFrame:
    """id, hop, ancestor: the chain of containers of each id, following the first CONTAINS edge into a node; a cycle ends where it closes."""
    parent = edges.filter(F.col("type") == "CONTAINS").groupBy("target").agg(F.min(F.struct("ord", "source")).alias("p")).select(F.col("target").alias("at"), F.col("p.source").alias("ancestor"))
    parent = materialise(parent, "parents")
    level = ids.select("id", F.col("id").alias("at"), F.array("id").alias("seen"))
    chains = []
    # each hop is one join with what the last one wrote, so plans don't grow with the hops; it stops where no chain goes on
    for hop in range(1, hops + 1):
        up = level.join(parent, "at").filter(~F.array_contains("seen", F.col("ancestor")))
        up = materialise(up.select("id", F.lit(hop).alias("hop"), F.col("ancestor").alias("at"), F.concat("seen", F.array("ancestor")).alias("seen")), "hop")
        chains.append(up.select("id", "hop", F.col("at").alias("ancestor")))
        if up.isEmpty():
            break
        level = up.drop("hop")
    out = chains[0]
    for c in chains[1:]:
        out = out.unionByName(c)
    return out


def degrees(edges: DataFrame) -> DataFrame:
    """id, degree: both directions, parallel edges counted; both ends must be there."""
    ends = edges.filter((F.col("source") != "") & (F.col("target") != "")).select(F.explode(F.array("source", "target")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def hubs(nodes: DataFrame, edges: DataFrame, most: int = 20) -> DataFrame:
    """hub_rank, id: god nodes by degree."""
    top = nodes.filter("is_god").join(degrees(edges), "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"), "ord").orderBy(F.desc("degree"), "ord").limit(most)
    return top.withColumn("hub_rank", F.row_number().over(W.orderBy(F.desc("degree"), "ord"))).select("hub_rank", "id", "degree")


def priority_edges(edges: DataFrame, ids: DataFrame, most: int = 8, direction: str = "out") -> DataFrame:
    """The first edges of each id by the priority of their type, then place: id, place, other, type."""
    node, other = ("source", "target") if direction == "out" else ("target", "source")
    tie = F.struct(other, "weight")
    near = edges.join(ids.select(F.col("id").alias(node)), node, "left_semi")
    place = F.row_number().over(W.partitionBy(node).orderBy(X.edge_priority(F.col("type")), "ord", tie))
    return near.withColumn("place", place).filter(F.col("place") <= most).select(F.col(node).alias("id"), "place", F.col(other).alias("other"), "type")


def call_chains(edges: DataFrame, ids: DataFrame, most: int = 8) -> DataFrame:
    """id, callee, next: calls two hops on; the cap on a node's edges comes before calls are chosen."""
    one = priority_edges(edges, ids, most).filter(F.col("type") == "CALLS").select("id", F.col("place").alias("p1"), F.col("other").alias("callee"))
    two = priority_edges(edges, one.select(F.col("callee").alias("id")).distinct(), most).filter(F.col("type") == "CALLS").select(F.col("id").alias("callee"), F.col("place").alias("p2"), F.col("other").alias("next"))
    return one.join(two, "callee", "left").select("id", "p1", "callee", "p2", "next")


def call_paths(edges: DataFrame, starts: DataFrame, hops: int = PATH_HOPS, children: int = PATH_CHILDREN, cap: int = PATH_CAP) -> DataFrame:
    """Call paths from starts (hub_rank, id), breadth first: hub_rank, place, path.

    A path goes on to the first ``children`` callees that are not on it. It is told when it can't go on, or on reaching ``hops``; a start
    alone is no path. The cap is tested when a path is taken up, so those that the last one brings forth are still told.
    """
    calls = edges.filter(F.col("type") == "CALLS").select(F.col("source").alias("at"), F.col("target").alias("to"), F.col("ord").alias("e"), F.struct("target", "weight").alias("tie"))
    ranks = "array<int>"
    level = starts.select("hub_rank", F.col("id").alias("at"), F.array("id").alias("path"), F.array().cast(ranks).alias("key"))
    told = []
    for depth in range(hops):
        on = level.join(calls, "at", "left").filter(F.col("to").isNull() | ~F.array_contains("path", F.col("to")))
        ranked = on.filter(F.col("to").isNotNull()).withColumn("k", F.row_number().over(W.partitionBy("hub_rank", "key").orderBy("e", "tie"))).filter(F.col("k") <= children)
        grown = ranked.select("hub_rank", F.col("to").alias("at"), F.concat("path", F.array("to")).alias("path"), F.concat("key", F.array("k")).alias("key"))
        leaves = level.join(ranked.select("hub_rank", "key").distinct(), ["hub_rank", "key"], "left_anti") if depth else level.limit(0)
        told.append(leaves.select("hub_rank", F.lit(depth).alias("taken"), F.col("key").alias("group"), "path", F.lit(0).alias("child")))
        if depth == hops - 1:
            told.append(grown.select("hub_rank", F.lit(depth).alias("taken"), F.slice("key", 1, depth).alias("group"), "path", F.element_at("key", -1).alias("child")))
        level = grown
    out = told[0]
    for t in told[1:]:
        out = out.unionByName(t)
    # parallel calls bring forth the same path again; its first place counts
    out = out.groupBy("hub_rank", "path").agg(F.min(F.struct("taken", "group", "child")).alias("x")).select("hub_rank", "path", "x.*")
    order: list[Column | str] = ["hub_rank", "taken", "group"]
    per = out.groupBy(*order).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a few rows per hub
    kept = per.withColumn("before", before).filter(F.col("before") < cap).drop("n")
    return out.join(kept, order).withColumn("place", F.row_number().over(W.orderBy(*order, "child"))).select("hub_rank", "place", "path")
