"""Aggregates over the built graph: undirected weights, god and orphan flags, degrees, statistics and file summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gneiss.session import hashed

GOD_COMMUNITIES = 2


def projection(edges: DataFrame) -> DataFrame:
    """u, v, weight of the undirected graph: loops out, parallel and reverse edges summed."""
    return edges.filter("source <> target").groupBy(F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v")).agg(F.sum("weight").alias("weight"))


def flags(nodes: DataFrame, edges: DataFrame, least: int = GOD_COMMUNITIES) -> DataFrame:
    """id, is_god (neighbours in ``least`` or more communities but its own), is_orphan (no edge at all; a loop is one)."""
    return flagged(nodes, edges, least).select("id", "is_god", "is_orphan")


def flagged(nodes: DataFrame, edges: DataFrame, least: int = GOD_COMMUNITIES) -> DataFrame:
    """Nodes with their flags; what the edges tell of an id joins the whole row, so nodes are not joined with themselves."""
    known = nodes.select("id", "community").filter("community is not null")
    at = lambda end, c: hashed(known.select(F.col("id").alias(end), F.col("community").alias(c)))
    both = edges.select("source", "target").join(at("source", "cs"), "source", "left").join(at("target", "ct"), "target", "left")
    # an end takes the other's community where that is not its own; ends are then rows of one key, whatever they meet, and no pairs are held
    met = lambda end, c: F.struct(F.col(end).alias("id"), F.when(~F.col("cs").eqNullSafe(F.col("ct")), F.col(c)).alias("c"))
    ends = both.select(F.inline(F.array(met("source", "ct"), met("target", "cs"))))
    spread = F.min("c") < F.max("c") if least == 2 else F.countDistinct("c") >= least  # that two differ is told without a set
    found = ends.groupBy("id").agg(F.coalesce(spread, F.lit(False)).alias("spread"), F.lit(True).alias("met"))
    rest = [c for c in nodes.columns if c not in ("id", "is_god", "is_orphan")]
    return nodes.join(found, "id", "left").select("id", *rest, F.coalesce("spread", F.lit(least <= 0)).alias("is_god"), F.col("met").isNull().alias("is_orphan"))


def summary(flagged: DataFrame) -> DataFrame:
    """n_communities, n_gods and n_orphans of a flagged graph, one row."""
    return flagged.agg(F.countDistinct("community").alias("n_communities"), F.count_if("is_god").alias("n_gods"), F.count_if("is_orphan").alias("n_orphans"))


def frequency(rows: DataFrame, column: str) -> DataFrame:
    """value, n and percent (one decimal) of a column, null as unknown."""
    n = rows.groupBy(F.coalesce(F.col(column), F.lit("unknown")).alias("value")).agg(F.count("*").alias("n"))
    return n.join(F.broadcast(rows.agg(F.count("*").alias("all")))).select("value", "n", F.round(100 * F.col("n") / F.col("all"), 1).alias("percent"))


def primary_cluster(nodes: DataFrame) -> DataFrame:
    """file, community: the community of most of a file's nodes, on ties that seen first; externals don't count."""
    n = nodes.filter("type <> 'external' and community is not null").groupBy("file", "community").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    best = n.groupBy("file").agg(F.max(F.struct("n", (-F.col("first")).alias("early"), "community")).alias("x"))
    return best.select("file", F.col("x.community").alias("community"))


def file_index(nodes: DataFrame, edges: DataFrame, files: int = 30, members: int = 5) -> DataFrame:
    """The first files by name with their cluster and leading members: hubs, then by degree."""
    from gneiss.operators.traverse import degrees

    first = nodes.filter("type <> 'external'").select("file").distinct().orderBy("file").limit(files)
    own = nodes.join(F.broadcast(first), "file").filter("type not in ('external', 'module')").join(degrees(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    place = F.row_number().over(W.partitionBy("file").orderBy(F.desc("is_god"), F.desc("degree"), "ord"))
    top = own.withColumn("place", place).filter(F.col("place") <= members).groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]).alias("x"))
    return first.join(primary_cluster(nodes), "file", "left").join(top, "file", "left").select("file", "community", F.coalesce(F.concat_ws(", ", "x"), F.lit("")).alias("members"))


def purposes(nodes: DataFrame, edges: DataFrame, parts: int = 2) -> DataFrame:
    """community, n, prefix (the path that all its files share, two parts at most) and hub (its first god by degree).

    The shared path is that of the least and the greatest file, so no list of files is gathered.
    """
    from gneiss.operators.traverse import degrees

    own = nodes.filter("community is not null and type <> 'external'").join(degrees(edges), "id", "left")
    path = F.split("file", "/")
    best = F.max(F.when(F.col("is_god"), F.struct(F.coalesce("degree", F.lit(0)).alias("d"), (-F.col("ord")).alias("o"), F.col("name"))))
    g = own.groupBy("community").agg(F.count("*").alias("n"), F.min(path).alias("a"), F.max(path).alias("b"), best.alias("h"))
    same = F.transform(F.sequence(F.lit(1), F.lit(parts)), lambda i: F.slice("a", 1, i) == F.slice("b", 1, i))
    depth = F.least(F.aggregate(same, F.lit(0), lambda n, x: n + x.cast("int")), F.size("a"))
    return g.select("community", "n", F.array_join(F.slice("a", F.lit(1), depth), "/").alias("prefix"), F.col("h.name").alias("hub"))
