"""Community detection by the Leiden method on modularity, in rounds over the edge table.

Moving: each vertex weighs the communities of its neighbours and takes the best if it gains. Only a share of the vertices, chosen by
a hash of the round, moves at a time, so that two neighbours don't swap for ever. Refining: within each community vertices start
alone and those that are well connected to it merge, at random but rather where they gain more, into parts that are well connected
too. Parts become the vertices of the next level, which starts with the communities that moving found. It ends when each community is
one part. A level but the last stops moving when few vertices still want to, since the next level moves what they become a part of; the
last goes on until none does. Parts grow along edges and never lose a vertex, so communities are connected; and as no vertex of the last level wants to
move, no two communities gain by merging.

Rounds are jobs over tables where a graph is too large for anything else. Levels of up to ``MOST_VERTICES`` and ``MOST_EDGES`` are arrays (``leiden``), with the
same results: the edges lie in shards that tasks read in every round, and levels of up to ``ONE_TASK`` edges are left to one task, to the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gneiss.operators import leiden
from gneiss.operators.flags import flags, projection
from gneiss.session import discard, hashed, materialise

#: How much parts are chosen at random, against gain; halvings of the vertices that join one part at once; the share of those that
#: could join a part at first from which refining leaves the rest to the next level; the share of a level's vertices that may still want
#: to move when it is refined.
RANDOMNESS, HALVINGS, SETTLED, RESTLESS = 0.05, 12, 0.2, 0.05
#: Edges that one task holds, and that a shard has (each from both ends); edges, vertices and bytes of ids up to which levels are arrays.
ONE_TASK, SHARD, MOST_EDGES, MOST_VERTICES, MOST_TEXT = 1 << 20, 400_000, 1 << 26, 1 << 22, 192 << 20


def _weigh(both: DataFrame, state: DataFrame, m2: float, resolution: float, turn: int) -> DataFrame:
    """vertex, k, now, c, more, wants, q of a state (vertex, k, c): the best community, what it gains, and the vertex's share of modularity.

    A vertex that loses in every community is better off alone, in a new one; so no community without inner edges is left.
    """
    total = state.groupBy("c").agg(F.sum("k").alias("held"))
    near = both.join(state.select(F.col("vertex").alias("v"), F.col("c")), "v").groupBy(F.col("u").alias("vertex"), "c").agg(F.sum("weight").alias("w"))
    own = state.select("vertex", "k", F.col("c").alias("now"))
    options = near.unionByName(state.select("vertex", "c", F.lit(0.0).alias("w"))).groupBy("vertex", "c").agg(F.sum("w").alias("w"))
    options = options.join(own, "vertex").join(total, "c")
    here = F.col("c") == F.col("now")
    rest = F.col("held") - F.when(here, F.col("k")).otherwise(0.0)
    gain = F.col("w") - resolution * F.col("k") * rest / m2
    q = F.max(F.when(here, F.col("w") / m2 - resolution * F.col("k") * F.col("held") / (m2 * m2)))
    best = options.groupBy("vertex", "k", "now").agg(F.max(F.struct(F.round(gain, 9).alias("g"), F.col("c"))).alias("b"), F.max(F.when(here, gain)).alias("stay"), q.alias("q"))
    more = F.greatest("b.g", F.lit(0.0)) - F.col("stay")
    c = F.when(F.col("b.g") < 0, F.concat("vertex", F.lit(f"\0{turn}"))).otherwise(F.col("b.c"))
    return materialise(best.select("vertex", "k", "now", c.alias("c"), more.alias("more"), (more > 1e-9 * F.greatest(F.lit(1.0), "k")).alias("wants"), "q"), "state")


def _apart(at: DataFrame) -> DataFrame:
    """vertex of moves of which no two touch one community, the best of each: their gains add up exactly."""
    moves = at.filter("wants").select("vertex", "now", "c", F.struct("more", "vertex").alias("p"))
    top = moves.select(F.col("now").alias("x"), "p").union(moves.select(F.col("c").alias("x"), "p")).groupBy("x").agg(F.max("p").alias("top"))
    for end in ("now", "c"):
        moves = moves.join(top.withColumnRenamed("x", end), end).filter("p = top").drop("top")
    return moves.select("vertex")


def _degrees(edges: DataFrame) -> DataFrame:
    """vertex, k of a weighted graph (u, v, weight; u = v for inner weight, which counts twice)."""
    ends = edges.select(F.explode(F.array("u", "v")).alias("vertex"), "weight")
    return ends.groupBy("vertex").agg(F.sum("weight").alias("k"))


def _move(both: DataFrame, degrees: DataFrame, m2: float, resolution: float, seed: int, start: DataFrame | None, restless: float = 0.0) -> tuple[DataFrame, int]:
    """(vertex, k, p; how many vertices still want to move): communities from which no more than a share of the vertices wants to move, starting
    from those of ``start`` (vertex, p), or alone.

    A share of the vertices moves at once. Where that does not raise modularity it is undone and a smaller share tried; below one
    vertex, the moves that don't touch each other's communities are made. So modularity grows with every state and the rounds end.
    """
    state = degrees.withColumn("c", F.col("vertex")) if start is None else degrees.join(start.withColumnRenamed("p", "c"), "vertex")

    def weighed(state: DataFrame, turn: int) -> tuple[DataFrame, int, float, int]:
        found = _weigh(both, state, m2, resolution, turn)
        return found, *found.agg(F.count_if("wants"), F.coalesce(F.sum("q"), F.lit(0.0)), F.count("*")).first()

    at, wants, q, n = weighed(materialise(state, "state"), 0)
    parts, turn = 2, 0
    while wants > restless * n:
        bold = parts <= wants
        if bold:
            go = at.withColumn("go", F.col("wants") & (F.pmod(F.xxhash64("vertex", F.lit(seed), F.lit(turn)), F.lit(parts)) == 0))
        else:
            go = at.join(_apart(at).withColumn("go", F.lit(True)), "vertex", "left")
        new = weighed(go.select("vertex", "k", F.when(F.col("go"), F.col("c")).otherwise(F.col("now")).alias("c")), turn + 1)
        if bold and new[2] <= q + 1e-12:
            discard(new[0])
            parts *= 4
        else:
            discard(at)
            (at, wants, q, _), parts = new, max(2, parts // 2)
        turn += 1
    return at.select("vertex", "k", F.col("now").alias("p")), wants


def _refine(both: DataFrame, moved: DataFrame, m2: float, resolution: float, seed: int, randomness: float = RANDOMNESS) -> DataFrame:
    """vertex, r: connected parts of the communities of ``moved`` (vertex, k, p), each named by one of its vertices.

    A vertex or part is well connected if its edges to the rest of its community weigh at least what chance gives them. Only
    vertices that are alone join a part, in a round only those that a coin lets go, and only parts that stay. Of those that want to
    join one part so many do that each still gains whatever the others add to its weight.
    """
    total = moved.groupBy("p").agg(F.sum("k").alias("all"))
    own = moved.select("vertex", "k", "p")
    inner = both.join(own.select(F.col("vertex").alias("u"), F.col("p").alias("pu")), "u").join(own.select(F.col("vertex").alias("v"), F.col("p").alias("pv")), "v").filter("pu = pv")
    inner = materialise(inner.select("u", "v", "weight"), "inner")
    within = inner.groupBy(F.col("u").alias("vertex")).agg(F.sum("weight").alias("w"))
    fair = lambda k: resolution * F.col(k) * (F.col("all") - F.col(k)) / m2
    # a vertex that is a community of its own has no inner edges, and stays a part
    state = own.join(total, "p").join(within, "vertex", "left").select("vertex", "k", "all", (F.coalesce("w", F.lit(0.0)) >= fair("k") - 1e-12).alias("well"), F.col("vertex").alias("r"))
    state, turn, most = materialise(state, "parts"), 0, 0
    coin = lambda c, turn: F.pmod(F.xxhash64(c, F.lit(seed), F.lit(turn)), F.lit(2)) == 0
    while True:
        label = state.select("vertex", "r")
        across = inner.join(label.select(F.col("vertex").alias("u"), F.col("r").alias("ru")), "u").join(label.select(F.col("vertex").alias("v"), F.col("r").alias("d")), "v").filter("ru <> d")
        across = materialise(across.groupBy("u", "ru", "d").agg(F.sum("weight").alias("w")), "across")
        parts = state.groupBy("r").agg(F.sum("k").alias("held"), F.first("all").alias("all"), F.count("*").alias("n")).join(across.groupBy(F.col("ru").alias("r")).agg(F.sum("w").alias("out")), "r")
        parts = parts.withColumn("open", F.col("out") >= fair("held") - 1e-12)
        alone = state.filter("well").join(parts.filter("n = 1").select("r"), "r", "left_semi").select(F.col("vertex").alias("u"), "k")
        options = across.select("u", "d", "w").join(alone, "u").join(parts.filter("open").select(F.col("r").alias("d"), "held", "n"), "d")
        options = options.withColumn("gain", F.col("w") - resolution * F.col("k") * F.col("held") / m2).filter(F.col("gain") >= -1e-9 * F.col("k"))
        options = materialise(options, "options")
        discard(across)
        could = options.agg(F.countDistinct("u")).first()[0]
        most = max(most, could)
        if could <= SETTLED * most:
            discard(inner, options)
            return label
        free = options.filter(coin(F.col("u"), turn) & ((F.col("n") > 1) | ~coin(F.col("d"), turn)))
        draw = F.pmod(F.xxhash64("u", "d", F.lit(seed + 1), F.lit(turn)), F.lit(1 << 40)) + F.lit(0.5)
        luck = -F.log(-F.log(draw / float(1 << 40)))  # the greatest of such sums is drawn with odds exp(gain)
        best = free.withColumn("luck", F.col("gain") / (randomness * F.col("k")) + luck).groupBy("u").agg(F.max(F.struct("luck", "d", "w", "k", "held")).alias("x")).select("u", "x.d", "x.w", "x.k", "x.held")
        # of ever smaller halves of those that want the same part, the first in which some still gain with all of the half
        order = F.pmod(F.xxhash64("u", F.lit(seed + 2), F.lit(turn)), F.lit(1 << HALVINGS))
        best = materialise(best.withColumn("level", F.lit(HALVINGS) - F.when(order == 0, 0).otherwise(F.floor(F.log2(order.cast("double"))) + 1)), "best")
        halves = range(HALVINGS + 1)
        weight = best.groupBy("d").agg(F.array(*[F.sum(F.when(F.col("level") >= j, F.col("k")).otherwise(0.0)) for j in halves]).alias("joined"))
        fits = F.array(*[(F.col("level") >= j) & (F.col("w") - resolution * F.col("k") * (F.col("held") + F.get("joined", F.lit(j)) - F.col("k")) / m2 > 0) for j in halves])
        tried = best.join(weight, "d").select("u", "d", fits.alias("fits"), F.struct(F.col("level").alias("l"), "u").alias("last"))
        first = tried.groupBy("d").agg(F.min(F.when(F.array_position("fits", True) > 0, F.array_position("fits", True))).alias("j"), F.max("last").alias("last"))
        # where not even the last halves fit, one joins
        joins = tried.join(first.withColumnRenamed("last", "one"), "d").filter(F.when(F.col("j").isNull(), F.col("last") == F.col("one")).otherwise(F.get("fits", (F.col("j") - 1).cast("int")))).select(F.col("u").alias("vertex"), F.col("d").alias("to"))
        new = materialise(state.join(joins, "vertex", "left").withColumn("r", F.coalesce("to", "r")).drop("to"), "parts")
        discard(state, options, best)
        state, turn = new, turn + 1


def _sliced(rows: DataFrame, *order) -> DataFrame:
    """Rows in range-partitioned slices: those of lower slices come first. Communities (at, n, first) unless told otherwise."""
    order = order or (F.desc("n"), F.asc("first"), F.asc("at"))
    slices = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialise(rows.repartitionByRange(slices, *order).withColumn("slice", F.spark_partition_id()), "slices")


def _places(rows: DataFrame, *order) -> DataFrame:
    """Rows with their place in an order, from 0, though no task sorts them all."""
    sliced = _sliced(rows, *order)
    before = F.coalesce(F.sum("rows").over(W.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a slice
    offsets = sliced.groupBy("slice").agg(F.count("*").alias("rows")).select("slice", before.alias("before"))
    place = F.row_number().over(W.partitionBy("slice").orderBy(*order)) - 1
    return sliced.withColumn("place", place).join(F.broadcast(offsets), "slice").withColumn("place", F.col("before") + F.col("place")).drop("slice", "before")


def _numbered(sizes: DataFrame) -> DataFrame:
    """at, community: numbered by size, then by the first member's place."""
    return _places(sizes, F.desc("n"), F.asc("first"), F.asc("at")).select("at", F.col("place").cast("int").alias("community"))


def _in_arrays(edges: int, vertices: int, text: int) -> bool:
    return edges <= MOST_EDGES and vertices <= MOST_VERTICES and text <= MOST_TEXT


def _in_rounds(base: DataFrame, m2: float, resolution: float, seed: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None, int]:
    """vertex, at: the part of each vertex of edges between ids; where a level fits into arrays, its edges (u, v, weight), its start (vertex, p), and its number."""
    place = base.select(F.explode(F.array("u", "v")).alias("vertex")).distinct().withColumn("at", F.col("vertex"))
    graph, start, level, restless = base, None, 0, RESTLESS
    while True:
        both = materialise(graph.filter("u <> v").select("u", "v", "weight").union(graph.filter("u <> v").select("v", "u", "weight")), "both-ways")
        moved, left = _move(both, _degrees(graph), m2, resolution, seed + level, start, restless)
        moved = materialise(moved, "moved")
        apart = moved.groupBy("p").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
        if apart and not left:
            return place, None, None, level
        part = None if apart else materialise(_refine(both, moved, m2, resolution, seed + level), "refined")
        if apart or (left and part.filter("vertex <> r").isEmpty()):
            # nothing merges while some want to move: this level moves on until none does
            start, restless = moved.select("vertex", "p"), 0.0
            discard(both, *([part] if part else []))
            continue
        # what moving joined has inner edges that gain, so some vertices merge and the next level is smaller
        restless = RESTLESS
        new = materialise(place.join(part.withColumnRenamed("vertex", "at"), "at", "left").select("vertex", F.coalesce("r", "at").alias("at")), "places")
        small = graph.join(part.select(F.col("vertex").alias("u"), F.col("r").alias("ru")), "u").join(part.select(F.col("vertex").alias("v"), F.col("r").alias("rv")), "v")
        small = materialise(small.groupBy(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).agg(F.sum("weight").alias("weight")), "contracted")
        start = materialise(moved.join(part, "vertex").filter("vertex = r").select("vertex", "p"), "start")
        discard(both, moved, part, place, *([graph] if level else []))
        graph, place, level = small, new, level + 1
        if _in_arrays(graph.filter("u <> v").count(), *start.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("vertex")), F.lit(0))).first()):
            return place, graph, start, level


def communities(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0, seed: int = 1) -> DataFrame:
    """id, community: numbered by size, then by the first member's place. Nodes without an edge are communities of their own.

    Every community with more than one node is connected in the undirected projection.
    """
    ids = _places(nodes.filter("id is not null").groupBy("id").agg(F.min("ord").alias("ord")), F.asc("id"))
    ids = materialise(ids.withColumnRenamed("place", "at"), "ids")
    named = lambda name, at: hashed(ids.select(F.col("id").alias(name), F.col("at").alias(at)))
    ends = edges.filter("source <> target").select("source", "target", "weight").join(named("source", "a"), "source").join(named("target", "b"), "target")
    base = ends.groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight"))
    base = materialise(base, "projection")
    n_edges, weight = base.agg(F.count("*"), F.sum("weight")).first()
    m2, level, rounds = 2 * (weight or 0.5), 0, (RESTLESS, (RANDOMNESS, HALVINGS, SETTLED))
    degrees = materialise(_degrees(base).withColumnRenamed("vertex", "at"), "degrees")
    vertices = materialise(degrees.join(ids, "at").select("at", "id", "k", F.lit(None).cast("long").alias("code")), "vertices")
    graph, parts = base, []
    if not _in_arrays(n_edges, *vertices.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("id")), F.lit(0))).first()):
        back = lambda end: ids.select(F.col("at").alias(end), F.col("id").alias(f"{end}_id"))
        whole = materialise(base.join(back("u"), "u").join(back("v"), "v").select(F.col("u_id").alias("u"), F.col("v_id").alias("v"), "weight"), "named")
        place, graph, start, level = _in_rounds(whole, m2, resolution, seed)
        parts.append(place.join(named("vertex", "x"), "vertex").join(named("at", "part"), "at").select(F.col("x").alias("vertex"), "part"))
        if graph:
            name, turn = F.substring_index("p", "\0", 1), F.when(F.contains("p", F.lit("\0")), F.substring_index("p", "\0", -1))
            code = F.shiftleft("c", leiden.TURN_BITS) + leiden.code_of(F.col("turn"))
            found = start.select("vertex", name.alias("name"), turn.alias("turn")).join(_degrees(graph), "vertex").join(named("vertex", "at"), "vertex").join(named("name", "c"), "name")
            vertices = materialise(found.select("at", F.col("vertex").alias("id"), "k", code.alias("code")), "vertices")
            graph = graph.filter("u <> v").join(named("u", "a"), "u").join(named("v", "b"), "v").select(F.col("a").alias("u"), F.col("b").alias("v"), "weight")
            graph = materialise(graph, "contracted")
            n_edges = graph.count()
    if graph and n_edges > ONE_TASK:
        found, graph, vertices, level = leiden.in_shards(graph, n_edges, vertices, m2, resolution, seed, level, *rounds, ONE_TASK, SHARD)
        parts.append(found)
        vertices = vertices.join(ids, "at")
    if graph:
        parts.append(leiden.in_a_task(graph, vertices, m2, resolution, seed, level, *rounds))
    place = ids.select("id", "ord", "at")
    for part in parts:
        place = place.join(part, place["at"] == part["vertex"], "left").select("id", "ord", F.coalesce("part", "at").alias("at"))
    sizes = place.groupBy("at").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    return place.join(_numbered(sizes), "at").select("id", "community")


def cluster_graph(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0, seed: int = 1) -> DataFrame:
    """``nodes`` with the communities found, and the flags that follow from them."""
    found = materialise(communities(nodes, edges, resolution, seed), "communities")
    own = nodes.drop("community", "is_god", "is_orphan").join(found, "id", "left")
    return own.join(flags(own, edges), "id")


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """q, one row: modularity of labels (id, community) over the projection."""
    p = projection(edges)
    m = p.agg(F.sum("weight").alias("m"))
    both = p.select(F.col("u").alias("id"), "weight").union(p.select(F.col("v").alias("id"), "weight")).groupBy("id").agg(F.sum("weight").alias("k"))
    ks = both.join(labels, "id").groupBy("community").agg(F.sum("k").alias("held"))
    inside = p.join(labels.select(F.col("id").alias("u"), F.col("community").alias("a")), "u").join(labels.select(F.col("id").alias("v"), F.col("community").alias("b")), "v").filter("a = b").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("w"))
    squares = ks.agg(F.sum(F.col("held") * F.col("held")).alias("s"))
    return inside.join(F.broadcast(squares)).join(F.broadcast(m)).select((F.col("w") / F.col("m") - resolution * F.col("s") / (4 * F.col("m") * F.col("m"))).alias("q"))
