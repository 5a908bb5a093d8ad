"""Exact top-k search by inner product with cover trees on both sides.

1. The top of both trees are cells: each vector goes to the nearest of some pivots, spread over a bounded sample. A cell's data and
   its queries are cut into blocks of bounded size, and every block becomes one cover tree, built in a task.
2. Each block of queries is searched against the data of its own cell, which gives every query a kth score to start with.
3. Blocks are nodes too: with centres c, d and covering radii r, s of a block of queries and one of data no inner product exceeds
   <c, d> + r|d| + s|c| + rs, so the pair is dropped when that is below the worst kth score of the block's queries. Only the
   pairs that are left are searched: queries travel to the data, a twentieth of it, and data blocks stay.
4. Within a pair both trees are walked together with the same bound, each query bringing the kth score it has. Equal scores
   are never dropped, so that ties go to the smaller id exactly.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gneiss.session import broadcast_if_small, materialise

K, EVERY, SCALE = 20, 20, 64
#: Vectors of a block of data and of queries, and of a leaf; most pivots, and vectors of the sample for each; blocks of queries in one task.
DATA_BLOCK, QUERY_BLOCK, LEAF = 4096, 1024, 64
PIVOTS, SAMPLE, IN_TASK = 512, 8, 64
LOW = np.iinfo(np.int64).min
CELL = ["dim", "cell", "sub"]


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v, floor(scale * x) of each component; rows without an id, or with a null or non-finite part, are left out."""
    v = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    whole = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(False))
    return vectors.select("vec_id", "embedding").filter(whole).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


class Tree:
    """A cover tree over points: a node at level l has its points within 2**l of its centre; its children's centres are points more than
    2**(l-1) apart and cover as far. ``ids``: of each point, the ids of the rows that it stands for."""

    def __init__(self, points: np.ndarray, ids: list[np.ndarray], leaf: int = LEAF):
        self.points, self.ids = points, ids
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.members: list[np.ndarray] = []
        x = points.astype(np.float64)
        if len(x):
            far = float(np.sqrt(((x - x[0]) ** 2).sum(1)).max())
            self._grow(x, np.arange(len(x)), 0, int(np.ceil(np.log2(far))) if far > 0 else 0, leaf)
        self.norm = [float(np.sqrt((x[c] ** 2).sum())) for c in self.centre]

    def _grow(self, x: np.ndarray, own: np.ndarray, centre: int, level: int, leaf: int) -> int:
        me = len(self.centre)
        d = np.sqrt(((x[own] - x[centre]) ** 2).sum(1))
        self.centre.append(centre)
        self.radius.append(float(d.max()))
        self.children.append([])
        self.members.append(own)
        if len(own) <= leaf or d.max() == 0:
            return me
        rest, at, groups = own, centre, []
        while len(rest) and len(groups) <= len(own) // 4:
            near = np.sqrt(((x[rest] - x[at]) ** 2).sum(1)) <= 2.0 ** (level - 1)
            groups.append((at, rest[near]))
            rest = rest[~near]
            at = int(rest[0]) if len(rest) else at
        if not len(rest):  # else the points are as far apart as they are from the centre: lower levels tell nothing, the node is a leaf
            for c, part in groups:
                self.children[me].append(self._grow(x, part, c, level - 1, leaf))
        return me


def data_tree(rows: pd.DataFrame, k: int) -> Tree:
    """Equal vectors are one point; of its ids only the smallest can be among k answers, one's own aside."""
    points = np.array(rows["v"].tolist(), dtype=np.int64).reshape(len(rows), -1)
    ids = rows["vec_id"].to_numpy(np.int64)
    order = np.lexsort((ids, *points.T))
    points, ids = points[order], ids[order]
    new = np.flatnonzero(np.r_[True, (points[1:] != points[:-1]).any(1)])
    return Tree(points[new], [g[: k + np.unique(g, return_counts=True)[1].max()] for g in np.split(ids, new[1:])])


def query_tree(rows: pd.DataFrame) -> Tree:
    rows = rows.sort_values("vec_id")
    return Tree(np.array(rows["v"].tolist(), dtype=np.int64).reshape(len(rows), -1), [np.array([i]) for i in rows["vec_id"]])


def _products(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Exact inner products: in floating point while all sums are whole numbers that it holds, else in integers of any size, held to 64 bits."""
    most = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(d.astype(np.float64)).max(initial=0)) * max(1, q.shape[1])
    for kind, room in ((np.float32, 2.0**24), (np.float64, 2.0**53)):
        if most < room:
            return (q.astype(kind) @ d.astype(kind).T).astype(np.int64)
    return np.clip(q.astype(object) @ d.astype(object).T, LOW + 1, -(LOW + 1)).astype(np.int64)


def search(queries: Tree, data: Tree, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Query ids, ids and scores of the k best of ``data`` for each query, as far as they reach its ``floor``; and the products it took."""
    n, big, products = len(queries.points), np.iinfo(np.int64).max, 0
    asks = np.concatenate(queries.ids) if n else np.zeros(0, np.int64)
    score, who = np.full((n, k), LOW, np.int64), np.full((n, k), big, np.int64)
    floor = np.full(n, LOW, np.int64) if floor is None else floor

    def bound(a: int, b: int) -> float:
        c = float(queries.points[queries.centre[a]].astype(np.float64) @ data.points[data.centre[b]].astype(np.float64))
        r, s = queries.radius[a], data.radius[b]
        return (c + r * data.norm[b] + s * queries.norm[a] + r * s) * (1 + 1e-12) + 1e-6 * (1 + abs(c))

    def meet(a: int, b: int) -> int:
        own, cand = queries.members[a], data.members[b]
        s = _products(queries.points[own], data.points[cand])
        take = [data.ids[c] for c in cand]
        if sum(map(len, take)) > len(take):
            s = s[:, np.repeat(np.arange(len(cand)), [len(t) for t in take])]
        ids = np.concatenate(take)
        r, c = np.nonzero(s >= np.maximum(score[own, k - 1], floor[own])[:, None])
        other = ids[c] != asks[own[r]]
        r, c = r[other], c[other]
        if len(r):
            rows = np.unique(r)
            at = np.r_[np.repeat(rows, k), r]
            new_s, new_i = np.r_[score[own[rows]].ravel(), s[r, c]], np.r_[who[own[rows]].ravel(), ids[c]]
            order = np.lexsort((new_i, -np.maximum(new_s, LOW + 1), at))
            at, new_s, new_i = at[order], new_s[order], new_i[order]
            rank = np.arange(len(at)) - np.searchsorted(at, at)
            keep = rank < k
            score[own[at[keep]], rank[keep]], who[own[at[keep]], rank[keep]] = new_s[keep], new_i[keep]
        return len(own) * len(cand)

    stack = [(0, 0)] if n and len(data.points) else []
    while stack:
        a, b = stack.pop()
        own = queries.members[a]
        if bound(a, b) < float(np.maximum(score[own, k - 1], floor[own]).min()):
            continue
        left, right = queries.children[a], data.children[b]
        if not left and not right:
            products += meet(a, b)
        else:  # the wider side opens; the pair with the best bound goes first
            pairs = [(x, b) for x in left] if left and (not right or queries.radius[a] > data.radius[b]) else [(a, y) for y in right]
            stack += sorted(pairs, key=lambda p: bound(*p))
    q, j = np.nonzero(who < big)
    return asks[q], who[q, j], score[q, j], products


def _spread(sample: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` points of a sample, each the farthest from those before it."""
    x, chosen = sample.astype(np.float64), [0]
    d = ((x - x[0]) ** 2).sum(1)
    while len(chosen) < most and d.max() > 0:
        chosen.append(int(d.argmax()))
        d = np.minimum(d, ((x - x[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def cells(points: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """vec_id, v, dim and cell: the pivot of the same length that is nearest."""

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            dim, cell = b["v"].map(len).to_numpy(), np.zeros(len(b), np.int32)
            for n, p in pivots.items():
                at = np.flatnonzero(dim == n)
                if len(at) and n:
                    x, y = np.array(b["v"].iloc[at].tolist(), np.float64), p.astype(np.float64)
                    cell[at] = ((y**2).sum(1)[None, :] - 2 * x @ y.T).argmin(1)
            yield b.assign(dim=dim.astype(np.int32), cell=cell)

    return points.mapInPandas(nearest, "vec_id long, v array<long>, dim int, cell int")


def cut(placed: DataFrame, size: int) -> DataFrame:
    """``placed`` with sub: cells of more than about ``size`` vectors are cut by a hash."""
    counts = materialise(placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / size).alias("subs")), "cell-sizes")
    return placed.join(broadcast_if_small(counts), ["dim", "cell"]).withColumn("sub", F.pmod(F.xxhash64("vec_id", "v"), "subs").cast("int")).drop("subs")


def blocks(cut: DataFrame, grow: Callable[[pd.DataFrame], Tree]) -> DataFrame:
    """dim, cell, sub, centre, norm, radius, n and tree of each block."""

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        t = grow(rows)
        return pd.DataFrame({"dim": [key[0]], "cell": [key[1]], "sub": [key[2]], "centre": [t.points[0].astype(np.float64).tolist()], "norm": [t.norm[0]], "radius": [t.radius[0]], "n": [len(t.points)], "tree": [pickle.dumps(t)]})

    return materialise(cut.groupBy(*CELL).applyInPandas(one, "dim int, cell int, sub int, centre array<double>, norm double, radius double, n long, tree binary"), "blocks")


def most_product() -> Column:
    """No inner product of two blocks (the queries' columns begin with q_) exceeds this; a little more, for rounding."""
    c = F.aggregate(F.zip_with("q_centre", "centre", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    top = c + F.col("q_radius") * F.col("norm") + F.col("radius") * F.col("q_norm") + F.col("radius") * F.col("q_radius")
    return top * F.lit(1 + 1e-12) + F.lit(1e-6) * (1 + F.abs(c))


def search_pairs(pairs: DataFrame, data: DataFrame, queries: DataFrame, floors: DataFrame | None, k: int, salts: int) -> DataFrame:
    """query_id, vec_id and score of what the pairs of blocks (dim, cell, sub, q_cell, q_sub) hold. Rows of a task come sorted: a data
    block, then the blocks of queries that meet it, one at a time. ``salts`` tasks share a data block's queries."""
    own = queries.select("dim", F.col("cell").alias("q_cell"), F.col("sub").alias("q_sub"), F.col("tree").alias("tree"))
    if floors is not None:
        own = own.join(floors, ["dim", "q_cell", "q_sub"], "left")
    else:
        own = own.withColumn("floors", F.lit(None).cast("array<struct<id:long,kth:long>>"))
    asked = pairs.join(own, ["dim", "q_cell", "q_sub"]).select(*CELL, F.pmod(F.xxhash64("q_cell", "q_sub"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("kind"), "tree", "floors")
    held = pairs.select(*CELL, F.pmod(F.xxhash64("q_cell", "q_sub"), F.lit(salts)).cast("int").alias("salt")).distinct().join(data.select(*CELL, "tree"), CELL)
    held = held.select(*CELL, "salt", F.lit(0).alias("kind"), "tree", F.lit(None).cast("array<struct<id:long,kth:long>>").alias("floors"))
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = held.unionByName(asked).repartition(parts, *CELL, "salt").sortWithinPartitions(*CELL, "salt", "kind")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = None
        for b in batches:
            for kind, packed, floors in zip(b["kind"], b["tree"], b["floors"]):
                if kind == 0:
                    tree = pickle.loads(packed)
                    continue
                asks = pickle.loads(packed)
                known = {} if floors is None else {f["id"]: f["kth"] for f in floors}
                floor = np.array([known.get(int(i[0]), LOW) for i in asks.ids], np.int64)
                q, i, s, _ = search(asks, tree, k, floor)
                yield pd.DataFrame({"query_id": q, "vec_id": i, "score": s})

    return rows.select("kind", "tree", "floors").mapInPandas(walk, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, data_block: int = DATA_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every`` the k best others, ties to smaller ids.

    Every row is a candidate, repeated ones too; rows with the query's own id are not. Of query rows with one id the least vector is
    asked. Vectors of different lengths have no product. An empty table gives an empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    points = materialise(quantised(vectors, scale), "vectors")
    n = points.count()
    most = min(PIVOTS, max(1, 2 * n // data_block))
    drawn = points.select("v").orderBy(F.xxhash64("vec_id", "v")).limit(SAMPLE * most).collect()  # bounded by parameters
    by_dim: dict[int, list] = {}
    for r in drawn:
        by_dim.setdefault(len(r["v"]), []).append(r["v"])
    pivots = {d: _spread(np.array(v, np.int64).reshape(len(v), d), max(1, most * len(v) // len(drawn))) for d, v in by_dim.items()}
    placed = materialise(cells(points, pivots), "cells")
    asked = placed.filter(F.col("vec_id") % every == 0)
    least = asked.groupBy("vec_id").agg(F.min(F.struct("v", "dim", "cell")).alias("x")).select("vec_id", "x.*")
    least = cut(least, query_block)
    data, queries = blocks(cut(placed, data_block), lambda rows: data_tree(rows, k)), blocks(least, query_tree)
    salts = max(1, -(-queries.count() // IN_TASK))

    side = queries.select("dim", *[F.col(c).alias(f"q_{c}") for c in ("cell", "sub", "centre", "norm", "radius")])
    near = side.join(data.drop("tree"), (side["dim"] == data["dim"]) & (side["q_cell"] == data["cell"])).select(data["dim"], "cell", "sub", "q_cell", "q_sub")
    first = materialise(search_pairs(near, data, queries, None, k, salts), "own-cells")
    by_score = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = first.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("kth"))
    member = least.select("vec_id", "dim", F.col("cell").alias("q_cell"), F.col("sub").alias("q_sub"))
    floors = member.join(kth, "vec_id", "left").groupBy("dim", "q_cell", "q_sub").agg(F.collect_list(F.when(F.col("kth").isNotNull(), F.struct(F.col("vec_id").alias("id"), "kth"))).alias("floors"), F.when(F.count("kth") == F.count("*"), F.min("kth")).alias("worst"))
    floors = materialise(floors, "kth-scores")
    far = side.join(floors.drop("floors"), ["dim", "q_cell", "q_sub"]).join(data.drop("tree"), "dim").filter((F.col("cell") != F.col("q_cell")) & (F.col("worst").isNull() | (most_product() >= F.col("worst"))))
    rest = search_pairs(materialise(far.select(*CELL, "q_cell", "q_sub"), "pairs"), data, queries, floors.drop("worst"), k, salts)
    found = first.unionByName(rest).withColumn("rank", F.row_number().over(by_score))
    return found.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, d.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM p)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20
"""
