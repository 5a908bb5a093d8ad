"""Communities by arrays: the same as by jobs for each round, whether one task holds a level or shards do."""

import random

import numpy as np
import pyarrow as pa
from gneiss.operators import cluster, leiden
from pyspark.sql import functions as F

ORDER = "ord long, id string"
EDGES = "ord long, source string, target string, type string, weight double"


def graph(spark, n=150, seed=5):
    """Groups of 15 with chance edges, loops, parallel and reverse edges, ends that no node has, a node without edges, one that repeats, and one without an id."""
    rng = random.Random(seed)
    ids = ["é" * (i % 3) + f"n{i * 7919 % 1000}" + "#x/y" * (i % 12) for i in range(n)]
    pairs = [(a, b) for a in range(n - 1) for b in range(n - 1) if rng.random() < (0.3 if a // 15 == b // 15 else 0.01)]
    rows = [(i, ids[a], ids[b], "CALLS", rng.choice([0.5, 1.0, 2.0, 7.5])) for i, (a, b) in enumerate(pairs)]
    rows += [(-1, ids[0], "nobody", "CALLS", 3.0), (-2, None, ids[1], "CALLS", 1.0)]
    return spark.createDataFrame([*enumerate(ids), (n, None), (n + 1, ids[3])], ORDER), spark.createDataFrame(rows, EDGES)


def found(spark, monkeypatch, nodes, edges, resolution=1.0, **bounds):
    with monkeypatch.context() as m:
        for name, value in bounds.items():
            m.setattr(cluster, name, value)
        return {r["id"]: r["community"] for r in cluster.communities(nodes, edges, resolution).collect()}


def test_arrays_and_rounds_find_the_same(spark, monkeypatch):
    nodes, edges = graph(spark)
    by_task = found(spark, monkeypatch, nodes, edges)
    assert len(by_task) == 150 and 1 < len(set(by_task.values())) < 60
    assert found(spark, monkeypatch, nodes, edges, MOST_VERTICES=0) == by_task
    # shards, then a task; rounds, then shards to the end
    assert found(spark, monkeypatch, nodes, edges, ONE_TASK=400, SHARD=300) == by_task
    assert found(spark, monkeypatch, nodes, edges, MOST_VERTICES=149, MOST_EDGES=600, ONE_TASK=-1, SHARD=300) == by_task


def test_vertices_that_leave_for_communities_of_their_own(spark, monkeypatch):
    """A greater resolution makes vertices leave, so that names with a turn are compared, and kept by levels."""
    nodes, edges = graph(spark, 60)
    by_task = found(spark, monkeypatch, nodes, edges, 2.5)
    assert found(spark, monkeypatch, nodes, edges, 2.5, MOST_VERTICES=0) == by_task
    assert found(spark, monkeypatch, nodes, edges, 2.5, ONE_TASK=-1, SHARD=300) == by_task


def test_small_graphs_need_no_jobs_for_rounds(spark, monkeypatch):
    """Jobs don't grow with rounds where a task holds the edges; each round took some before."""
    nodes, edges = graph(spark)
    monkeypatch.setattr(cluster, "_weigh", None)
    monkeypatch.setattr(cluster, "_refine", None)
    spark.sparkContext.setJobGroup("communities", "communities")
    cluster.communities(nodes, edges).collect()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("communities")) < 80
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_no_edges(spark, monkeypatch):
    nodes, edges = graph(spark, 4)
    for bounds in ({}, {"ONE_TASK": -1}, {"MOST_EDGES": -1}):
        assert sorted(found(spark, monkeypatch, nodes, edges.filter("false"), **bounds).values()) == [0, 1, 2, 3]


def test_hashes_rounding_and_codes_are_those_of_spark(spark):
    rng = random.Random(3)
    ids = ["".join(rng.choice("aé:#/0€") for _ in range(n % 90)) for n in range(300)]
    t = spark.createDataFrame([(i, x, ids[-1 - i]) for i, x in enumerate(ids)], "i int, a string, b string")
    got = t.select("i", F.xxhash64("a").alias("h"), F.xxhash64("a", F.lit(7), F.lit(-3)).alias("n"), F.xxhash64("a", "b", F.lit(1 << 33)).alias("p")).orderBy("i").toPandas()
    lengths, text = leiden.Ids.parts(pa.array(ids))
    x, every = leiden.Ids(lengths, [text], len(text)), np.arange(len(ids))
    h = x.hash(every, np.full(len(ids), 42, np.uint64))
    assert (h.view(np.int64) == got.h).all()
    assert (leiden.hash_number(-3, leiden.hash_number(7, h)).view(np.int64) == got.n).all()
    assert (leiden.hash_number(1 << 33, x.hash(every[::-1], h)).view(np.int64) == got.p).all()
    v = np.array([rng.uniform(-1, 1) * 10 ** rng.randint(-10, 9) for _ in range(2000)] + [i / 2048 for i in range(-500, 500)] + [i * 5e-10 for i in range(-200, 200)])
    r = spark.createDataFrame(pa.table({"i": np.arange(len(v)), "v": v})).select("i", F.round("v", 9).alias("r")).orderBy("i").toPandas().r
    assert (leiden.rounded(v) == r).all()
    turns = [0, 1, 2, 9, 10, 11, 99, 100, 12345]
    codes = [r.c for r in spark.createDataFrame([(str(i),) for i in turns] + [(None,)], "t string").select(leiden.code_of(F.col("t")).alias("c")).collect()]
    assert codes == [leiden.code(i) for i in turns] + [0] and sorted(turns, key=str) == sorted(turns, key=leiden.code)
