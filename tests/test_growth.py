"""Steps whose tasks must not grow with the input: what is shuffled, and into how many parts."""

from pyspark.sql import functions as F

from gneiss.functions import text as X
from gneiss.operators import build, cluster, flags, index, resolve, search, traverse
from gneiss.plans import queries as Q
from gneiss.plans import views
from gneiss.session import deal_finely, hashed, materialise

INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_shuffles_begin_with_more_parts_for_larger_tables(spark):
    li = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    spark.conf.unset(INITIAL)
    try:
        deal_finely(li)
        assert spark.conf.get(INITIAL, None) is None  # a megabyte needs no more than there are
        deal_finely(li, 50_000)
        parts = int(spark.conf.get(INITIAL))
        assert parts > 20
        views.edges(spark, "/root/testdata/sf0.01")
        deal_finely(li, 10**9)
        assert int(spark.conf.get(INITIAL)) == parts  # never fewer
    finally:
        spark.conf.unset(INITIAL)


def test_flags_hold_no_pairs_of_ids(spark):
    """Ends meet communities, not each other: a hub with edges to a thousand members of one community is one row."""
    nodes = spark.range(1001).select(F.concat(F.lit("n"), "id").alias("id"), F.when(F.col("id") > 0, (F.col("id") % 3).cast("int")).alias("community"))
    edges = spark.range(1, 1001).select(F.lit("n0").alias("source"), F.concat(F.lit("n"), "id").alias("target"))
    edges = edges.union(edges.select("target", "source")).union(edges)
    found = flags.flags(nodes, edges)
    assert "Aggregate [id#" in plan(found) and not any("other" in line for line in plan(found).splitlines() if "Aggregate" in line)
    got = {r["id"]: (r["is_god"], r["is_orphan"]) for r in found.collect()}
    assert got.pop("n0") == (True, False) and set(got.values()) == {(False, False)} and len(got) == 1000


def test_flags_hold_a_row_for_each_id(spark):
    """Whether communities differ is told by the least and the greatest, so an id with many of them is one row; other bounds still count them."""
    nodes = spark.range(203).select(F.concat(F.lit("n"), "id").alias("id"), F.when(F.col("id") > 1, (F.col("id") % 50).cast("int")).otherwise(F.lit(2)).alias("community"))
    nodes = nodes.withColumn("community", F.when(F.col("id") != "n202", F.col("community")))
    edges = spark.range(2, 202).select(F.lit("n0").alias("source"), F.concat(F.lit("n"), "id").alias("target"))
    edges = edges.union(spark.createDataFrame([("n1", "n2"), ("n3", "n1"), ("n202", "n202")], edges.schema))
    found = flags.flags(nodes, edges)
    assert not any("Aggregate [id#" in line and ", c#" in line.split("]")[0] for line in plan(found).splitlines())
    for least, gods in ((1, {"n0", "n1", *(f"n{i}" for i in range(2, 202) if i % 50 != 2)}), (2, {"n0"}), (49, {"n0"}), (50, set())):
        got = {r["id"]: r for r in flags.flags(nodes, edges, least).collect()}
        assert {i for i, r in got.items() if r["is_god"]} == gods and len(got) == 203 and not any(r["is_orphan"] for r in got.values())


def test_ids_of_many_nodes_are_not_broadcast(spark):
    """A written table below the planner's bound for a broadcast can be many times that in memory."""
    ids = materialise(spark.range(400_000).select(F.sha2(F.col("id").cast("string"), 256).substr(1, 8).alias("id")))
    size = int(ids._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    assert 1 << 20 < size < spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    rows = spark.createDataFrame([("5feceb66",), ("x",)], "id string")
    joined = rows.join(hashed(ids), "id", "left")
    assert "ShuffledHashJoin" in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 2


def test_adjacency_repeats_no_ends(spark):
    """An edge's ends are carried once each way, and parallel edges of one place are still told apart."""
    rows = [(1, "a", "b", "T", 2.0), (1, "a", "b", "T", 1.0), (1, "c", "a", "T", 1.0), (1, "a", "a", "S", 1.0)]
    near = search.adjacency(spark.createDataFrame(rows, "ord long, source string, target string, type string, weight double"))
    assert [c for c, t in near.dtypes if t == "string"] == ["node", "other", "direction", "type"] and all("struct" not in t for _, t in near.dtypes)
    got = [(r["other"], r["direction"], r["weight"]) for r in near.filter("node = 'a'").orderBy(*search.ADJACENT).collect()]
    assert got == [("a", "out", 1.0), ("b", "out", 1.0), ("b", "out", 2.0), ("a", "in", 1.0), ("c", "in", 1.0)]


def test_levels_of_communities_end_early_and_keep_lone_vertices(spark):
    """A level may leave some moves to the next one; a vertex alone in its community stays a part, and so keeps its edges."""
    pairs = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")]
    both = spark.createDataFrame([(u, v, 1.0) for p in pairs for u, v in (p, p[::-1])], "u string, v string, weight double")
    degrees = both.groupBy(F.col("u").alias("vertex")).agg(F.sum("weight").alias("k"))
    early, left = cluster._move(both, degrees, 8.0, 1.0, 1, None, restless=1.0)
    assert left == 4 and all(r["vertex"] == r["p"] for r in early.collect())
    assert cluster._move(both, degrees, 8.0, 1.0, 1, None)[1] == 0
    moved = degrees.withColumn("p", F.when(F.col("vertex") == "d", "d").otherwise("a"))
    parts = {r["vertex"]: r["r"] for r in cluster._refine(both, moved, 8.0, 1.0, 1).collect()}
    assert parts.keys() == set("abcd") and parts["d"] == "d"


def test_edges_are_joined_once(spark):
    """Flags and neighbours read written edges, so the star schema's joins are not made anew for each use."""
    for query in (Q.god_and_orphan_flags, Q.neighbours):
        scans = plan(query(spark, "/root/testdata/sf0.001"))
        assert "l_orderkey" not in scans and "l_suppkey" not in scans


def test_index_deals_documents_and_not_postings(spark, tmp_path):
    """A document is one row with its counted terms; a posting is a place and a frequency."""
    own = index.Index(spark, f"{tmp_path}/g", width=4, buckets=2)
    rows = [(i, f"n{i}", "a b a camelCase" if i % 2 else None) for i in range(9)]
    own.update(search.documents(spark.createDataFrame(rows, "ord long, id string, name string")))
    forward = own.log.read("forward", index.FORWARD)
    assert forward.count() == 9
    got = forward.filter("ord = 1").first()
    assert dict(zip(got["terms"].split(" "), got["tfs"])) == {"a": 6.0, "b": 3.0, "camelcase": 3.0, "camel": 3.0, "case": 3.0, "n1": 2.0}
    block = own.blocks(["a"]).filter("slice = 0").first()
    assert (block["ords"], block["tfs"], block["n"], block["most_tf"]) == ([1, 3], [6.0, 6.0], 2, 6.0)


def test_references_alike_are_answered_once(spark):
    rows = [(i, f"a/f.py::s{i % 2}", "x.go(y)" if i % 3 else "z.no()", "call", "a/f.py") for i in range(30)]
    refs = spark.createDataFrame(rows, "ord long, source string, raw string, kind string, file string")
    nodes = spark.createDataFrame([(0, "b.py::go", "go")], "ord long, id string, name string")
    one = resolve.alike(refs)
    assert sorted((r["source"], r["ord"], r["times"]) for r in one.collect()) == [("a/f.py", 0, 10), ("a/f.py", 1, 20)]
    asked = [sorted(map(tuple, resolve.outcomes(resolve.resolve(r, nodes)).collect())) for r in (refs, one)]
    assert asked[0] == asked[1] and {r[2]: r[4] for r in asked[0]} == {"resolve": 20, "drop": 10}


def test_texts_without_humps_give_the_same_tokens(spark):
    texts = ["plain Words, ALL 3a x1", "camelCase HTTPServer", "9A b", "Kelvin İx", None, ""]
    got = [r["t"] for r in spark.createDataFrame([(t,) for t in texts], "x string").select(X.identifier_tokens(F.col("x")).alias("t")).collect()]
    assert got == [["plain", "words", "all", "a", "x1"], ["camelcase", "camel", "case", "httpserver", "http", "server"], ["a", "b"], ["elvin", "x"], [], []]


def test_externals_read_the_written_edges(spark, monkeypatch):
    """The star schema's joins are made for the edges alone, not again for the nodes that edges add."""
    seen = {}
    real = Q.materialise
    monkeypatch.setattr(Q, "materialise", lambda df, name="table": seen.update({name: plan(df)}) or real(df, name))
    Q.flagged(spark, "/root/testdata/sf0.001")
    assert "l_suppkey" in seen["edges"] and "l_suppkey" not in seen["nodes"] and "l_orderkey" not in seen["nodes"]


def test_views_join_written_edges(spark, monkeypatch):
    """A view's edges are joined with the ids once, and matches are looked for in what was written."""
    seen = []
    real = traverse.materialise
    monkeypatch.setattr(traverse, "materialise", lambda df, name="table": seen.append(name) or real(df, name))
    nodes = spark.createDataFrame([("a", "can", "f", True), ("b", "x", "f", True), ("c", "x", "f", True), ("d", "x", "f", False)], "id string, name string, file string, is_god boolean")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "a"), ("d", "a")], "source string, target string")
    n, e = traverse.view(nodes, edges, gods_only=True, query="an")
    assert sorted(r["id"] for r in n.collect()) == ["a", "b"] and sorted(map(tuple, e.collect())) == [("a", "b"), ("b", "a")]
    assert seen == ["within", "seen"]


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_parts_stay_small_when_ids_are_alike(spark):
    """Rows with alike ids take ten times and more in memory of what is shuffled or written of them, so a part's bytes are bounded, and never raised."""
    li = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    names = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes")
    try:
        for name in names:
            spark.conf.set(name, "64m")
        views.edges(spark, "/root/testdata/sf0.01")
        assert [int(spark.conf.get(n)) for n in names] == [8 << 20] * 2
        for name in names:
            spark.conf.set(name, "1m")
        deal_finely(li)
        assert [spark.conf.get(n) for n in names] == ["1m"] * 2
    finally:
        for name in (*names, INITIAL):
            spark.conf.unset(name)


def test_nodes_are_collapsed_after_the_shuffle(spark):
    """A task sorts a part of the ids, not all the rows that it has scanned; the last row's attributes still stand at the first row's place."""
    rows = [(3, "a", "x", 1), (1, "a", "z", None), (2, "b", "y", 2), (4, "a", None, 5)]
    nodes = spark.createDataFrame(rows, "ord long, id string, name string, community int")
    one = build.collapse_nodes(nodes)
    assert "REPARTITION_BY_COL" in executed(one) and executed(one).count("Exchange") == 1
    assert sorted(map(tuple, one.collect())) == [(1, "a", None, 5), (2, "b", "y", 2)]
    edges = spark.createDataFrame([("a", "c")], "source string, target string")
    assert [tuple(r) for r in build.external_nodes(nodes, edges).collect()] == [("c", "external", "c", "")]


def test_flags_join_whole_nodes_once(spark):
    """What edges tell of an id joins the node's row; the nodes are neither joined with their own ids nor broadcast."""
    nodes = spark.createDataFrame([(0, "a", 1), (1, "b", 2), (2, "c", 3), (3, "d", None)], "ord long, id string, community int")
    edges = spark.createDataFrame([("a", "b"), ("c", "a")], "source string, target string")
    found = flags.flagged(nodes, edges)
    assert sum("Join" in line for line in plan(found).splitlines()) == 3
    assert found.columns == ["id", "ord", "community", "is_god", "is_orphan"]
    assert sorted(map(tuple, found.collect())) == [("a", 0, 1, True, False), ("b", 1, 2, False, False), ("c", 2, 3, False, False), ("d", 3, None, False, True)]


def test_communities_of_many_ids_are_not_broadcast(spark):
    row = [F.sha2(F.col("id").cast("string"), 256).substr(1, 8).alias("id"), (F.col("id") % 5).cast("int").alias("community"), F.col("id").alias("ord"), F.lit("n").alias("name"), (F.col("id") < 3).alias("is_god"), F.lit(False).alias("is_orphan")]
    nodes = materialise(spark.range(400_000).select(*row))
    summary, members = traverse.community(nodes, nodes.select("id"))
    assert "ShuffledHashJoin" in executed(summary) and "ShuffledHashJoin" in executed(members)
    assert {r["community"]: (r["members"], r["gods"]) for r in summary.collect()} == {c: (80_000, int(c < 3)) for c in range(5)}
