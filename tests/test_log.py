"""The commit log: crashes between writes, writers at the same time, commits out of order."""

import pytest
from pyspark.sql import functions as F

from gneiss import schemas
from gneiss.sources.log import Change, Conflict, Log
from gneiss.sources.store import GRAPHS, TREES, Payload, Store
from gneiss.streaming import patches

NODE = "ord long, id string, type string, name string, file string"
EDGE = "ord long, source string, target string, type string, weight double"


def tree(spark, names):
    nodes = spark.createDataFrame([(i, f"{f}::{n}", "function", n, f) for i, (f, n) in enumerate(names)], NODE)
    ids = [f"{f}::{n}" for f, n in names]
    edges = spark.createDataFrame([(i, a, b, "CALLS", 1.0) for i, (a, b) in enumerate(zip(ids, ids[1:]))], EDGE)
    return nodes, edges


def ids(df):
    return sorted(r["id"] for r in df.collect())


class Crash(Exception):
    pass


def crashing(log, at):
    """A log that stops before its write number ``at``, folders and entries counted."""
    left, write, create = [at], log.write, log._create

    def count(do):
        def run(*args, **more):
            if not left[0]:
                raise Crash
            left[0] -= 1
            return do(*args, **more)

        return run

    log.write, log._create = count(write), count(create)
    return log


def graphs(spark, gid, sha="s0"):
    return spark.createDataFrame([(gid, "u", f"https://x/{gid}/r", "main", "READY", 1, 1, 1, sha, None)], GRAPHS)


def test_a_crash_between_any_two_writes_leaves_nothing(spark, tmp_path):
    nodes, edges = tree(spark, [("a.py", "f"), ("a.py", "g"), ("b.py", "h")])
    done = False
    for at in range(8):
        root = f"{tmp_path}/s{at}"
        store = Store(spark, root)
        store.record_version("g", nodes, edges, "s1")
        before = store.log.state()
        broken = Store(spark, root)
        crashing(broken.log, at)
        try:
            assert broken.record_version("g", nodes.limit(1), edges.limit(0), "s2") == 2
            done = True
            break
        except Crash:
            assert store.log.state() == before and store.next_version("g") == 2
            assert ids(store.snapshot("nodes", "g", 1)) == ids(nodes)
        assert store.record_version("g", nodes.limit(1), edges.limit(0), "s2") == 2
        assert store.snapshot("nodes", "g", 2).count() == 1 and store.snapshot("edges", "g", 2).count() == 0
        assert store.history("g").count() == 2
        # folders of the crash are seen by no reader, and vacuumed
        assert store.log.vacuum(older=0) == min(at, 3) and store.snapshot("nodes", "g", 2).count() == 1
    assert done and at == 4  # three folders and an entry


def test_replay_after_a_crash_at_each_write(spark, tmp_path):
    """A commit's snapshot, history, run, row and number are there together or not at all, and once only."""
    new = tree(spark, [("b.py", "k"), ("c.py", "m")])
    extract = lambda paths: tuple(x.join(F.broadcast(paths), x["file" if "file" in x.columns else "source"].startswith(F.col("path")), "left_semi") for x in new)
    change = spark.createDataFrame([("M", "b.py", None), ("A", "c.py", None)], schemas.CHANGES)
    final = None
    for at in range(9):
        root = f"{tmp_path}/r{at}"
        store = Store(spark, root)
        store.save_graphs(graphs(spark, "g"))
        store.record_version("g", *tree(spark, [("a.py", "f"), ("b.py", "h")]), "s0")
        broken = Store(spark, root)
        crashing(broken.log, at)
        try:
            patches.apply_changes(broken, "g", 1, "s1", change, extract)
            break
        except Crash:
            assert store.next_version("g") == 2 and store.runs().count() == 0 and store.graphs().first()["last_commit_sha"] == "s0"
        assert patches.apply_changes(store, "g", 1, "s1", change, extract) == "applied"
        assert patches.apply_changes(store, "g", 1, "s1", change, extract) == "known"
        got = (ids(store.snapshot("nodes", "g", 2)), store.snapshot("edges", "g", 2).count(), store.runs().count(), store.graphs().first()["last_commit_sha"], store.next_version("g"))
        assert final in (None, got)
        final = got
    assert at == 6 and final == (["a.py::f", "b.py::k", "c.py::m"], 1, 1, "s1", 3)


def test_two_writers(spark, tmp_path):
    """Of two that rest on the same rows the later plans again; one that rests on others takes the next number."""
    a, b = Store(spark, f"{tmp_path}/w"), Store(spark, f"{tmp_path}/w")
    nodes, edges = tree(spark, [("a.py", "f")])
    plans = []

    def slow(state):
        plans.append(state.version)
        if len(plans) == 1:
            b.record_version("g", nodes, edges, "first")
        change = Change()
        a._version(change, state, "g", nodes, edges, "second")
        return change

    a.log.commit("version", slow)
    assert plans == [0, 1] and a.versions("g") == [1, 2]
    assert sorted((r["version"], r["sha"]) for r in a.history("g").collect()) == [(1, "first"), (2, "second")]

    def apart(state):
        plans.append(state.version)
        b.record_run("g", "FULL", "SUCCESS")
        change = Change()
        a._version(change, state, "other", nodes, edges, "x")
        return change

    a.log.commit("version", apart)
    assert plans == [0, 1, 2] and a.versions("other") == [1] and a.runs().count() == 1

    def never(state):
        b.record_version("g", nodes, edges, "faster")
        change = Change()
        a._version(change, state, "g", nodes, edges, "late")
        return change

    with pytest.raises(Conflict):
        a.log.commit("version", never, tries=2)
    assert a.versions("g") == [1, 2, 3, 4] and a.history("g").filter("sha = 'late'").count() == 0


def test_readers_keep_their_version(spark, tmp_path):
    log = Log(spark, f"{tmp_path}/l")
    for i in range(45):
        log.commit("add", lambda s, i=i: Change(add=[("t", {"i": i % 3}, spark.range(i, i + 1), ())] if i % 10 == 0 else [], facts={"last": i}))
    old, now = log.state(21), log.state()
    assert (old.version, old.facts, now.facts) == (21, {"last": 20}, {"last": 44})
    assert log._numbers()[1] == [20, 40] and len(log.state(45).tables["t"]) == 5
    log.compact("t", "id long")
    assert len(log.state().tables["t"]) == 1 and sorted(r["id"] for r in log.read("t", "id long").collect()) == [0, 10, 20, 30, 40]
    assert sorted(r["id"] for r in log.read("t", "id long", old).collect()) == [0, 10, 20]
    assert sorted(r["id"] for r in log.read("t", "id long", now, i=1).collect()) == [10, 40]
    (tmp_path / "l/_log/.mine").write_text("{}")
    at, to, new = (log._path(f"{log.where}/{n}")[0] for n in (".mine", f"{5:020d}.entry", f"{47:020d}.entry"))
    assert not log._renamed(at, to) and log._load(f"{5:020d}.entry")["name"] == "add"  # what other file systems do: an existing entry stays
    assert log._renamed(at, new) and log._numbers()[0][-1] == 47


def test_commits_in_any_order(spark, tmp_path):
    """A stream of files that bring commits late, early and twice; numbers of ids with digits only stay text."""
    store, gid = Store(spark, f"{tmp_path}/o"), "12e4"
    store.save_graphs(graphs(spark, gid))
    nodes, edges = tree(spark, [("a.py", "f")])
    store.record_version(gid, nodes, edges, "s0")
    source = tmp_path / "in"
    source.mkdir()
    line = lambda n, status, path: f'{{"graph_id": "{gid}", "sequence": {n}, "sha": "{"zyx"[n % 3]}{n}", "status": "{status}", "path": "{path}"}}\n'
    extract = lambda paths: (paths.select(F.lit(0).cast("long").alias("ord"), F.concat("path", F.lit("::n")).alias("id"), F.lit("function").alias("type"), F.lit("n").alias("name"), F.col("path").alias("file")), edges.limit(0))
    run = lambda: patches.stream_changes(spark, str(source), f"{tmp_path}/cp", store, extract).awaitTermination()
    (source / "1.json").write_text(line(3, "D", "b.py") + line(1, "A", "b.py"))
    run()
    assert store.versions(gid) == [1, 2] and ids(store.snapshot("nodes", gid, 2)) == ["a.py::f", "b.py::n"]
    (source / "2.json").write_text(line(1, "A", "b.py") + line(2, "A", "c.py"))
    (source / "3.json").write_text(line(3, "D", "b.py"))
    run()
    assert store.versions(gid) == [1, 2, 3, 4] and ids(store.snapshot("nodes", gid, 4)) == ["a.py::f", "c.py::n"]
    assert store.graphs().first()["last_commit_sha"] == "z3" and not store.log.state().tables["waiting"]
    assert [r["sha"] for r in store.history(gid).orderBy("version").collect()] == ["s0", "y1", "x2", "z3"]


def test_tree_payloads(spark, tmp_path):
    """A tree's rows come back with defaults; linking and deleting take what others held."""
    store = Store(spark, f"{tmp_path}/t")
    nodes, edges = tree(spark, [("a.py", "f"), ("b.py", "g")])
    refs = spark.createDataFrame([(0, "a.py::f", "x.y()", "call", "a.py", 3, {"k": "v"})], schemas.REFS)
    row = lambda t, status="READY": spark.createDataFrame([(t, None, status, 2, 1, "s")], TREES)
    store.save_tree(row("t1"), Payload(nodes, edges.drop("weight"), refs))
    store.save_tree(row("t2", "BUILDING"), Payload(nodes.limit(1), edges.limit(0), refs.limit(0)))
    got = store.tree("t1", "READY")
    assert got.nodes.columns == [c.split()[0] for c in schemas.split(schemas.NODES)]
    one = got.nodes.filter("ord = 0").first()
    assert (one["id"], one["params"], one["is_god"], one["docstring"]) == ("a.py::f", [], False, None)
    edge = got.edges.first()
    assert (edge["confidence"], edge["weight"], edge["metadata"]) == ("EXTRACTED", 1.0, {}) and got.refs.first()["metadata"] == {"k": "v"}
    assert store.tree("t2", "READY") is None and store.tree("none") is None and store.tree("t2").nodes.count() == 1
    store.save_tree(row("t1"), Payload(nodes.limit(1), edges.limit(0), refs))
    assert store.tree("t1").nodes.count() == 1
    store.save_graphs(graphs(spark, "g"))
    store.link_tree("t1", "g")
    store.link_tree("t2", "g")
    assert store.tree("t1") is None and not store.log.state().folders("tree_nodes", tree_id="t1")
    assert store.with_trees().first()["tree_id"] == "t2"
    store.delete_graph("g")
    assert store.trees().count() == 0 and not store.log.state().folders("tree_nodes")
