"""Graph operators on small fixtures, and the registered queries against their SQL."""

import base64
import hashlib
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from gneiss import schemas
from gneiss.functions import text as X
from gneiss.operators import answers, build, cluster, flags, merge, resolve, search, traverse
from gneiss.plans import queries as Q
from gneiss.sources import files
from gneiss.sources.store import GRAPHS, TREES, Store
from gneiss.streaming import patches

SF = "/root/testdata/sf0.001"


def graph(spark):
    names = {"a": ("a.py", 0), "b": ("a.py", 0), "c": ("b.py", 1), "d": ("b.py", 2), "e": ("c.py", None), "lone": ("c.py", 2)}
    nodes = [(i, f"{f}::{n}", "function", n, f, c) for i, (n, (f, c)) in enumerate(names.items())]
    nodes.append((9, "a.py::a", "function", "a_last", "a.py", 0))  # an overload: last attributes, first place
    at = {n: f"{f}::{n}" for n, (f, _) in names.items()}
    edges = [(0, at["a"], at["b"], "CALLS", 1.0), (1, at["b"], at["a"], "CALLS", 2.0), (2, at["a"], at["c"], "CALLS", 1.0), (3, at["a"], at["d"], "IMPORTS", 1.0), (4, at["a"], at["a"], "CALLS", 5.0), (5, at["c"], "ghost", "CALLS", 1.0), (6, at["e"], at["e"], "CALLS", 1.0), (7, at["a"], "never", "BOGUS", 1.0)]
    return spark.createDataFrame(nodes, "ord long, id string, type string, name string, file string, community int"), spark.createDataFrame(edges, "ord long, source string, target string, type string, weight double")


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_build(spark):
    nodes, edges = build.build(*graph(spark))
    assert rows(nodes.filter("type = 'external'"), "id") == [("ghost",)]
    assert rows(nodes.filter("id = 'a.py::a'"), "ord", "name") == [(0, "a_last")]
    assert edges.count() == 7 and build.counts(*graph(spark)).first().asDict() == {"n_nodes": 7, "n_external": 1, "n_edges": 7, "n_dropped": 1}


def test_flags(spark):
    nodes, edges = build.build(*graph(spark))
    got = {r["id"]: (r["is_god"], r["is_orphan"]) for r in flags.flags(nodes, edges).collect()}
    assert got["a.py::a"] == (True, False) and got["c.py::lone"] == (False, True) and got["c.py::e"] == (False, False)
    assert rows(flags.projection(edges).filter("u like '%::a' and v like '%::b'"), "weight") == [(3.0,)]


def test_neighbours_and_chain(spark):
    nodes, edges = build.build(*graph(spark))
    one = spark.createDataFrame([("a.py::a",)], "id string")
    got = rows(traverse.neighbours(nodes, edges, one, most=4), "direction", "place", "other")
    assert got == [("in", 1, "a.py::b"), ("in", 2, "a.py::a"), ("out", 1, "a.py::b"), ("out", 2, "b.py::c")]
    assert traverse.resolve_id(nodes, "LON").first()["id"] == "c.py::lone"
    chain = rows(traverse.call_chains(edges, one), "callee", "next")
    assert ("b.py::c", "ghost") in chain


def test_call_paths(spark):
    edges = spark.createDataFrame([(i, s, t, "CALLS", 1.0) for i, (s, t) in enumerate([("h", "a"), ("h", "b"), ("h", "c"), ("h", "d"), ("a", "h"), ("a", "x"), ("x", "y"), ("y", "z"), ("z", "w")])], "ord long, source string, target string, type string, weight double")
    starts = spark.createDataFrame([(1, "h")], "hub_rank int, id string")
    twice = edges.unionAll(edges.filter("ord = 1").withColumn("ord", F.lit(20).cast("long")))
    assert [r["path"] for r in traverse.call_paths(twice, starts).orderBy("place").collect()] == [["h", "b"], ["h", "c"], ["h", "a", "x", "y", "z"]]
    got = [r["path"] for r in traverse.call_paths(edges, starts).orderBy("place").collect()]
    assert got == [["h", "b"], ["h", "c"], ["h", "a", "x", "y", "z"]]


def test_search_against_python(spark):
    names = ["parseFile reader", "HTTPServer handler", "read file and parse", "misc", "fileReader"]
    nodes = spark.createDataFrame([(i, f"f{i}", "function", n, "src/m.py", i == 4, False) for i, n in enumerate(names)], "ord long, id string, type string, name string, file string, is_god boolean, is_orphan boolean")

    def tokens(s):
        import re

        out = []
        for w in re.findall(X.WORD, s):
            out.append(w.lower())
            out += [p.lower() for p in X._HUMP.split(w) if p.lower() != w.lower()]
        return out

    docs = []
    for i, n in enumerate(names):
        tf: dict = {}
        for text, w in ((n, 3), (f"f{i}", 2), ("src/m.py", 1), ("function", 1)):
            for t in tokens(text):
                tf[t] = tf.get(t, 0) + w
        docs.append(tf)
    avg = sum(sum(d.values()) for d in docs) / len(docs)
    want = []
    for i, d in enumerate(docs):
        s = 0.0
        for t in X.query_terms("parse the file"):
            if t in d:
                df = sum(t in x for x in docs)
                s += math.log((len(docs) - df + 0.5) / (df + 0.5) + 1) * d[t] * 2.5 / (d[t] + 1.5 * (0.25 + 0.75 * sum(d.values()) / avg))
        if s:
            want.append((round(s * (1.3 if i == 4 else 1), 9), i))
    got = [(r["score"], r["ord"]) for r in search.search(nodes, "parse the file").orderBy("rank").collect()]
    assert got == sorted(want, key=lambda x: (-x[0], x[1]))
    assert X.query_terms("parse") == ["parse", "parse"] and X.query_terms("the") == ["the"]


def test_resolution_table(spark):
    nodes = spark.createDataFrame([(0, "p/a.py::only", "only"), (1, "p/q/b.py::twice", "twice"), (2, "z/c.py::twice", "twice"), (3, "j/X.java::X.go", "go"), (4, "j/Y.java::Y.go", "go"), (5, "com/acme/Tool.java::Tool", "Tool"), (6, "other/Tool.java::Tool", "Tool")], "ord long, id string, name string")
    refs = [(0, "p/m.py::f", "x.only(1)", "call", "p/m.py"), (1, "p/q/m.py::f", "twice", "inherits", "p/q/m.py"), (2, "p/q/m.py::f", "twice()", "call", "p/q/m.py"), (3, "w/M.java::M", "Y.go(1)", "call", "w/M.java"), (4, "w/M.java::M", "import com.acme.Tool;", "import", "w/M.java"), (5, "w/M.java::M", "import a.b.Tool;", "import", "w/M.java"), (6, "p/m.py::f", "from a import b, c", "import", "p/m.py"), (7, "w/M.java::M", "log.info(1)", "call", "w/M.java"), (8, "p/m.py::f", "nothing()", "call", "p/m.py"), (1, "p/q/m.py::f", "twice", "inherits", "p/q/m.py")]
    got = resolve.resolve(spark.createDataFrame(refs, "ord long, source string, raw string, kind string, file string"), nodes)
    assert rows(got, "ord", "outcome", "target") == sorted([(0, "resolve", "p/a.py::only"), (1, "resolve", "p/q/b.py::twice"), (1, "resolve", "p/q/b.py::twice"), (2, "pass", None), (3, "resolve", "j/Y.java::Y.go"), (4, "resolve", "com/acme/Tool.java::Tool"), (5, "drop", None), (6, "drop", None), (7, "drop", None), (8, "drop", None)], key=str)
    assert rows(resolve.resolved_edges(got), "type", "confidence")[0] == ("CALLS", "INFERRED")
    more = spark.createDataFrame([(0, "s/UserService.java::UserService.save1", "save1"), (1, "s/B.java::B.save1", "save1"), (2, "a/b/Utils.java::Utils.helper", "helper"), (3, "c/Utils.java::Utils.helper", "helper"), (4, "root.py::x", "x"), (5, "q/r.py::x", "x"), (6, "d/OrderServiceImpl.java::OrderServiceImpl.go1", "go1"), (7, "d/C.java::C.go1", "go1")], "ord long, id string, name string")
    refs = [(0, "w/M.java::M", "this.userService.save1", "call", "w/M.java"), (1, "w/M.java::M", "import static a.b.Utils.helper;", "import", "w/M.java"), (2, "root.py::f", "x", "inherits", "root.py"), (3, "w/M.java::M", "orderService.go1", "call", "w/M.java"), (4, "q/z/m.go::f", "x", "decorator", "q/z/m.go"), (5, "w/M.java::M", "x", "odd", "w/M.java")]
    got = resolve.resolve(spark.createDataFrame(refs, "ord long, source string, raw string, kind string, file string"), more)
    assert rows(got, "ord", "target", "reasoning") == [(0, "s/UserService.java::UserService.save1", resolve.RECEIVER), (1, "a/b/Utils.java::Utils.helper", resolve.PATH), (2, "root.py::x", resolve.PACKAGE), (3, "d/OrderServiceImpl.java::OrderServiceImpl.go1", resolve.RECEIVER), (4, "q/r.py::x", resolve.UNIQUE), (5, None, None)]


def test_import_names(spark):
    cases = [("from a.b import c as d", "python", "c"), ("from a import (b, c)", "python", ""), ("import a.b", "python", "b"), ("import static java.util.X.y;", "java", "y"), ("import a.b.*;", "java", ""), ("import { x as y } from './m'", "javascript", "x"), ("import D from 'm'", "javascript", "D"), ("import * as n from 'm'", "javascript", ""), ("import {a, b} from 'm'", "javascript", "")]
    for raw, d, want in cases:
        assert spark.range(1).select(X.import_name(F.lit(raw), d)).first()[0] == want, raw
    both = spark.range(1).select(X.call_name(F.lit("f(a.b)"), "java"), X.call_name(F.lit("f(a.b)"), "python")).first()
    assert tuple(both) == ("f", "b)")


def test_merge(spark):
    nodes, edges = build.build(*graph(spark))
    stale = spark.createDataFrame([("b.py",)], "path string")
    back = nodes.filter("id = 'b.py::c'")
    n, e = merge.merge_tree(nodes, edges, stale, back, edges.limit(0))
    assert rows(n.filter("file = 'b.py'"), "id") == [("b.py::c",)]
    kept = rows(e, "source", "target")
    assert ("a.py::a", "b.py::c") in kept and ("a.py::a", "b.py::d") not in kept and ("b.py::c", "ghost") not in kept
    assert tuple(merge.deltas(nodes, n, ["id"]).first()) == (0, 1)
    one = lambda p, k, l, e: spark.createDataFrame([(p, k, l, e)], schemas.STATS)
    got = merge.merge_stats(one(3, 1, {"a": 2}, ["x"]), one(2, 4, {"a": 1, "b": 1}, ["y"])).first()
    assert got["files_parsed"] == 3 and got["files_skipped"] == 4 and got["languages"] == {"a": 3, "b": 1} and got["errors"] == ["x", "y"]


def test_answers(spark):
    refs = spark.createDataFrame([(i, f"s{i % 3}", "r", "call", "f.py") for i in range(6)], "ord long, source string, raw string, kind string, file string")

    def resolver(numbered):
        text = 'Sure:\n```json\n[{"ref_index": 0, "target": "old"}, {"ref_index": 0, "target": "t0", "reasoning": "x"}, {"ref_index": 2, "target": null}]\n```'
        return answers.parse_answers(numbered.select("chunk").distinct().withColumns({"ord": F.lit(0), "text": F.lit(text)}))

    got = rows(answers.resolve_rest(refs, resolver), "ord", "target")
    assert got == [(0, "t0"), (1, None), (2, None), (3, "t0"), (4, None), (5, None)]


def test_communities(spark):
    """Two dense groups joined by one edge, an isolated node: right parts, connected, better than singletons."""
    ids = [f"n{i}" for i in range(13)]
    nodes = spark.createDataFrame(list(enumerate(ids)), "ord long, id string")
    pairs = [(a, b) for g in (range(6), range(6, 12)) for a in g for b in g if a < b] + [(0, 6)]
    edges = spark.createDataFrame([(i, ids[a], ids[b], "CALLS", 1.0) for i, (a, b) in enumerate(pairs)], "ord long, source string, target string, type string, weight double")
    got = cluster.communities(nodes, edges)
    of = {r["id"]: r["community"] for r in got.collect()}
    assert len(of) == 13 and len({of[i] for i in ids[:6]}) == 1 and len({of[i] for i in ids[6:12]}) == 1 and len(set(of.values())) == 3
    m = len(pairs)
    assert abs(cluster.modularity(edges, got).first()["q"] - (30 / m - 2 * 31**2 / (4 * m * m))) < 1e-9


def test_python_files(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "tests").mkdir()
    (tmp_path / "pkg" / "a.py").write_text('"""Doc."""\nimport os\nclass A(Base):\n    def run(self, x: int, *a) -> int:\n        """Go."""\n        self.stop(); helper(x); print(x); os.path.join(x)\n    def stop(self): pass\n@deco\ndef helper(y): return y\ndef deco(f): return f\n')
    (tmp_path / "pkg" / "bad.py").write_text("def (")
    (tmp_path / "pkg" / "b.java").write_text("class B {}")
    (tmp_path / "tests" / "t.py").write_text("x = 1")
    (tmp_path / "big.py").write_text("#" * 1_000_001)
    (tmp_path / "conf.json").write_text("{}")
    found = files.scan(spark, str(tmp_path))
    assert rows(found, "path", "language") == [("pkg/a.py", "python"), ("pkg/b.java", "java"), ("pkg/bad.py", "python")]
    parsed = files.parse_files(found)
    n, e, r = files.tables(parsed)
    assert rows(n, "id", "type") == [("pkg/a.py", "module"), ("pkg/a.py::A", "class"), ("pkg/a.py::A.run", "method"), ("pkg/a.py::A.stop", "method"), ("pkg/a.py::deco", "function"), ("pkg/a.py::helper", "function")]
    assert {("pkg/a.py::A.run", "pkg/a.py::A.stop", "CALLS"), ("pkg/a.py::A.run", "pkg/a.py::helper", "CALLS"), ("pkg/a.py::helper", "pkg/a.py::deco", "DECORATES"), ("pkg/a.py", "pkg/a.py::A", "CONTAINS")} <= set(rows(e, "source", "target", "type"))
    assert rows(r, "raw", "kind") == [("Base", "inherits"), ("import os", "import")]
    stats = files.parse_stats(parsed).first()
    assert stats["files_parsed"] == 1 and stats["files_skipped"] == 1 and len(stats["errors"]) == 1
    lines = spark.createDataFrame([("A\tx.py",), ("R090\told.py\tnew.py",), ("C100\ta\tb",), ("D\tz.py",)], "value string")
    assert rows(files.name_status(lines), "status", "path", "old_path") == [("A", "x.py", None), ("D", "z.py", None), ("R", "new.py", "old.py")]
    raw = base64.b64encode(b"hi").decode()
    assert spark.range(1).select(files.decoded_content(F.lit(raw), F.lit("base64"))).first()[0] == "hi"


def test_script_imports(spark):
    paths = ["src/a.ts", "src/b.js", "src/b.tsx", "src/lib/index.js", "src/user.ts", "src/c.mjs", "index.tsx", "top.cjs"]
    want = {
        ("src/a.ts", "./b"): "src/b.tsx", ("src/a.ts", "./b.js"): "src/b.js", ("src/a.ts", "./lib/"): "src/lib/index.js", ("src/lib/index.js", "../c"): "src/c.mjs",
        ("src/a.ts", "./user.service"): "src/user.ts", ("src/a.ts", "../"): "index.tsx", ("src/a.ts", "../../a"): None, ("src/a.ts", "react"): None, ("src/a.ts", None): None,
        ("top.cjs", "./src/./lib/../a"): "src/a.ts", ("src/a.ts", "../top.cjs"): "top.cjs", ("src/a.ts", "../top"): None, ("src/a.ts", "./gone"): None,
    }
    refs = spark.createDataFrame([(*k, "x") for k in want] + [("src/a.ts", "./b", "y")], "file string, specifier string, path string")
    tree = spark.createDataFrame([(p,) for p in paths], "path string")
    got = files.script_imports(refs, tree).collect()
    assert len(got) == len(want) + 1 and all(r["resolved"] == want[r["file"], r["specifier"]] for r in got)
    assert files.script_imports(refs, tree.limit(0)).filter("resolved is not null").count() == 0 == files.script_imports(refs.limit(0), tree).count()


def test_store_and_stream(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/store")
    row = lambda gid, sha: spark.sql("select 1").select(*[F.lit(v).cast(t).alias(c) for c, v, t in zip([x.split()[0] for x in GRAPHS.split(", ")], [gid, "u", "url", "main", "BUILDING", 1, 1, 1, sha, None], [x.split()[1] for x in GRAPHS.split(", ")])])
    store.save_graphs(row("g1", "s0"))
    store.save_graphs(row("g2", "s1"))
    assert rows(store.graphs(), "graph_id", "last_commit_sha") == [("g1", "s1")]  # the id is kept
    store.mark_error("g1")
    assert store.graphs().first()["status"] == "ERROR" and store.active("u", "url", "main").count() == 0
    nodes, edges = build.build(*graph(spark))
    assert store.record_version("g1", nodes, edges, "s1") == 1
    changes = tmp_path / "in"
    changes.mkdir()
    (changes / "1.json").write_text('{"graph_id": "g1", "sequence": 1, "sha": "s2", "status": "D", "path": "b.py"}\n')

    def extract(paths):
        return nodes.limit(0), edges.limit(0)

    for _ in range(2):  # replayed from another checkpoint, the commit is known already
        patches.stream_changes(spark, str(changes), f"{tmp_path}/cp{_}", store, extract).awaitTermination()
    assert store.next_version("g1") == 3 and store.snapshot("nodes", "g1", 2).filter("file = 'b.py'").count() == 0
    assert rows(store.runs(), "mode", "nodes_removed") == [("PATCH", 2)]
    with pytest.raises(KeyError):
        store.save_clusters("none", nodes)
    store.save_clusters("g1", nodes)
    assert tuple(store.graphs().select("n_communities", "status").first()) == (3, "READY")
    store.save_trees(spark.createDataFrame([("t1", "g1", "READY", 1, 1, "s"), ("t2", None, "READY", 1, 1, "s"), ("t3", "g9", "READY", 1, 1, "s")], TREES))
    store.link_tree("t2", "g1")
    assert rows(store.trees(), "tree_id", "graph_id") == [("t2", "g1"), ("t3", "g9")] and rows(store.with_trees(), "graph_id", "tree_id") == [("g1", "t2")]
    store.record_version("g9", nodes, edges, "s1")
    store.delete_graph("g1")
    assert store.graphs().count() == 0 and store.runs().count() == 1 and rows(store.trees(), "tree_id") == [("t3",)]
    assert store.next_version("g1") == 1 and store.next_version("g9") == 2 and store.snapshot("nodes", "g9", 1).count() == nodes.count()


def test_small_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(X.identifier_tokens(F.lit("parseHTTPFile x_1 9z"))) == ["parsehttpfile", "parse", "http", "file", "x", "z"]
    assert one(X.owner_of(F.lit("git@github.com:o/r.git"))) == "o" and one(X.repo_of(F.lit("https://github.com/o/r/"))) == "r"
    assert one(X.location(F.lit("f"), F.lit(3), F.lit(9))) == "f:3-9" and one(X.location(F.lit("f"), F.lit(3), F.lit(3))) == "f:3"
    assert one(X.signature(F.array(F.lit("a"), F.lit("b")), F.lit("R"), F.lit("method"))) == "(a, b) -> R"
    for url in ("https://github.com/O/r/tree/main", "git@github.com:o/R.git", "http://github.com/o/r"):
        assert one(X.repo_id(F.lit(url))) == hashlib.sha256(b"github.com/o/r").hexdigest()[:16]
    assert one(X.repo_id(F.lit("https://example.com/o/r"))) is None
    assert one(X.is_accessor(F.lit("getName"))) and not one(X.is_accessor(F.lit("getaway"))) and one(X.safe_filename(F.lit("a/b c.d"))) == "a-b-c.d"
    assert one(X.slug(F.lit("My Repo!"))) == "my-repo" and one(X.truncated(F.lit("abcdef"), 3)) == "abc..."
    frames = spark.createDataFrame([("m", 2, "delta", "lo"), ("m", 1, "delta", "hel"), ("m", 3, "done", None)], "message_id string, seq int, kind string, text string")
    assert tuple(patches.assemble_messages(frames).first()) == ("m", "hello", True)


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_against_sql(spark, name):
    db = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents conversations".split():
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = Q.QUERIES[name](spark, SF)
    cur = db.execute(Q.SQL[name])
    names = [d[0] for d in cur.description]
    norm = lambda v: round(v, 6) if isinstance(v, float) else v
    want = sorted((tuple(map(norm, r)) for r in cur.fetchall()), key=str)
    assert sorted(got.columns) == sorted(names)
    assert sorted((tuple(map(norm, r)) for r in got.select(*names).collect()), key=str) == want
