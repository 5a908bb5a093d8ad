"""Payloads as typed rows with what doesn't fit beside them, errors as rows, and the way back."""

import json

import pytest
from pyspark.sql import functions as F

from gneiss import schemas
from gneiss.plans import queries as Q
from gneiss.sources import payloads
from gneiss.sources.store import TREES, Store

NODES = [
    {"ord": 7, "id": "a.py::f", "type": "function", "name": "f", "file": "a.py", "line_start": 3, "params": ["x", None], "is_god": True},
    {"id": "a.py::g", "line_start": "three", "line_end": 2**40, "params": [1], "colour": {"r": 1.5, "g": None}, "docstring": None, "is_orphan": 0},
    {"id": 5, "name": "", "Name": "other case", "line_start": 3.7, "params": []},
    {},
]
EDGES = [
    {"source": "a", "target": "b", "type": "CALLS", "weight": 2, "metadata": {"k": "v"}},
    {"source": "a", "target": "c", "weight": 0.25, "confidence": "GUESSED", "metadata": {"k": {"deep": 1}}},
    {"source": "a", "target": "d", "weight": "heavy", "metadata": {"k": 1}, "since": [1, "x"]},
]
GOOD = json.dumps({"nodes": NODES, "edges": EDGES, "refs": [{"source": "a", "raw": "x" * 200_000, "line": 1, "metadata": {}}], "version": 3})
BAD = {
    "null": (None, "no payload"), "empty": ("", "not JSON"), "broken": (GOOD[:-1], "not JSON"), "repeated": ('{"nodes": [], "nodes": []}', "not JSON"),
    "list": ("[1]", "not an object"), "nothing": ("null", "not an object"), "number": ("4", "not an object"), "dict": ('{"nodes": {"a": 1}}', "nodes is not a list"),
    "text": ('{"nodes": [], "refs": "r"}', "refs is not a list"),
}


@pytest.fixture(scope="module")
def trees(spark):
    texts = [("good", GOOD), ("good", GOOD), ("none", "{}"), ("nulls", '{"nodes": null, "edges": []}'), ("mixed", '{"nodes": [4, {"id": "a"}, null, [1]]}'), *[(k, t) for k, (t, _) in BAD.items()]]
    return payloads.parsed(spark.createDataFrame([(k, t, 1, "mine") for k, t in texts], "tree_id string, payload string, body int, error string"))


def plain(row):
    return {k: v for k, v in row.asDict().items() if v is not None and k not in ("tree_id", "place", "rescued", "error")}


def test_errors(trees):
    got = {r["tree_id"]: (r["error"], r["none"]) for r in trees.select("tree_id", "error", F.col("body").isNull().alias("none")).collect()}
    assert got == {k: (e, True) for k, (_, e) in BAD.items()} | dict.fromkeys(["good", "none", "nulls", "mixed"], (None, False))


def test_what_fits_and_what_does_not(trees):
    """Repeated trees give their rows twice; values of other kinds and other fields are rescued."""
    got = payloads.rows(trees, "nodes").filter("tree_id = 'good'").withColumn("rescued", F.to_json("rescued")).orderBy("place").collect()
    assert [r["place"] for r in got] == [0, 0, 1, 1, 2, 2, 3, 3] and got[::2] == got[1::2]
    base = {"params": [], "is_god": False, "is_orphan": False}
    assert [plain(r) for r in got[::2]] == [
        base | NODES[0],
        {"ord": 1, "id": "a.py::g", "is_god": False},
        base | {"ord": 2, "name": ""},
        base | {"ord": 3},
    ]
    rescued = [json.loads(r["rescued"]) if r["rescued"] else None for r in got[::2]]
    assert rescued == [None, {k: NODES[1][k] for k in ("line_start", "line_end", "params", "colour", "is_orphan")}, {"id": 5, "Name": "other case", "line_start": 3.7}, None]
    edges = payloads.rows(trees, "edges").filter("tree_id = 'good'").withColumn("rescued", F.to_json("rescued")).dropDuplicates(["place"]).orderBy("place").collect()
    assert [plain(r) for r in edges] == [
        EDGES[0] | {"ord": 0, "confidence": "EXTRACTED", "weight": 2.0},
        {"ord": 1, "source": "a", "target": "c", "weight": 0.25, "confidence": "GUESSED"},
        {"ord": 2, "source": "a", "target": "d", "confidence": "EXTRACTED"},
    ]
    assert [r["rescued"] and json.loads(r["rescued"]) for r in edges] == [None, {"metadata": {"k": {"deep": 1}}}, {"weight": "heavy", "metadata": {"k": 1}, "since": [1, "x"]}]


def test_elements_that_are_no_objects(trees):
    got = payloads.rows(trees, "nodes").filter("tree_id = 'mixed'").orderBy("place").select("place", "id", "ord", "error", F.to_json("rescued").alias("rescued")).collect()
    assert [tuple(r) for r in got] == [(0, None, None, "not an object", "4"), (1, "a", 1, None, None), (2, None, None, "not an object", "null"), (3, None, None, "not an object", "[1]")]


@pytest.mark.parametrize(("part", "want"), [("nodes", NODES), ("edges", EDGES)])
def test_round_trip(spark, trees, tmp_path, part, want):
    """Written and read back, elements hold all they held, and typed rows are the same again."""
    first = payloads.rows(trees, part).filter("tree_id IN ('good', 'mixed')").dropDuplicates(["tree_id", "place"])
    first.write.parquet(f"{tmp_path}/{part}")
    first = spark.read.schema(first.schema).parquet(f"{tmp_path}/{part}")
    lines = payloads.elements(first, part)
    held = [json.loads(r["element"]) for r in lines.filter("tree_id = 'good'").orderBy("place").collect()]
    assert all({k: v for k, v in w.items() if v is not None}.items() <= h.items() for w, h in zip(want, held, strict=True)) if part == "edges" else [h | w for w, h in zip(want, held, strict=True)] == [h | {k: None for k, v in w.items() if v is None} for w, h in zip(want, held, strict=True)]
    again = payloads.typed(lines.withColumn("element", F.parse_json("element")), part)
    shown = lambda df: sorted(map(str, df.withColumn("rescued", F.to_json("rescued")).collect()))
    assert shown(again) == shown(first)


def test_empty_table(spark):
    none = payloads.parsed(spark.createDataFrame([], "tree_id string, payload string"))
    assert none.count() == 0 and payloads.elements(payloads.rows(none, "refs"), "refs").count() == 0


def test_trees_of_the_store(spark, tmp_path):
    """A payload becomes a tree with its counts; an unreadable one is an error and changes nothing; a new one replaces all."""
    store = Store(spark, f"{tmp_path}/s")
    text = lambda t: spark.createDataFrame([("t", t)], "tree_id string, payload string")
    store.index_tree(text(GOOD), "sha1")
    row = store.trees().first()
    assert (row["status"], row["n_nodes"], row["n_edges"], row["last_commit_sha"], row["graph_id"]) == ("READY", 4, 3, "sha1", None)
    got = store.tree("t", "READY")
    assert got.nodes.columns == [c.split()[0] for c in schemas.split(schemas.NODES)] and got.refs.count() == 1
    kept = store.tree("t", rescued=True).nodes.filter("ord = 1").select(F.try_variant_get("rescued", "$.line_start", "string")).first()[0]
    assert kept == "three"
    for bad, error in BAD.values():
        with pytest.raises(ValueError, match=error):
            store.index_tree(text(bad), "sha2")
    with pytest.raises(ValueError, match="one row"):
        store.index_tree(text(GOOD).limit(0), "sha2")
    assert store.trees().first()["last_commit_sha"] == "sha1"
    store.save_trees(spark.createDataFrame([("t", "g", "READY", 4, 3, "sha1")], TREES))
    store.index_tree(text('{"nodes": [{"id": "n"}, 4]}'), "sha3")
    row = store.trees().first()
    assert (row["n_nodes"], row["n_edges"], row["last_commit_sha"], row["graph_id"]) == (1, 0, "sha3", "g")
    assert [tuple(r) for r in store.tree_errors("t").collect()] == [("t", "nodes", 1, "not an object", "4")]


def test_counts_of_trees_are_not_broadcast(spark):
    """There is a row of counts for each tree, however small the planner thinks it."""
    plan = Q.payload_rows(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
