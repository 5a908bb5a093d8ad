"""The inverted index against scans of the whole corpus."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gneiss.operators import index, render, search

NODE = "ord long, id string, type string, name string, file string, is_god boolean, is_orphan boolean"


def corpus(n=700, seed=1):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    rows = []
    for i in range(n):
        # rare words gather in a few stretches of places
        text = " ".join(rng.choice(words[:40] if (i // 60) % 5 else words) for _ in range(rng.randint(0, 30)))
        rows.append((i, f"n{i}", rng.choice(["function", "class"]), text or None, f"f{i % 9}.py", i % 11 == 0, i % 13 == 0))
    return rows


def hits(df):
    return sorted((r["rank"], r["ord"], r["id"], round(r["score"], 7)) for r in df.collect())


QUESTIONS = ["waa wbb", "f3 py", "nothing here"]


def test_index_equals_scan(spark, tmp_path):
    nodes = spark.createDataFrame(corpus(), NODE)
    own = index.Index(spark, f"{tmp_path}/i", width=32, buckets=8)
    own.update(search.documents(nodes))
    for q in QUESTIONS:
        assert hits(own.search(q, 5)) == hits(search.search(nodes, q, top_k=5))
    assert hits(own.search("waa wbb", 5, "class")) == hits(search.search(nodes, "waa wbb", top_k=5, node_type="class"))
    _, slices = own.scored("wah", 1, None)
    opened = [r["opened"] for r in slices.collect()]
    assert 0 < sum(opened) < len(opened)  # slices that can't reach the best are not opened
    # only files of the term's bucket are read
    plan = own.blocks(["wab"])._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#", plan) and re.search(r"PushedFilters: \[[^\]]*EqualTo\(t,wab\)", plan)
    assert own.log.read("blocks", index.BLOCK).select("bucket").distinct().count() > 4


def test_index_follows_changes(spark, tmp_path):
    """Replaced, added, moved and removed documents give what a scan of the present ones gives; other slices are not written again."""
    rows = corpus()
    own = index.Index(spark, f"{tmp_path}/u", width=32, buckets=8)
    own.update(search.documents(spark.createDataFrame(rows, NODE)))
    now = {r[0]: r for r in rows}
    steps = [
        ([(5, "n5", "class", "waa waa waa wbb", "f.py", False, False), (2000, "far", "function", "wab", "g.py", True, False)], [6, 7, 9999]),
        ([(7, "again", "class", "wah", "h.py", False, True), (5, "n5", "function", None, "f.py", False, False)], [2000]),
        ([], [5]),
    ]
    for changed, removed in steps:
        now = {k: v for k, v in now.items() if k not in removed} | {r[0]: r for r in changed}
        own.update(search.documents(spark.createDataFrame(changed, NODE)), spark.createDataFrame([(i,) for i in removed], "ord long"))
        nodes = spark.createDataFrame(list(now.values()), NODE)
        for q in QUESTIONS[:2]:
            assert hits(own.search(q, 5)) == hits(search.search(nodes, q, top_k=5))
    second = own.log.read("blocks", index.BLOCK, None, generation=2)
    assert {r["slice"] for r in second.select("slice").distinct().collect()} == {0, 62}
    before = hits(own.search("waa wab", 6))
    own.compact()
    state = own.log.state()
    assert hits(own.search("waa wab", 6)) == before and len(state.tables["blocks"]) == 1 and not state.tables["touched"]
    now[1] = (1, "n1", "class", "wab " * 9, "z.py", True, False)
    own.update(search.documents(spark.createDataFrame([now[1]], NODE)))
    got = hits(own.search("wab", 5))
    assert got == hits(search.search(spark.createDataFrame(list(now.values()), NODE), "wab", top_k=5)) and 1 in [h[1] for h in got]


def test_index_edges(spark, tmp_path):
    own = index.Index(spark, f"{tmp_path}/e")
    assert own.search("anything").count() == 0
    none = search.documents(spark.createDataFrame([], NODE))
    own.update(none)
    assert own.search("anything").count() == 0
    with pytest.raises(ValueError):
        own.update(search.documents(spark.createDataFrame([(None, "x", None, "word", None, None, None)], NODE)))
    rows = [(1, "b", None, "word", None, None, None), (1, "a", None, "word word", None, None, None), (2, None, None, None, None, None, None)]
    own.update(search.documents(spark.createDataFrame(rows, NODE)))
    assert [(r["ord"], r["id"]) for r in own.search("word").collect()] == [(1, "a")]  # of a repeated place the least id


def test_question_lines_keep_rank(spark):
    rows = [(i, f"f.py::n{i}", "function", "alpha " * (i % 4) + "beta", "f.py", i == 3, False) for i in range(9)]
    nodes = spark.createDataFrame(rows, NODE).withColumn("community", F.lit(1))
    edges = spark.createDataFrame([(0, "f.py::n3", "f.py::n1", "CALLS", 1.0)], "ord long, source string, target string, type string, weight double")
    ranked = [r["id"] for r in search.search(nodes, "alpha", edges, 4).orderBy("rank").collect()]
    lines = [r["line"] for r in render.query_lines(nodes, edges, "alpha", 4).orderBy("n").collect()]
    names = {r[1]: r[3] for r in rows}
    assert [x.split(" in ")[0] for x in lines] == [f"function {names[i]}" for i in ranked]
    gods = render.query_lines(nodes, edges, "zzz", 4).collect()
    assert len(gods) == 1 and gods[0]["line"].startswith("function " + names["f.py::n3"])
