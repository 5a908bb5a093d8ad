"""The text that answers a question from a graph, and files for assistant tools."""

import pytest

from gneiss.operators import render, search

NODE = "ord long, id string, type string, name string, file string, community int, is_god boolean, is_orphan boolean, line_start int, line_end int"
EDGE = "ord long, source string, target string, type string, weight double"


def graph(spark):
    nodes = [
        (0, "a::alpha", "function", "alpha", "a.py", 1, True, False, 3, 9),
        (1, "a::beta", "function", "beta", "a.py", 1, False, False, 12, None),
        (2, "b::alpha_two", "class", "alpha_two", "b.py", 2, False, True, None, None),
        (3, "ext", None, None, None, None, False, False, None, None),
        *[(10 + i, f"m{i:02d}", "function", f"m{i:02d}", "c.py", 1, False, False, 1, 2) for i in range(15)],
    ]
    edges = [(0, "a::alpha", "a::beta", "CALLS", 1.0), (1, "a::beta", "a::alpha", "IMPORTS", 1.0), (2, "a::alpha", "ext", "CALLS", 1.0), (3, "a::alpha", "gone", "CALLS", 1.0), (4, "a::alpha", "a::alpha", "CALLS", 1.0)]
    edges += [(5 + i, "a::alpha", f"m{i:02d}", "CALLS", 1.0) for i in range(15)]
    return spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE)


def lines(df):
    return [tuple(r) for r in df.orderBy("section", "n").select("section", "n", "line").collect()]


ALPHA = "function alpha [hub] #1 in a.py:3-9 -> beta (CALLS), ext (CALLS), gone (CALLS), m00 (CALLS), m01 (CALLS), m02 (CALLS), m03 (CALLS), m04 (CALLS) <- beta (IMPORTS), alpha (CALLS)"
MEMBERS = "#1: 17 members, 1 hubs, cut: alpha*, beta, " + ", ".join(f"m{i:02d}" for i in range(8))


def test_hits_and_their_communities(spark):
    nodes, edges = graph(spark)
    ranked = [r["id"] for r in search.search(nodes, "alpha", edges, 30).orderBy("rank").collect()]
    got = lines(render.context_lines(nodes, edges, "alpha", 30))
    assert {"a::alpha", "b::alpha_two"} < set(ranked) and [(s, n) for s, n, _ in got] == [(0, n) for n in range(len(ranked) + 1)] + [(1, n) for n in range(3)]
    assert [x.split(" ")[1] for s, n, x in got if not s and n] == [i.split("::")[-1] for i in ranked]
    assert got[1 + ranked.index("a::alpha")][2] == ALPHA and got[1 + ranked.index("b::alpha_two")][2] == "class alpha_two [orphan] #2 in b.py"
    groups = [MEMBERS, "#2: 1 members, 0 hubs: alpha_two"]
    assert [x for _, _, x in got[-2:]] == (groups[::-1] if ranked[0] == "b::alpha_two" else groups)  # in the order in which hits meet them


def test_gods_where_nothing_hits(spark):
    nodes, edges = graph(spark)
    assert [x for _, _, x in lines(render.context_lines(nodes.drop("line_start", "line_end"), edges, "zzz", 2))] == ["Hits", ALPHA.replace(":3-9", ""), "Communities", MEMBERS]


def test_empty_graph(spark):
    nodes, edges = graph(spark)
    assert lines(render.context_lines(nodes.limit(0), edges.limit(0), "alpha")) == [(0, 0, "Hits"), (1, 0, "Communities")]


@pytest.mark.parametrize("tool", sorted(render.FORMATS))
def test_files_for_tools(spark, tmp_path, tool):
    text = spark.createDataFrame([("one\ntwo \u00e9",)], "text string")
    for _ in range(2):  # a file that is there is written over
        path = render.write_skill_file(text, f"{tmp_path}", "My Repo", "0123456789", tool)
    where, head = render.FORMATS[tool]
    held = (tmp_path / where.format(slug="my-repo")).read_text()
    assert path.endswith(where.format(slug="my-repo")) and held.endswith("one\ntwo \u00e9")
    assert held.startswith("---\nname: my-repo\n") and "01234567\n" in held if head else held == "one\ntwo \u00e9"


def test_files_of_nothing(spark, tmp_path):
    text = spark.createDataFrame([], "text string")
    render.write_skill_file(text, f"{tmp_path}", "r", "s", "plain")
    assert (tmp_path / "r.md").read_text() == ""
    with pytest.raises(ValueError, match="unknown tool"):
        render.write_skill_file(text, f"{tmp_path}", "r", "s", "other")
