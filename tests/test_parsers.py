"""The registry of parsers, its table function, and listed files."""

import pytest

from gneiss.sources import files, parsers

FILES = "path string, language string, content binary, commit string, status int, AT int"


def some() -> tuple[parsers.Parser, dict[str, parsers.Parser]]:
    """Parsers as a user's session has them: workers can't import them, so they go by value."""

    def shell(path: str, text: str) -> parsers.Parsed:
        """A parser of a few lines: functions of a shell script, and what it sources."""
        nodes = [(path, "module", path, 1, text.count("\n") + 1, [], None, None)]
        edges, refs = [], []
        for n, line in enumerate(text.split("\n"), 1):
            if line.endswith("() {"):
                nodes.append((f"{path}::{line[:-4]}", "function", line[:-4], n, n, [], None, None))
                edges.append((path, nodes[-1][0], "CONTAINS"))
            elif line.startswith(". "):
                refs.append((path, line[2:], "import", n))
        return nodes, edges, refs, []

    def failing(path: str, text: str) -> parsers.Parsed:
        raise KeyError(path)

    broken = {
        "fails": failing,
        "short": lambda p, t: ([(p, "module")], [], [], []),
        "typed": lambda p, t: ([], [], [(p, "x", "call", "three")], []),
        "large": lambda p, t: ([], [], [(p, "x", "call", 2**31)], []),
        "triple": lambda p, t: ([], [], []),
        "nothing": lambda p, t: None,
    }
    return shell, broken


SHELL, BROKEN = some()
KNOWN = parsers.Parsers({**files.PARSERS.by_language, "shell": SHELL, **BROKEN})


@pytest.fixture(scope="module")
def table(spark):
    rows = [
        ("a.py", "python", b"def f():\n    g()\n", "c1", 1, 1), ("bad.py", "python", b"def (", "c1", 1, 1), ("none.py", "python", None, "c1", 1, 1),
        ("latin.py", "python", b"\xff\xfe", "c1", 1, 1), ("x.sh", "shell", b". lib.sh\ngo() {\n}\nstop() {\n}", "c2", 2, 2), ("e.sh", "shell", b"", None, None, None),
        ("b.rs", "rust", b"fn main() {}", "c3", 3, 3), ("u", None, b"?", "c3", 3, 3), ("a.py", "python", b"def f():\n    g()\n", "c1", 1, 1), (None, "fails", b"", None, None, None),
    ]
    return spark.createDataFrame(rows + [(f"{k}.x", k, b"text", "c4", 4, 4) for k in BROKEN], FILES)


def test_every_file_has_an_outcome(spark, table):
    got = parsers.parse(table, KNOWN)
    assert got.columns == ["path", "language", "commit", "AT", "status", "error", "nodes", "edges", "refs", "imports"]
    rows = got.collect()
    assert len(rows) == table.count()
    by = {r["path"]: r for r in rows}
    assert {p for p, r in by.items() if r["status"] == "parsed"} == {"a.py", "x.sh", "e.sh"}
    assert {p for p, r in by.items() if r["status"] == "skipped"} == {"b.rs", "u"}
    errors = {p: r["error"] for p, r in by.items() if r["status"] == "error"}
    assert errors == {
        "bad.py": "bad.py: SyntaxError", "none.py": "none.py: ValueError", "latin.py": "latin.py: UnicodeDecodeError", "fails.x": "fails.x: KeyError", None: "None: KeyError",
        "short.x": "short.x: TypeError", "typed.x": "typed.x: TypeError", "large.x": "large.x: TypeError", "triple.x": "triple.x: ValueError", "nothing.x": "nothing.x: TypeError",
    }
    assert all(not (r["nodes"] or r["edges"] or r["refs"] or r["imports"]) for r in rows if r["status"] != "parsed")
    assert [n["name"] for n in by["x.sh"]["nodes"]] == ["x.sh", "go", "stop"] and by["x.sh"]["commit"] == "c2"
    assert parsers.parse(table.limit(0), KNOWN).count() == 0
    stats = files.parse_stats(got).first()
    assert (stats["files_parsed"], stats["files_skipped"], stats["languages"]) == (4, 2, {"python": 2, "shell": 2}) and stats["errors"] == sorted(errors.values())
    none = files.parse_stats(got.limit(0)).first()
    assert (none["files_parsed"], none["files_skipped"], none["languages"], none["errors"]) == (0, 0, {}, [])


def test_rows_of_one_kind(spark, table):
    whole = {r["path"]: r for r in parsers.parse(table, KNOWN).collect()}
    for kind in parsers.KINDS:
        got = parsers.parse(table.dropDuplicates(["path"]), KNOWN, kind)
        assert got.columns[:3] == ["path", "language", "commit"] and "content" not in got.columns and "AT" not in got.columns and "at" in got.columns
        names = got.columns[got.columns.index("at") + 1 :]
        want = [(p, i, *[x[n] for n in names]) for p, r in whole.items() for i, x in enumerate(r[kind])]
        assert sorted(map(str, ((r["path"], r["at"], *[r[n] for n in names]) for r in got.collect()))) == sorted(map(str, want))
    nodes, edges, refs = files.tables(parsers.parse(table, KNOWN))
    assert {(r["id"], r["language"]) for r in nodes.collect()} >= {("a.py::f", "python"), ("x.sh::go", "shell")} and edges.columns == ["ord", "source", "target", "type"] and refs.columns == ["ord", "source", "raw", "kind", "line", "file"]


def test_sql_and_arguments(spark, table):
    parsers.register(spark, KNOWN, "parse_some")
    table.createOrReplaceTempView("some_files")
    got = spark.sql("SELECT path, name FROM parse_some(TABLE(some_files), 'nodes') WHERE type = 'function' AND language = 'shell'").collect()
    assert sorted(map(tuple, got)) == [("x.sh", "go"), ("x.sh", "stop")]
    for wrong in ("TABLE(some_files), 'trees'", "TABLE(SELECT path, language FROM some_files), 'nodes'", "1, 'nodes'"):
        with pytest.raises(Exception, match="argument must be|lacks content"):
            spark.sql(f"SELECT * FROM parse_some({wrong})").collect()
    plan = parsers.parse(table, KNOWN)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # files stay where they are
    more = files.PARSERS.register("shell", SHELL)
    assert set(more.by_language) == {"python", "shell"} and set(files.PARSERS.by_language) == {"python"}


def test_listed_files(spark, table):
    wanted = ["a.py", "./x/../a.py", "sub/../../a.py", "/etc/passwd", "..", "gone.py", "", None, "x.sh", "x.sh"]
    paths = spark.createDataFrame([(p,) for p in wanted], "path string")
    told = files.asked(table, paths)
    assert {(r["asked"], r["path"], r["outcome"]) for r in told.collect()} == {
        ("a.py", "a.py", "found"), ("./x/../a.py", "a.py", "found"), ("x.sh", "x.sh", "found"), ("gone.py", "gone.py", "missing"), ("", "", "missing"), (None, None, "missing"),
        ("sub/../../a.py", None, "refused"), ("/etc/passwd", None, "refused"), ("..", None, "refused"),
    }
    chosen = files.only(table.dropDuplicates(["path"]), paths)
    assert sorted(r["path"] for r in chosen.collect()) == ["a.py", "x.sh"]
    stats = files.parse_stats(parsers.parse(chosen, KNOWN), told).first()
    assert (stats["files_parsed"], stats["files_skipped"], stats["errors"]) == (2, 6, ["..: refused", "/etc/passwd: refused", "sub/../../a.py: refused"])
