"""Parsers of source files by language, called by one Python table function whose columns follow from its arguments.

A parser is a function of (path, text) to lists of nodes, edges, refs and imports, rows as in NODE, EDGE, REF and IMPORT. The table
function takes the files as a table: one call reads one file, files stay where the scan has put them, and nothing of other files is held.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

NODE = "id string, type string, name string, line_start int, line_end int, params array<string>, docstring string, return_type string"
EDGE = "source string, target string, type string"
REF = "source string, raw string, kind string, line int"
#: A name of an import statement: the path its module would have, what it is bound to, and the place of the statement's ref.
IMPORT = "module string, top string, name string, bound string, ref_at int"
KINDS = ("nodes", "edges", "refs", "imports")
#: What the function gives: a row for each file, or the rows of one kind.
OUTPUTS = ("files", *KINDS)
READ = ("path", "language", "content")

Parsed = tuple[list[tuple], list[tuple], list[tuple], list[tuple]]
Parser = Callable[[str, str], Parsed]


def _fits(value: Any, field: StructField) -> bool:
    if value is None:
        return True
    if isinstance(field.dataType, IntegerType):
        return isinstance(value, int) and not isinstance(value, bool) and -(2**31) <= value < 2**31
    if isinstance(field.dataType, StringType):
        return isinstance(value, str)
    return isinstance(value, (list, tuple)) and all(isinstance(v, str) for v in value)


class Parsers:
    """Parsers by language. ``register`` gives a new set, so that a set in use never changes."""

    def __init__(self, by_language: dict[str, Parser] | None = None):
        self.by_language = dict(by_language or {})

    def register(self, language: str, parser: Parser) -> Parsers:
        return Parsers({**self.by_language, language: parser})

    def function(self) -> type:
        """The class of the table function for this set."""
        types = [StructType.fromDDL(d) for d in (NODE, EDGE, REF, IMPORT)]
        lists = StructType.fromDDL("status string, error string, " + ", ".join(f"{k} array<struct<{d}>>" for k, d in zip(KINDS, (NODE, EDGE, REF, IMPORT))))
        own = {"files": lists, **{k: StructType([StructField("at", LongType()), *t]) for k, t in zip(KINDS, types)}}
        parsers = self.by_language

        def kept(names: list[str], output: str) -> list[str]:
            made = {f.name.lower() for f in own[output]} | {"content"}
            return [n for n in names if n.lower() not in made]

        def parse(path: str, language: str, content: bytes) -> tuple[str, str | None, Parsed]:
            nothing: Parsed = ([], [], [], [])
            if language not in parsers:
                return "skipped", None, nothing
            try:
                if content is None:
                    raise ValueError("no content")
                got = parsers[language](path, bytes(content).decode("utf-8"))
                for rows, t in zip(got, types, strict=True):
                    if not all(len(r) == len(t) and all(map(_fits, r, t)) for r in rows):
                        raise TypeError("rows that do not fit")
                return "parsed", None, got
            except Exception as e:  # a file that a parser fails on is a row of its own; the others go on
                return "error", f"{path}: {type(e).__name__}", nothing

        class Parse:
            @staticmethod
            def analyze(file: AnalyzeArgument, output: AnalyzeArgument) -> AnalyzeResult:
                if not file.isTable:
                    raise ValueError("the first argument must be a table of files")
                if not output.isConstantExpression or output.value not in own:
                    raise ValueError(f"the second argument must be one of {', '.join(own)}")
                names = [f.name for f in file.dataType]
                if missing := [c for c in READ if c not in names]:
                    raise ValueError(f"the table of files lacks {', '.join(missing)}")
                keep = kept(names, output.value)
                return AnalyzeResult(StructType([*(f for f in file.dataType if f.name in keep), *own[output.value]]))

            def eval(self, file: Row, output: str) -> Iterator[tuple]:
                held = tuple(file[c] for c in kept(file.__fields__, output))
                status, error, got = parse(file["path"], file["language"], file["content"])
                if output == "files":
                    yield (*held, status, error, *got)
                else:
                    for at, row in enumerate(got[KINDS.index(output)]):
                        yield (*held, at, *row)

        return Parse


def parse(files: DataFrame, parsers: Parsers, output: str = "files") -> DataFrame:
    """``files`` (path, language, content and others) parsed, by the parser of each file's language.

    Output "files": a row for each row of ``files``: its columns but the content, then status (parsed, skipped, error), error, nodes, edges, refs
    and imports. A language that no parser is registered for, null among them, is skipped; a file without content, one that is no UTF-8, one whose
    parser fails, and one whose parser gives rows that do not fit are errors with empty lists. Outputs "nodes", "edges", "refs" and "imports": a row for
    each of these of parsed files, with its place in its file (at). Input columns named like an output column give way to it. Repeated rows are
    parsed each; no files, no rows.
    """
    return F.udtf(parsers.function())(files.asTable(), F.lit(output))


def register(spark: SparkSession, parsers: Parsers, name: str = "parse_files") -> None:
    """Let SQL call the function: SELECT * FROM parse_files(TABLE(files), 'nodes')."""
    spark.udtf.register(name, F.udtf(parsers.function()))
