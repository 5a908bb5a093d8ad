"""Source trees, diffs and payloads read as tables, and Python files parsed into graph rows."""

from __future__ import annotations

import ast
import builtins

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.functions import text as X
from gneiss.sources import parsers

MAX_BYTES = 1_000_000
SKIPPED_DIRS = ("node_modules", "__pycache__", "venv", "env", "build", "dist", "target", "out", "vendor", "coverage", "site-packages")
# Endings that a relative script import may name, those tried in its place, and the files that stand for a folder.
SCRIPT_ENDINGS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
TRIED_ENDINGS = (".ts", ".tsx", ".js", ".jsx", ".mjs")
INDEX_FILES = ("index.ts", "index.tsx", "index.js")
SKIPPED_EXTENSIONS = ("properties", "yaml", "yml", "json", "xml")


def relative(path: Column, root: str) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "^file:/*", "/"), "^" + root.rstrip("/").replace(".", r"\.") + "/", "")


def is_source(path: Column) -> Column:
    """Whether a relative path is read: no hidden, skipped or test folder, no hidden file, no data format."""
    parts = F.split(path, "/")
    dirs, name = F.slice(parts, F.lit(1), F.size(parts) - 1), F.element_at(parts, -1)
    bad = F.exists(dirs, lambda d: d.isin(*SKIPPED_DIRS) | F.startswith(d, F.lit(".")) | F.contains(F.lower(d), F.lit("test")))
    return ~bad & ~F.startswith(name, F.lit(".")) & ~F.lower(X.extension(path)).isin(*SKIPPED_EXTENSIONS)


def scan(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """path, language, length, content of the source files under a folder; the size limit is pushed into the scan."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).filter(F.col("length") <= max_bytes)
    files = files.withColumn("path", relative(F.col("path"), root.removeprefix("file://")))
    return files.filter(is_source(F.col("path"))).select("path", X.language_of(F.col("path")).alias("language"), "length", "content")


def inside(path: Column) -> Column:
    """A relative path with . and .. worked out; null if it is absolute or climbs out of the root."""
    step = lambda at, x: F.when(x != "..", F.array_append(at, x)).when(F.size(at) > 0, F.slice(at, 1, F.size(at) - 1))
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    whole = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.when(~F.startswith(path, F.lit("/")), F.when(whole.isNotNull(), F.array_join(whole, "/")))


def asked(files: DataFrame, paths: DataFrame) -> DataFrame:
    """asked, path, outcome of each distinct path that is asked for (column path): found; missing among ``files``, null paths too; or refused, since it
    is absolute or climbs out of the root. ``path`` is what the files call it."""
    wanted = paths.select(F.col("path").alias("asked"), inside(F.col("path")).alias("path")).distinct()
    there = files.select("path", F.lit(True).alias("there")).distinct()
    outcome = F.when(F.col("there"), "found").when(F.col("path").isNull() & F.col("asked").isNotNull(), "refused").otherwise("missing")
    return wanted.join(there, "path", "left").select("asked", "path", outcome.alias("outcome"))


def only(files: DataFrame, paths: DataFrame) -> DataFrame:
    """The listed files (column path); paths that climb out of the root are refused, see ``asked``."""
    return files.join(paths.select(inside(F.col("path")).alias("path")).distinct(), "path", "left_semi")


def name_status(lines: DataFrame) -> DataFrame:
    """status, path, old_path from tab-separated diff lines (value); codes other than A, M, D and R are left out."""
    p = F.split("value", "\t")
    code = F.substring(F.get(p, F.lit(0)), 1, 1)
    rows = lines.select(code.alias("status"), F.get(p, F.lit(1)).alias("a"), F.get(p, F.lit(2)).alias("b")).filter(F.col("status").isin("A", "M", "D") | ((F.col("status") == "R") & F.col("b").isNotNull()))
    return rows.select("status", F.when(F.col("status") == "R", F.col("b")).otherwise(F.col("a")).alias("path"), F.when(F.col("status") == "R", F.col("a")).alias("old_path"))


def payload_items(text: Column) -> Column:
    """The list in a JSON reply: itself, or under items, data, results or value; null if there is none."""
    v = F.try_parse_json(text)
    here = F.try_variant_get(v, "$", "array<variant>")
    for name in ("items", "data", "results", "value"):
        here = F.coalesce(here, F.try_variant_get(v, f"$.{name}", "array<variant>"))
    return here


def decoded_content(content: Column, encoding: Column) -> Column:
    return F.when(encoding == "base64", F.try_to_binary(F.regexp_replace(content, r"\s", ""), F.lit("base64")).cast("string")).otherwise(content)


# Python files: the tree of one file is the only thing held

_BUILTIN = frozenset(dir(builtins)) | {m for t in (str, list, dict, set, bytes, int, float, tuple) for m in dir(t)}


class _Walk(ast.NodeVisitor):
    """The definitions of one module, and what they call, extend, decorate and import."""

    def __init__(self, path: str, text: str):
        self.path, self.text = path, text
        self.nodes: list[tuple] = []
        self.edges: list[tuple] = []
        self.refs: list[tuple] = []
        self.imports: list[tuple] = []
        tree = ast.parse(text)
        self.local = {d.name: f"{path}::{d.name}" for d in tree.body if isinstance(d, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))}
        self._node(path, "module", path.rsplit("/", 1)[-1].rsplit(".", 1)[0], 1, text.count("\n") + 1, [], ast.get_docstring(tree), None)
        for d in tree.body:
            if isinstance(d, (ast.Import, ast.ImportFrom)):
                self._import(d)
                self.refs.append((path, ast.unparse(d), "import", d.lineno))
        self.bound = {i[3] for i in self.imports}
        for d in tree.body:
            if isinstance(d, ast.ClassDef):
                self._class(d)
            elif isinstance(d, (ast.FunctionDef, ast.AsyncFunctionDef)):
                self._function(d, path, None, {})

    def _node(self, *row) -> None:
        self.nodes.append(row)

    def _import(self, d: ast.Import | ast.ImportFrom) -> None:
        at = len(self.refs)
        if isinstance(d, ast.Import):  # binds no name that is called or extended bare
            self.imports += [(a.name.replace(".", "/"), a.name.split(".")[0], None, None, at) for a in d.names]
            return
        parts = d.module.split(".") if d.module else []
        up = self.path.split("/")[:-1] if d.level else []
        base = up[: max(len(up) - d.level + 1, 0)] + parts
        for a in d.names:
            bound = None if a.name == "*" else a.asname or a.name
            if parts:
                self.imports.append(("/".join(base), None if d.level else parts[0], None if bound is None else a.name, bound, at))
            else:  # from . import a: the name is a module itself
                self.imports.append(("/".join([*base, a.name]), None, None, bound, at))

    def _named(self, owner: str, expr: ast.expr, kind: str, edge: str, known: bool = False) -> None:
        raw = ast.unparse(expr)
        if isinstance(expr, ast.Name) and expr.id in self.local:
            self.edges.append((owner, self.local[expr.id], edge))
        elif isinstance(expr, ast.Name) and expr.id in self.bound:
            self.refs.append((owner, raw, kind, expr.lineno))
        elif not known and not (isinstance(expr, ast.Name) and expr.id in _BUILTIN):
            self.refs.append((owner, raw, kind, expr.lineno))

    def _class(self, d: ast.ClassDef) -> None:
        me = f"{self.path}::{d.name}"
        self._node(me, "class", d.name, d.lineno, d.end_lineno, [], ast.get_docstring(d), None)
        self.edges.append((self.path, me, "CONTAINS"))
        for base in d.bases:
            self._named(me, base, "inherits", "INHERITS")
        for deco in d.decorator_list:
            self._named(me, deco, "decorator", "DECORATES", known=True)
        own = {f.name: f"{me}.{f.name}" for f in d.body if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef))}
        for f in d.body:
            if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)):
                self._function(f, me, me, own)

    def _function(self, d: ast.FunctionDef | ast.AsyncFunctionDef, parent: str, owner: str | None, own: dict) -> None:
        me = f"{owner}.{d.name}" if owner else f"{self.path}::{d.name}"
        a = d.args
        params = [ast.unparse(x) for x in (*a.posonlyargs, *a.args)] + ([f"*{a.vararg.arg}"] if a.vararg else []) + [ast.unparse(x) for x in a.kwonlyargs] + ([f"**{a.kwarg.arg}"] if a.kwarg else [])
        self._node(me, "method" if owner else "function", d.name, d.lineno, d.end_lineno, params, ast.get_docstring(d), ast.unparse(d.returns) if d.returns else None)
        self.edges.append((parent, me, "CONTAINS"))
        for deco in d.decorator_list:
            self._named(me, deco, "decorator", "DECORATES", known=True)
        stack = list(d.body)
        while stack:
            n = stack.pop(0)
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)):
                continue
            if isinstance(n, ast.Call):
                self._call(me, n, own)
            stack += ast.iter_child_nodes(n)

    def _call(self, me: str, n: ast.Call, own: dict) -> None:
        f = n.func
        if isinstance(f, ast.Name):
            self._named(me, f, "call", "CALLS")
        elif isinstance(f, ast.Attribute):
            if isinstance(f.value, ast.Name) and f.value.id in ("self", "cls") and f.attr in own:
                self.edges.append((me, own[f.attr], "CALLS"))
            elif f.attr not in _BUILTIN and not f.attr.startswith("__"):
                self.refs.append((me, ast.unparse(f), "call", n.lineno))


def python_module(path: str, text: str) -> parsers.Parsed:
    """The rows of one Python file."""
    w = _Walk(path, text)
    return w.nodes, w.edges, w.refs, w.imports


#: The parsers that come with the library; ``register`` adds others.
PARSERS = parsers.Parsers({"python": python_module})


def parse_files(files: DataFrame, known: parsers.Parsers = PARSERS) -> DataFrame:
    """Each file with status, error, nodes, edges, refs and imports, see ``parsers.parse``."""
    return parsers.parse(files, known)


def parse_python(files: DataFrame) -> DataFrame:
    """The Python files alone, parsed; a file that can't be read or parsed has an error and nothing else."""
    return parse_files(files.filter("language = 'python'"))


def tables(parsed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, edges and refs of parsed files; ord is the row's place in its file, after a hash of the path."""
    base = F.pmod(F.xxhash64("path"), F.lit(2**42)) * F.lit(2**20)

    def rows(c: str) -> DataFrame:
        found = parsed.select("path", "language", F.posexplode(c).alias("at", "x"))
        return found.select((base + F.col("at")).alias("ord"), "x.*", F.col("path").alias("file"), "language")

    return rows("nodes"), rows("edges").drop("file", "language"), rows("refs").drop("language")


def link(parsed: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges and refs of parsed files with their imports looked up among the files (path).

    An import of a file is an IMPORTS edge, one of a package that has no file here is dropped, and others stay refs. A bare call,
    base or decorator whose name is bound by an import is an edge to what it is bound to.
    """
    _, edges, refs = tables(parsed)
    base = F.pmod(F.xxhash64("path"), F.lit(2**42)) * F.lit(2**20)
    python = files.filter(F.endswith("path", F.lit(".py"))).select("path", F.regexp_replace("path", r"\.py$", "").alias("stem"))
    packages = python.filter(F.endswith("stem", F.lit("/__init__"))).select(F.regexp_replace("stem", "/__init__$", "").alias("module"), F.struct(F.lit(1).alias("p"), "path").alias("f"))
    modules = python.select(F.col("stem").alias("module"), F.struct(F.lit(0).alias("p"), "path").alias("f")).unionByName(packages).groupBy("module").agg(F.min("f").getField("path").alias("found"))
    first = F.split_part("path", F.lit("/"), F.lit(1))
    tops = files.select(F.when(F.contains("path", F.lit("/")), first).otherwise(F.regexp_replace("path", r"\.py$", "")).alias("top")).distinct().withColumn("ours", F.lit(True))
    i = parsed.select("path", F.posexplode("imports").alias("at", "x")).select("path", base.alias("base"), "at", "x.*")
    i = i.join(modules, "module", "left").join(tops, "top", "left")
    i = i.withColumn("done", F.col("found").isNotNull() | (F.col("top").isNotNull() & F.col("ours").isNull()))
    done = i.filter("done").select((F.col("base") + F.col("ref_at")).alias("ord"), F.col("path").alias("file")).distinct()
    found = i.filter("found is not null")
    imports = found.groupBy("path", "base", "ref_at", "found").agg(F.min("at").alias("at"))
    imports = imports.select((F.col("base") + 2**18 + F.col("at")).alias("ord"), F.col("path").alias("source"), F.col("found").alias("target"), F.lit("IMPORTS").alias("type"))

    to = F.when(F.col("name").isNull(), F.col("found")).otherwise(F.concat("found", F.lit("::"), "name"))
    bound = found.filter("bound is not null").groupBy(F.col("path").alias("file"), F.col("bound").alias("raw")).agg(F.max(F.struct("at", to.alias("to"))).getField("to").alias("to"))
    left = refs.join(done.withColumn("kind", F.lit("import")), ["ord", "file", "kind"], "left_anti").join(bound, ["file", "raw"], "left")
    named = F.col("kind").isin("call", "inherits", "decorator") & F.col("to").isNotNull()
    uses = left.filter(named).select((F.col("ord") + 2**19).alias("ord"), "source", F.col("to").alias("target"), X.edge_of_kind(F.col("kind")).alias("type"))
    foreign = (F.col("kind") == "decorator") | (F.col("kind").isin("call", "inherits") & F.col("raw").isin(*sorted(_BUILTIN)))  # bound, but to nothing of ours
    return edges.unionByName(imports).unionByName(uses), left.filter(~named & ~foreign).select(*refs.columns)


def script_imports(refs: DataFrame, files: DataFrame) -> DataFrame:
    """``refs`` (file, specifier) with the column resolved: the file (path) that a relative import of a script names, or null.

    In this order: the path as written, with another ending, as a folder with an index file. Packages, paths that climb out of the root and
    null specifiers are null; repeated rows stay; an input column resolved is replaced.
    """
    step = lambda at, x: F.when(x != "..", F.array_append(at, x)).when(F.size(at) > 0, F.slice(at, 1, F.size(at) - 1))
    whole = F.filter(F.split(F.concat_ws("/", X.dir_of(F.col("file")), "specifier"), "/"), lambda x: ~x.isin("", "."))
    asked = refs.select("file", "specifier").distinct().filter(F.startswith("specifier", F.lit("./")) | F.startswith("specifier", F.lit("../")))
    asked = asked.withColumn("base", F.array_join(F.aggregate(whole, F.array().cast("array<string>"), step), "/"))
    written = F.when(F.regexp_extract("base", r"[^/](\.[^./]+)$", 1).isin(*SCRIPT_ENDINGS), F.col("base"))
    stem = F.when(F.col("base") != "", F.regexp_replace("base", r"(?<=[^/])\.[^./]+$", ""))
    folder = F.when(F.col("base") == "", "").otherwise(F.concat("base", F.lit("/")))
    tried = F.array(written, *[F.concat(stem, F.lit(e)) for e in TRIED_ENDINGS], *[F.concat(folder, F.lit(i)) for i in INDEX_FILES])
    options = asked.select("file", "specifier", F.posexplode(tried).alias("rank", "path"))
    found = options.join(files.select("path").distinct(), "path").groupBy("file", "specifier").agg(F.min_by("path", "rank").alias("resolved"))
    return refs.drop("resolved").join(found, ["file", "specifier"], "left")


def parse_stats(parsed: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """files_parsed, files_skipped, languages (files parsed by language) and errors of ``parse_files``, one row.

    Files without a parser are skipped, broken ones are errors. Where the files were listed (``asked``), missing ones count as skipped, and refused
    ones as skipped and as errors. Nothing parsed gives zeros, no languages and no errors.
    """
    told = parsed.select("status", "language", "error")
    if listed is not None:
        why = F.when(F.col("outcome") == "refused", F.concat("asked", F.lit(": refused")))
        told = told.unionByName(listed.filter("outcome <> 'found'").select(F.lit("skipped").alias("status"), F.lit(None).cast("string").alias("language"), why.alias("error")))
    by = told.groupBy("language").agg(F.count_if(F.col("status") == "parsed").cast("int").alias("n"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.collect_list("error").alias("errors"))
    some = F.collect_list(F.when(F.col("n") > 0, F.struct("language", "n")))  # one for each language
    all_of = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("parsed"), F.coalesce(F.sum("skipped"), F.lit(0)).alias("skipped"), F.map_from_entries(some).alias("languages"), F.array_sort(F.flatten(F.collect_list("errors"))).alias("errors"))
    return all_of.select(F.col("parsed").cast("int").alias("files_parsed"), F.col("skipped").cast("int").alias("files_skipped"), "languages", "errors")
