"""Symbol resolution: references joined to an index of names, then narrowed by package, receiver or path.

No list of candidates is made. The index is counted by name, by name and each folder above the file, by name and class, and by
name and file name, each with the least id; a reference joins these by equality, and a count of one is its target. References
are reduced to distinct questions first, so that a name that many files use is asked once a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions import text as X
from gneiss.session import materialise

# Names of calls that are never looked up, and the texts that tell how a target was found.
JAVA_DENY = (
    "toString", "hashCode", "equals", "compareTo", "clone", "finalize", "wait", "notify", "notifyAll", "getClass",
    "debug", "info", "warn", "error", "trace", "fatal", "isDebugEnabled", "isInfoEnabled", "isWarnEnabled", "isErrorEnabled",
    "build",
    "save", "saveAll", "saveAndFlush", "saveAllAndFlush", "findById", "findAll", "findAllById", "findOne",
    "deleteById", "delete", "deleteAll", "deleteAllById", "deleteAllInBatch", "existsById", "count", "flush", "getOne", "getById", "getReferenceById",
)
JS_DENY = (
    "toString", "valueOf", "hasOwnProperty", "isPrototypeOf", "propertyIsEnumerable", "toLocaleString",
    "log", "debug", "info", "warn", "error", "trace", "group", "groupEnd", "table", "assert", "clear", "count", "time", "timeEnd", "timeLog", "dir",
)
UNIQUE, PACKAGE, RECEIVER, PATH = "symbol_index: unique match", "symbol_index: same-package heuristic", "symbol_index: receiver-class heuristic", "symbol_index: FQN path heuristic"
ORDER = {"python": 0, "java": 1, "javascript": 2, "generic": 3}


def _dialect(language: Column) -> Column:
    return F.when(language == "python", "python").when(language == "java", "java").when(language.isin("javascript", "typescript", "tsx"), "javascript").otherwise("generic")


def symbol(raw: Column, kind: Column, of: Column) -> Column:
    """The name that a reference is looked up by; '' if it names none or several."""

    def one(d: str) -> Column:
        return F.when(kind == "call", X.call_name(raw, d)).when(kind == "import", X.import_name(raw, d)).when(kind == "decorator", X.call_name(F.regexp_replace(raw, "^@", ""), d)).otherwise(F.substring_index(X.strip_generics(raw, d != "java"), ".", -1))

    out = one("generic")
    for d in ("python", "java", "javascript"):
        out = F.when(of == d, one(d)).otherwise(out)
    return out


def _counted(index: DataFrame, *keys: str) -> DataFrame:
    return index.groupBy("name", *keys).agg(F.count("*").alias("k"), F.min("id").alias("c"))


def _look(asks: DataFrame, table: DataFrame, keys: dict[str, str], step: str) -> DataFrame:
    """``asks`` with how many entries of a table meet it (k_step) and, of one, which (c_step)."""
    there = table.select("name", *[F.col(c).alias(own) for c, own in keys.items()], F.col("k").alias(f"k_{step}"), F.col("c").alias(f"c_{step}"))
    return asks.join(there, ["name", *keys.values()], "left")


def narrow(asks: DataFrame, index: DataFrame) -> DataFrame:
    """``asks`` (name, dialect, kind, raw, file_) with target and reasoning, null where no step leaves exactly one candidate.

    Steps, in order: the file's folder with all below it (or the file itself); the folder above; in Java the class that a call's
    receiver names, and the file that an import's path, or the path of its class, ends. An import of a file without a package is
    matched by the whole name of the file.
    """
    java, call, imports = F.col("dialect") == "java", F.col("kind") == "call", F.col("kind") == "import"
    file, path = X.file_of(F.col("id")), F.split("file", "/")
    index = index.select("name", "id", file.alias("file"))
    above = F.transform(F.sequence(F.lit(1), F.size(path) - 1), lambda n: F.array_join(F.slice(path, F.lit(1), n), "/"))
    folders = _counted(index.filter(F.size(path) > 1).select("name", "id", F.explode(above).alias("folder")), "folder")
    classes = _counted(index.select("name", "id", F.regexp_extract("id", r"::([^.:]+)\.", 1).alias("class")).filter(F.startswith(F.substring_index("id", "::", -1), F.concat("class", F.lit("."), "name"))), "class")
    files = _counted(index, "file").withColumn("base", F.substring_index("file", "/", -1)).filter(F.endswith("file", F.lit(".java")))

    folder = X.dir_of(F.col("file_"))
    plain = java | F.col("kind").isin("import", "inherits", "decorator")
    chain = F.filter(F.split(F.regexp_extract(F.substring_index("raw", "(", 1), r"^(.*)\.", 1), r"\."), lambda x: ~F.trim(x).isin("", "this", "super"))
    receiver = F.when(java & call & (F.size(chain) > 0), F.trim(F.element_at(chain, -1)))
    capital = F.concat(F.upper(F.substring(receiver, 1, 1)), F.substring(receiver, 2, 1 << 30))
    cleaned = F.trim(F.regexp_replace(F.regexp_replace(F.trim("raw"), r";\s*$", ""), r"^import\s+(?:static\s+)?", ""))
    whole = F.when(java & imports & ~F.endswith(cleaned, F.lit("*")), F.regexp_replace(cleaned, r"\.", "/"))
    asks = asks.select(
        "*", F.when(plain & (folder != ""), folder).alias("own"), F.when(plain & (folder == ""), F.col("file_")).alias("lone"), F.when(plain & F.contains(folder, F.lit("/")), X.dir_of(folder)).alias("parent"),
        capital.alias("cls"), F.when(receiver != capital, F.concat(capital, F.lit("Impl"))).alias("impl"), F.concat(whole, F.lit(".java")).alias("whole"), F.when(F.contains(whole, F.lit("/")), F.concat(X.dir_of(whole), F.lit(".java"))).alias("short"),
    )
    asks = _look(asks, folders, {"folder": "own"}, "own")
    asks = _look(asks, _counted(index, "file"), {"file": "lone"}, "lone")
    asks = _look(asks, folders, {"folder": "parent"}, "parent")
    asks = _look(asks, classes, {"class": "cls"}, "cls")
    asks = _look(asks, classes, {"class": "impl"}, "impl")
    for of in ("whole", "short"):
        ends = asks.filter(F.col(of).isNotNull()).select("name", of).distinct().withColumn("base", F.substring_index(of, "/", -1)).join(files, ["name", "base"])
        ends = ends.filter(F.endswith("file", of)).groupBy("name", of).agg(F.sum("k").alias(f"k_{of}"), F.min("c").alias(f"c_{of}"))
        asks = asks.join(ends, ["name", of], "left")
    both = F.coalesce("k_cls", F.lit(0)) + F.coalesce("k_impl", F.lit(0))
    steps = [(F.col("k_own") == 1, F.col("c_own"), PACKAGE), (F.col("k_lone") == 1, F.col("c_lone"), PACKAGE), (F.col("k_parent") == 1, F.col("c_parent"), PACKAGE),
             (both == 1, F.coalesce("c_cls", "c_impl"), RECEIVER), (F.col("k_whole") == 1, F.col("c_whole"), PATH), (F.col("k_short") == 1, F.col("c_short"), PATH)]
    target, reasoning = F.lit(None).cast("string"), F.lit(None).cast("string")
    for met, c, why in reversed(steps):
        target, reasoning = F.when(met, c).otherwise(target), F.when(met, F.lit(why)).otherwise(reasoning)
    return asks.select("name", "dialect", "kind", "raw", "file_", target.alias("target"), F.when(F.col("dialect") == "generic", F.when(target.isNotNull(), UNIQUE)).otherwise(reasoning).alias("reasoning"))


def resolve(refs: DataFrame, nodes: DataFrame, java_deny: tuple[str, ...] = JAVA_DENY, js_deny: tuple[str, ...] = JS_DENY) -> DataFrame:
    """Each reference (ord, source, raw, kind, file) with dialect, outcome (resolve, pass, drop), target and reasoning.

    A reference whose kind makes no edge is dropped once it has a target. How many references a row stands for (times) is kept where it is given.
    """
    refs = refs.select(*[c for c in ("ord", "source", "raw", "kind", "file", "times") if c in refs.columns])
    # dialect and name are evaluated once, as lambda variables: as plain columns they would be written out in each branch that tests them
    r = refs.withColumn("dialect", F.transform(F.array(X.language_of(F.col("file"), lower=False)), _dialect)[0])
    r = r.withColumn("name", F.transform(F.array("dialect"), lambda d: F.coalesce(symbol(F.col("raw"), F.col("kind"), d), F.lit("")))[0])
    denied = (F.col("kind") == "call") & (((F.col("dialect") == "java") & F.col("name").isin(*java_deny)) | ((F.col("dialect") == "javascript") & F.col("name").isin(*js_deny)))
    index = nodes.filter("name is not null and name <> ''")
    counted = index.groupBy("name").agg(F.count("*").alias("k"), F.min("id").alias("only"))
    r = r.join(counted, "name", "left").withColumn("k", F.when(denied | (F.col("name") == ""), 0).otherwise(F.coalesce("k", F.lit(0))))
    # names are found and counted once, and not anew for each use
    r = materialise(r.withColumn("file_", X.file_of(F.col("source"))), "references")
    keys = ["name", "dialect", "kind", "raw", "file_"]
    found = narrow(r.filter("k > 1").select(*keys).distinct(), index.select("name", "id"))
    r = r.join(found, keys, "left")
    edge = X.edge_of_kind(F.col("kind")).isNotNull()
    target = F.when(F.col("k") == 1, F.col("only")).when(F.col("k") > 1, F.col("target"))
    outcome = F.when(F.col("k") == 0, "drop").when(target.isNotNull(), F.when(edge, "resolve").otherwise("drop")).when((F.col("dialect") == "java") & (F.col("kind") == "import"), "drop").otherwise("pass")
    reasoning = F.when(F.col("k") == 1, UNIQUE).otherwise(F.col("reasoning"))
    made = F.when(outcome == "resolve", target)
    return r.select(*refs.columns, "dialect", outcome.alias("outcome"), made.alias("target"), F.when(made.isNotNull(), reasoning).alias("reasoning"))


def alike(refs: DataFrame) -> DataFrame:
    """A row for all references that ``resolve`` can't but answer alike: the first ord, the file of their sources for source, and how many (times)."""
    return refs.groupBy("raw", "kind", "file", X.file_of(F.col("source")).alias("source")).agg(F.min("ord").alias("ord"), F.count("*").alias("times"))


def resolved_edges(found: DataFrame) -> DataFrame:
    """INFERRED edges of the resolved references, in the order Python, Java, JavaScript, others, then as given."""
    lang = F.try_element_at(F.create_map(*[F.lit(x) for kv in ORDER.items() for x in kv]), F.col("dialect"))
    return found.filter("outcome = 'resolve'").select(
        (lang * F.lit(10**15) + F.col("ord")).alias("ord"), "source", "target", X.edge_of_kind(F.col("kind")).alias("type"), F.lit("INFERRED").alias("confidence"), F.lit(1.0).alias("weight"),
        F.create_map(F.lit("reasoning"), "reasoning", F.lit("raw"), "raw").alias("metadata"),
    )


def outcomes(found: DataFrame) -> DataFrame:
    """dialect, kind, outcome, reasoning, n and percent (of all references, one decimal)."""
    times = F.sum("times") if "times" in found.columns else F.count("*")
    n = found.groupBy("dialect", "kind", "outcome", "reasoning").agg(times.alias("n"))
    return n.join(F.broadcast(n.agg(F.sum("n").alias("all")))).select("dialect", "kind", "outcome", "reasoning", "n", F.round(100 * F.col("n") / F.col("all"), 1).alias("percent"))
