"""Text views of a graph: ordered lines as a table, joined into one text per graph only at the very end.

Every section is capped by a parameter, so a rendered text has a bounded number of lines however large the graph is. The layout
of the texts is our own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gneiss.functions import text as X
from gneiss.operators import flags, search, traverse
from gneiss.session import materialise

# Files in which assistant tools look for instructions.
FORMATS = {
    "claude": (".claude/skills/{slug}/SKILL.md", True),
    "copilot": (".github/copilot-instructions.md", False),
    "windsurf": (".windsurf/rules/{slug}.md", True),
    "cursor": (".cursor/rules/{slug}.mdc", True),
    "plain": ("{slug}.md", False),
}
TAGS = 2


def _lines(df: DataFrame, section: int, order: list[Column], line: Column) -> DataFrame:
    return df.select(F.lit(section).alias("section"), F.row_number().over(W.orderBy(*order)).alias("n"), line.alias("line"))


def _title(df: DataFrame, section: int, title: str) -> DataFrame:
    return df.sparkSession.range(1).select(F.lit(section).alias("section"), F.lit(0).alias("n"), F.lit(title).alias("line"))


def anchor_lines(nodes: DataFrame, edges: DataFrame, most_hubs: int = 20, most_clusters: int = 12, most_files: int = 30) -> DataFrame:
    """section, n, line: counts, frequent types, hubs, clusters, files and call paths of a flagged graph."""
    freq = lambda df, c: flags.frequency(df, c).orderBy(F.desc("n"), "value").limit(10)
    hubs = traverse.hubs(nodes, edges, most_hubs)
    near = traverse.priority_edges(edges, hubs, 8).groupBy("id").agg(F.concat_ws(", ", F.transform(F.array_sort(F.collect_list(F.struct("place", "other"))), lambda x: x["other"])).alias("to"))
    named = hubs.join(nodes.select("id", "type", "name", "file"), "id").join(near, "id", "left")
    clusters = flags.purposes(nodes, edges).orderBy(F.desc("n"), "community").limit(most_clusters)
    files = flags.file_index(nodes, edges, most_files)
    paths = traverse.call_paths(edges, hubs)
    tag = F.substring("type", 1, TAGS)
    parts = [
        (freq(nodes, "type"), [F.desc("n"), F.col("value")], F.concat_ws(" ", F.col("value"), F.col("n"), F.concat(F.lit("("), F.col("percent"), F.lit("%)"))), "Node types"),
        (freq(edges, "type"), [F.desc("n"), F.col("value")], F.concat_ws(" ", F.col("value"), F.col("n"), F.concat(F.lit("("), F.col("percent"), F.lit("%)"))), "Edge types"),
        (named, [F.col("hub_rank")], F.concat(F.lit("["), tag, F.lit("] "), F.col("name"), F.lit(" in "), F.col("file"), F.coalesce(F.concat(F.lit(" -> "), F.col("to")), F.lit(""))), "Hubs"),
        (clusters, [F.desc("n"), F.col("community")], F.concat_ws(" ", F.concat(F.lit("#"), F.col("community")), F.col("n"), F.col("prefix"), F.col("hub")), "Clusters"),
        (files, [F.col("file")], F.concat_ws(" ", F.col("file"), F.concat(F.lit("#"), F.col("community")), F.col("members")), "Files"),
        (paths, [F.col("place")], F.array_join("path", " > "), "Call paths"),
    ]
    out = None
    for section, (df, order, line, title) in enumerate(parts):
        part = _title(df, section, title).unionByName(_lines(df, section, order, line))
        out = part if out is None else out.unionByName(part)
    return out


def query_lines(nodes: DataFrame, edges: DataFrame, query: str, top_k: int = 6, most: int = 8) -> DataFrame:
    """The hits of a question, or the first gods if there is none, each with its first neighbours each way."""
    hits = search.seeds(nodes, search.search(nodes, query, edges, top_k), top_k)
    near = traverse.neighbours(nodes, edges, hits, most).groupBy("id").agg(F.concat_ws(", ", F.transform(F.array_sort(F.collect_list(F.struct("direction", "place", "other_name"))), lambda x: F.concat(F.when(x["direction"] == "in", "<- ").otherwise("-> "), X.truncated(x["other_name"], 40, "")))).alias("near"))
    full = hits.join(nodes.select("id", "name", "type", "file"), "id").join(near, "id", "left")
    return _lines(full, 0, [F.col("rank")], F.concat(F.col("type"), F.lit(" "), F.col("name"), F.lit(" in "), F.col("file"), F.coalesce(F.concat(F.lit(": "), F.col("near")), F.lit(""))))


def context_lines(nodes: DataFrame, edges: DataFrame, query: str, top_k: int = 6, most: int = 20, shown: int = 8, clusters: int = 4, members: int = 12, named: int = 10) -> DataFrame:
    """section, n, line: the hits of a question, or the first gods if there is none, by rank, each with its place, community and first neighbours
    each way; then the communities that the hits meet first, with their size and first members, gods starred.

    Columns line_start and line_end may be missing; null names fall back to ids, and what is null or empty is left out of a line.
    """
    hits = materialise(search.seeds(nodes, search.search(nodes, query, edges, top_k), top_k).select("rank", "id"), "hits")
    label = F.concat("other_name", F.coalesce(F.concat(F.lit(" ("), "type", F.lit(")")), F.lit("")))
    near = traverse.neighbours(nodes, edges, hits, most).filter(F.col("place") <= shown).select("id", "direction", F.struct("place", label.alias("label")).alias("near"))
    way = lambda d: F.nullif(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("direction") == d, F.col("near")))), lambda x: x["label"]), ", "), F.lit(""))
    ways = near.groupBy("id").agg(way("out").alias("out"), way("in").alias("in"))
    first, last = (F.col(c) if c in nodes.columns else F.lit(None).cast("int") for c in ("line_start", "line_end"))
    span = F.when(first > 0, F.concat(F.lit(":"), first, F.coalesce(F.when(last > 0, F.concat(F.lit("-"), last)), F.lit("")))).otherwise("")
    own = nodes.select("id", "type", "name", "community", "is_god", "is_orphan", F.concat(F.nullif("file", F.lit("")), span).alias("at"))
    full = own.join(F.broadcast(hits), "id").join(ways, "id", "left")  # at most top_k rows
    tag = F.when(F.col("is_god"), "[hub]").when(F.col("is_orphan"), "[orphan]")
    parts = [F.coalesce("type", F.lit("node")), F.coalesce("name", "id"), tag, *[F.concat(F.lit(mark), c) for mark, c in (("#", "community"), ("in ", "at"), ("-> ", "out"), ("<- ", "in"))]]
    met = traverse.first_communities(nodes, hits, clusters)
    sizes, listed = traverse.community(nodes, hits, members)
    starred = F.struct("place", F.concat(F.coalesce("name", "id"), F.when(F.col("is_god"), "*").otherwise("")).alias("name"))
    names = listed.filter(F.col("place") <= named).join(nodes.select("id", "is_god"), "id").groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(starred)), lambda x: x["name"]), ", ").alias("names"))
    groups = sizes.join(F.broadcast(met), "community").join(names, "community")  # at most as many rows as clusters
    group = F.concat(F.lit("#"), "community", F.lit(": "), "members", F.lit(" members, "), "gods", F.lit(" hubs"), F.when(F.col("truncated"), ", cut").otherwise(""), F.lit(": "), "names")
    out = _title(nodes, 0, "Hits").unionByName(_lines(full, 0, [F.col("rank")], F.concat_ws(" ", *parts)))
    return out.unionByName(_title(nodes, 1, "Communities")).unionByName(_lines(groups, 1, [F.col("place")], group))


def joined(lines: DataFrame) -> DataFrame:
    """One text of capped lines."""
    return lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "n", "line"))), lambda x: x["line"]), "\n").alias("text"))


def skill_file(text: DataFrame, repo: str, sha: str, tool: str) -> tuple[str, DataFrame]:
    """(path, text) of a file for an assistant tool; some have a head of fields. Unknown tools are an error."""
    if tool not in FORMATS:
        raise ValueError(f"unknown tool {tool}; known: {', '.join(FORMATS)}")
    path, head = FORMATS[tool]
    slug = "".join(c if c.isalnum() else "-" for c in repo.lower()).strip("-")
    front = f"---\nname: {slug}\ndescription: structure of {repo} at {sha[:8]}\n---\n" if head else ""
    return path.format(slug=slug), text.select(F.concat(F.lit(front), F.col("text")).alias("text"))


def write_skill_file(text: DataFrame, root: str, repo: str, sha: str, tool: str) -> str:
    """Write such a file under a folder, over an older one, and return its path. The text is one row of capped lines; an empty table is an empty text."""
    path, content = skill_file(text, repo, sha, tool)
    row, spark = content.first(), text.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{path}")
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        stream.write(bytearray((row["text"] or "" if row else "").encode()))
    finally:
        stream.close()
    return at.toString()


def transcript(messages: DataFrame) -> DataFrame:
    """conv_id, text: a conversation's turns (conv_id, turn, role, text) in order."""
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return messages.groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda x: F.concat(F.lit("**"), x["role"], F.lit("**\n\n"), x["text"])), "\n\n").alias("text"))


def totals(messages: DataFrame, columns: list[str]) -> DataFrame:
    """Sums of figures over all messages, null as nothing."""
    return messages.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns])
