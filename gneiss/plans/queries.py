"""The registered graph queries and the SQL they are held against. All run over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.functions import text as X
from gneiss.operators import answers, build, cluster, flags, index, merge, render, resolve, search, traverse
from gneiss.plans import views
from gneiss.session import delete_at_end, materialise, scratch_path
from gneiss.sources import payloads
from gneiss.streaming import messages, patches

QUERY = "the pathetic loser and the trash"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = "WITH " + views.SQL + "\n" + sql if "g_" in sql and not sql.startswith("WITH ") else sql
        return f

    return add


def _built(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The built graph, written: edges first, since externals are found among their ends, and so their joins are made once."""
    g = views.graph(spark, sf_dir)
    edges = materialise(build.valid_edges(g.edges), "edges")
    return materialise(build.build(g.nodes, edges)[0], "nodes"), edges


def flagged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The built graph with its flags."""
    nodes, edges = _built(spark, sf_dir)
    return materialise(flags.flagged(nodes, edges).filter("id is not null"), "flagged"), edges


TYPES = "('IMPORTS', 'CALLS', 'CONTAINS', 'INHERITS', 'DECORATES', 'RELATES_TO', 'DEPENDS_ON')"
TERMS = ", ".join(f"('{t}', {n})" for t, n in sorted({t: X.query_terms(QUERY).count(t) for t in X.query_terms(QUERY)}.items()))
#: The built graph: externals added, edges of known types kept, and flags.
BUILT = f""",
ve AS (SELECT * FROM g_edges WHERE type IN {TYPES}),
ends AS (SELECT source AS id FROM ve UNION SELECT target FROM ve),
ext AS (SELECT id FROM ends WHERE id NOT IN (SELECT id FROM g_nodes)),
bn AS (SELECT ord, id, type, name, file, community FROM g_nodes UNION ALL SELECT NULL, id, 'external', id, '', NULL FROM ext),
ne AS (SELECT DISTINCT * FROM (SELECT source AS id, target AS other FROM ve UNION ALL SELECT target, source FROM ve) WHERE id <> other),
sprd AS (SELECT a.id, count(DISTINCT CASE WHEN b.community IS DISTINCT FROM a.community THEN b.community END) AS n
  FROM ne JOIN bn a ON ne.id = a.id JOIN bn b ON ne.other = b.id WHERE b.community IS NOT NULL GROUP BY 1),
deg AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM ve UNION ALL SELECT target FROM ve) GROUP BY 1),
fl AS (SELECT bn.id, coalesce(sprd.n, 0) >= 2 AS is_god, deg.degree IS NULL AS is_orphan FROM bn LEFT JOIN sprd USING (id) LEFT JOIN deg USING (id)),
fn AS (SELECT bn.*, is_god, is_orphan, coalesce(degree, 0) AS degree FROM bn JOIN fl USING (id) LEFT JOIN deg USING (id)),
adj AS (SELECT source AS node, target AS other, 'out' AS direction, type, ord * 2 AS adj_ord, source, target, weight FROM ve
  UNION ALL SELECT target, source, 'in', type, ord * 2 + 1, source, target, weight FROM ve)
"""
_SPLIT = "string_split(regexp_replace(regexp_replace({w}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), ' ')"
TOKENS = "flatten(list_transform(regexp_extract_all(coalesce({c}, ''), '[A-Za-z][A-Za-z0-9]*'), lambda w: list_concat([lower(w)], list_filter(list_transform(" + _SPLIT.format(w="w") + ", lambda p: lower(p)), lambda p: p <> lower(w) AND p <> ''))))"


def _bm25(corpus: str, terms: str = TERMS, key: str = "ord", near: bool = False) -> str:
    weights = {"name": 3.0, "id": 2.0, "file": 1.0, "type": 1.0} | ({"neighbours": 1.0} if near else {})
    fields = " UNION ALL ".join(f"SELECT {key} AS ord, unnest({TOKENS.format(c=c)}) AS t, {w} AS w FROM {corpus}" for c, w in weights.items())
    return f"""
tk AS ({fields}),
dl AS (SELECT c.{key} AS ord, coalesce(sum(w), 0) AS dl FROM {corpus} c LEFT JOIN tk ON c.{key} = tk.ord GROUP BY 1),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
q(t, times) AS (VALUES {terms}),
tf AS (SELECT ord, t, sum(w) AS tf FROM tk WHERE t IN (SELECT t FROM q) GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY 1),
sc AS (SELECT tf.ord, sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS s
  FROM tf JOIN df USING (t) JOIN q USING (t) JOIN dl ON tf.ord = dl.ord, st GROUP BY 1)"""


@query(", " + _bm25("g_docs").strip() + """
SELECT CAST(row_number() OVER (ORDER BY round(s, 9) DESC, ord) AS INT) AS rank, ord, id, round(s, 9) AS score
FROM sc JOIN g_docs USING (ord) ORDER BY round(s, 9) DESC, ord LIMIT 8""")
def search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents for a question, by BM25 over all texts."""
    return search.search(views.documents(spark, sf_dir), QUERY)


@query(SQL["search_documents"])
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from an index of all texts that was built in two steps, the second of which replaces and takes away some of the first."""
    docs = search.documents(views.documents(spark, sf_dir))
    found = index.Index(spark, scratch_path(spark, "index"))
    stale = docs.withColumn("tokens", F.slice("tokens", 1, 3)).withColumn("dl", F.lit(9.0))
    third = F.floor(F.col("ord") / 500) % 3
    never = docs.filter(third == 2).withColumn("ord", -F.col("ord") - 1)
    found.update(docs.filter(third == 0).unionByName(stale.filter(third == 1)).unionByName(never))
    delete_at_end(spark, found.log.root)
    found.update(docs.filter(third > 0), never.select("ord"))
    return found.search(QUERY)


@query(BUILT + """SELECT count_if(type <> 'external') + count_if(type = 'external') AS n_nodes, count_if(type = 'external') AS n_external,
(SELECT count(*) FROM ve) AS n_edges, (SELECT count(*) FROM g_edges) - (SELECT count(*) FROM ve) AS n_dropped FROM bn""")
def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = views.graph(spark, sf_dir)
    return build.counts(g.nodes, g.edges)


@query(BUILT + "SELECT id FROM ext")
def external_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = views.graph(spark, sf_dir)
    return build.external_nodes(g.nodes, build.valid_edges(g.edges)).select("id")


@query(BUILT + "SELECT least(source, target) AS u, greatest(source, target) AS v, sum(weight) AS weight FROM ve WHERE source <> target GROUP BY 1, 2")
def undirected_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags.projection(build.valid_edges(views.edges(spark, sf_dir)))


@query(BUILT + "SELECT id, is_god, is_orphan FROM fl")
def god_and_orphan_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags.flags(*_built(spark, sf_dir))


def _pair(g: views.Graph) -> tuple[DataFrame, DataFrame]:
    return g.nodes, g.edges


@query(BUILT + "SELECT id, degree FROM deg")
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.degrees(build.valid_edges(views.edges(spark, sf_dir)))


@query(BUILT + "SELECT coalesce(type, 'unknown') AS value, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM bn), 1) AS percent FROM bn GROUP BY 1")
def node_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags.frequency(build.build(*_pair(views.graph(spark, sf_dir)))[0], "type")


@query("SELECT type AS value, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM g_edges), 1) AS percent FROM g_edges GROUP BY 1")
def edge_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags.frequency(views.edges(spark, sf_dir), "type")


@query(BUILT + """, r AS (SELECT node AS id, direction, other, type, row_number() OVER (PARTITION BY node, direction ORDER BY adj_ord, type, source, target, weight) AS place
  FROM adj WHERE node <> other OR direction = 'in')
SELECT r.id, direction, CAST(place AS INT) AS place, other, coalesce(bn.name, other) AS other_name, r.type FROM r LEFT JOIN bn ON r.other = bn.id WHERE place <= 12""")
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first neighbours each way of every node."""
    nodes, edges = _built(spark, sf_dir)
    return traverse.neighbours(nodes, edges, nodes.select("id"))


@query(BUILT + """SELECT community, count(*) AS members, count_if(is_god) AS gods, count_if(is_orphan) AS orphans, count(*) > 20 AS truncated
FROM fn WHERE community IS NOT NULL GROUP BY 1""")
def community_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = flagged(spark, sf_dir)
    return traverse.community(nodes, nodes.select("id"))[0]


@query(BUILT + """, r AS (SELECT community, id, name, row_number() OVER (PARTITION BY community ORDER BY CASE WHEN is_god THEN 0 WHEN is_orphan THEN 2 ELSE 1 END, ord) AS place
  FROM fn WHERE community IS NOT NULL) SELECT community, CAST(place AS INT) AS place, id, name FROM r WHERE place <= 20""")
def community_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = flagged(spark, sf_dir)
    return traverse.community(nodes, nodes.select("id"))[1]


@query(BUILT + """, vn AS (SELECT * FROM fn WHERE type IN ('class', 'function', 'method') AND is_god),
e2 AS (SELECT * FROM ve WHERE source IN (SELECT id FROM vn) AND target IN (SELECT id FROM vn)),
m AS (SELECT id FROM vn WHERE contains(lower(name), 'an') OR contains(lower(file), 'an')),
s AS (SELECT id FROM m UNION SELECT target FROM e2 WHERE source IN (SELECT id FROM m) UNION SELECT source FROM e2 WHERE target IN (SELECT id FROM m))
SELECT source, target, count(*) AS n FROM e2 WHERE source IN (SELECT id FROM s) AND target IN (SELECT id FROM s) GROUP BY 1, 2""")
def filtered_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = flagged(spark, sf_dir)
    _, e = traverse.view(nodes, edges, types=("class", "function", "method"), gods_only=True, query=" AN ")
    return e.groupBy("source", "target").agg(F.count("*").alias("n"))


@query("""SELECT s_id AS id, 1 AS hop, nation_id AS ancestor FROM sp UNION ALL SELECT s_id, 2, region_id FROM sp
UNION ALL SELECT c_id, 1, nation_id FROM cu UNION ALL SELECT c_id, 2, region_id FROM cu UNION ALL SELECT nation_id, 1, region_id FROM pl -- g_""")
def breadcrumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The containers of every node."""
    g = views.graph(spark, sf_dir)
    return traverse.breadcrumb(g.edges, g.nodes.select("id"))


@query(BUILT + "SELECT CAST(row_number() OVER (ORDER BY degree DESC, ord) AS INT) AS hub_rank, id, degree FROM fn WHERE is_god ORDER BY degree DESC, ord LIMIT 20")
def hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.hubs(*flagged(spark, sf_dir))


_PRIORITY = "CASE type WHEN 'CALLS' THEN 0 WHEN 'IMPORTS' THEN 1 WHEN 'INHERITS' THEN 2 WHEN 'DECORATES' THEN 3 WHEN 'CONTAINS' THEN 4 WHEN 'RELATES_TO' THEN 5 WHEN 'DEPENDS_ON' THEN 6 ELSE 99 END"


@query(BUILT + f""", r AS (SELECT source AS id, target AS other, type, row_number() OVER (PARTITION BY source ORDER BY {_PRIORITY}, ord, target, weight) AS place FROM ve)
SELECT id, CAST(place AS INT) AS place, other, type FROM r WHERE place <= 8""")
def priority_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = views.graph(spark, sf_dir)
    return traverse.priority_edges(build.valid_edges(g.edges), g.nodes.select("id"))


@query(BUILT + """, n AS (SELECT file, community, count(*) AS n, min(ord) AS first FROM bn WHERE type <> 'external' AND community IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY n DESC, first) AS k FROM n) SELECT file, community FROM r WHERE k = 1""")
def file_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags.primary_cluster(views.nodes(spark, sf_dir))


@query(BUILT + """, f AS (SELECT DISTINCT file FROM bn WHERE type <> 'external' ORDER BY file LIMIT 30),
n AS (SELECT file, community, count(*) AS n, min(ord) AS first FROM bn WHERE type <> 'external' AND community IS NOT NULL GROUP BY 1, 2),
pc AS (SELECT file, community FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY n DESC, first) AS k FROM n) WHERE k = 1),
m AS (SELECT file, string_agg(name, ', ' ORDER BY k) AS x FROM (SELECT file, name, row_number() OVER (PARTITION BY file ORDER BY is_god DESC, degree DESC, ord) AS k
  FROM fn WHERE type NOT IN ('external', 'module')) WHERE k <= 5 GROUP BY 1)
SELECT f.file, community, coalesce(x, '') AS members FROM f LEFT JOIN pc USING (file) LEFT JOIN m USING (file)""")
def file_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags.file_index(*flagged(spark, sf_dir))


@query(""", ch AS (SELECT c_custkey % 4 AS s, place || '/C' || c_custkey || '.py' AS file FROM cu)
SELECT file AS path, 'fresh' AS side FROM ch WHERE s IN (0, 1) UNION ALL SELECT file, 'stale' FROM ch WHERE s IN (1, 2, 3)
UNION ALL SELECT file || '.new', 'fresh' FROM ch WHERE s = 3 -- g_""")
def diff_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.split_diff(views.customer_changes(spark, sf_dir))


@query(BUILT + """, stale AS (SELECT place AS file FROM pl WHERE n_nationkey % 4 <> 0), fresh AS (SELECT place AS file FROM pl WHERE n_nationkey % 4 IN (0, 1)),
removed AS (SELECT id FROM g_nodes WHERE file IN (SELECT file FROM stale)), newn AS (SELECT * FROM g_nodes WHERE file IN (SELECT file FROM fresh) AND ord % 3 <> 0),
gone AS (SELECT id FROM removed WHERE id NOT IN (SELECT id FROM newn))
SELECT type, count(*) AS n, sum(weight) AS weight FROM ve WHERE source NOT IN (SELECT id FROM removed) AND target NOT IN (SELECT id FROM gone) GROUP BY 1""")
def merged_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that survive a commit in which two thirds of the rows of fresh files come back."""
    g = views.graph(spark, sf_dir)
    sides = merge.split_diff(views.changes(spark, sf_dir))
    fresh = sides.filter("side = 'fresh'").select(F.col("path").alias("file"))
    new = g.nodes.join(F.broadcast(fresh), "file", "left_semi").filter("ord % 3 <> 0")
    edges = build.valid_edges(g.edges)
    _, e = merge.merge_tree(g.nodes, edges, sides.filter("side = 'stale'").select("path"), new, edges.limit(0))
    return e.groupBy("type").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


_REFS = """, rx AS (SELECT row_number() OVER () AS rid, l_orderkey * 8 + l_linenumber AS ord, p_name, p_partkey, p_file, l_suppkey,
  (CASE WHEN l_suppkey % 2 = 0 THEN place ELSE p_folder END) || '/m' || (l_suppkey % 5) || ['.py', '.java', '.ts', '.go'][l_orderkey % 4 + 1] AS file,
  ['python', 'java', 'javascript', 'generic'][l_orderkey % 4 + 1] AS dialect, ['call', 'inherits', 'decorator', 'import'][l_linenumber % 4 + 1] AS kind
  FROM lineitem JOIN pa ON l_partkey = p_partkey JOIN sp ON l_suppkey = s_suppkey),
rf AS (SELECT *, file || '::S' || l_suppkey AS source, regexp_replace(file, '/[^/]*$', '') AS dir, kind = 'call' AND dialect = 'java' AND l_suppkey % 3 = 0 AS named,
  CASE WHEN kind = 'call' AND dialect = 'java' AND l_suppkey % 3 = 0 THEN 'K' || p_partkey || '.' || p_name WHEN kind = 'call' THEN 'x.' || p_name || '(y)' WHEN kind <> 'import' THEN p_name
    WHEN dialect = 'python' THEN 'from parts import ' || p_name WHEN dialect = 'java' THEN 'import static ' || replace(left(p_file, -5), '/', '.') || '.' || p_name || ';'
    WHEN dialect = 'javascript' THEN 'import { ' || replace(p_name, ' ', '_') || ' } from "./parts"' ELSE 'parts.' || p_name END AS raw FROM rx)"""


@query(_REFS + """, t AS (SELECT rid, dialect, kind, count(n.id) AS k,
  count_if(plain AND (starts_with(n.file, dir || '/') OR n.file = rf.file)) AS same, count_if(plain AND contains(dir, '/') AND starts_with(n.file, regexp_replace(dir, '/[^/]*$', '') || '/')) AS above,
  count_if(named AND contains(n.id, '::K' || p_partkey || '.' || p_name)) AS cls, count_if(dialect = 'java' AND kind = 'import' AND ends_with(n.file, p_file)) AS path
  FROM (SELECT *, dialect = 'java' OR kind <> 'call' AS plain, CASE WHEN dialect = 'javascript' AND kind = 'import' THEN replace(p_name, ' ', '_') ELSE p_name END AS sought FROM rf) rf LEFT JOIN g_nodes n ON n.name = sought GROUP BY 1, 2, 3),
o AS (SELECT dialect, kind, CASE WHEN k = 0 THEN 'drop' WHEN k = 1 OR same = 1 OR above = 1 OR cls = 1 OR path = 1 THEN 'resolve' WHEN dialect = 'java' AND kind = 'import' THEN 'drop' ELSE 'pass' END AS outcome,
  CASE WHEN k = 0 THEN NULL WHEN k = 1 THEN 'symbol_index: unique match' WHEN dialect = 'generic' AND (same = 1 OR above = 1) THEN 'symbol_index: unique match'
    WHEN same = 1 OR above = 1 THEN 'symbol_index: same-package heuristic' WHEN cls = 1 THEN 'symbol_index: receiver-class heuristic' WHEN path = 1 THEN 'symbol_index: FQN path heuristic' END AS reasoning FROM t)
SELECT dialect, kind, outcome, reasoning, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM o), 1) AS percent FROM o GROUP BY 1, 2, 3, 4""")
def resolution_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each reference, and by which step: unique names, packages, receivers and import paths all occur."""
    return resolve.outcomes(resolve.resolve(resolve.alike(views.refs(spark, sf_dir)), views.nodes(spark, sf_dir)))


@query(_REFS + """, f AS (SELECT file, raw, kind, source, min(ord) AS ord FROM rf GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY ord, file, raw, kind, source) - 1 AS n FROM f)
SELECT file || '#' || CAST(n // 30 AS VARCHAR) AS chunk, count(*) AS n, min(ord) AS first, max(n % 30) AS last_index FROM n GROUP BY 1 -- g_""")
def reference_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct references dealt into chunks for an outside resolver."""
    return answers.distinct_refs(views.refs(spark, sf_dir)).groupBy("chunk").agg(F.count("*").alias("n"), F.min("ord").alias("first"), F.max("ref_index").cast("long").alias("last_index"))


GRAPH_QUERY = "red widget of supplier in Brand"
#: The ten first neighbours' names are a field of a node, hubs weigh more and nodes without an edge less.
HITS = """, nr AS (SELECT node, coalesce(b.name, a.other) AS n, row_number() OVER (PARTITION BY node ORDER BY adj_ord, a.type, source, target, weight) AS r FROM adj a LEFT JOIN bn b ON a.other = b.id),
co AS (SELECT fn.*, coalesce(x, '') AS neighbours FROM fn LEFT JOIN (SELECT node, string_agg(n, ' ' ORDER BY r) AS x FROM nr WHERE r <= 10 GROUP BY 1) ON id = node),
""" + _bm25("co", "('red', 2), ('widget', 2), ('of', 2), ('supplier', 2), ('in', 2), ('brand', 2)", "id", True).strip() + """,
hit AS (SELECT CAST(row_number() OVER (ORDER BY s DESC, ord NULLS FIRST) AS INT) AS rank, ord, id, s AS score FROM
  (SELECT co.ord, id, round(s * CASE WHEN is_god THEN 1.3 ELSE 1 END * CASE WHEN is_orphan THEN 0.8 ELSE 1 END, 9) AS s FROM sc JOIN co ON sc.ord = co.id) ORDER BY s DESC, ord NULLS FIRST LIMIT 8)"""


@query(BUILT + HITS + """, r AS (SELECT rank, node, other, direction, a.type, row_number() OVER (PARTITION BY node ORDER BY adj_ord, a.type, source, target, weight) AS place FROM adj a JOIN hit ON node = hit.id)
SELECT rank, node AS id, CAST(place AS INT) AS place, other, coalesce(b.name, other) AS other_name, direction, r.type FROM r LEFT JOIN bn b ON other = b.id WHERE place <= 15""")
def search_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours of the best nodes for a question, the names of neighbours being searched too."""
    nodes, edges = flagged(spark, sf_dir)
    return search.search_with_neighbours(nodes, edges, GRAPH_QUERY)


@query(BUILT + HITS + """, c AS (SELECT community, min(rank) AS f FROM hit JOIN fn USING (id) WHERE community IS NOT NULL GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY f, community) AS INT) AS place, community FROM c ORDER BY f, community LIMIT 4""")
def hit_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = flagged(spark, sf_dir)
    return traverse.first_communities(nodes, search.search(nodes, GRAPH_QUERY, edges))


@query(BUILT + HITS + """, qn AS (SELECT a.node AS id, direction, a.type, coalesce(bn.name, a.other) AS other_name, row_number() OVER (PARTITION BY a.node, direction ORDER BY adj_ord) AS place
  FROM adj a LEFT JOIN bn ON bn.id = a.other WHERE a.node IN (SELECT id FROM hit) AND (a.node <> a.other OR direction = 'in')),
nb AS (SELECT id, string_agg(other_name || ' (' || type || ')', ', ' ORDER BY place) FILTER (direction = 'out') AS o, string_agg(other_name || ' (' || type || ')', ', ' ORDER BY place) FILTER (direction = 'in') AS i FROM qn WHERE place <= 8 GROUP BY id),
ct AS (SELECT community, min(rank) AS f FROM hit JOIN fn USING (id) WHERE community IS NOT NULL GROUP BY 1 ORDER BY f, community LIMIT 4),
mb AS (SELECT fn.*, f, row_number() OVER (PARTITION BY community ORDER BY CASE WHEN is_god THEN 0 WHEN is_orphan THEN 2 ELSE 1 END, ord) AS place FROM fn JOIN ct USING (community))
SELECT 0 AS section, 0 AS n, 'Hits' AS line UNION ALL SELECT 1, 0, 'Communities'
UNION ALL SELECT 0, CAST(rank AS INT), concat_ws(' ', type, name, CASE WHEN is_god THEN '[hub]' WHEN is_orphan THEN '[orphan]' END, '#' || community, 'in ' || nullif(file, ''), '-> ' || o, '<- ' || i)
  FROM hit JOIN fn USING (id) LEFT JOIN nb USING (id)
UNION ALL SELECT 1, CAST(row_number() OVER (ORDER BY any_value(f), community) AS INT), '#' || community || ': ' || count(*) || ' members, ' || count_if(is_god) || ' hubs' || CASE WHEN count(*) > 12 THEN ', cut' ELSE '' END
  || ': ' || string_agg(name || CASE WHEN is_god THEN '*' ELSE '' END, ', ' ORDER BY place) FILTER (place <= 10) FROM mb GROUP BY community""")
def question_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a text that answers a question from the graph: hits with their neighbours, and the communities they meet."""
    return render.context_lines(*flagged(spark, sf_dir), GRAPH_QUERY, search.TOP_K)


@query(BUILT + """, r AS (SELECT community, id, degree, row_number() OVER (PARTITION BY community ORDER BY is_god DESC, degree DESC, ord) AS place FROM fn WHERE community IS NOT NULL)
SELECT community, CAST(place AS INT) AS place, id, degree FROM r WHERE place <= 20""")
def leading_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.leading_members(*flagged(spark, sf_dir))


@query(BUILT + "SELECT count(DISTINCT community) AS n_communities, count_if(is_god) AS n_gods, count_if(is_orphan) AS n_orphans FROM fn")
def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags.summary(flagged(spark, sf_dir)[0])


@query()
def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities found by local moving; held against invariants in the tests."""
    g = views.graph(spark, sf_dir)
    return cluster.communities(g.nodes, build.valid_edges(g.edges))


@query()
def call_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call paths from the hubs."""
    nodes, edges = flagged(spark, sf_dir)
    return traverse.call_paths(edges, traverse.hubs(nodes, edges))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beyond graphs: hourly counts, the batch form of the streaming query."""
    out = patches.windowed_counts(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return out.withColumn("total", F.col("total"))


@query(BUILT + f""", r AS (SELECT source, target, type, row_number() OVER (PARTITION BY source ORDER BY {_PRIORITY}, ord, target, weight) AS p FROM ve),
k AS (SELECT * FROM r WHERE p <= 8 AND type = 'CALLS')
SELECT a.source AS id, CAST(a.p AS INT) AS p1, a.target AS callee, CAST(b.p AS INT) AS p2, b.target AS next FROM k a LEFT JOIN k b ON a.target = b.source""")
def call_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of every node and what these call."""
    g = views.graph(spark, sf_dir)
    return traverse.call_chains(build.valid_edges(g.edges), g.nodes.select("id"))


@query(BUILT + """, o AS (SELECT *, string_split(file, '/') AS f FROM fn WHERE community IS NOT NULL AND type <> 'external'),
c AS (SELECT community, count(*) AS n, min(f) AS a, max(f) AS b, max(CASE WHEN is_god THEN {'d': degree, 'o': -ord, 'name': name} END).name AS hub FROM o GROUP BY 1)
SELECT community, n, array_to_string(CASE WHEN a[1:2] = b[1:2] THEN a[1:2] WHEN a[1:1] = b[1:1] THEN a[1:1] ELSE [] END, '/') AS prefix, hub FROM c""")
def cluster_purposes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags.purposes(*flagged(spark, sf_dir))


@query("SELECT role, count(*) AS n, sum(length(text)) AS chars, max(turn) AS last_turn FROM conversations GROUP BY 1")
def conversation_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.groupBy("role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.max("turn").alias("last_turn"))


@query("""WITH f AS (SELECT conv_id, conv_id % 11 = 0 AS failed, conv_id % 5 = 0 AS cut, conv_id % 7 = 0 AS lost, turn + 1 AS seq, text, max(turn) OVER (PARTITION BY conv_id) + 2 AS e FROM conversations),
k AS (SELECT * FROM f WHERE NOT (lost AND seq = 2)), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY seq) = seq AS reached FROM k)
SELECT 'c' || conv_id AS message_id, CASE WHEN bool_and(reached) AND NOT any_value(cut) AND NOT (any_value(lost) AND any_value(e) = 3) THEN CASE WHEN any_value(failed) THEN 'error' ELSE 'done' END ELSE 'timeout' END AS outcome,
  coalesce(string_agg(text, '' ORDER BY seq) FILTER (reached), '') AS text, count_if(reached) AS frames FROM r GROUP BY conv_id""")
def assembled_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as frames, a turn each and an end: some fail, some lose their end and some their second turn."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    key = F.concat(F.lit("c"), "conv_id").alias("message_id")
    turns = c.filter(~((F.col("conv_id") % 7 == 0) & (F.col("turn") == 1))).select(key, (F.col("turn") + 1).alias("seq"), F.lit("delta").alias("kind"), "text")
    ends = c.groupBy("conv_id").agg(F.max("turn").alias("last")).filter("conv_id % 5 <> 0").select(key, (F.col("last") + 2).alias("seq"), F.when(F.col("conv_id") % 11 == 0, "error").otherwise("done").alias("kind"), F.lit(None).cast("string").alias("text"))
    return messages.assemble(turns.unionByName(ends).unionByName(turns.filter("seq % 3 = 0")))


@query("""SELECT conv_id, string_agg('**' || role || '**' || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn, role, text) AS text FROM conversations GROUP BY 1""")
def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.transcript(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@query("""SELECT o_orderkey AS tree_id, CASE WHEN o_orderstatus = 'P' THEN 'not JSON' END AS error, count(l_orderkey) FILTER (o_orderstatus <> 'P') AS n_nodes,
  CAST(sum(l_linenumber) FILTER (o_orderstatus <> 'P' AND l_returnflag <> 'R') AS BIGINT) AS lines, count(*) FILTER (o_orderstatus <> 'P' AND (l_returnflag = 'R' OR l_linestatus = 'O')) AS n_rescued,
  CAST(sum(CAST(floor(l_quantity) AS BIGINT)) FILTER (o_orderstatus <> 'P' AND l_linestatus = 'O') AS BIGINT) AS quantity
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus""")
def payload_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as payloads with a node for each line: some texts are cut off, some lines give their number as text, some have a field of their own."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("tree_id"), "o_orderstatus")
    own = [F.concat(F.lit("part "), "l_partkey").alias("id"), F.col("l_linestatus").alias("type"), F.when(F.col("l_linestatus") == "O", F.floor("l_quantity")).alias("quantity")]
    number = F.col("l_linenumber")
    element = F.when(F.col("l_returnflag") == "R", F.to_json(F.struct(*own, number.cast("string").alias("line_start")))).otherwise(F.to_json(F.struct(*own, number.alias("line_start"))))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("tree_id")).agg(F.array_join(F.collect_list(element), ",").alias("elements"))
    text = F.concat(F.lit('{"nodes":['), F.coalesce("elements", F.lit("")), F.lit("]"), F.when(F.col("o_orderstatus") == "P", "").otherwise("}"))
    # both joins have a row for each tree on either side; the planner takes texts for 20 bytes and a VARIANT for 2 KB, finds what it
    # knows so little of small, and would broadcast it
    trees = materialise(payloads.parsed(o.join(lines.hint("merge"), "tree_id", "left").select("tree_id", text.alias("payload"))), "trees")
    nodes = payloads.rows(trees, "nodes").groupBy("tree_id").agg(
        F.count("*").alias("n_nodes"), F.sum("line_start").alias("lines"), F.count("rescued").alias("n_rescued"), F.sum(F.try_variant_get("rescued", "$.quantity", "long")).alias("quantity")
    )
    none = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_nodes", "n_rescued")]
    return trees.join(nodes.hint("merge"), "tree_id", "left").select("tree_id", "error", *none, "lines", "quantity")


_FREQUENCIES = "WITH t AS (SELECT doc_id, unnest(" + TOKENS.format(c="text") + ") AS t FROM documents) SELECT t AS token, count(DISTINCT doc_id) AS df, count(*) AS tf FROM t GROUP BY 1"


@query(_FREQUENCIES)
def document_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents hold each identifier token, and how often it stands in all of them."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.explode(X.identifier_tokens(F.col("text"))).alias("token"))
    each = d.groupBy("token", "doc_id").agg(F.count("*").alias("n"))
    return each.groupBy("token").agg(F.count("doc_id").alias("df"), F.sum("n").alias("tf"))


@query(_FREQUENCIES)
def token_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency and count of every identifier token."""
    return document_frequencies(spark, sf_dir)


@query()
def graph_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a graph's summary text."""
    return render.anchor_lines(*flagged(spark, sf_dir))
