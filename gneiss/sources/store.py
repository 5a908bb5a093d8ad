"""Graphs, trees, snapshots and audits kept as Parquet tables of one folder, under a commit log.

Plain Parquet has no MERGE and no transaction: every change here is one entry of the log (see ``log``), however many tables it
writes, so a reader sees all of it or none, a crash leaves nothing behind that counts, and of two writers the second plans again. All rows
of a version, tree or graph lie in folders whose shared values the log knows, so a read of one opens no other's files and no value is
guessed from a path.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss import schemas
from gneiss.functions import text as X
from gneiss.session import materialise
from gneiss.sources import payloads
from gneiss.sources.log import Change, Log, Part, State

GRAPH_KEY = ["user_id", "repo_url", "branch"]
GRAPHS = "graph_id string, user_id string, repo_url string, branch string, status string, n_nodes long, n_edges long, n_communities long, last_commit_sha string, updated_at timestamp"
TREES = "tree_id string, graph_id string, status string, n_nodes long, n_edges long, last_commit_sha string"
#: Rows of trees; what a payload held beside the typed columns is rescued.
TREE_TABLES = {f"tree_{part}": f"{schema}, rescued variant" for part, schema in payloads.LISTS.items()}
TREE_ERRORS = "tree_id string, list string, place int, error string, element string"
CLONES = "user_id string, owner string, repo string, branch string, path string, last_sha string, size_bytes long"
HISTORY = "graph_id string, version long, sha string, n_nodes long, n_edges long, at timestamp"
RUNS = "graph_id string, mode string, status string, at timestamp, nodes_added long, nodes_removed long, edges_added long, edges_removed long"


class Payload(NamedTuple):
    nodes: DataFrame
    edges: DataFrame
    refs: DataFrame


class Store:
    """Tables under one folder of the shared file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.log = spark, Log(spark, root)

    def read(self, table: str, schema: str, state: State | None = None) -> DataFrame:
        return self.log.read(table, schema, state)

    def _with(self, change: Change, state: State, table: str, schema: str, make: Callable[[DataFrame], DataFrame]) -> Change:
        """A change that writes a whole small table anew, too."""
        change.add.append((table, {}, make(self.read(table, schema, state)), ()))
        change.remove.append((table, {}))
        change.reads.append((table, {}))
        return change

    def _replace(self, name: str, table: str, schema: str, make: Callable[[DataFrame], DataFrame]) -> None:
        self.log.commit(name, lambda state: self._with(Change(), state, table, schema, make))

    # graphs

    def graphs(self) -> DataFrame:
        return self.read("graphs", GRAPHS)

    def save_graphs(self, rows: DataFrame) -> None:
        """Insert or update on (user, url, branch); an existing graph keeps its id."""
        self._replace("save graphs", "graphs", GRAPHS, lambda old: upsert(old, rows, GRAPH_KEY, keep=("graph_id",)))

    def update_graph(self, graph_id: str, **values: Column) -> int:
        """Set columns of one graph; how many rows there were."""
        found = [0]

        def plan(state: State) -> Change | None:
            found[0] = self.read("graphs", GRAPHS, state).filter(F.col("graph_id") == graph_id).count()
            return self._with(Change(), state, "graphs", GRAPHS, lambda old: with_values(old, graph_id, values)) if found[0] else None

        self.log.commit("update graph", plan)
        return found[0]

    def mark_error(self, graph_id: str) -> None:
        """BUILDING becomes ERROR; other states stay."""
        self.update_graph(graph_id, status=F.when(F.col("status") == "BUILDING", "ERROR").otherwise(F.col("status")))

    def active(self, user_id: str, repo_url: str, branch: str) -> DataFrame:
        return self.graphs().filter((F.col("user_id") == user_id) & (F.col("repo_url") == repo_url) & (F.col("branch") == branch) & (F.col("status") == "READY"))

    def listing(self, user_id: str) -> DataFrame:
        """A user's graphs, newest first."""
        return self.graphs().filter(F.col("user_id") == user_id).orderBy(F.desc("updated_at"), "graph_id")

    def save_clusters(self, graph_id: str, flagged: DataFrame) -> None:
        """Record what clustering found, and that the graph is ready; an unknown graph is an error."""
        n = flagged.agg(F.countDistinct("community")).first()[0]
        if not self.update_graph(graph_id, n_communities=F.lit(n).cast("long"), status=F.lit("READY"), updated_at=F.current_timestamp()):
            raise KeyError(f"no graph {graph_id}")

    # trees

    def trees(self) -> DataFrame:
        return self.read("trees", TREES)

    def save_trees(self, rows: DataFrame) -> None:
        self._replace("save trees", "trees", TREES, lambda old: upsert(old, rows, ["tree_id"]))

    def save_tree(self, row: DataFrame, payload: Payload, errors: DataFrame | None = None) -> None:
        """A tree's row (of TREES), its nodes, edges and references and its unreadable elements, all in one commit; those it had before go."""
        tree_id = row.first()["tree_id"]
        one = {"tree_id": tree_id}

        def plan(state: State) -> Change:
            change = Change(reads=[("tree_nodes", one)])
            change.remove += [(t, one) for t in (*TREE_TABLES, "tree_errors")]
            change.add += [(table, one, fitted(rows, schema), ()) for (table, schema), rows in zip(TREE_TABLES.items(), payload)]
            if errors is not None:
                change.add.append(("tree_errors", one, fitted(errors, TREE_ERRORS), ()))
            return self._with(change, state, "trees", TREES, lambda old: upsert(old, row, ["tree_id"]))

        self.log.commit("save tree", plan)

    def index_tree(self, payload: DataFrame, sha: str) -> None:
        """Keep a payload (one row of tree_id, payload) as a tree that is ready, with its counts; a tree that is there keeps its graph.

        An unreadable payload is an error and changes nothing; elements that are no objects are kept apart, see ``tree_errors``.
        """
        tree = materialise(payloads.parsed(payload), "payload")
        found = tree.select("tree_id", "error").take(2)
        if len(found) != 1:
            raise ValueError("one row of tree_id and payload is expected")
        if found[0]["error"]:
            raise ValueError(f"tree {found[0]['tree_id']}: {found[0]['error']}")
        lists = {part: payloads.rows(tree, part) for part in payloads.LISTS}
        good = Payload(*[rows.filter("error IS NULL") for rows in lists.values()])
        bad = [rows.filter("error IS NOT NULL").select("tree_id", F.lit(part).alias("list"), "place", "error", F.to_json("rescued").alias("element")) for part, rows in lists.items()]
        row = tree.select("tree_id", F.lit("READY").alias("status"), *[F.lit(rows.count()).cast("long").alias(f"n_{part}") for part, rows in zip(("nodes", "edges"), good)], F.lit(sha).alias("last_commit_sha"))
        self.save_tree(row, good, bad[0].unionByName(bad[1]).unionByName(bad[2]))

    def tree_errors(self, tree_id: str) -> DataFrame:
        """tree_id, list, place, error, element: what a tree's payload held that is no node, edge or reference."""
        return self.log.read("tree_errors", TREE_ERRORS, tree_id=tree_id)

    def tree(self, tree_id: str, status: str | None = None, rescued: bool = False) -> Payload | None:
        """A tree's nodes, edges and references with defaults filled in, and what was rescued, if asked for; None if there is no such tree, or it
        is in another state."""
        state = self.log.state()
        found = self.read("trees", TREES, state).filter(F.col("tree_id") == tree_id).first()
        if found is None or status is not None and found["status"] != status:
            return None
        nodes, edges, refs = (self.log.read(t, s, state, tree_id=tree_id) for t, s in TREE_TABLES.items())
        if not rescued:
            nodes, edges, refs = schemas.filled(nodes).drop("rescued"), schemas.filled(edges).drop("rescued"), refs.drop("rescued")
        return Payload(nodes, edges, refs)

    def link_tree(self, tree_id: str, graph_id: str) -> None:
        """The tree belongs to the graph from now on; other trees of the graph go, with what they hold."""
        own = F.col("tree_id") == tree_id

        def plan(state: State) -> Change:
            old = self.read("trees", TREES, state)
            change = Change()
            for r in old.filter(~own & (F.col("graph_id") == graph_id)).select("tree_id").toLocalIterator():  # a graph's trees, one or a few
                change.remove += [(t, {"tree_id": r["tree_id"]}) for t in (*TREE_TABLES, "tree_errors")]
            kept = old.filter(own | F.col("graph_id").isNull() | (F.col("graph_id") != graph_id))
            return self._with(change, state, "trees", TREES, lambda _: kept.withColumn("graph_id", F.when(own, F.lit(graph_id)).otherwise(F.col("graph_id"))))

        self.log.commit("link tree", plan)

    def with_trees(self) -> DataFrame:
        """Graphs with the tree of each, null where there is none."""
        return self.graphs().join(self.trees().select("graph_id", "tree_id", F.col("status").alias("tree_status")), "graph_id", "left")

    def save_clones(self, rows: DataFrame) -> None:
        """A null commit never replaces a known one."""
        self._replace("save clones", "clones", CLONES, lambda old: upsert(old, rows, ["user_id", "owner", "repo", "branch"], known=("last_sha",)))

    # versions

    def versions(self, graph_id: str, state: State | None = None) -> list[int]:
        """The versions that a graph has, from the log alone."""
        return sorted(p["version"] for p in (state or self.log.state()).tables.get("history", {}).values() if p["graph_id"] == graph_id)

    def next_version(self, graph_id: str, state: State | None = None) -> int:
        return max(self.versions(graph_id, state), default=0) + 1

    def _version(self, change: Change, state: State, graph_id: str, nodes: DataFrame, edges: DataFrame, sha: str) -> int:
        version = self.next_version(graph_id, state)
        key: Part = {"graph_id": graph_id, "version": version}
        counts = nodes.agg(F.count("*").alias("n_nodes")).join(F.broadcast(edges.agg(F.count("*").alias("n_edges"))))
        row = counts.select(F.lit(graph_id).alias("graph_id"), F.lit(version).cast("long").alias("version"), F.lit(sha).alias("sha"), "n_nodes", "n_edges", F.current_timestamp().alias("at"))
        change.add += [("nodes", key, nodes, ()), ("edges", key, edges, ()), ("history", key, row, ())]
        change.reads.append(("history", {"graph_id": graph_id}))
        return version

    def record_version(self, graph_id: str, nodes: DataFrame, edges: DataFrame, sha: str) -> int:
        """Keep a graph's nodes and edges as its next version, all in one commit."""
        made = [0]

        def plan(state: State) -> Change:
            change = Change()
            made[0] = self._version(change, state, graph_id, nodes, edges, sha)
            return change

        self.log.commit("record version", plan)
        return made[0]

    def history(self, graph_id: str) -> DataFrame:
        return self.log.read("history", HISTORY, graph_id=graph_id)

    def snapshot(self, name: str, graph_id: str, version: int, state: State | None = None) -> DataFrame:
        """The nodes or edges of a version, as they were written; an unknown version is an error."""
        folders = (state or self.log.state()).folders(name, graph_id=graph_id, version=version)
        if not folders:
            raise KeyError(f"no version {version} of {graph_id}")
        return self.spark.read.option("basePath", f"{self.log.root}/{name}").parquet(*[f"{self.log.root}/{name}/part={f}" for f in folders]).drop("part")

    def _run(self, graph_id: str, mode: str, status: str, counts: dict[str, int]) -> DataFrame:
        return self.spark.range(1).select(F.lit(graph_id).alias("graph_id"), F.lit(mode).alias("mode"), F.lit(status).alias("status"), F.current_timestamp().alias("at"), *[F.lit(counts.get(c, 0)).cast("long").alias(c) for c in ("nodes_added", "nodes_removed", "edges_added", "edges_removed")])

    def record_run(self, graph_id: str, mode: str, status: str, **counts: int) -> None:
        self.log.commit("record run", lambda _: Change(add=[("runs", {"graph_id": graph_id}, self._run(graph_id, mode, status, counts), ())]))

    def runs(self) -> DataFrame:
        return self.read("runs", RUNS)

    def delete_graph(self, graph_id: str) -> None:
        """Take a graph, its trees, history, snapshots and clone away in one commit; its runs are kept. Files go when the log is vacuumed."""

        def plan(state: State) -> Change:
            graphs, trees, clones = (self.read(t, s, state) for t, s in (("graphs", GRAPHS), ("trees", TREES), ("clones", CLONES)))
            gone = graphs.filter(F.col("graph_id") == graph_id).select("user_id", F.lower("repo_url").alias("url"), "branch")
            gone = gone.select("user_id", "branch", X.owner_of(F.col("url")).alias("owner"), X.repo_of(F.col("url")).alias("repo"))
            same = [clones[c] == gone[c] for c in ("user_id", "branch")] + [F.lower(clones[c]) == gone[c] for c in ("owner", "repo")]
            change = Change(remove=[(t, {"graph_id": graph_id}) for t in ("nodes", "edges", "history", "waiting")], reads=[("history", {"graph_id": graph_id})], facts={f"sequence:{graph_id}": None})
            for r in trees.filter(F.col("graph_id") == graph_id).select("tree_id").toLocalIterator():  # a graph's trees, one or a few
                change.remove += [(t, {"tree_id": r["tree_id"]}) for t in (*TREE_TABLES, "tree_errors")]
            self._with(change, state, "clones", CLONES, lambda _: clones.join(gone, same, "left_anti"))
            self._with(change, state, "trees", TREES, lambda _: trees.filter(F.col("graph_id").isNull() | (F.col("graph_id") != graph_id)))
            return self._with(change, state, "graphs", GRAPHS, lambda _: graphs.filter(F.col("graph_id") != graph_id))

        self.log.commit("delete graph", plan)

    # commits in sequence

    def apply(self, graph_id: str, sequence: int, sha: str, changes: DataFrame, merged: Callable[[DataFrame | None, DataFrame | None, DataFrame], tuple[DataFrame, DataFrame, dict[str, int]]], rest: str) -> str:
        """Apply a graph's commit of a number: its nodes, edges, history, run, row and number are one entry of the log.

        A number that is done already is "known". One beyond the next is "waiting": its changes (of schema ``rest``) are kept, and taken
        up when those before it are there. ``merged`` gets nodes and edges of the last version, null if there is none, and the changes.
        """
        told = [""]
        fact = f"sequence:{graph_id}"

        def plan(state: State) -> Change | None:
            last = state.facts.get(fact, 0)
            key: Part = {"graph_id": graph_id, "sequence": sequence, "sha": sha}
            waits = state.folders("waiting", graph_id=graph_id, sequence=sequence)
            if sequence <= last or sequence > last + 1 and waits:
                told[0] = "known" if sequence <= last else "waiting"
                return None
            if sequence > last + 1:
                told[0] = "waiting"
                return Change(add=[("waiting", key, changes, ())], knows=[fact], reads=[("waiting", {"graph_id": graph_id})])
            told[0] = "applied"
            change = Change(facts={fact: sequence}, knows=[fact], remove=[("waiting", {"graph_id": graph_id, "sequence": sequence})])
            version = max(self.versions(graph_id, state), default=0)
            old = [self.snapshot(t, graph_id, version, state) if version else None for t in ("nodes", "edges")]
            nodes, edges, counts = merged(*old, changes)
            self._version(change, state, graph_id, nodes, edges, sha)
            change.add.append(("runs", {"graph_id": graph_id}, self._run(graph_id, "PATCH", "SUCCESS", counts), ()))
            now = {"last_commit_sha": F.lit(sha), "status": F.lit("READY"), "updated_at": F.current_timestamp()}
            return self._with(change, state, "graphs", GRAPHS, lambda graphs: with_values(graphs, graph_id, now))

        state = self.log.commit("apply commit", plan)
        if told[0] == "applied":
            after = [p for p in state.tables.get("waiting", {}).values() if p["graph_id"] == graph_id and p["sequence"] == sequence + 1]
            if after:
                kept = self.log.read("waiting", rest, state, graph_id=graph_id, sequence=sequence + 1)
                self.apply(graph_id, sequence + 1, after[0]["sha"], kept, merged, rest)
        return told[0]


def with_values(graphs: DataFrame, graph_id: str, values: dict[str, Column]) -> DataFrame:
    hit = F.col("graph_id") == graph_id
    return graphs.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def fitted(rows: DataFrame, schema: str) -> DataFrame:
    """Rows in the columns of a schema; those they lack are null."""
    names = [x.split() for x in schemas.split(schema)]
    return rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(k).alias(n) for n, k in names])


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep: tuple[str, ...] = (), known: tuple[str, ...] = ()) -> DataFrame:
    """Rows of both by key: new ones win, but for the columns to keep, and for known values that the new row has as null."""
    a = old.select(F.struct(*old.columns).alias("o"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(key)])
    b = new.select(F.struct(*new.columns).alias("n"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(key)])
    both = a.join(b, [f"k{i}" for i in range(len(key))], "full")
    have = F.col("n").isNotNull()

    def value(c: str) -> Column:
        if c not in new.columns:
            return F.col(f"o.{c}")
        if c in keep:
            return F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}"))
        if c in known:
            return F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))
        return F.when(have, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))

    return both.select(*[value(c).alias(c) for c in old.columns])
