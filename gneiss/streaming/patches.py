"""Change batches as a stream: each micro-batch is merged into the stored graph once, however often it is replayed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gneiss import schemas
from gneiss.operators import merge
from gneiss.sources.store import Store

#: sequence numbers the commits of a graph, from 1 on.
BATCH = "graph_id string, sequence long, sha string, " + schemas.CHANGES
Extract = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def apply_changes(store: Store, graph_id: str, sequence: int, sha: str, changes: DataFrame, extract: Extract) -> str:
    """Merge one commit's changes, once and in order: "applied", "known" if it is there already, "waiting" if one before it is missing.
    ``extract`` gets the fresh paths and returns nodes and edges."""

    def merged(nodes: DataFrame | None, edges: DataFrame | None, changes: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, int]]:
        sides = merge.split_diff(changes)
        new_nodes, new_edges = extract(sides.filter("side = 'fresh'").select("path"))
        nodes, edges = new_nodes.limit(0) if nodes is None else nodes, new_edges.limit(0) if edges is None else edges
        after_n, after_e = merge.merge_tree(nodes, edges, sides.filter("side = 'stale'").select("path"), new_nodes, new_edges)
        d_n, d_e = merge.deltas(nodes, after_n, ["id"]).first(), merge.deltas(edges, after_e, ["source", "target", "type"]).first()
        return after_n, after_e, {"nodes_added": d_n["added"], "nodes_removed": d_n["removed"], "edges_added": d_e["added"], "edges_removed": d_e["removed"]}

    return store.apply(graph_id, sequence, sha, changes.select(*[c.split()[0] for c in schemas.CHANGES.split(", ")]), merged, schemas.CHANGES)


def stream_changes(spark: SparkSession, folder: str, checkpoint: str, store: Store, extract: Extract) -> StreamingQuery:
    """Take JSON change batches from a folder as they come. Commits of a graph are applied by number, in whatever order files bring them;
    a file that is replayed changes nothing. A commit without a number stops the stream."""
    rows = spark.readStream.schema(BATCH).option("maxFilesPerTrigger", 1).json(folder)

    def each(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        for r in batch.select("graph_id", "sequence", "sha").distinct().orderBy("graph_id", "sequence").toLocalIterator():  # a file holds a commit or a few
            if r["sequence"] is None:
                raise ValueError(f"commit {r['sha']} of {r['graph_id']} has no sequence number")
            apply_changes(store, r["graph_id"], r["sequence"], r["sha"], batch.filter((F.col("graph_id") == r["graph_id"]) & (F.col("sequence") == r["sequence"])), extract)
        batch.unpersist()

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def assemble_messages(frames: DataFrame) -> DataFrame:
    """message_id, text, done: deltas of a message joined in order (message_id, seq, kind, text)."""
    rows = frames.groupBy("message_id").agg(F.array_sort(F.collect_list(F.when(F.col("kind") == "delta", F.struct("seq", "text")))).alias("x"), F.bool_or(F.col("kind") == "done").alias("done"))
    return rows.select("message_id", F.array_join(F.transform("x", lambda y: y["text"]), "").alias("text"), "done")


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Beyond graphs: event counts by type and time window, with a watermark where the events are a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
