"""Session helpers: one place that names the defaults used in local runs and where shared scratch tables go."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "gneiss", shuffle: int = 8) -> SparkSession:
    """A session for tests and benches; a cluster supplies its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, local runs get a temporary one; a cluster is told so."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-gneiss-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Delete an existing path when the application ends."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a table in the shared folder and read it again: it cuts lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    delete_at_end(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialise`` wrote for these tables, which nothing reads any more; loops let go of their states so."""
    for t in tables:
        path = t.__dict__.pop("_written", None)
        if path:
            where = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def spread(table: DataFrame) -> DataFrame:
    """A scanned table whose files make fewer parts than there are cores is dealt over all cores; others, and thus large ones, stay as they are."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def deal_finely(table: DataFrame, bytes_a_part: int = 3 << 20, most_bytes: int = 8 << 20) -> None:
    """Let shuffles begin with at least a part for each so many bytes of a scanned table, so that a task's share doesn't grow with the
    input; adaptive execution joins small parts again, up to its advisory size. That and the size of scanned parts are lowered to ``most_bytes``:
    rows whose ids are alike are shuffled and written in a tenth or less of what they take in a task's sorts and hash tables."""
    conf, as_bytes = table.sparkSession.conf, table.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for name in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes"):
        if as_bytes(conf.get(name)) > most_bytes:
            conf.set(name, str(most_bytes))
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    parts = -(-int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) // bytes_a_part)
    if parts > int(conf.get(name, None) or conf.get("spark.sql.shuffle.partitions")):
        conf.set(name, str(parts))


def broadcast_if_small(df: DataFrame, most_bytes: int = 16 << 20) -> DataFrame:
    """Hint a broadcast only for a table whose plan is known to be within a number of bytes (a written table is: its files are
    measured, compressed); beyond it Spark chooses, which means that it shuffles both sides."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.hint("broadcast") if size <= most_bytes else df


def hashed(df: DataFrame, least_bytes: int = 1 << 20) -> DataFrame:
    """Hint a shuffled hash join with this side, which has each key once, so that the larger side needn't be sorted. Ids that are alike
    are written in a twentieth or less of what they take in memory, so a table grows out of a broadcast well below the planner's bound."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.hint("shuffle_hash") if size > min(least_bytes, df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()) else df


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand Python workers at most so many rows at once: texts can be long."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
