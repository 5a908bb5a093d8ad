"""A property graph derived from the star schema, and the same as SQL, so that graph operators run over the given tables.

Regions are modules, nations classes, suppliers functions, customers methods and parts functions of a class of their own in one of
the files of a brand's folders. Part names are not unique, some parts are left out of the nodes (their edges end in external nodes) and returned lines get a type that
the builder drops. ord is computed from keys: the class of row times 10**12, then its key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.session import deal_finely, hashed, spread

STEP = 10**12


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with the file and id of their rows; 25 of them."""
    n, r = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    both = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    return both.select("n_nationkey", "n_name", "r_name", "r_regionkey", F.concat(F.lit("r/"), "r_name").alias("region_id"), F.concat(F.lit("r/"), "r_name", F.lit("::"), "n_name").alias("nation_id"), F.concat(F.lit("r/"), "r_name", F.lit("/"), "n_name").alias("place"))


def _part_file() -> Column:
    return F.concat(F.lit("parts/"), "p_brand", F.lit("/T"), F.col("p_size") % 10, F.lit("/f"), F.col("p_partkey") % 4, F.lit(".java"))


def _part_id() -> Column:
    return F.concat(_part_file(), F.lit("::K"), "p_partkey", F.lit("."), "p_name")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.broadcast(_places(spark, sf_dir))

    def row(kind: int, key, ident, typ: str, name, comm):
        return [(F.lit(kind * STEP) + key.cast("long")).alias("ord"), ident.alias("id"), F.lit(typ).alias("type"), name.alias("name"), F.split_part(ident, F.lit("::"), F.lit(1)).alias("file"), comm.cast("int").alias("community")]

    r = _table(spark, sf_dir, "region").select(*row(0, F.col("r_regionkey"), F.concat(F.lit("r/"), "r_name"), "module", F.col("r_name"), F.col("r_regionkey")))
    n = place.select(*row(1, F.col("n_nationkey"), F.col("nation_id"), "class", F.col("n_name"), F.col("n_nationkey")))
    s = _table(spark, sf_dir, "supplier").join(place, F.col("s_nationkey") == F.col("n_nationkey"))
    s = s.select(*row(2, F.col("s_suppkey"), F.concat("place", F.lit("::S"), "s_suppkey"), "function", F.col("s_name"), F.col("n_nationkey")))
    c = _table(spark, sf_dir, "customer").join(place, F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.select(*row(3, F.col("c_custkey"), F.concat("place", F.lit("::C"), "c_custkey"), "method", F.col("c_name"), F.col("n_nationkey")))
    p = _table(spark, sf_dir, "part").filter("p_partkey % 97 <> 0")
    p = p.select(*row(4, F.col("p_partkey"), _part_id(), "function", F.col("p_name"), F.when(F.col("p_partkey") % 50 != 0, F.col("p_partkey") % 7)))
    return r.unionByName(n).unionByName(s).unionByName(c).unionByName(p)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = F.broadcast(_places(spark, sf_dir))

    def row(kind: int, key, source, target, typ, weight):
        return [(F.lit(kind * STEP) + key.cast("long")).alias("ord"), source.alias("source"), target.alias("target"), typ.alias("type"), weight.cast("double").alias("weight")]

    one = F.lit(1.0)
    s = _table(spark, sf_dir, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey")).withColumn("s_id", F.concat("place", F.lit("::S"), "s_suppkey"))
    c = _table(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).withColumn("c_id", F.concat("place", F.lit("::C"), "c_custkey"))
    p = _table(spark, sf_dir, "part").withColumn("p_id", _part_id())
    li, o = _table(spark, sf_dir, "lineitem"), _table(spark, sf_dir, "orders")
    deal_finely(li)
    a = places.select(*row(0, F.col("n_nationkey"), F.col("region_id"), F.col("nation_id"), F.lit("CONTAINS"), one))
    b = s.select(*row(1, F.col("s_suppkey"), F.col("nation_id"), F.col("s_id"), F.lit("CONTAINS"), one))
    d = c.select(*row(2, F.col("c_custkey"), F.col("nation_id"), F.col("c_id"), F.lit("CONTAINS"), one))
    # parts first: once suppliers turn out to be few, their join needs no shuffle of the lines
    lines = li.join(hashed(p.select("p_partkey", "p_id")), F.col("l_partkey") == F.col("p_partkey")).join(s.select("s_suppkey", "s_id"), F.col("l_suppkey") == F.col("s_suppkey"))
    key = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    e = lines.select(*row(3, key, F.col("s_id"), F.col("p_id"), F.when(F.col("l_returnflag") == "R", "RETURNS").otherwise("CALLS"), F.col("l_quantity")))
    f = li.filter("l_linenumber = 1").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c.select("c_custkey", "c_id"), F.col("o_custkey") == F.col("c_custkey"))
    f = f.join(s.select("s_suppkey", "s_id"), F.col("l_suppkey") == F.col("s_suppkey")).select(*row(4, key, F.col("c_id"), F.col("s_id"), F.lit("DEPENDS_ON"), one))
    return a.unionByName(b).unionByName(d).unionByName(e).unionByName(f)


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(nodes(spark, sf_dir), edges(spark, sf_dir))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as nodes: the text is the name that searches weigh most."""
    d = spread(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return d.select(F.col("doc_id").alias("ord"), F.concat("lang", F.lit("/"), "doc_id").alias("id"), F.col("lang").alias("type"), F.col("text").alias("name"), F.col("source").alias("file"))


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference per line item, to a part's name, half of them from a supplier's file and half from one in the part's own folder; kinds
    and languages go round by line and order. Every third Java call names the part's class, and Java imports its file."""
    s = _table(spark, sf_dir, "supplier").join(F.broadcast(_places(spark, sf_dir)), F.col("s_nationkey") == F.col("n_nationkey"))
    folder = F.concat(F.lit("parts/"), "p_brand", F.lit("/T"), F.col("p_size") % 10)
    p = _table(spark, sf_dir, "part").select("p_partkey", "p_name", folder.alias("folder"), F.regexp_replace(F.regexp_replace(_part_file(), r"\.java$", ""), "/", ".").alias("path"))
    li = _table(spark, sf_dir, "lineitem")
    deal_finely(li)
    li = li.join(p, F.col("l_partkey") == F.col("p_partkey")).join(s.select("s_suppkey", "place", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    turn = (F.col("l_orderkey") % 4 + 1).cast("int")
    ext = F.element_at(F.array(*map(F.lit, (".py", ".java", ".ts", ".go"))), turn)
    kind = F.element_at(F.array(*map(F.lit, ("call", "inherits", "decorator", "import"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    call = F.when((turn == 2) & (F.col("l_suppkey") % 3 == 0), F.concat(F.lit("K"), "p_partkey", F.lit("."), "p_name")).otherwise(F.concat(F.lit("x."), F.col("p_name"), F.lit("(y)")))
    imports = F.when(turn == 1, F.concat(F.lit("from parts import "), "p_name")).when(turn == 2, F.concat(F.lit("import static "), "path", F.lit("."), "p_name", F.lit(";")))
    imports = imports.when(turn == 3, F.concat(F.lit("import { "), F.translate("p_name", " ", "_"), F.lit(' } from "./parts"'))).otherwise(F.concat(F.lit("parts."), "p_name"))
    file = F.concat(F.when(F.col("l_suppkey") % 2 == 0, F.col("place")).otherwise(F.col("folder")), F.lit("/m"), F.col("l_suppkey") % 5, ext)
    return li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"), F.concat(file, F.lit("::S"), "l_suppkey").alias("source"),
        F.when(kind == "call", call).when(kind == "import", imports).otherwise(F.col("p_name")).alias("raw"), kind.alias("kind"), file.alias("file"), F.col("l_linenumber").alias("line"),
    )


def customer_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change per customer's file: added, modified, deleted and renamed in turn."""
    c = _table(spark, sf_dir, "customer").join(F.broadcast(_places(spark, sf_dir)), F.col("c_nationkey") == F.col("n_nationkey"))
    status = F.element_at(F.array(*map(F.lit, "AMDR")), (F.col("c_custkey") % 4 + 1).cast("int"))
    rows = c.select(F.col("c_custkey").alias("ord"), status.alias("status"), F.concat("place", F.lit("/C"), "c_custkey", F.lit(".py")).alias("file"))
    return rows.select("ord", "status", F.when(F.col("status") == "R", F.concat("file", F.lit(".new"))).otherwise(F.col("file")).alias("path"), F.when(F.col("status") == "R", F.col("file")).alias("old_path"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change per nation's file: added, modified, deleted and renamed in turn."""
    n = _places(spark, sf_dir)
    status = F.element_at(F.array(*map(F.lit, "AMDR")), (F.col("n_nationkey") % 4 + 1).cast("int"))
    return n.select(status.alias("status"), "place", F.col("n_nationkey").alias("ord")).select("ord", "status", F.when(F.col("status") == "R", F.concat("place", F.lit(".new"))).otherwise(F.col("place")).alias("path"), F.when(F.col("status") == "R", F.col("place")).alias("old_path"))


SQL = """
pl AS (SELECT n_nationkey, n_name, r_name, r_regionkey, 'r/' || r_name AS region_id, 'r/' || r_name || '::' || n_name AS nation_id,
  'r/' || r_name || '/' || n_name AS place FROM nation JOIN region ON n_regionkey = r_regionkey),
sp AS (SELECT *, place || '::S' || s_suppkey AS s_id FROM supplier JOIN pl ON s_nationkey = n_nationkey),
cu AS (SELECT *, place || '::C' || c_custkey AS c_id FROM customer JOIN pl ON c_nationkey = n_nationkey),
pf AS (SELECT *, 'parts/' || p_brand || '/T' || (p_size % 10) AS p_folder, 'parts/' || p_brand || '/T' || (p_size % 10) || '/f' || (p_partkey % 4) || '.java' AS p_file FROM part),
pa AS (SELECT *, p_file || '::K' || p_partkey || '.' || p_name AS p_id FROM pf),
g_nodes AS (
  SELECT CAST(r_regionkey AS BIGINT) AS ord, 'r/' || r_name AS id, 'module' AS type, r_name AS name, 'r/' || r_name AS file, CAST(r_regionkey AS INT) AS community FROM region
  UNION ALL SELECT 1000000000000 + n_nationkey, nation_id, 'class', n_name, region_id, CAST(n_nationkey AS INT) FROM pl
  UNION ALL SELECT 2000000000000 + s_suppkey, s_id, 'function', s_name, place, CAST(n_nationkey AS INT) FROM sp
  UNION ALL SELECT 3000000000000 + c_custkey, c_id, 'method', c_name, place, CAST(n_nationkey AS INT) FROM cu
  UNION ALL SELECT 4000000000000 + p_partkey, p_id, 'function', p_name, p_file, CASE WHEN p_partkey % 50 <> 0 THEN CAST(p_partkey % 7 AS INT) END FROM pa WHERE p_partkey % 97 <> 0),
g_edges AS (
  SELECT CAST(n_nationkey AS BIGINT) AS ord, region_id AS source, nation_id AS target, 'CONTAINS' AS type, 1.0::DOUBLE AS weight FROM pl
  UNION ALL SELECT 1000000000000 + s_suppkey, nation_id, s_id, 'CONTAINS', 1.0 FROM sp
  UNION ALL SELECT 2000000000000 + c_custkey, nation_id, c_id, 'CONTAINS', 1.0 FROM cu
  UNION ALL SELECT 3000000000000 + l_orderkey * 8 + l_linenumber, s_id, p_id, CASE WHEN l_returnflag = 'R' THEN 'RETURNS' ELSE 'CALLS' END, l_quantity
    FROM lineitem JOIN sp ON l_suppkey = s_suppkey JOIN pa ON l_partkey = p_partkey
  UNION ALL SELECT 4000000000000 + l_orderkey * 8 + l_linenumber, c_id, s_id, 'DEPENDS_ON', 1.0
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN cu ON o_custkey = c_custkey JOIN sp ON l_suppkey = s_suppkey WHERE l_linenumber = 1),
g_docs AS (SELECT doc_id AS ord, lang || '/' || doc_id AS id, lang AS type, text AS name, source AS file FROM documents)"""
