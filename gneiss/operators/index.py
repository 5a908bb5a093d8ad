"""A persisted inverted index: a question reads the buckets of its terms, and skips blocks that can't reach the best.

Documents lie in slices of neighbouring places. A block holds a term's postings in one slice, with bounds: the greatest frequency, the
least length and the greatest multiplier. Blocks of all terms are cut at the same slices, so the bounds of a question's terms add up to
a bound of each slice. The slices with the best bounds are scored first; those whose bound is below the score that is then at place k
are never opened (block-max pruning). Results are exact.

Blocks are kept in buckets by term. Changed documents touch their slices only: blocks of these are written anew, with a generation of their
own, and older blocks of a touched slice no longer count. Every update is one commit of the log.

A document is one row with its counted terms wherever it is dealt or written; postings are made where a slice's documents lie together, and
hold places and frequencies alone. What else a score needs is read from the opened slices' documents.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gneiss.functions import text as X
from gneiss.operators import search
from gneiss.session import broadcast_if_small, materialise
from gneiss.sources.log import Change, Log, State

#: Places in a slice, buckets of terms, slices scored first for each place asked for.
WIDTH, BUCKETS, FIRST = 128, 64, 4
_TERMS = "array<struct<t:string,tf:double>>"
BLOCK = "t string, type string, slice long, generation long, n long, most_tf double, least_dl double, most_m double, ords array<bigint>, tfs array<double>, bucket int"
FORWARD = "slice long, ord long, id string, type string, m double, dl double, terms string, tfs array<double>, generation long, bucket int"
TOUCHED = "slice long, generation long"
TOTALS = "type string, n long, dl double"


def _counted(tokens: Column) -> Column:
    """Each different token (t) with its weight in all (tf): tokens are sorted, and each run of equal ones is added up."""

    def runs(s: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["t"] != F.get(s, i - 1)["t"]))

        def counted(b: Column) -> Column:
            weight = lambda p, j: F.aggregate(F.slice(s, p + 1, F.coalesce(F.get(b, j + 1), F.size(s)) - p), F.lit(0.0), lambda a, x: a + x["w"])
            return F.transform(b, lambda p, j: F.struct(F.get(s, p)["t"].alias("t"), weight(p, j).alias("tf")))

        # arrays of one hold what is made once and looked at for each element
        return F.transform(F.array(first), counted)[0]

    return F.when(F.size(tokens) > 0, F.transform(F.array(F.sort_array(tokens)), runs)[0]).otherwise(F.array()).cast(_TERMS)


class Index:
    """An index in a folder of the shared file system; ``width`` and ``buckets`` count when it is first written."""

    def __init__(self, spark: SparkSession, root: str, width: int = WIDTH, buckets: int = BUCKETS):
        self.spark, self.log = spark, Log(spark, root)
        self.width, self.buckets = width, buckets

    def _shape(self, state: State) -> tuple[int, int, int]:
        return state.facts.get("width", self.width), state.facts.get("buckets", self.buckets), state.facts.get("generation", 0)

    def _live(self, table: str, schema: str, state: State, only: Column) -> DataFrame:
        """Rows of a table that no later generation replaced."""
        rows = self.log.read(table, schema, state).filter(only)
        last = self.log.read("touched", TOUCHED, state).groupBy("slice").agg(F.max("generation").alias("last"))
        return rows.join(broadcast_if_small(last), "slice", "left").filter(F.col("generation") == F.coalesce("last", F.lit(1))).drop("last")

    # writing

    def update(self, changed: DataFrame, removed: DataFrame | None = None) -> State:
        """Add documents, or replace those of the same ord, and take others (ord) away.

        changed is made by ``search.documents``: ord, id, type, m, tokens, dl. An ord is a document; of repeated ones the least id counts, with
        its tokens. Documents without tokens count for lengths and numbers. A null ord is an error.
        """
        own = changed.select("ord", "id", F.coalesce("type", F.lit("")).alias("type"), F.col("m").cast("double").alias("m"), F.col("dl").cast("double").alias("dl"), _counted(F.col("tokens")).alias("terms"))
        # identifiers hold no blanks; one text and one list of numbers are dealt more compactly than a list of pairs
        own = own.select("ord", "id", "type", "m", "dl", F.array_join(F.transform("terms", lambda x: x["t"]), " ").alias("terms"), F.transform("terms", lambda x: x["tf"]).alias("tfs"))
        width, buckets, _ = self._shape(self.log.state())
        place = F.floor(F.col("ord") / width).cast("long")
        # whole slices, and of a bucket's as many together as make files of a fair size
        own = own.withColumn("slice", place).withColumn("bucket", F.pmod("slice", F.lit(buckets)).cast("int")).withColumn("chunk", F.floor(F.col("slice") / 1024)).repartition("bucket", "chunk")
        own = own.withColumn("r", F.row_number().over(W.partitionBy("bucket", "chunk", "ord").orderBy("id", "type", "dl", "m", "terms", "tfs"))).filter("r = 1").drop("r", "slice", "bucket", "chunk")
        words = materialise(own, "index-words")
        if not words.filter("ord is null").isEmpty():
            raise ValueError("a document without ord")

        def plan(state: State) -> Change:
            width, buckets, generation = self._shape(state)
            generation += 1
            place = F.floor(F.col("ord") / width).cast("long")
            new = words.select(place.alias("slice"), "ord", "id", "type", "m", "dl", "terms", "tfs")
            gone = new.select("slice", "ord")
            if removed is not None:
                gone = gone.unionByName(removed.select(place.alias("slice"), F.col("ord").cast("long").alias("ord")).filter("ord is not null")).distinct()
            gone = materialise(gone, "index-gone")
            touched = materialise(gone.select("slice").distinct(), "index-touched")
            first = generation == 1
            rows, totals = new, self.log.read("totals", TOTALS, state)
            if not first:
                # the touched slices' buckets are read, and of these their other documents stay
                own = sorted(r["b"] for r in touched.select(F.pmod("slice", F.lit(buckets)).cast("int").alias("b")).distinct().collect())  # as many as there are buckets at most
                old = self._live("forward", FORWARD, state, F.col("bucket").isin(*own)).join(broadcast_if_small(touched), "slice", "left_semi")
                old = old.join(broadcast_if_small(gone.withColumn("gone", F.lit(True))), ["slice", "ord"], "left").drop("generation", "bucket")
                rows = new.unionByName(old.filter("gone is null").drop("gone"))
                less = old.filter("gone")
                totals = totals.unionByName(less.groupBy("type").agg((-F.count("*")).alias("n"), (-F.sum("dl")).alias("dl")))
            more = new.groupBy("type").agg(F.count("*").alias("n"), F.sum("dl").alias("dl"))
            totals = totals.unionByName(more).groupBy("type").agg(F.sum("n").alias("n"), F.sum("dl").alias("dl")).filter("n > 0")
            mark = F.lit(generation).cast("long").alias("generation")
            forward = rows.select("slice", "ord", "id", "type", "m", "dl", "terms", "tfs", mark, F.pmod("slice", F.lit(buckets)).cast("int").alias("bucket"))
            # a block has at most as many entries as a slice has places; a slice's documents are in one task, and so are its blocks
            postings = rows.filter("terms <> ''").repartition("slice").select("slice", "ord", "type", "m", "dl", F.inline(F.arrays_zip(F.split("terms", " ").alias("t"), F.col("tfs").alias("tf"))))
            blocks = postings.groupBy("t", "type", "slice").agg(F.min("dl").alias("least_dl"), F.max("m").alias("most_m"), F.sort_array(F.collect_list(F.struct("ord", "tf"))).alias("entries"))
            blocks = blocks.select("t", "type", "slice", "least_dl", "most_m", F.transform("entries", lambda x: x["ord"]).alias("ords"), F.transform("entries", lambda x: x["tf"]).alias("tfs"), F.pmod(F.crc32("t"), F.lit(buckets)).cast("int").alias("bucket"))
            # a term of very many blocks is dealt over tasks; within a file its blocks lie together
            blocks = blocks.repartition("bucket", F.floor(F.col("slice") / 1024)).sortWithinPartitions("bucket", "t", "slice")
            blocks = blocks.select("t", "type", "slice", mark, F.size("ords").cast("long").alias("n"), F.array_max("tfs").alias("most_tf"), "least_dl", "most_m", "ords", "tfs", "bucket")
            change = Change(facts={"width": width, "buckets": buckets, "generation": generation}, knows=["generation"], remove=[("totals", {})])
            change.add = [
                ("blocks", {"generation": generation}, blocks, ("bucket",)),
                ("forward", {"generation": generation}, forward.sortWithinPartitions("bucket", "slice"), ("bucket",)),  # words and old rows lie by bucket as they were written
                ("totals", {}, totals.coalesce(1), ()),
            ]
            if not first:
                change.add.append(("touched", {}, touched.withColumn("generation", mark), ()))
            return change

        return self.log.commit("update index", plan)

    def compact(self) -> State:
        """Write all live rows as one generation, without marks of touched slices."""

        def plan(state: State) -> Change:
            width, buckets, generation = self._shape(state)
            one = F.lit(1).cast("long")
            every = lambda t, s: self._live(t, s, state, F.lit(True)).withColumn("generation", one)
            change = Change(facts={"generation": 1}, knows=["generation"], remove=[("blocks", {}), ("forward", {}), ("touched", {})])
            change.add = [
                ("blocks", {"generation": 1}, every("blocks", BLOCK).repartition("bucket", F.floor(F.col("slice") / 1024)).sortWithinPartitions("bucket", "t", "slice"), ("bucket",)),
                ("forward", {"generation": 1}, every("forward", FORWARD).repartition("bucket").sortWithinPartitions("bucket", "slice"), ("bucket",)),
            ]
            return change

        return self.log.commit("compact index", plan)

    # reading

    def blocks(self, terms: list[str], node_type: str | None = None, state: State | None = None) -> DataFrame:
        """The live blocks of some terms: only the files of their buckets are opened."""
        state = state or self.log.state()
        _, buckets, _ = self._shape(state)
        wanted = F.col("bucket").isin(*sorted({zlib.crc32(t.encode()) % buckets for t in terms})) & F.col("t").isin(*terms)
        return self._live("blocks", BLOCK, state, wanted if node_type is None else wanted & (F.col("type") == node_type))

    def search(self, query: str, top_k: int = search.TOP_K, node_type: str | None = None, stop: tuple[str, ...] = X.STOP_WORDS) -> DataFrame:
        """rank, ord, id and score, as ``search.search`` gives them for the documents of the index."""
        return self.scored(query, top_k, node_type, stop)[0]

    def scored(self, query: str, top_k: int, node_type: str | None, stop: tuple[str, ...] = X.STOP_WORDS) -> tuple[DataFrame, DataFrame]:
        """(hits, slices): the hits, and bound, type and slice of all slices with a term, whether their blocks were opened or not."""
        state = self.log.state()
        times: dict[str, int] = {}
        for t in X.query_terms(query, stop):
            times[t] = times.get(t, 0) + 1
        totals = self.log.read("totals", TOTALS, state)
        if node_type is not None:
            totals = totals.filter(F.col("type") == node_type)
        whole = totals.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0.0)).alias("dl")).first()
        n, average = whole["n"], whole["dl"] / whole["n"] if whole["n"] else 0.0
        blocks = self.blocks(list(times), node_type, state)
        heads = materialise(blocks.drop("ords", "tfs", "bucket", "generation"), "index-heads")
        df = {r["t"]: r["df"] for r in heads.groupBy("t").agg(F.sum("n").alias("df")).collect()}  # a row for each term of the question
        mine = F.create_map(*[F.lit(x) for t in times for x in (t, float(times[t]))])
        counts = F.create_map(*[F.lit(x) for t in times for x in (t, df.get(t, 0))])

        def worth(tf: str, dl: str) -> Column:
            return F.element_at(mine, F.col("t")) * X.bm25(F.col(tf), F.element_at(counts, F.col("t")), F.lit(n), F.col(dl), F.lit(average))

        # a document of a slice has at most each term's greatest frequency, in the shortest text, with the greatest multiplier
        bounds = heads.groupBy("type", "slice").agg((F.sum(worth("most_tf", "least_dl")) * F.max("most_m") * (1 + 1e-9) + 1e-8).alias("bound"))
        bounds = materialise(bounds, "index-bounds")

        def hits(slices: DataFrame) -> DataFrame:
            entries = blocks.join(broadcast_if_small(slices.select("type", "slice")), ["type", "slice"], "left_semi").select("slice", "t", F.inline(F.arrays_zip(F.col("ords").alias("ord"), F.col("tfs").alias("tf"))))
            own = sorted(r["b"] for r in slices.select(F.pmod("slice", F.lit(self._shape(state)[1])).cast("int").alias("b")).distinct().collect())  # as many as there are buckets at most
            docs = self._live("forward", FORWARD, state, F.col("bucket").isin(*own)).select("slice", "ord", "id", "m", "dl")
            docs = docs.join(broadcast_if_small(slices.select("slice").distinct()), "slice", "left_semi")
            scores = entries.join(docs, ["slice", "ord"]).groupBy("ord", "id", "m").agg(F.sum(worth("tf", "dl")).alias("s"))
            return scores.select("ord", "id", F.round(F.col("s") * F.col("m"), 9).alias("score")).orderBy(F.desc("score"), "ord").limit(top_k)

        first = materialise(bounds.orderBy(F.desc("bound"), "type", "slice").limit(FIRST * top_k), "index-first")
        found = hits(first).agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
        opened = bounds.filter(F.col("bound") >= F.lit(found["least"])) if found["n"] == top_k else bounds
        opened = materialise(opened, "index-opened")
        best = hits(opened).withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "ord")))  # top_k rows
        return best.select("rank", "ord", "id", "score"), bounds.join(opened.select("type", "slice", F.lit(True).alias("opened")), ["type", "slice"], "left").withColumn("opened", F.coalesce("opened", F.lit(False)))
