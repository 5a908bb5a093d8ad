"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Each source's documents are permuted by a hash and cut into blocks; a target of several times the source's size takes
   whole passes over its blocks and part of one more. The number of blocks that the mix takes is the source's exact quota.
2. A tree splits the vector of quotas between two children at a time, each child's share drawn from the multivariate
   hypergeometric distribution (the law of an urn from which half of all blocks is drawn without replacement), until
   each leaf is an output shard. A node is one row with an array of quotas, so the tree needs no shuffle.
3. Shards draw disjoint runs of each source's permuted blocks and order their documents by a hash of their own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gneiss.llm.columns import WORD, let
from gneiss.session import broadcast_if_small, materialise

REPEATS = 3
#: Words of a block and blocks of a shard, on average.
BLOCK_WORDS, SHARD_BLOCKS = 50_000, 64
#: Trials of a draw, levels of the tree after which its nodes are dealt out, and bits of a stretch of running sums.
TRIALS, SPREAD, STRETCH = 64, 8, 10


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """source, source_size, ordinal and target: weights 1, 2, 3 by code point (null last) share all words; what a source
    can't take within ``repeats`` times its size is shared again by weight until none is above.

    The fixed point is closed: with sources sorted by size a weight, those that are cut come first, so the running sums
    of cut sizes and of weights tell where the cut ends. One row a source; the windows are over sources, not documents.
    """
    one = W.partitionBy(F.lit(0))
    s = sizes.withColumn("ordinal", F.row_number().over(one.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))) - 1)
    s = s.withColumn("weight", (F.col("ordinal") % 3 + 1).cast("double"))
    order = one.orderBy(F.col("source_size") / F.col("weight"), "ordinal")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    total, weights = F.sum("source_size").over(one), F.sum("weight").over(one)
    left = (total - repeats * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (weights - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("level", left).withColumn("cut", left * F.col("weight") > repeats * F.col("source_size"))
    s = s.withColumn("rate", F.min(F.when(~F.col("cut"), F.struct((F.col("source_size") / F.col("weight")).alias("k"), F.col("ordinal"), F.col("level").alias("v")))).over(one)["v"])
    capped = F.least(F.col("rate") * F.col("weight"), (repeats * F.col("source_size")).cast("double"))
    return s.select("source", "source_size", "ordinal", F.coalesce(capped, (repeats * F.col("source_size")).cast("double")).alias("target"))


def _uniform(*keys: Column) -> Column:
    """A number of [0, 1) that depends on nothing but the keys."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11) / F.lit(float(1 << 53))


def _log_factorial(n: Column) -> Column:
    """ln n! of a whole number of 0 or more: a short product below 8, else Stirling's series, right to about 1e-11."""
    small = F.log(F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(n, F.lit(8)).cast("int"))), F.lit(1.0), lambda a, i: a * i))
    series = lambda x: (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + (1 - (1 / 30 - 1 / (105 * x * x)) / (x * x)) / (12 * x)
    return F.when(n < 8, small).otherwise(let(n.cast("double"), series))


def _hypergeometric(total: Column, good: Column, drawn: Column, *keys: Column) -> Column:
    """How many good ones are among ``drawn`` of ``total`` when ``good`` of them are, by rejection from a table-mountain hat
    (ratio of uniforms): about 1.3 trials each, however large the quotas. ``keys`` make the trials' random numbers; should none of
    TRIALS be accepted (1e-20), the mode is taken.
    """

    def draw(few: Column, many: Column, m: Column) -> Column:
        mode = F.floor((m + 1) * (few + 1) / (total + 2)).cast("long")
        logs = lambda k: F.aggregate(F.transform(F.array(k, few - k, m - k, many - m + k), _log_factorial), F.lit(0.0), lambda a, x: a + x)
        share = few / total
        centre = m * share + 0.5
        spread = F.sqrt((total - m) * m * share * (1 - share) / F.greatest(total - 1, F.lit(1).cast("long")) + 0.5)
        width = 2 * math.sqrt(2 / math.e) * spread + (3 - 2 * math.sqrt(3 / math.e))

        def trials(top: Column) -> Column:
            def judge(x: Column, i: Column) -> Column:
                k = F.floor(centre + width * (_uniform(*keys, i, F.lit(1)) - 0.5) / x).cast("long")
                fits = lambda k: (k >= 0) & (k <= few) & (k <= m) & (m - k <= many)
                return let(k, lambda k: F.when(fits(k), F.when(2 * F.log(x) <= top - logs(k), k)))

            def trial(acc: Column, i: Column) -> Column:
                return F.when(acc.isNotNull(), acc).otherwise(let(_uniform(*keys, i, F.lit(0)) + 2.0**-54, lambda x: judge(x, i)))

            return F.coalesce(F.aggregate(F.sequence(F.lit(1), F.lit(TRIALS)), F.lit(None).cast("long"), trial), mode)

        return let(logs(mode), trials)

    def turned(few: Column, m: Column) -> Column:
        # the rarer kind was counted, among the smaller part
        k = let(draw(few, total - few, m), lambda k: F.when(good > few, m - k).otherwise(k))
        return let(k, lambda k: F.when(drawn > m, good - k).otherwise(k))

    sure = F.when((good <= 0) | (drawn <= 0), F.lit(0).cast("long")).when(good >= total, drawn).when(drawn >= total, good)
    k = let(F.least(good, total - good), lambda few: let(F.least(drawn, total - drawn), lambda m: turned(few, m)))
    return let(sure, lambda sure: F.when(sure.isNotNull(), sure).otherwise(k))


def split_quotas(root: DataFrame, levels: int, seed: int) -> DataFrame:
    """The tree: ``root`` has one row with quotas, an array of long by source ordinal. One row a shard: shard, quotas.

    After SPREAD levels the nodes are dealt over all tasks.
    """
    nodes = root.select(F.lit(0).cast("long").alias("shard"), "quotas")
    for level in range(levels):
        if level and level % SPREAD == 0:
            nodes = materialise(nodes.repartition("shard"), "tree")
        total = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, x: a + x)

        def left(total: Column, level: int = level) -> Column:
            start = F.struct(total.alias("rest"), F.ceil(total / 2).cast("long").alias("draw"), F.array().cast("array<bigint>").alias("out"))

            def step(a: Column, i: Column) -> Column:
                def take(q: Column) -> Column:
                    x = _hypergeometric(a["rest"], q, a["draw"], F.lit(seed), F.lit(level), F.col("shard"), i)
                    return let(x, lambda x: F.struct((a["rest"] - q).alias("rest"), (a["draw"] - x).alias("draw"), F.concat(a["out"], F.array(x)).alias("out")))

                return let(F.get("quotas", i), take)

            return F.aggregate(F.sequence(F.lit(0), F.size("quotas") - 1), start, step, lambda a: a["out"])

        halves = let(left(total), lambda l: F.array(F.struct(F.lit(0).cast("long").alias("side"), l.alias("q")), F.struct(F.lit(1).cast("long").alias("side"), F.zip_with("quotas", l, lambda a, b: a - b).alias("q"))))
        nodes = nodes.select("shard", F.explode(halves).alias("half")).select((F.col("shard") * 2 + F.col("half.side")).alias("shard"), F.col("half.q").alias("quotas"))
    return nodes


def running(rows: DataFrame, by: str, order: str, values: dict[str, str]) -> DataFrame:
    """``rows`` with the sums of some columns over what stands before each row in the order of ``order`` (whole numbers from 0),
    per ``by``: first by stretches of STRETCH, then within them, so that a hot ``by`` is dealt over many tasks."""
    part = F.shiftright(F.col(order), STRETCH)
    sums = rows.groupBy(by, part.alias("_part")).agg(*[F.sum(v).alias(f"_{v}") for v in values])
    before = W.partitionBy(by).orderBy("_part")
    sums = sums.select(by, "_part", *[(F.sum(f"_{v}").over(before) - F.col(f"_{v}")).alias(f"_{v}") for v in values])
    within = W.partitionBy(by, "_part").orderBy(order)
    out = rows.withColumn("_part", part).join(sums, [by, "_part"])
    return out.select(*rows.columns, *[(F.col(f"_{v}") + F.sum(v).over(within) - F.col(v)).alias(name) for v, name in values.items()])


def mix(docs: DataFrame, repeats: int = REPEATS, seed: int = 7, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, whole: bool = False, row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(draws, sizes). draws: one row for each time that a row of ``docs`` is drawn: row, shard, place (order in its shard), pass and
    words. sizes: row, doc_id, source, size, source_size, target of every row of ``docs`` (doc_id, text, source; ``row`` names a column
    that numbers the rows, else they are numbered here).

    The words drawn of a source are its target, rounded; the last document of a source is drawn in part, or, with ``whole``, whole
    if at least half of it is. A null text has no words and is never drawn; a null source is a source, the last; repeated
    rows are drawn each for itself; an empty table gives empty results; other columns are not read. Reruns agree.
    """
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    sizes = docs.select(F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("key"), number.alias("row"))
    sizes = materialise(sizes, "sizes")
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, round(total / block_words))
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = materialise(targets(per, repeats), "targets")
    known = sizes.join(broadcast_if_small(goal.withColumnRenamed("source", "s2")), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")

    # blocks: ranges of the hash that permutes a source; their sums come from partial sums, so a hot source is no hot task
    block = F.floor(_uniform(F.col("key")) * blocks).cast("long")
    placed = known.filter("size > 0").withColumn("block", block)
    sums = placed.groupBy("ordinal", "block").agg(F.sum("size").alias("words"), F.first("target").alias("target"), F.first("source_size").alias("all")).withColumn("one", F.lit(1).cast("long"))
    sums = materialise(running(sums, "ordinal", "block", {"words": "start", "one": "index"}), "blocks")
    goal_words = F.round("target").cast("long")
    passes = F.sequence(F.lit(0), F.lit(repeats - 1))
    taken = sums.select("ordinal", "block", "index", "start", "all", goal_words.alias("goal"), F.explode(passes).alias("pass")).filter(F.col("start") + F.col("pass") * F.col("all") < F.col("goal"))

    quota = materialise(taken.groupBy("ordinal").agg(F.count("*").alias("q")).join(sums.groupBy("ordinal").agg(F.count("*").alias("n_blocks")), "ordinal"), "source-quotas")
    root = quota.agg(F.sort_array(F.collect_list(F.struct("ordinal", "q"))).alias("x")).filter(F.size("x") > 0)
    counts = root.select(F.transform("x", lambda y: y["q"]).alias("quotas"))
    first = counts.select(F.aggregate("quotas", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).first()
    levels = max(0, ((first["n"] if first else 0) // shard_blocks).bit_length())
    leaves = materialise(split_quotas(counts, levels, seed), "quotas")
    ordinals = quota.select("ordinal", (F.row_number().over(W.partitionBy(F.lit(0)).orderBy("ordinal")) - 1).alias("i"))  # one row a source
    leaf = leaves.select("shard", F.posexplode("quotas").alias("i", "n")).filter("n > 0").join(broadcast_if_small(ordinals), "i").select("ordinal", "shard", "n")
    runs = running(leaf, "ordinal", "shard", {"n": "from"}).select("ordinal", "shard", F.explode(F.sequence(F.col("from"), F.col("from") + F.col("n") - 1)).alias("turn"))

    # which turn a taken block has: every pass but the last takes all blocks of a source, each in permuted order
    turn = F.col("pass") * F.col("n_blocks") + F.col("index")
    drawn = taken.join(broadcast_if_small(quota.drop("q")), "ordinal").withColumn("turn", turn).join(runs, ["ordinal", "turn"]).select("ordinal", "block", "start", "all", "goal", "pass", "shard")
    within = W.partitionBy("ordinal", "block").orderBy("key", "doc_id", "row")
    members = placed.select("ordinal", "block", "row", "key", "size", (F.sum("size").over(within) - F.col("size")).alias("inner"))
    at = F.col("start") + F.col("inner") + F.col("pass") * F.col("all")
    part = F.least(F.col("size"), F.col("goal") - at)
    part = F.when(part * 2 >= F.col("size"), F.col("size")).otherwise(F.lit(0)) if whole else part
    draws = members.join(drawn, ["ordinal", "block"]).withColumn("words", part).filter("words > 0")
    order = F.xxhash64(F.lit(seed), "shard", "key", "pass")
    draws = draws.withColumn("order", order).withColumn("place", F.row_number().over(W.partitionBy("shard").orderBy("order", "key", "row", "pass")))
    return draws.select("row", "shard", "place", "pass", "words"), known.select("row", "doc_id", "source", "size", "source_size", "target")


def digest(draws: DataFrame, sizes: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken and places (shard:place of each draw, by pass); documents that are never drawn have 0 and ''."""
    got = draws.groupBy("row").agg(F.sum("words").alias("taken"), F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("pass", "shard", "place"))), lambda x: F.concat_ws(":", x["shard"], x["place"]))).alias("places"))
    return sizes.join(got, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("places", F.lit("")).alias("places"))


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix as rows of ``docs``, whole documents, each row as many times as it is drawn, dealt by shard and in each shard's shuffled
    order; all columns are kept, whatever their names. Texts without words are not drawn; an empty table gives an empty result."""
    rows = materialise(docs.select(F.struct(*docs.columns).alias("d"), F.monotonically_increasing_id().alias("row")), "numbered")
    draws, _ = mix(rows.select("d.doc_id", "d.text", "d.source", "row"), whole=True, row="row", **settings)
    draws = materialise(draws.select("row", "shard", "place"), "draws")
    out = rows.join(broadcast_if_small(draws), "row")
    return out.repartition("shard").sortWithinPartitions("shard", "place").select(*[F.col("d").getField(c).alias(c) for c in docs.columns])


#: What SQL can express of the mix.
TARGET_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size) AS n, (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1 AS w FROM d GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY n / w, source IS NULL, encode(source)) AS i, sum(n) OVER () AS total, sum(w) OVER () AS weights FROM s),
r AS (SELECT *, (total - 3 * (sum(n) OVER (ORDER BY i) - n)) / CAST(weights - (sum(w) OVER (ORDER BY i) - w) AS DOUBLE) AS rate FROM o),
c AS (SELECT arg_min(rate, i) AS rate FROM r WHERE rate * w <= 3 * n)
SELECT doc_id, size, CAST(n AS BIGINT) AS source_size, CAST(least(coalesce((SELECT rate FROM c), 1e300) * w, 3 * n) AS DOUBLE) AS target FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source
"""
