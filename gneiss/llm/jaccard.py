"""N-gram Jaccard join by grouped prefixes.

Tokens (hashed word n-grams) are ordered by hash. Two sets of similarity t or more share at least ceil(t * size) tokens, hence
one of the first size - ceil(t * size) + 1 of each: the prefix. Equal sets are one class; classes of equal prefix and size
are one group. Groups that share a prefix token are joined, and their pairs filtered, as groups: by size, and by the bits of
parity bitmaps that all members of a group have alike, whose difference bounds that of any two members from below. Only the pairs
of groups that are left are expanded to members, filtered by the members' own bitmaps, and verified exactly.

Three steps keep this from listing all pairs of a large family of copies or of all texts that quote one passage:
* a filter over a fixed quarter of the hash range: a set with a partner misses at most size - ceil(t * size) tokens of it, so
  sets with more unshared tokens there are out at once (texts that only quote the same passage mostly are);
* among what is left, tokens that many sets have come last in the order, so prefixes are made of rare ones;
* a star: the groups of a token are compared with the one that shares most, and their members with its best member. Then only
  what is in different components is compared on (a group's members in one component being a unit of their own), over a growing
  part of the tokens at a time, components being joined in between; members of one component need no further link, as
  components are asked for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.components import components
from gneiss.llm.textbytes import shingles
from gneiss.session import broadcast_if_small, materialise, small_batches

N, PERCENT = 4, 85
#: Hashes below this (of signed 64-bit numbers) are the quarter that the filter looks at.
QUARTER = -(1 << 62)
#: Tokens of this many sets come last in the order. Longs of the parity bitmap. Of 16 parts of the tokens, how many each round takes.
HEAVY, LONGS, ROUNDS = 16, 8, (1, 3, 12)


def _needed(percent: int) -> Column:
    return F.floor((F.col("n") * percent + 99) / 100).cast("int")


def token_sets(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, a hash of the text, set size, a 128-bit digest of the set, and its tokens in the filter's range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [_tokens(t, n) for t in b["_t"].to_pylist()]
            made = [pa.array([len(h) for h in sets], pa.int32()), pa.array([_digest(h) for h in sets], pa.binary()), pa.array([h[: np.searchsorted(h, QUARTER)] for h in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b["_id"], b["_h"], *made], ["_id", "_h", "n", "c", "low"])

    return _keyed(docs).mapInArrow(run, f"_id {docs.schema['doc_id'].dataType.simpleString()}, _h long, n int, c binary, low array<long>")


def _keyed(docs: DataFrame) -> DataFrame:
    t = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").alias("_id"), F.xxhash64(t).alias("_h"), t.alias("_t"))


def _tokens(text: str, n: int) -> np.ndarray:
    h = shingles(np.frombuffer(text.encode("utf-8", "replace").lower(), np.uint8), n)
    return np.sort(h.view(np.int64))


def _digest(h: np.ndarray) -> bytes:
    u = h.view(np.uint64)
    a = u.sum(dtype=np.uint64)
    b = (u * (u >> np.uint64(7) | np.uint64(1))).sum(dtype=np.uint64)
    return b"".join(int(x).to_bytes(8, "big") for x in (a, b)) + len(h).to_bytes(4, "big")


def _parity(h: np.ndarray) -> list[int]:
    """A bitmap with each bit's count of tokens modulo 2."""
    bits = np.bincount((h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(55)).astype(np.int64), minlength=64 * LONGS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64).tolist()


BITS = [f"b{i}" for i in range(LONGS)]
#: Which bits of a group's bitmap differ between its members; null where none does.
LOOSE = [f"o{i}" for i in range(LONGS)]


def _apart(percent: int, loose: bool) -> Column:
    """Whether n and the bitmap and those of the other side (hub_) leave a high enough similarity possible; ``loose`` bits say nothing."""
    size = F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * percent
    apart = F.lit(0)
    for b, o in zip(BITS, LOOSE):
        differ = F.col(b).bitwiseXOR(F.col(f"hub_{b}"))
        for side in (o, f"hub_{o}") if loose else ():
            differ = differ.bitwiseAND(F.bitwise_not(F.coalesce(side, F.lit(0).cast("long"))))
        apart = apart + F.bit_count(differ)
    return size & (apart * (100 + percent) <= (F.col("n") + F.col("hub_n")) * (100 - percent))


def _bucket(percent: int) -> Column:
    """Sets of sizes that fit are in the same bucket or in neighbouring ones."""
    return F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent)).cast("int")


def _units(members: DataFrame, *keys: str) -> DataFrame:
    """Members that are one group (or the part of it in one component): their common bits, the best score and how many they are."""
    common = [F.bit_and(b).alias(b) for b in BITS]
    loose = [F.nullif(F.bit_and(b).bitwiseXOR(F.bit_or(b)), F.lit(0).cast("long")).alias(o) for b, o in zip(BITS, LOOSE)]
    return members.groupBy(*keys, "n").agg(F.max("score").alias("score"), F.count("*").alias("members"), *common, *loose)


def group_pairs(at: DataFrame, percent: int, keys: list[str]) -> DataFrame:
    """The pairs of units that share a token and may have similar members; in ``at`` each unit stands once for each of its tokens (h)
    with left and right telling on which side. A unit is paired with itself only where it stands for several members."""
    side = [*keys, "n", *BITS, *LOOSE]
    right = at.filter("right").select("h", F.explode(F.array(*[_bucket(percent) + d for d in (-1, 0, 1)])).alias("bucket"), *[F.col(c).alias(f"hub_{c}") for c in side])
    left = at.filter("left").select("h", _bucket(percent).alias("bucket"), "members", *side)
    other = F.col("comp") != F.col("hub_comp") if "comp" in keys else (F.col("grp") != F.col("hub_grp")) | (F.col("members") > 1)
    pairs = left.join(right, ["h", "bucket"]).filter(other & _apart(percent, loose=True))
    return pairs.select(*keys, *[f"hub_{c}" for c in keys]).distinct()


def expand(pairs: DataFrame, left: DataFrame, right: DataFrame, percent: int, keys: list[str]) -> DataFrame:
    """The pairs (a, b) of members of paired units whose bitmaps fit."""
    other = right.select(*[F.col(c).alias(f"hub_{c}") for c in (*keys, "c", "n", *BITS)])
    both = pairs.join(left.select(*keys, "c", "n", *BITS), keys).join(other, [f"hub_{c}" for c in keys])
    both = both.filter((F.col("c") != F.col("hub_c")) & _apart(percent, loose=False))
    return both.select(F.least("c", "hub_c").alias("a"), F.greatest("c", "hub_c").alias("b")).distinct()


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose exact similarity is high enough."""
    left = sets.select(F.col("c").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("c").alias("b"), F.col("tokens").alias("y"))
    both = pairs.join(left, "a").join(right, "b").withColumn("both", F.size(F.array_intersect("x", "y")))
    return both.filter(F.col("both") * 100 >= (F.size("x") + F.size("y") - F.col("both")) * percent).select("a", "b")


def near_duplicates(docs: DataFrame, n: int = N, percent: int = PERCENT, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles and component_id, the smallest doc_id reachable by links.

    Null texts and texts without words have no tokens and no links; their component is their own id. Rows with the same
    text are linked (if it has words); repeated rows each give a row; doc_id may be of any type with an order. A null doc_id is never the smallest unless all are null.
    An empty table gives an empty result; other columns are not read.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.col(text).alias("text"))
    rows = materialise(token_sets(docs, n).withColumn("row", F.monotonically_increasing_id()), "token-sets")
    low = rows.select("row", F.explode("low").alias("h"))
    shared = low.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1").select("h")
    hits = low.join(shared, "h").groupBy("row").agg(F.count("*").alias("hits"))
    need = _needed(percent)
    kept = rows.filter("n > 0").select("row", "_id", "_h", "n", "c", F.size("low").alias("s")).join(hits, "row", "left")
    kept = kept.withColumn("hits", F.coalesce("hits", F.lit(0))).filter(F.col("hits") >= F.col("s") - (F.col("n") - need))
    classes = kept.groupBy("c", "n").agg(F.min(F.struct("_id", "_h")).alias("r"), F.max(F.col("hits") / F.greatest("s", F.lit(1))).alias("score"))
    classes = materialise(classes.select("c", "n", "score", F.col("r._id").alias("i"), F.col("r._h").alias("g")), "classes")
    wanted = _keyed(docs).join(broadcast_if_small(classes), F.col("_id").eqNullSafe(F.col("i")) & (F.col("_h") == F.col("g")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = [_tokens(x, n) for x in b["_t"].to_pylist()]
            parity = np.array([_parity(h) for h in tokens], np.int64).reshape(len(tokens), LONGS)
            yield pa.RecordBatch.from_arrays([b["c"], b["n"], b["score"], pa.array(tokens, pa.list_(pa.int64())), *map(pa.array, parity.T)], ["c", "n", "score", "tokens", *BITS])

    longs = ", ".join(f"{c} long" for c in BITS)
    sets = materialise(wanted.select("c", "n", "score", "_t").mapInArrow(run, f"c binary, n int, score double, tokens array<long>, {longs}").dropDuplicates(["c"]), "sets")
    each = sets.select("c", F.explode("tokens").alias("h"))
    heavy = materialise(each.groupBy("h").agg(F.count("*").alias("df")).filter(F.col("df") >= HEAVY).select("h"), "heavy-tokens")
    common = each.join(broadcast_if_small(heavy), "h").groupBy("c").agg(F.array_sort(F.collect_list("h")).alias("heavy"))
    ordered = F.when(F.col("heavy").isNull(), F.col("tokens")).otherwise(F.concat(F.array_except("tokens", "heavy"), F.col("heavy")))
    prefix = F.slice(ordered, F.lit(1), F.col("n") - need + 1)
    grouped = sets.join(common, "c", "left").select("c", "n", "score", prefix.alias("prefix"), *BITS)
    grouped = materialise(grouped.withColumn("grp", F.xxhash64("prefix", "n")), "groups")

    # one posting per prefix token and group; a group's own name is a posting that joins its members
    members = grouped.drop("prefix")
    prefixes = grouped.groupBy("grp").agg(F.min_by("prefix", "c").alias("prefix"), F.count("*").alias("members"))
    posts = prefixes.select("grp", F.explode("prefix").alias("h"))
    several = posts.groupBy("h").agg(F.count("*").alias("k")).filter("k > 1").select("h")
    lone = prefixes.filter("members > 1").select("grp", F.col("grp").alias("h"))
    posts = materialise(posts.join(several, "h").select("h", "grp").unionByName(lone.select("h", "grp")), "postings")
    links = known = None

    for turn in range(len(ROUNDS) + 1):
        if turn:  # tokens of units in more than one component: all units outside the main one against all others
            keys = ["grp", "comp"]
            found = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
            own = materialise(members.join(found, members["c"] == found["node"], "left").withColumn("comp", F.coalesce("root", "c")).drop("node", "root"), "members")
            first = sum(ROUNDS[: turn - 1])
            part = F.pmod("h", F.lit(sum(ROUNDS))).between(first, first + ROUNDS[turn - 1] - 1)
            at = materialise(posts.filter(part).join(_units(own, *keys), "grp"), "units-of-tokens")
            sizes = at.groupBy("h", "comp").agg(F.count("*").alias("k"))
            tokens = sizes.groupBy("h").agg(F.count("*").alias("comps"), F.max(F.struct("k", "comp")).alias("main")).filter("comps > 1").select("h", F.col("main.comp").alias("main"))
            at = at.join(tokens, "h").withColumns({"left": F.col("comp") != F.col("main"), "right": F.lit(True)})
            right = own
        else:  # all groups of a token against its hub, and their members against the hub's best
            keys, own = ["grp"], members
            at = materialise(posts.join(_units(members, "grp"), "grp"), "groups-of-tokens")
            hubs = at.groupBy("h").agg(F.max(F.struct("score", "grp")).alias("p")).select("h", F.col("p.grp").alias("hub"))
            at = at.join(hubs, "h").withColumns({"left": F.lit(True), "right": F.col("grp") == F.col("hub")})
            right = members.groupBy("grp").agg(F.max(F.struct("score", "c", "n", *BITS)).alias("p")).select("grp", "p.*")
        pairs = expand(materialise(group_pairs(at, percent, keys), "group-pairs"), own, right, percent, keys)
        pairs = materialise(pairs if known is None else pairs.join(known, ["a", "b"], "left_anti"), "pairs")
        new = materialise(_verify(pairs, sets.select("c", "tokens"), percent), "new-links")
        links, known = (new, pairs) if known is None else (links.unionByName(new), known.unionByName(pairs))
    found = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    every = rows.select("_id", "n", "c").join(found, rows["c"] == found["node"], "left").withColumn("root", F.coalesce("root", "c"))
    every = materialise(every.select("_id", "n", "root"), "roots")
    first = every.filter("n > 0").groupBy("root").agg(F.min("_id").alias("first"))
    out = every.join(first, "root", "left")
    return out.select(F.col("_id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("first")).otherwise(F.col("_id")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with all columns, whose doc_id is the smallest of its component; rows with a null id stay."""
    gone = near_duplicates(docs, n, percent).filter("component_id <> doc_id").select(F.col("doc_id").alias("_id")).distinct()
    gone = materialise(gone, "further-copies")
    return docs.join(broadcast_if_small(gone), docs["doc_id"] == gone["_id"], "left_anti")


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS root, doc_id FROM d UNION SELECT r.root, e.b FROM r JOIN e ON r.doc_id = e.a)
SELECT d.doc_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM d LEFT JOIN c USING (doc_id) JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY 1) m USING (doc_id)
"""
