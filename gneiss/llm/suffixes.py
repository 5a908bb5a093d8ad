"""Removal of repeated byte strings by column-wise construction over anchored segments.

A byte goes when a string of LENGTH bytes that covers it also starts anywhere else. Inserting one symbol of every document each
round takes as many passes over the whole collection as its longest document has bytes, so the construction runs on bounded
pieces that hold all that can match:

1. Anchors. In each window of LENGTH bytes one K-byte string is the anchor: that of least hash, the last among equals. It
   depends on the window's bytes alone, so equal windows have equal anchors at equal places. A maximal run of windows with one
   anchor is a segment; segments are named by hashes, counted, and most are the only ones of their anchor and out.
2. Segments that occur twice as a whole repeat as a whole. Those left share an anchor with different segments.
3. Columns. Their texts are dealt by anchor into files of the shared folder, each sorted by anchor, which a task reads in sequence.
   Aligned at their anchors, the segments are a collection of which each round inserts the next symbol of every segment: the
   order of the segments by what has been inserted, read backwards, and with it the column's Burrows-Wheeler transform (the symbols in
   that order, by which a stable sort gives the next order), and where the common part of neighbours begins, are updated from
   those of the round before. A window repeats when the common part of its segment and a neighbour is as long.
4. An anchor with more segments than a task should hold has its windows counted one by one by their hashes instead, which
   deals them over all tasks: the exact way for what a cap leaves over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.textbytes import BASE, BASE2, Sums, mix
from gneiss.session import broadcast_if_small, materialise, small_batches

LENGTH, ANCHOR = 400, 128
#: Bytes of a text that are looked at together, segments of one anchor in a task, bytes of segments in a round.
PIECE, GROUP, ROUND_BYTES = 1 << 20, 16_384, 8 << 20
_LOW = np.uint64((1 << 24) - 1)


def segments(data: np.ndarray, length: int = LENGTH, k: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """lo, hi (first and last window), x (anchor), h (its hash) and s (hash of the whole) of each segment of some bytes."""
    parts = [_segments(data[at : at + PIECE + length - 1], at, length, k) for at in range(0, max(1, len(data) - length + 1), PIECE)]
    return tuple(np.concatenate(p) for p in zip(*parts))


def _segments(data: np.ndarray, at: int, length: int, k: int) -> tuple[np.ndarray, ...]:
    n, w = len(data), length - k + 1
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    start = np.arange(n - k + 1)
    h = Sums(data).ranges(start, start + k)
    key = (h & ~_LOW) | (_LOW - start.astype(np.uint64))
    windows = n - length + 1
    rows = np.full(-(-len(key) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    rows[: len(key)] = key
    rows = rows.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    x = (_LOW - (np.minimum(behind[:windows], ahead[w - 1 : w - 1 + windows]) & _LOW)).astype(np.int64)
    new = np.flatnonzero(x[1:] != x[:-1]) + 1
    lo, hi = np.r_[0, new], np.r_[new, windows] - 1
    x = x[lo]
    s = mix(Sums(data, BASE2).ranges(lo, hi + length) + (x - lo).astype(np.uint64) * np.uint64(BASE))
    return lo + at, hi + at, x + at, h[x], s


class Columns:
    """The collection of aligned strings up to a column: ``order``, the strings by what they have up to it, read backwards, and ``since``,
    the column in which the common part of each and the one before it in the order begins."""

    def __init__(self, texts: list[bytes], before: np.ndarray):
        """``before``: how many symbols a string has before column 0."""
        size = np.array([len(t) for t in texts], np.int64)
        self.flat = np.frombuffer(b"".join(texts), np.uint8)
        self.begin, self.end = -before, size - before
        self.zero = np.cumsum(size) - size + before
        self.entering = np.argsort(self.begin, kind="stable")
        self.entered = 0
        self.order, self.since = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def insert(self, column: int) -> np.ndarray:
        """Insert the symbols of a column; the column's transform."""
        gone = self.end[self.order] <= column
        if gone.any():  # what follows a string that has ended has in common with those before it what both had with the ended one
            stay = np.flatnonzero(~gone)
            self.since = np.maximum.reduceat(self.since[: stay[-1] + 1], np.r_[0, stay[:-1] + 1]) if len(stay) else self.since[:0]
            self.order = self.order[stay]
        upto = int(np.searchsorted(self.begin[self.entering], column, "right"))
        new = self.entering[self.entered : upto]
        self.entered = upto
        self.order, self.since = np.r_[self.order, new], np.r_[self.since, np.full(len(new), column, np.int64)]
        symbols = self.flat[self.zero[self.order] + column]
        by = np.argsort(symbols, kind="stable")
        same = np.zeros(len(by), bool)
        same[1:] = symbols[by[1:]] == symbols[by[:-1]]
        since = np.full(len(by), column + 1, np.int64)
        since[same] = _greatest(self.since, by[np.flatnonzero(same) - 1] + 1, by[same])
        self.order, self.since = self.order[by], since
        return symbols


def _greatest(x: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The maximum of x[first : last + 1] of each pair, from maxima over stretches of powers of two."""
    if not len(first):
        return np.zeros(0, np.int64)
    level = np.frexp(last - first + 1)[1] - 1
    table = [x]
    for i in range(int(level.max())):
        table.append(np.r_[np.maximum(table[i][: -(1 << i)], table[i][1 << i :]), np.zeros(1 << i, np.int64)])
    table = np.stack(table)
    return np.maximum(table[level, first], table[level, last + 1 - (1 << level)])


def repeated_windows(texts: list[bytes], before: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """Which windows of each segment (bytes, with ``before`` of them before its anchor) occur in another segment at the same place."""
    c = Columns(texts, before)
    found = [np.zeros(max(0, len(t) - length + 1), bool) for t in texts]
    offset = np.cumsum([len(f) for f in found]) - [len(f) for f in found]
    flags = np.zeros(sum(map(len, found)), bool)
    for column in range(int(c.begin.min()), int(c.end.max())):
        c.insert(column)
        long = column + 1 - c.since >= length
        own = c.order[long | np.r_[long[1:], False]]
        flags[offset[own] + column + 1 - length - c.begin[own]] = True
    return [flags[o : o + len(f)] for o, f in zip(offset, found)]


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist()))


def _columns(rows: pd.DataFrame, length: int) -> pd.DataFrame:
    found = repeated_windows(list(rows["bytes"]), rows["before"].to_numpy(np.int64), length)
    out = [(h, s, a, b) for h, s, f in zip(rows["h"], rows["s"], found) for a, b in _runs(f)]
    return pd.DataFrame(out, columns=["h", "s", "a", "b"]).astype("int64")


def repeated_ranges(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR, group: int = GROUP) -> DataFrame:
    """_id, _h (hash of the text) and ranges, array of struct(a, b) of bytes to remove, of each text that has any."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, t in enumerate(b["_t"]):
                lo, hi, x, h, s = segments(np.frombuffer(t.encode(), np.uint8), length, k)
                if len(lo):
                    out.append(pd.DataFrame({"i": i, "lo": lo, "hi": hi, "x": x, "h": h.view(np.int64), "s": s.view(np.int64)}))
            if out:
                rows = pd.concat(out)
                yield pd.DataFrame({"_id": b["_id"].to_numpy()[rows["i"]], "_h": b["_h"].to_numpy()[rows["i"]]}).assign(**{c: rows[c].to_numpy() for c in ("lo", "hi", "x", "h", "s")})

    whole = _keyed(docs)
    runs = materialise(whole.mapInPandas(cut, "_id long, _h long, lo int, hi int, x int, h long, s long"), "segments")
    counted = runs.groupBy("h", "s").agg(F.count("*").alias("n"))
    anchors = counted.groupBy("h").agg(F.count("*").alias("kinds"), F.max("n").alias("most")).filter("kinds > 1 or most > 1").select("h", "kinds")
    named = materialise(counted.join(anchors, "h"), "shared-segments")
    held = materialise(runs.join(named, ["h", "s"]), "places")

    one = held.filter("kinds > 1").groupBy("h", "s", "kinds").agg(F.min(F.struct("_id", "_h", "lo", "hi", "x")).alias("p"))
    one = one.groupBy(F.col("p._id").alias("i"), F.col("p._h").alias("g")).agg(F.collect_list(F.struct("h", "s", "kinds", "p.lo", "p.hi", "p.x")).alias("ps"))
    one = materialise(one, "first-places")
    texts = whole.join(broadcast_if_small(one), (F.col("_id") == F.col("i")) & (F.col("_h") == F.col("g")))

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p["h"], p["s"], p["kinds"], p["x"] - p["lo"], d[p["lo"] : p["hi"] + length]) for d, ps in zip((t.encode() for t in b["_t"]), b["ps"]) for p in ps]
            yield pd.DataFrame(rows, columns=["h", "s", "kinds", "before", "bytes"])

    small = texts.select("_t", "ps").mapInPandas(take, "h long, s long, kinds long, before long, bytes binary").dropDuplicates(["h", "s"])
    small = materialise(small, "segment-texts")

    def columns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting, size = [], 0  # rows come sorted by anchor: what follows the last complete anchor waits
        for b in batches:
            waiting.append(b)
            size += sum(map(len, b["bytes"]))
            if size >= ROUND_BYTES:
                rows = pd.concat(waiting)
                done = rows["h"] != rows["h"].iloc[-1]
                if done.any():
                    yield _columns(rows[done], length)
                waiting = [rows[~done]]
                size = sum(map(len, waiting[0]["bytes"]))
        if waiting and sum(map(len, waiting)):
            yield _columns(pd.concat(waiting), length)

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for h, s, text in zip(b["h"], b["s"], b["bytes"]):
                data, at = np.frombuffer(text, np.uint8), np.arange(len(text) - length + 1)
                yield pd.DataFrame({"h": h, "s": s, "at": at, "w1": Sums(data).ranges(at, at + length).view(np.int64), "w2": Sums(data, BASE2).ranges(at, at + length).view(np.int64)})

    # a given number of parts: the rounds cost more than their bytes suggest, so these must not be coalesced by size
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = small.filter(F.col("kinds") <= group).repartition(parts, "h").sortWithinPartitions("h")
    found = few.select("h", "s", "before", "bytes").mapInPandas(columns, "h long, s long, a long, b long")
    many = small.filter(F.col("kinds") > group).repartition("h", "s").select("h", "s", "bytes")
    many = many.mapInPandas(windows, "h long, s long, at long, w1 long, w2 long")
    again = many.groupBy("h", "w1", "w2").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    spots = many.join(again, ["h", "w1", "w2"]).select("h", "s", F.col("at").alias("a"), F.col("at").alias("b"))
    found = materialise(found.unionByName(spots), "repeats")

    sure = held.filter("n > 1").select("_id", "_h", F.col("lo").alias("a"), (F.col("hi") + length).alias("b"))
    part = held.filter("n = 1").join(found, ["h", "s"]).select("_id", "_h", (F.col("lo") + F.col("a")).cast("int").alias("a"), (F.col("lo") + F.col("b") + length).cast("int").alias("b"))
    return sure.unionByName(part).groupBy("_id", "_h").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))


def _keyed(docs: DataFrame) -> DataFrame:
    t = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.xxhash64("doc_id").alias("_id"), F.xxhash64(t).alias("_h"), t.alias("_t"))


def keep_mask(n: int, ranges) -> np.ndarray:
    step = np.zeros(n + 1, np.int64)
    for r in ranges if ranges is not None else ():
        step[r["a"]] += 1
        step[r["b"]] -= 1
    return np.cumsum(step[:n]) == 0


def deduplicate(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans and kept (the bytes that stay, which may no longer be UTF-8).

    A null text counts as empty. Texts shorter than ``length`` bytes lose nothing. Repeated rows, and the same text in other rows,
    count as other places. An empty table gives an empty result; other columns are not read.
    """
    small_batches(docs.sparkSession)
    ranges = repeated_ranges(docs, length, k)
    t = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64("doc_id").alias("_id"), F.xxhash64(t).alias("_h"), t.alias("_t")).join(ranges, ["_id", "_h"], "left").select("doc_id", "_t", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, r in zip(b["_t"].to_pylist(), b["ranges"].to_pylist()):
                data = np.frombuffer(t.encode(), np.uint8)
                keep = keep_mask(len(data), r)
                out.append((len(data), int((~keep).sum()), len(_runs(~keep)), data[keep].tobytes()))
            made = [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *made], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from those of ``deduplicate``; what is left of a text may be nothing, whose digest is that of no bytes."""
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
