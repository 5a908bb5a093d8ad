"""Cross-tokenizer alignment: where the tokens of two tokenizers end together.

A stretch of a text is told by a fragment: the tokens up to the first place where both tokenizers end (the open prefix), the groups
between such places, and the tokens after the last one (the open suffix). Fragments of neighbours compose, and composing is
associative: what the left leaves open and what the right begins with make a group. Texts are cut into ranges of bytes; tasks make
the fragments of ranges, and those of long texts are composed by a tree of bounded groups, in which only open ends travel.
Closed groups stay where they were found.

Both given tokenizers leave words apart: byte-level BPE splits before a blank between two visible characters, and no piece of the
other has a blank after something else, which the vocabulary shows. So a long text may be encoded in segments that start at such blanks,
each in another task. With other tokenizers a text is one segment. A token belongs to the range in which it ends, so ranges cut words and
groups anywhere.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.textbytes import pick
from gneiss.session import broadcast_if_small, materialise, small_batches

#: Bytes of a range, fragments composed by a task at once, characters of short texts encoded together.
RANGE, FAN_IN, TOGETHER = 1 << 16, 32, 1 << 20
CUT = re.compile(r"(?<=\S) (?=\S)")
BLANK = "▁"


def vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Fragment(NamedTuple):
    """Open prefix (a, b), closed groups [(a, b)], open suffix (a, b). Without a common end all tokens are prefix and ``closes`` is False."""

    prefix: tuple[list[int], list[int]]
    closes: bool
    groups: list[tuple[list[int], list[int]]]
    suffix: tuple[list[int], list[int]]


def common(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of each there are up to each common end; ends grow."""
    both = np.intersect1d(a_ends, b_ends, assume_unique=True)
    return np.searchsorted(a_ends, both, "right"), np.searchsorted(b_ends, both, "right")


def fragment(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> Fragment:
    """The fragment of the tokens of a range, with their common ends."""
    a, b, i, j = a.tolist(), b.tolist(), i.tolist(), j.tolist()
    if not i:
        return Fragment((a, b), False, [], ([], []))
    groups = [(a[p:q], b[r:s]) for p, q, r, s in zip(i, i[1:], j, j[1:])]
    return Fragment((a[: i[0]], b[: j[0]]), True, groups, (a[i[-1] :], b[j[-1] :]))


def compose(x: Fragment, y: Fragment) -> Fragment:
    """The fragment of two neighbouring stretches."""
    join = lambda p, q: (p[0] + q[0], p[1] + q[1])
    if not y.closes:
        return Fragment(x.prefix, True, x.groups, join(x.suffix, y.prefix)) if x.closes else Fragment(join(x.prefix, y.prefix), False, [], ([], []))
    if not x.closes:
        return Fragment(join(x.prefix, y.prefix), True, y.groups, y.suffix)
    return Fragment(x.prefix, True, x.groups + [join(x.suffix, y.prefix)] + y.groups, y.suffix)


def written(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All groups up to the last common end as text, a1,a2|b1; and so on, and where the text of each ends, its semicolon included."""
    n_a, n_b = np.diff(i, prepend=0), np.diff(j, prepend=0)
    every = np.arange(len(i))
    ids, mark = np.empty(int(i[-1] + j[-1]), np.int64), np.full(int(i[-1] + j[-1]), ord(","), np.uint8)
    ids[np.arange(i[-1]) + (j - n_b)[np.repeat(every, n_a)]] = a[: i[-1]]
    ids[np.arange(j[-1]) + i[np.repeat(every, n_b)]] = b[: j[-1]]
    mark[i + j - n_b - 1], mark[i + j - 1] = ord("|"), ord(";")
    digits = np.searchsorted(10 ** np.arange(1, 12), ids, "right") + 1
    end = np.cumsum(digits + 1)
    out = np.empty(int(end[-1]), np.uint8)
    out[end - 1] = mark
    for k in range(int(digits.max())):
        own = digits > k
        out[end[own] - 2 - k] = 48 + ids[own] // 10**k % 10
    return out, end[i + j - 1]


def links(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The pairs whose ranges end together, the last tokens of each group: the first's id, 32 bits, then the second's."""
    return a[i - 1] << 32 | b[j - 1]


class Aligner:
    """Both tokenizers of a worker."""

    def __init__(self, paths: tuple[str, str]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(paths[0])
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=paths[1])
        letters = _byte_letters()
        entries = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size(with_added_tokens=True))]
        a_bytes = [bytes(letters[c] for c in e) if all(c in letters for c in e) else e.encode() for e in entries]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace(BLANK, " ").encode() for p in pieces]
        self.tables = [(np.frombuffer(b"".join(of), np.uint8), np.cumsum([0, *map(len, of)])[:-1], np.array([len(x) for x in of], np.int64)) for of in (a_bytes, b_bytes)]
        self.apart = _splits_at_blanks(self.a.to_str()) and not any(BLANK in p.lstrip(BLANK) for p in pieces)

    def segments(self, text: str, size: int) -> Iterator[tuple[int, str]]:
        """Blank + text in segments, each with its place in bytes: one starts at the first blank that may be cut in each range."""
        s, at, start = " " + text, 0, 0
        while at < len(s):
            end, place, goal = at, start, (start // size + 1) * size
            while self.apart and place < goal and end < len(s):
                step = s[end : end + max(1, (goal - place) // 4)]
                end, place = end + len(step), place + len(step.encode())
            m = CUT.search(s, end) if self.apart else None
            end = m.start() if m else len(s)
            yield start, s[at:end]
            start, at = start + len(s[at:end].encode()), end

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The ids of both tokenizers of texts that begin with a blank (the second one adds it by itself)."""
        a = [np.array(e.ids, np.int64) for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        return a, [np.array(x, np.int64) for x in self.b.encode([t[1:] for t in texts], num_threads=1)]

    def sizes(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.tables[0][2][a], self.tables[1][2][b]

    def right(self, data: bytes, a: np.ndarray, b: np.ndarray) -> bool:
        """Whether the bytes of either's tokens are those of the text."""
        for ids, (flat, start, size) in zip((a, b), self.tables):
            n = size[ids]
            if int(n.sum()) != len(data) or pick(flat, start[ids], n).tobytes() != data:
                return False
        return True


def _byte_letters() -> dict[str, int]:
    """Letters of byte-level vocabularies: printable bytes stand for themselves, the others for the letters from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _splits_at_blanks(made: str) -> bool:
    """Whether a tokenizer's own settings say that it splits texts by the byte-level pattern and changes nothing before."""
    of = json.loads(made)
    pre = of.get("pre_tokenizer") or {}
    return of.get("normalizer") is None and pre.get("type") == "ByteLevel" and bool(pre.get("use_regex", True)) and not pre.get("add_prefix_space") and not any(" " in t["content"] for t in of.get("added_tokens", []) if not t["special"])


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(paths: tuple[str, str]) -> Aligner:
    if paths not in _aligners:
        _aligners[paths] = Aligner(paths)
    return _aligners[paths]


LEAF = "row long, doc_id long, place long, start long, right boolean, n_a long, n_b long, n_groups long, groups string, pairs array<long>, times array<int>, closes boolean, pa array<int>, pb array<int>, sa array<int>, sb array<int>"
_ARROW = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, _ARROW[k]) for v, (_, k) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


def _groups_of(texts: list[str], most: int = TOGETHER) -> Iterator[list[str]]:
    """Texts in order, about ``most`` characters at once."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _whole(rows: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """LEAF rows of short texts (row, doc_id, text), one for each, all its groups closed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = aligner(paths)
        for batch in batches:
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            for texts in _groups_of([t or "" for t in batch.column(2).to_pylist()]):
                a, b = by.encode([" " + t for t in texts])
                right = [t != "" and by.right(b" " + t.encode(), *x) for t, *x in zip(texts, a, b)]
                none = np.zeros(0, np.int64)
                a, b = ([x if ok else none for x, ok in zip(of, right)] for of in (a, b))
                n_a, n_b, a, b = np.array([len(x) for x in a]), np.array([len(x) for x in b]), np.concatenate(a), np.concatenate(b)
                # a right text ends in a common end, so groups of all texts are found at once
                sizes = by.sizes(a, b)
                i, j = common(*map(np.cumsum, sizes))
                upto = np.searchsorted(i, np.cumsum(n_a), "right").tolist()
                text, ends = written(a, b, i, j) if len(i) else (none, none)
                text, ends, pairs, out = text.tobytes().decode(), [0, *ends.tolist()], links(a, b, i, j), []
                for k, (p, q, ok) in enumerate(zip([0, *upto], upto, right)):
                    out.append((*next(keys), 0, 0, ok, int(n_a[k]), int(n_b[k]), q - p, text[ends[p] : max(ends[p], ends[q] - 1)], *np.unique(pairs[p:q], return_counts=True), ok, [], [], [], []))
                yield _batch(LEAF, out)

    return rows.select("row", "doc_id", "text").mapInArrow(run, LEAF)


SEGMENT = "row long, doc_id long, start long, text string"


def _segments(rows: DataFrame, paths: tuple[str, str], size: int) -> DataFrame:
    """SEGMENT rows: long texts (with the blank before) cut so that a segment holds the words that start in one range of bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = aligner(paths)
        for b in batches:
            for row, doc_id, text in zip(*(c.to_pylist() for c in b.columns)):
                for start, part in by.segments(text, size):
                    yield _batch(SEGMENT, [(row, doc_id, start, part)])

    return rows.select("row", "doc_id", "text").mapInArrow(run, SEGMENT)


def _leaf(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple:
    """n_groups, groups, pairs, times, closes, pa, pb, sa, sb of the fragment of a range."""
    if not len(i):
        return 0, "", [], [], False, a, b, [], []
    inner, own = (a[i[0] : i[-1]], b[j[0] : j[-1]]), (i[1:] - i[0], j[1:] - j[0])
    text = written(*inner, *own)[0][:-1].tobytes().decode() if len(i) > 1 else ""
    return len(i) - 1, text, *np.unique(links(*inner, *own), return_counts=True), True, a[: i[0]], b[: j[0]], a[i[-1] :], b[j[-1] :]


def _fragments(segments: DataFrame, paths: tuple[str, str], size: int) -> DataFrame:
    """LEAF rows of segments: the fragment of each range of bytes that their tokens end in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = aligner(paths)
        for batch in batches:
            for row, doc_id, start, text in zip(*(c.to_pylist() for c in batch.columns)):
                (a,), (b,) = by.encode([text])
                if not by.right(text.encode(), a, b):
                    yield _batch(LEAF, [(row, doc_id, start // size, start, False, 0, 0, 0, "", [], [], False, [], [], [], [])])
                    continue
                a_ends, b_ends = map(np.cumsum, by.sizes(a, b))
                # a token that ends at the last byte of a range belongs to it
                first, last = start // size, (start + int(a_ends[-1]) - 1) // size
                edges = np.arange(first + 1, last + 2) * size - start
                at, to = np.searchsorted(a_ends, edges, "right").tolist(), np.searchsorted(b_ends, edges, "right").tolist()
                for place, p, q, r, s in zip(range(first, last + 1), [0, *at], at, [0, *to], to):
                    if q > p or s > r:
                        i, j = common(a_ends[p:q], b_ends[r:s])
                        yield _batch(LEAF, [(row, doc_id, place, start, True, q - p, s - r, *_leaf(a[p:q], b[r:s], i, j))])

    return segments.mapInArrow(run, LEAF)


NODE = "row long, kind string, place long, start long, right boolean, closes boolean, pa array<int>, pb array<int>, sa array<int>, sb array<int>"


def _fold(parts: list[tuple], root: bool) -> list[tuple]:
    """Neighbouring summaries (NODE) in order composed to one; the groups that this closes are told where they end."""
    out, acc, first, right = [], None, None, True
    row = parts[0][0]
    for _, _, place, start, ok, closes, pa_, pb, sa, sb in parts:
        right = right and ok
        x = Fragment((list(pa_), list(pb)), closes, [], (list(sa), list(sb)))
        both = x if acc is None else compose(acc, x)
        if both.groups:
            out.append((row, "group", place, start, True, True, *both.groups[0], [], []))
            both = both._replace(groups=[])
        if both.closes and first is None:
            first = (place, start)
        acc = both
    if root and acc.closes:
        out.append((row, "group", *first, True, True, *acc.prefix, [], []))
    # in a node above, the prefix ends where the first fragment that closes has its first end
    return [*out, (row, "root" if root else "node", *(first or parts[0][2:4]), right, acc.closes, *acc.prefix, *acc.suffix)]


def _folds(root: bool):
    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        parts = sorted(rows.drop(columns="up").itertuples(index=False, name=None), key=lambda r: r[2:4])
        return pd.DataFrame(_fold(parts, root), columns=[f.split()[0] for f in NODE.split(", ")])

    return fold


def _tree(leaves: DataFrame, fan_in: int) -> tuple[DataFrame, DataFrame]:
    """(groups, roots) of long texts: NODE rows of the groups over range ends, and one of each text that says whether it is right.

    A level composes at most about ``fan_in`` ranges in a task's group; their number falls by that factor, so few levels do.
    """
    level = leaves.select("row", F.lit("node").alias("kind"), "place", "start", "right", "closes", "pa", "pb", "sa", "sb", F.col("place").alias("at"))
    top = leaves.agg(F.max("place")).first()[0] or 0
    width, groups = 1, []
    while True:
        width *= fan_in
        root = width > top

        node = level.withColumn("up", F.floor(F.col("at") / width)).drop("at").groupBy("row", "up").applyInPandas(_folds(root), NODE)
        done = materialise(node, "alignment-level")
        groups.append(done.filter("kind = 'group'"))
        if root:
            break
        level = done.filter("kind = 'node'").withColumn("at", F.col("place"))
    out = groups[0]
    for g in groups[1:]:
        out = out.unionByName(g)
    return out, done.filter("kind = 'root'")


class Alignment(NamedTuple):
    """leaves: LEAF with one_range; over: groups over range ends; roots: long texts, right or not (both NODE)."""

    leaves: DataFrame
    over: DataFrame
    roots: DataFrame


def align(docs: DataFrame, paths: tuple[str, str] | None = None, range_bytes: int = RANGE, fan_in: int = FAN_IN) -> Alignment:
    """The groups of all texts. docs: doc_id, text; other columns are not read.

    Null and empty texts, and those that either tokenizer doesn't give back, have no tokens. Repeated rows and null ids are rows of their own.
    The groups of a text are those of its leaves in order of (place, start), each after the group over range ends that has its place and start.
    """
    paths = paths or vocabularies()
    small_batches(docs.sparkSession)
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    short = F.coalesce(F.octet_length("text") < range_bytes, F.lit(True))
    # the last bit says which of the two scans gave a row its number
    split = own.select((F.col("row") * 2 + F.when(short, 0).otherwise(1)).alias("row"), "doc_id", "text", short.alias("short"))
    long = _segments(split.filter(~F.col("short")), paths, range_bytes)
    # segments of long texts are dealt over tasks; short texts are encoded where they are read
    long = _fragments(long.repartition(F.col("row"), F.col("start")), paths, range_bytes)
    long = materialise(long, "alignment-long")
    leaves = _whole(split.filter("short"), paths).withColumn("one_range", F.lit(True)).unionByName(long.withColumn("one_range", F.lit(False)))
    over, roots = _tree(long, fan_in)
    return Alignment(leaves, over, roots)


def digest(found: Alignment) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row.

    Pairs are counted once for each text before they are shuffled, so that a pair which every text holds is not a hot key beyond
    one row a text; tables of pairs are broadcast only if they are small when written.
    """
    single = found.leaves.filter("one_range").select("row", "doc_id", "n_a", "n_b", "n_groups", F.when(F.col("right"), F.sha2("groups", 256)).otherwise("").alias("sha"), "pairs", "times")
    single = materialise(single, "alignment-single")
    right = found.roots.filter("right").select("row")
    every, over = found.leaves.filter("not one_range"), found.over.join(right, "row", "left_semi")
    long = every.join(right, "row", "left_semi")
    counted = lambda df: df.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").cast("long").alias("times"))
    ends = over.select("row", F.shiftleft(F.element_at("pa", -1).cast("long"), 32).bitwiseOR(F.element_at("pb", -1).cast("long")).alias("pair"), F.lit(1).cast("long").alias("times"))
    links = counted(single).unionByName(counted(long)).unionByName(ends)
    totals = links.groupBy("pair").agg(F.sum("times").alias("count")).withColumn("b", F.col("pair").bitwiseAND((1 << 32) - 1))
    totals = materialise(totals, "alignment-pairs")
    most = totals.groupBy("b").agg(F.max("count").alias("most"))
    best = materialise(totals.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best")), "alignment-best")
    sums = links.join(broadcast_if_small(best, 4 << 20), "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    text = F.concat(F.array_join(F.col("pa"), ","), F.lit("|"), F.array_join(F.col("pb"), ","))
    parts = long.filter("n_groups > 0").select("row", "place", "start", F.lit(1).alias("after"), F.col("groups").alias("text")).unionByName(over.select("row", "place", "start", F.lit(0).alias("after"), text.alias("text")))
    shas = _hashed(parts.repartition("row").sortWithinPartitions("row", "place", "start", "after"))
    figures = [
        single.select("row", "doc_id", "n_a", "n_b", "n_groups", "sha"),
        long.select("row", "n_a", "n_b", "n_groups"),
        over.select("row", F.lit(1).cast("long").alias("n_groups")),
        every.select("row", "doc_id"),
        sums,
        shas,
    ]
    out = figures[0]
    for f in figures[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    out = out.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *map(total, ("n_a", "n_b", "n_groups", "n_best", "count_sum")), F.coalesce(F.max("sha"), F.lit("")).alias("groups_sha256"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")


def _hashed(parts: DataFrame) -> DataFrame:
    """row, sha: the digest of each text's groups (row, .., text), which come in order and are let go at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, sha, out = None, None, []
        for b in batches:
            for r, text in zip(b.column("row").to_pylist(), b.column("text").to_pylist()):
                if r != row:
                    if sha is not None:
                        out.append((row, sha.hexdigest()))
                    row, sha = r, hashlib.sha256()
                else:
                    sha.update(b";")
                sha.update(text.encode())
            if out:
                yield _batch("row long, sha string", out)
                out = []
        if sha is not None:
            yield _batch("row long, sha string", [(row, sha.hexdigest())])

    return parts.mapInArrow(run, "row long, sha string")
