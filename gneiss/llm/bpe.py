"""BPE encoding and decoding with reuse of content-defined chunks.

1. A rolling hash cuts each text into chunks, so that texts which share a passage share its chunks.
2. Chunks that occur more than once are encoded once, at their first place, and sent to the texts that hold them; the stretches
   between them are encoded where they stand. Cuts fall anywhere, within words too.
3. At each join a window of one whole word each side is encoded again, alone and up to the cut from either side. The join is
   mended when the window begins as the left piece's own ids do and ends as the right piece's do; otherwise the window doubles, and one
   that outgrows a piece makes the two pieces one. Rounds go on until all joins agree.

A tokenizer that drops white space and never joins or splits words over it is told by a trial; its words are then encoded once
each and remembered by a worker, in arrays of bounded size. Any other tokenizer encodes pieces as they are.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.textbytes import Sums, pick, word_ranges
from gneiss.session import broadcast_if_small, materialise, small_batches

#: Bytes under the rolling hash; one cut in this many bytes, on average, and the least between two; words a worker remembers; bytes looked at together.
ROLL, CHUNK, LEAST, MEMORY, TOGETHER = 24, 1024, 256, 600_000, 1 << 20
GAP = re.compile(rb"[ \t\n\r\x0b\x0c]+")
TRIAL = ("a", "Word", "b1", "12", ".", ",x.", "'s", "don't", "é", "中文", "_", "<|endoftext|>", "́z")
_coders: dict[str, "Coder"] = {}


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Coder:
    """A worker's tokenizer, with the ids of words it has met: sorted hashes, and for each where its ids lie in one array."""

    def __init__(self, path: str, memory: int = MEMORY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.memory, self.kind = memory, np.uint16 if size <= 1 << 16 else np.uint32
        #: Without a decoder, decoding is the tokens with blanks between them.
        self.names = [(self.tokenizer.id_to_token(i) or "").encode() for i in range(size)] if self.tokenizer.decoder is None else None
        self.forget()
        alone = {w: self._raw([w])[0].tolist() for w in TRIAL}
        pairs = [(a, b, s) for a in TRIAL for b in TRIAL for s in (" ", "\n", " \t\x0b\x0c\r ")]
        both = self._raw([a + s + b for a, b, s in pairs] + [" a", "a\n", " "])
        self.apart = [x.tolist() for x in both] == [alone[a] + alone[b] for a, b, _ in pairs] + [alone["a"], alone["a"], []]

    def _raw(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for at in range(0, len(texts), 4096) for e in self.tokenizer.encode_batch_fast(texts[at : at + 4096], add_special_tokens=False)]

    def forget(self) -> None:
        self.keys, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.ids, self.start, self.size = np.zeros(0, self.kind), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        """Remember new words by the sorted hashes of their bytes."""
        got = self._raw([w.decode() for w in words])
        size = np.array([len(x) for x in got], np.int32)
        where = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, where, keys)
        self.entry = np.insert(self.entry, where, np.arange(len(self.start), len(self.start) + len(keys), dtype=np.int32))
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size, dtype=np.int64) - size])
        self.size, self.ids = np.concatenate([self.size, size]), np.concatenate([self.ids, *got])

    def _words(self, parts: list[bytes]) -> list[np.ndarray]:
        data = b" ".join(parts)
        raw = np.frombuffer(data, np.uint8)
        start, end = word_ranges(raw)
        if not len(start):
            return [np.zeros(0, self.kind)] * len(parts)
        keys, first, which = np.unique(Sums(raw).ranges(start, end), return_index=True, return_inverse=True)
        new = ~np.isin(keys, self.keys, assume_unique=True)
        if len(self.keys) + int(new.sum()) > self.memory:
            self.forget()
            new[:] = True
        if new.any():
            self._learn(keys[new], [data[start[i] : end[i]] for i in first[new]])
        at = self.entry[np.searchsorted(self.keys, keys)][which]
        size = self.size[at].astype(np.int64)
        ids = pick(self.ids, self.start[at], size)
        edge = np.searchsorted(start, np.cumsum([0] + [len(p) + 1 for p in parts]))
        at = np.r_[0, np.cumsum(size)][edge].tolist()
        return [ids[at[i] : at[i + 1]] for i in range(len(parts))]

    def encode(self, parts: list[bytes]) -> list[np.ndarray]:
        """The ids of each part by itself."""
        if not self.apart:
            return self._raw([p.decode() for p in parts])
        out, held, size = [], [], 0
        for p in parts:
            if len(p) > TOGETHER:  # a long text goes in slices that end in white space
                out += self._words(held) if held else []
                held, size = [], 0
                out.append(np.concatenate([x for at, to in _slices(p) for x in self._words([p[at:to]])]))
                continue
            held.append(p)
            size += len(p)
            if size > TOGETHER:
                out += self._words(held)
                held, size = [], 0
        return out + (self._words(held) if held else [])

    def decode(self, ids: np.ndarray) -> bytes:
        if self.names is None:
            return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False).encode()
        return b" ".join(map(self.names.__getitem__, ids.tolist()))


def _slices(data: bytes) -> list[tuple[int, int]]:
    out, at = [], 0
    while at < len(data):
        gap = GAP.search(data, min(at + TOGETHER, len(data)))
        out.append((at, gap.start() if gap else len(data)))
        at = out[-1][1]
    return out


def coder(path: str) -> Coder:
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def chunks(data: bytes) -> list[tuple[int, int]]:
    """(start, end) of the content-defined chunks that make up some bytes of UTF-8; no cut lies within a character."""
    n = len(data)
    if n <= ROLL:
        return [(0, n)] if n else []
    raw = np.frombuffer(data, np.uint8)
    cuts = [0]
    for at in range(0, n - ROLL, TOGETHER):  # in slices, so that a long text needs no more room
        end = np.arange(ROLL, min(n - at, TOGETHER + ROLL))
        h = Sums(raw[at : at + TOGETHER + ROLL]).ranges(end - ROLL, end)
        for c in (at + end[(h & np.uint64(CHUNK - 1)) == 0]).tolist():
            while c < n and data[c] & 0xC0 == 0x80:
                c += 1
            if c - cuts[-1] >= LEAST and n - c >= LEAST:
                cuts.append(c)
    return list(zip(cuts, [*cuts[1:], n]))


def chunk_name(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _left(data: bytes, at: int, low: int, words: int) -> int:
    """Where the white space before the ``words`` whole words that precede a cut begins, or ``low`` if that lies before it."""
    room = 32 * (words + 1)
    while True:
        start = max(low, at - room)
        gaps = [m.start() for m in GAP.finditer(data, start, at) if m.start() > start]
        if len(gaps) > words:
            return gaps[-words - 1]
        if start == low:
            return low
        room *= 4


def _right(data: bytes, at: int, high: int, words: int) -> int:
    """Where the white space after the ``words`` whole words that follow a cut begins, or ``high``."""
    gap = next(islice(GAP.finditer(data, at, high), words, None), None)
    return gap.start() if gap else high


def repair(data: list[bytes], pieces: list[list[tuple[int, int, np.ndarray | None]]], encode: Callable[[list[bytes]], list[np.ndarray]]) -> tuple[list[np.ndarray], int]:
    """The ids of each text from the ids of its pieces (start, end, ids or None where they are not known), and the rounds it took."""
    out: list[np.ndarray | None] = [None] * len(data)
    todo, width, rounds = {i: list(p) for i, p in enumerate(pieces)}, dict.fromkeys(range(len(data)), 1), 0
    while todo:
        rounds += 1
        windows = {}
        for i, p in todo.items():  # windows that outgrow a piece or meet in one make it one with its neighbour
            while True:
                wins = [(_left(data[i], x[1], x[0], width[i]), _right(data[i], y[0], y[1], width[i])) for x, y in zip(p, p[1:])]
                fuse = next((k for k, (a, b) in enumerate(wins) if a <= p[k][0] > 0 or b >= p[k + 1][1] < len(data[i]) or k and wins[k - 1][1] > a), None)
                if fuse is None:
                    break
                p[fuse : fuse + 2] = [(p[fuse][0], p[fuse + 1][1], None)]
            windows[i] = wins
        missing = [(i, k) for i, p in todo.items() for k, x in enumerate(p) if x[2] is None]
        asked = [data[i][todo[i][k][0] : todo[i][k][1]] for i, k in missing]
        joins = [(i, k) for i, w in windows.items() for k in range(len(w))]
        for i, k in joins:
            (a, b), c = windows[i][k], todo[i][k][1]
            asked += [data[i][a:c], data[i][c:b], data[i][a:b]]
        got = encode(asked)
        for (i, k), ids in zip(missing, got):
            todo[i][k] = (*todo[i][k][:2], ids)
        at = iter(got[len(missing) :])
        found = {j: (next(at), next(at), next(at)) for j in joins}
        for i, p in list(todo.items()):
            parts, start, good = [], 0, True
            for k, (a, b) in enumerate(windows[i]):
                (left, right, window), x, y = found[i, k], p[k][2], p[k + 1][2]
                end = len(x) - len(left)
                good = start <= end and np.array_equal(x[end:], left) and np.array_equal(y[: len(right)], right)
                good = good and (a == 0 or len(left) > 0 and len(window) > 0 and window[0] == left[0]) and (b == len(data[i]) or len(right) > 0 and len(window) > 0 and window[-1] == right[-1])
                if not good:
                    break
                parts += [x[start:end], window]
                start = len(right)
            if good:
                out[i] = np.concatenate([*parts, p[-1][2][start:]]) if p else np.zeros(0, np.uint16)
                del todo[i]
            else:
                width[i] *= 2
    return out, rounds


def _texts(column: pa.Array) -> list[bytes]:
    return [(x or "").encode() for x in column.to_pylist()]


def shared_chunks(whole: DataFrame, path: str) -> DataFrame:
    """_id, _h and parts: for each text (_t) with shared chunks, (number, packed ids) of these."""

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, h, k, chunk_name(d[s:e])) for i, h, d in zip(b["_id"].to_pylist(), b["_h"].to_pylist(), _texts(b["_t"])) for k, (s, e) in enumerate(chunks(d))]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.binary()))], ["_id", "_h", "k", "name"])

    placed = whole.mapInArrow(names, "_id long, _h long, k int, name binary")
    placed = materialise(placed.dropDuplicates(["_id", "_h", "k"]), "chunk-places")  # repeated rows share their chunks anyway
    first = placed.groupBy("name").agg(F.count("*").alias("n"), F.min(F.struct("_id", "_h", "k")).alias("first")).filter("n > 1")
    owners = first.groupBy("first._id", "first._h").agg(F.collect_list("first.k").alias("ks"))
    owners = materialise(owners, "owners")
    texts = whole.join(broadcast_if_small(owners), ["_id", "_h"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for b in batches:
            parts = []
            for d, ks in zip(_texts(b["_t"]), b["ks"].to_pylist()):
                wanted = set(ks)
                parts += [d[s:e] for k, (s, e) in enumerate(chunks(d)) if k in wanted]
            ids = [x.tobytes() for x in own.encode(parts)]
            yield pa.RecordBatch.from_arrays([pa.array(list(map(chunk_name, parts)), pa.binary()), pa.array(ids, pa.binary())], ["name", "ids"])

    codes = texts.select("_t", "ks").mapInArrow(encode, "name binary, ids binary").dropDuplicates(["name"])
    return placed.join(codes, "name").groupBy("_id", "_h").agg(F.collect_list(F.struct("k", "ids")).alias("parts"))


def encoded(docs: DataFrame, keep: tuple[str, ...], build: Callable[[list[np.ndarray], Coder], dict[str, pa.Array]], schema: str, path: str | None = None) -> DataFrame:
    """Rows of ``docs`` (text, and the kept columns) with what ``build`` makes of the ids of some texts.

    A null text counts as empty; repeated rows each give a row; an empty table gives an empty result; columns that are not kept are
    not read. doc_id may be of any type.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = path or vocabulary()
    t = F.coalesce(F.col("text"), F.lit(""))
    key = [F.xxhash64("doc_id").alias("_id"), F.xxhash64(t).alias("_h")]
    parts = shared_chunks(docs.select(*key, t.alias("_t")), path)
    kept = [c for c in keep if c != "text"]
    fields = "".join(f", k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(kept))

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            packed = pa.array([None if x is None else z.compress(x.encode()) for x in b["_t"].to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], packed], [*b.schema.names[:-1], "z"])

    # the text travels compressed, and comes back as a kept column from there
    rows = docs.select(*key, *[F.col(c).alias(f"k{i}") for i, c in enumerate(kept)], F.col("text").alias("_t")).mapInArrow(squeeze, f"_id long, _h long{fields}, z binary")
    rows = rows.join(parts, ["_id", "_h"], "left").select("z", "parts", *[f"k{i}" for i in range(len(kept))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        own, z = coder(path), zstandard.ZstdDecompressor()
        for b in batches:
            packed = b["z"].to_pylist()
            data = [b"" if x is None else z.decompress(x) for x in packed]
            pieces = []
            for d, known in zip(data, b["parts"].to_pylist()):
                known, own_pieces = {x["k"]: x["ids"] for x in known or ()}, []
                for k, (s, e) in enumerate(chunks(d)) if known else ((0, (0, len(d))),):
                    ids = np.frombuffer(known[k], own.kind) if k in known else None
                    if ids is None and own_pieces and own_pieces[-1][2] is None:
                        own_pieces[-1] = (own_pieces[-1][0], e, None)
                    else:
                        own_pieces.append((s, e, ids))
                pieces.append(own_pieces)
            made = build(repair(data, pieces, own.encode)[0], own)
            have = {c: b[f"k{i}"] for i, c in enumerate(kept)}
            if "text" in keep:
                have["text"] = pa.array([None if x is None else d.decode() for x, d in zip(packed, data)], pa.string())
            yield pa.RecordBatch.from_arrays([*(have[c] for c in keep), *made.values()], [*keep, *made])

    out = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return rows.mapInArrow(run, out + schema)


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    def build(ids: list[np.ndarray], own: Coder) -> dict[str, pa.Array]:
        sha = lambda x: hashlib.sha256(x).hexdigest()
        return {"n_tokens": pa.array([len(x) for x in ids], pa.int64()), "ids_sha256": pa.array([sha(x.astype("<u4").tobytes()) for x in ids], pa.string()), "decoded_sha256": pa.array([sha(own.decode(x)) for x in ids], pa.string())}

    return encoded(docs, ("doc_id",), build, "n_tokens long, ids_sha256 string, decoded_sha256 string", path)


def encode(docs: DataFrame, keep: tuple[str, ...] = (), path: str | None = None) -> DataFrame:
    """doc_id, the kept columns, ids (array of int) and decoded. Kept columns named ids or decoded give way to these."""

    def build(ids: list[np.ndarray], own: Coder) -> dict[str, pa.Array]:
        return {"ids": pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), "decoded": pa.array([own.decode(x).decode() for x in ids], pa.string())}

    keep = ("doc_id", *(c for c in keep if c not in ("doc_id", "ids", "decoded")))
    return encoded(docs, keep, build, "ids array<int>, decoded string", path)
