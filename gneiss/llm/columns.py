"""Column helpers that the native operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"
SPAN = "array<struct<s:int,e:int,m:string>>"
BLOCK = 256


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``use`` as a lambda variable, so that no rewrite evaluates it again."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    """All words of a text in order: runs without the six ASCII white-space characters."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def find_spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches with code-point offsets: struct(s, e, m), e exclusive.

    ``split`` and ``regexp_extract_all`` walk the same matches, so the lengths of the pieces give the offsets: running sums within
    blocks of BLOCK matches, then of the blocks' lengths, so that a text with many matches is not copied for each of them.
    """
    empty = F.array().cast(SPAN)

    def block(pieces: Column, found: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

        def step(acc: Column, i: Column) -> Column:
            s = acc["at"] + F.length(F.get(pieces, i))
            e = s + F.length(F.get(found, i))
            one = F.struct(s.alias("s"), e.alias("e"), F.get(found, i).alias("m"))
            return F.struct(e.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

        return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), start, step)

    def walk(pieces: Column, found: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(found), F.lit(BLOCK))
        blocks = F.transform(starts, lambda at: let(F.slice(pieces, at, F.lit(BLOCK)), lambda p: let(F.slice(found, at, F.lit(BLOCK)), lambda f: block(p, f))))

        def moved(blocks: Column) -> Column:
            ends = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x["at"])))
            shift = lambda ends: F.transform(blocks, lambda x, i: F.transform(x["out"], lambda y: F.struct((y["s"] + F.get(ends, i)).alias("s"), (y["e"] + F.get(ends, i)).alias("e"), y["m"].alias("m"))))
            return F.flatten(let(ends, shift))

        return let(blocks, moved)

    def every(found: Column) -> Column:
        return F.when(F.size(found) == 0, empty).otherwise(let(F.split(text, pattern, -1), lambda pieces: F.when(F.size(found) <= BLOCK, block(pieces, found)["out"]).otherwise(walk(pieces, found))))

    return F.when(F.regexp_like(text, F.lit(pattern)), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), every)).otherwise(empty)


def span_text(spans: Column, kind: str | None = None) -> Column:
    """kind:start:end of each span; without ``kind`` each span's own k is taken."""
    return F.transform(spans, lambda x: F.concat_ws(":", x["k"] if kind is None else F.lit(kind), x["s"].cast("string"), x["e"].cast("string")))


def replace_spans(text: Column, spans: Column) -> Column:
    """Replace spans, struct(s, e, to) sorted by start, with their text; of overlapping spans the later gives way to what is left of it.

    Blocks of BLOCK spans are walked one after the other, each with what lies before it, so that no long text is copied for every span.
    """

    def block(at: Column, own: Column) -> Column:
        start = F.struct(at.alias("at"), F.lit("").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            gap = F.when(x["s"] > acc["at"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"])).otherwise(F.lit(""))
            to = F.when(x["s"] >= acc["at"], x["to"]).otherwise(F.lit(""))
            return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.concat(acc["out"], gap, to).alias("out"))

        return F.aggregate(own, start, step)

    def walk(spans: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

        def step(acc: Column, i: Column) -> Column:
            return let(block(acc["at"], F.slice(spans, i, F.lit(BLOCK))), lambda x: F.struct(x["at"].alias("at"), F.concat(acc["parts"], F.array(x["out"])).alias("parts")))

        return F.aggregate(F.sequence(F.lit(1), F.size(spans), F.lit(BLOCK)), first, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text))))

    return F.when(F.size(spans) == 0, text).otherwise(let(spans, walk))
