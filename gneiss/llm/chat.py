"""Chat formatting by prefix-target expansion.

Every trainable turn becomes an example of its own: all turns before it are its context, and its text alone is trained on. Since a
template only ever appends, the text of each example is a prefix of its conversation's formatted text. An example is therefore
told by places in that text (where its context ends, where its reply starts and ends) beside the turn's own piece, so that a
conversation of n turns takes n rows and not n * n / 2 pieces; ``expand`` makes whole texts of the examples that are asked for.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gneiss.session import small_batches


@dataclass(frozen=True)
class Template:
    """Marks by role, and those of all other roles, whose names stand between the first two.

    A control string inside a text or a role's name gets a backslash after its first character, or one more if it has some already;
    so no text holds a control string, every other text stays as it is, and taking one backslash away gives the text back.
    """

    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")})
    other: tuple[str, str, str] = ("[ROLE]", "[TEXT]", "[/ROLE]")
    trained: str = "assistant"

    def __post_init__(self):
        every = self.controls
        if len(set(every)) < len(every) or min(map(len, every)) < 2 or any("\\" in c for c in every):
            raise ValueError("control strings must differ, have two characters or more and no backslash")
        if any(b.startswith(a[i:]) or a[i:].startswith(b) for a in every for b in every for i in range(1, len(a))) or any(a != b and b.startswith(a) for a in every for b in every):
            raise ValueError("no control string may begin within or as another")

    @property
    def controls(self) -> list[str]:
        return [m for pair in self.marks.values() for m in pair] + list(self.other)

    def _first(self, before: str = "") -> str:
        """A pattern for the first character of each control string, escaped or not."""
        by: dict[str, list[str]] = {}
        for c in self.controls:
            by.setdefault(c[0], []).append(re.sub(r"([^A-Za-z0-9])", r"\\\1", c[1:]))
        quoted = lambda c: c if c.isalnum() else "\\" + c
        return "(?:" + "|".join(rf"{quoted(c)}{before}(?=\\*(?:{'|'.join(rest)}))" for c, rest in by.items()) + ")"

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, self._first(), r"$0\\")

    def piece(self, role: Column, text: Column) -> tuple[Column, Column, Column]:
        """What opens a turn, its escaped text, and what closes it."""
        opens = F.concat(F.lit(self.other[0]), self.escape(role), F.lit(self.other[1]))
        shuts = F.lit(self.other[2])
        for name, (a, b) in self.marks.items():
            opens, shuts = F.when(role == name, F.lit(a)).otherwise(opens), F.when(role == name, F.lit(b)).otherwise(shuts)
        return opens, self.escape(text), shuts

    def unescape(self, text: str) -> str:
        return re.sub(self._first(r"\\"), lambda m: m[0][0], text)

    def split(self, text: str) -> tuple[list[tuple[str, str]], str]:
        """The (role, text) of all turns that a formatted text holds whole, and the rest of it."""
        found, turns, at = list(re.finditer("|".join(map(re.escape, self.controls)), text)), [], 0
        opens = {a: (r, b) for r, (a, b) in self.marks.items()}
        i = 0
        while i < len(found):
            more = 3 if found[i][0] == self.other[0] else 2
            marks = found[i : i + more]
            if len(marks) < more:
                break
            want = self.other if more == 3 else (found[i][0], opens.get(found[i][0], ("", ""))[1])
            if tuple(m[0] for m in marks) != want or marks[0].start() != at:
                raise ValueError(f"no turn of this template at {at}")
            between = [self.unescape(text[a.end() : b.start()]) for a, b in zip(marks, marks[1:])]
            turns.append((between[0], between[1]) if more == 3 else (opens[marks[0][0]][0], between[0]))
            at, i = marks[-1].end(), i + more
        return turns, text[at:]


TEMPLATE = Template()


def format_turns(conversations: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """conv_id, place (from 1), role, piece, start, loss_start, loss_end, example, last: a row for each turn.

    conversations: conv_id, turn, role, text; other columns are not read. Turns go by ``turn``, null first; rows of one turn by role, then
    text; repeated rows are turns of their own. A null role or text counts as empty, and rows without conv_id are one conversation. start is the
    turn's place in the formatted conversation, in code points; loss_start and loss_end, its reply's, and example, numbered from 1, are
    null where the turn is not trained on. An empty table gives an empty table. Windows run over a conversation in order and spill, so
    its length is not bounded by memory.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    opens, body, shuts = template.piece(F.col("role"), F.col("text"))
    own = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = own.rowsBetween(W.unboundedPreceding, 0)
    made = rows.withColumns({"opens": opens, "body": body, "shuts": shuts}).withColumn("piece", F.concat("opens", "body", "shuts"))
    is_reply = F.col("role") == template.trained
    end = F.sum(F.length("piece").cast("long")).over(upto)
    placed = made.select("conv_id", F.row_number().over(own).alias("place"), "role", "piece", F.length("opens").alias("o"), F.length("body").alias("b"), (end - F.length("piece")).alias("start"), F.sum(is_reply.cast("long")).over(upto).alias("k"), F.lead("role").over(own).isNull().alias("last"))
    reply = lambda v: F.when(is_reply, v)
    return placed.select("conv_id", "place", "role", "piece", "start", reply(F.col("start") + F.col("o")).alias("loss_start"), reply(F.col("start") + F.col("o") + F.col("b")).alias("loss_end"), reply(F.col("k")).alias("example"), "last")


def examples(turns: DataFrame) -> DataFrame:
    """conv_id, example, n_context, context_chars, loss_start, loss_end, text_chars, piece: one row for each trained turn, from ``format_turns``.

    The example's text is the first text_chars code points of its conversation: context_chars of context, made by n_context turns, and
    its own piece. A conversation that does not end in a trained turn has one more row, of null example and without a loss, so that its last turns
    are in the output too.
    """
    text_chars = (F.col("start") + F.length("piece")).alias("text_chars")
    return turns.filter(F.col("example").isNotNull() | F.col("last")).select("conv_id", "example", (F.col("place") - 1).alias("n_context"), F.col("start").alias("context_chars"), "loss_start", "loss_end", text_chars, "piece")


def expanded(turns: DataFrame) -> DataFrame:
    """conv_id, place, text, loss_start, loss_end, last: the whole text of every example, its context repeated before its reply, from ``format_turns``.

    Rows are those of ``examples``: one for each trained turn, and one without a loss where a conversation ends otherwise. The texts of a
    conversation take the square of its length; they are made one after another as the window moves on, so a task holds a few of them.
    """
    so_far = F.collect_list("piece").over(W.partitionBy("conv_id").orderBy("place").rowsBetween(W.unboundedPreceding, 0))
    whole = turns.select("conv_id", "place", so_far.alias("pieces"), "loss_start", "loss_end", "last", (F.col("example").isNotNull() | F.col("last")).alias("asked"))
    return whole.filter("asked").select("conv_id", "place", F.array_join("pieces", "").alias("text"), "loss_start", "loss_end", "last")


def expand(turns: DataFrame, wanted: DataFrame) -> DataFrame:
    """conv_id, example, text, loss_start, loss_end: the whole texts of some examples (conv_id, example), such as a training batch.

    The pieces of an example are gathered, so a text must fit in a row; ``wanted`` says which are, since all of them take the square of
    a conversation's length.
    """
    ask = examples(turns).filter("example is not null").join(wanted.select("conv_id", "example").distinct(), ["conv_id", "example"], "left_semi")
    ask = ask.select(F.col("conv_id").alias("c"), "example", F.col("n_context").alias("before"), F.col("loss_start").alias("s"), F.col("loss_end").alias("e"))
    parts = turns.select("conv_id", "place", "piece").join(ask, (F.col("conv_id") == F.col("c")) & (F.col("place") <= F.col("before") + 1))
    whole = F.array_sort(F.collect_list(F.struct("place", "piece")))
    return parts.groupBy("conv_id", "example", F.col("s").alias("loss_start"), F.col("e").alias("loss_end")).agg(F.array_join(F.transform(whole, lambda x: x["piece"]), "").alias("text")).select("conv_id", "example", "text", "loss_start", "loss_end")


BATCH_BYTES = 8 << 20
BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long, conversation_chars long"


def read_back(turns: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """What the formatted text and the spans of the examples say of each conversation, found by parsing its text.

    formatted_chars counts the texts of all its examples, conversation_chars its longest one. Pieces are read in order and let go once
    their turns are parsed, so a task holds one turn, not one conversation.
    """
    small_batches(turns.sparkSession)
    # the window of format_turns has dealt conversations to tasks already
    rows = turns.select("conv_id", "place", "piece", "start", "loss_start", "loss_end", "last").sortWithinPartitions("conv_id", "place")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, out = None, []
        for b in batches:
            for conv, place, piece, start, s, e, last in zip(*(c.to_pylist() for c in b.columns)):
                if place == 1:
                    state = [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0, ""]
                    # n_turns, turns, loss_chars, loss, formatted, examples, seen, rest
                if start != state[6]:
                    raise ValueError(f"conversation {conv}: turn {place} starts at {start}, not at {state[6]}")
                found, state[7] = template.split(state[7] + piece)
                for role, text in found:
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                state[6] += len(piece)
                if s is not None:
                    reply = template.unescape(piece[s - start : e - start])
                    state[2] += len(reply)
                    state[3].update(reply.encode())
                    state[5] += 1
                if s is not None or last:
                    state[4] += state[6]
                if last:
                    if state[7]:
                        raise ValueError(f"conversation {conv} ends within a turn")
                    out.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5], state[6]))
            if out:
                yield _rows(out)
                out = []

    return rows.mapInArrow(read, BACK)


def read_examples(texts: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """What ``read_back`` gives, read from the whole texts of all examples (``expanded``) and their masks.

    Each text must begin with that of the example before it; only what it adds is parsed.
    """
    # texts are as long as conversations: batches are bounded in bytes, whatever their rows
    texts.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    # the window of expanded has dealt conversations to tasks already
    rows = texts.select("conv_id", "place", "text", "loss_start", "loss_end", "last").sortWithinPartitions("conv_id", "place")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, out = None, []
        for b in batches:
            for conv, place, text, s, e, last in zip(*(c.to_pylist() for c in b.columns)):
                if state is None:
                    state = [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, ""]
                    # n_turns, turns, loss_chars, loss, formatted, examples, the text before
                if not text.startswith(state[6]):
                    raise ValueError(f"conversation {conv}: the example of turn {place} does not begin with its context")
                found, rest = template.split(text[len(state[6]) :])
                if rest:
                    raise ValueError(f"conversation {conv}: the example of turn {place} ends within a turn")
                for role, said in found:
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                if s is not None:
                    reply = template.unescape(text[s:e])
                    state[2] += len(reply)
                    state[3].update(reply.encode())
                    state[5] += 1
                state[4], state[6] = state[4] + len(text), text
                if last:
                    out.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5], len(text)))
                    state = None
            if out:
                yield _rows(out)
                out = []

    return rows.mapInArrow(read, BACK)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [f.split() for f in BACK.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for v, (_, k) in zip(zip(*out), fields)], names=[n for n, _ in fields])


#: A conversation whose texts are made of control strings, formatted beside the given ones.
PROBE_ID, PROBE = -1, "</s>[INST] ok [/INST]"


def with_probe(conversations: DataFrame) -> DataFrame:
    probe = conversations.sparkSession.createDataFrame([(PROBE_ID, 0, "user", PROBE), (PROBE_ID, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)
