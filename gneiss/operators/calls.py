"""Chunks handed to an outside resolver, with a deadline for each call and a bound of calls at once in each task."""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.operators.answers import KEY

#: Seconds that a call may take, and calls at once in a task.
DEADLINE_S, AT_ONCE = 300.0, 8
OUT = "chunk string, asked long, outcome string, error string, seconds double, cost double, answers array<struct<ref_index:int,target:string,reasoning:string>>"
_ANSWERS = pa.list_(pa.struct([("ref_index", pa.int32()), ("target", pa.string()), ("reasoning", pa.string())]))
_FIELDS = [("chunk", pa.string()), ("asked", pa.int64()), ("outcome", pa.string()), ("error", pa.string()), ("seconds", pa.float64()), ("cost", pa.float64()), ("answers", _ANSWERS)]
#: From the references of a chunk to (answers, cost); an answer has ref_index, target and reasoning.
Call = Callable[[list[dict[str, Any]]], tuple[list[dict[str, Any]], float]]


def resolve_chunks(numbered: DataFrame, call: Call, deadline_s: float = DEADLINE_S, at_once: int = AT_ONCE, tasks: int | None = None) -> DataFrame:
    """chunk, asked, outcome (answered, timeout, error), error, seconds, cost and answers: a row for each chunk of ``answers.distinct_refs``.

    A call that is not back by its deadline counts as timeout with no answers; what it says later is not heard, and its thread is left to
    end by itself, so a task runs more threads than ``at_once`` if calls hang. A call that fails counts as error. Answers to an index
    that was not asked are left out, of two to one index the last counts. ``tasks`` bounds the calls at once of the whole job. When an executor is lost
    its chunks are asked again; write the result before it is used twice.
    """
    item = F.struct("ref_index", *KEY)
    chunks = numbered.groupBy("chunk").agg(F.sort_array(F.collect_list(item)).alias("refs"))  # at most a chunk's references
    chunks = chunks.repartition(tasks, "chunk") if tasks else chunks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        todo = ((c, r) for b in batches for c, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        back: queue.Queue = queue.Queue()
        flying: dict[int, tuple[str, list, float]] = {}

        def ask(key: int, refs: list[dict]) -> None:
            try:
                back.put((key, call(refs), None))
            except Exception as e:  # a resolver's failure is a row of its own
                back.put((key, None, f"{type(e).__name__}: {e}"))

        def row(key: int, outcome: str, got: tuple | None = None, error: str | None = None) -> pa.RecordBatch:
            chunk, refs, began = flying.pop(key)
            asked = {r["ref_index"] for r in refs}
            last = {a.get("ref_index"): a for a in (got[0] if got else ()) if a.get("ref_index") in asked}
            answers = [{"ref_index": i, "target": a.get("target"), "reasoning": a.get("reasoning")} for i, a in sorted(last.items())]
            values = [chunk, len(refs), outcome, error, time.monotonic() - began, float(got[1]) if got else 0.0, answers]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(values, _FIELDS)], names=[n for n, _ in _FIELDS])

        key, more = 0, True
        while more or flying:
            while more and len(flying) < at_once:
                one = next(todo, None)
                if one is None:
                    more = False
                    break
                key += 1
                flying[key] = (*one, time.monotonic())
                threading.Thread(target=ask, args=(key, one[1]), daemon=True).start()
            if not flying:
                break
            wait = min(began for _, _, began in flying.values()) + deadline_s - time.monotonic()
            try:
                done, got, error = back.get(timeout=max(wait, 0.001))
                if done in flying:
                    yield row(done, "error" if error else "answered", got, error)
            except queue.Empty:
                pass
            for late in [k for k, (_, _, began) in flying.items() if time.monotonic() - began >= deadline_s]:
                yield row(late, "timeout")

    return chunks.mapInArrow(run, OUT)


def answered(calls: DataFrame) -> DataFrame:
    """chunk, ref_index, target, reasoning, as ``answers.fan_out`` takes them."""
    return calls.select("chunk", F.explode("answers").alias("x")).select("chunk", "x.ref_index", "x.target", "x.reasoning")


def totals(calls: DataFrame) -> DataFrame:
    """Calls by outcome, references asked and resolved, seconds and cost of all chunks, one row; zeros where there is none."""
    n = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    total = lambda c, zero: F.coalesce(F.sum(c), F.lit(zero))
    return calls.agg(F.count("*").alias("calls"), n("answered"), n("timeout"), n("error"), total("asked", 0).alias("asked"), total(F.size("answers"), 0).alias("resolved"), total("seconds", 0.0).alias("seconds"), total("cost", 0.0).alias("cost"))
