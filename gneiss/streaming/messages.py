"""Messages that arrive in frames: deltas put together by number, gaps waited for, and an outcome for each message.

A frame is (message_id, seq, kind, text, ts); kind is delta, or done or error, which end a message. Numbers start at ``first``. Of frames
of one number the least (kind, text) counts, and the first end does. A message is complete once all deltas before its end are there: its
outcome is the end's kind and its text all of them. One that does not get there is timeout, with the deltas up to the first gap.
The batch form and the stream agree on frames that come in time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FRAMES = "message_id string, seq long, kind string, text string, ts timestamp"
OUT = "message_id string, outcome string, text string, frames long"
ENDS = ("done", "error")
FIRST, TIMEOUT_S = 1, 60


def assemble(frames: DataFrame, first: int = FIRST) -> DataFrame:
    """message_id, outcome, text, frames (deltas in the text) of every message. Frames of null id or number, or of numbers before the first, are not read."""
    own = frames.filter((F.col("seq") >= first) & F.col("message_id").isNotNull()).groupBy("message_id", "seq").agg(F.min(F.struct("kind", F.coalesce("text", F.lit("")).alias("text"))).alias("x")).select("message_id", "seq", "x.kind", "x.text")
    whole = W.partitionBy("message_id")
    end = F.min(F.when(F.col("kind").isin(*ENDS), F.struct("seq", "kind"))).over(whole)
    own = own.withColumn("end", end).filter(F.col("end").isNull() | (F.col("seq") <= F.col("end.seq")))
    # a frame is in reach if none before it is missing
    own = own.withColumn("reached", F.row_number().over(whole.orderBy("seq")) + (first - 1) == F.col("seq"))
    delta = F.col("reached") & ~F.col("kind").isin(*ENDS)
    rows = own.groupBy("message_id").agg(
        F.max(F.when(F.col("reached") & F.col("kind").isin(*ENDS), F.col("kind"))).alias("end"),
        F.array_sort(F.collect_list(F.when(delta, F.struct("seq", "text")))).alias("parts"),
    )
    return rows.select("message_id", F.coalesce("end", F.lit("timeout")).alias("outcome"), F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"), F.size("parts").cast("long").alias("frames"))


class Assembly(StatefulProcessor):
    """One message's frames as state. Each frame puts its timer off; when that goes, the message is told as timeout, or, if it was told
    before, forgotten: until then frames that come again change nothing."""

    def __init__(self, first: int, timeout_s: int):
        self.first, self.wait = first, timeout_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.frames = handle.getMapState("frames", "seq long", "kind string, text string")
        self.state = handle.getValueState("state", "timer long, told boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        timer, told = self.state.get() if self.state.exists() else (None, False)
        latest = 0
        for batch in rows:
            latest = max(latest, int(batch["ts"].max().timestamp() * 1000))
            for seq, kind, text in zip(batch["seq"], batch["kind"], batch["text"]):
                if not told and seq is not None and seq == seq and seq >= self.first:
                    one = (kind, text if isinstance(text, str) else "")
                    own = (int(seq),)
                    if not self.frames.containsKey(own) or one < tuple(self.frames.getValue(own)):
                        self.frames.updateValue(own, one)
        due = max(latest, timerValues.getCurrentWatermarkInMs()) + self.wait
        if timer is None or due > timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
            timer = due
        if not told:
            outcome, text, n = self._read()
            if outcome:
                told = True
                self.frames.clear()
                yield pd.DataFrame({"message_id": [key[0]], "outcome": [outcome], "text": [text], "frames": [n]})
        self.state.update((timer, told))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists() and not self.state.get()[1]:
            _, text, n = self._read()
            yield pd.DataFrame({"message_id": [key[0]], "outcome": ["timeout"], "text": [text], "frames": [n]})
        self.frames.clear()
        self.state.clear()

    def _read(self) -> tuple[str | None, str, int]:
        """The outcome, if all frames before an end are there, and the deltas in reach."""
        parts, seq = [], self.first
        while self.frames.containsKey((seq,)):
            kind, text = self.frames.getValue((seq,))
            if kind in ENDS:
                return kind, "".join(parts), len(parts)
            parts.append(text)
            seq += 1
        return None, "".join(parts), len(parts)

    def close(self) -> None:
        pass


def stream(frames: DataFrame, first: int = FIRST, timeout_s: int = TIMEOUT_S, late: str = "30 seconds") -> DataFrame:
    """The same as a stream: a message is told once, when it is complete or when no frame came for ``timeout_s`` of event time.

    Frames later than ``late`` behind the newest are not read. State is kept in RocksDB, which keyed state with timers needs.
    """
    frames.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own = frames.filter("message_id is not null").withWatermark("ts", late)
    return own.groupBy("message_id").transformWithStateInPandas(Assembly(first, timeout_s), OUT, "Append", "EventTime")
