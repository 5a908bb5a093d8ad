"""Frames as a batch and as a stream: late, repeated and lost ones."""

import json
import os
import random
from datetime import datetime, timedelta, timezone

from gneiss.streaming import messages

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def sent() -> tuple[list[tuple], dict]:
    """Frames in the order in which they come, and what becomes of each message."""
    rng = random.Random(6)
    frames, want = [], {}
    for m in range(40):
        n = rng.randint(0, 6)
        parts = [f"{m}.{i} " for i in range(n)]
        end = ("done", "error", None)[m % 3]
        own = [(f"m{m}", i + 1, "delta", p) for i, p in enumerate(parts)] + ([(f"m{m}", n + 1, end, None)] if end else [])
        outcome, text = end or "timeout", "".join(parts)
        if m % 4 == 0 and n > 1:  # a lost frame
            gone = rng.randrange(n)
            del own[gone]
            outcome, text = "timeout", "".join(parts[:gone])
        if m % 5 == 0:
            own += [(f"m{m}", n + 4, "done", None), (f"m{m}", 0, "delta", "never")] if end else []  # a second end, and a number before the first
        own += rng.sample(own, len(own) // 2)  # repeated
        rng.shuffle(own)
        if own:
            want[f"m{m}"] = (outcome, text)
        frames += [(*f, START + timedelta(seconds=m * 2 + k % 9)) for k, f in enumerate(own)]
    frames.sort(key=lambda f: f[4])
    return frames, want


def test_batch(spark):
    frames, want = sent()
    got = messages.assemble(spark.createDataFrame(frames + [(None, 1, "delta", "x", START), ("m1", None, "delta", "x", START)], messages.FRAMES))
    assert {r["message_id"]: (r["outcome"], r["text"]) for r in got.collect()} == want
    assert messages.assemble(spark.createDataFrame([], messages.FRAMES)).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    frames, want = sent()
    # a message of its own moves the watermark on, so that all others are told; a frame that comes after its message is told changes nothing
    frames += [("m1", 1, "delta", "again", START + timedelta(seconds=95)), ("tick", 1, "delta", "", START + timedelta(hours=1)), ("tick", 2, "delta", "", START + timedelta(hours=1, minutes=1))]
    source = tmp_path / "in"
    source.mkdir()
    size = len(frames) // 5 + 1
    for k in range(0, len(frames), size):
        lines = [json.dumps(dict(zip(("message_id", "seq", "kind", "text", "ts"), (*f[:4], f[4].isoformat())))) for f in frames[k : k + size]]
        (source / f"{k:05d}.json").write_text("\n".join(lines))
    (source / "99999.json").write_text(json.dumps({"message_id": "tick", "seq": 3, "kind": "delta", "text": "", "ts": (START + timedelta(hours=2)).isoformat()}))
    for k, path in enumerate(sorted(source.iterdir())):  # files are taken by their times
        os.utime(path, (1_700_000_000 + k,) * 2)
    told = []

    def keep(batch, _):
        told.extend((r["message_id"], r["outcome"], r["text"]) for r in batch.collect())

    rows = spark.readStream.schema(messages.FRAMES).option("maxFilesPerTrigger", 1).json(str(source))
    query = messages.stream(rows, timeout_s=60).writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert not query.isActive
    others = [t for t in told if t[0] != "tick"]
    assert {m: (o, t) for m, o, t in others} == want and len(others) == len(want)
