"""Paged listings, and calls with deadlines."""

import json
import time

from pyspark.sql import functions as F

from gneiss.operators import answers, calls
from gneiss.sources import paged


def write(folder, tool, pages):
    at = folder / tool
    at.mkdir(parents=True, exist_ok=True)
    for n, reply in pages.items():
        (at / f"page-{n:05d}.json").write_text(json.dumps(reply))


def test_pages_and_filters(spark, tmp_path):
    issues = [{"number": i, "state": ("open", "closed")[i % 2], "title": f"é {i}"} for i in range(25)]
    write(tmp_path, "list_issues", {1: issues[:10], 2: {"items": issues[10:20]}, 3: {"results": issues[20:]}, 4: {"none": 1}, 5: ["plain", 7]})
    rows = paged.listing(spark, str(tmp_path), "list_issues")
    assert rows.count() == 27 and rows.rdd.getNumPartitions() == 5
    assert sorted(int(r["id"]) for r in paged.listing(spark, str(tmp_path), "list_issues", "open").collect()) == list(range(0, 25, 2))
    one = rows.filter("page = 2")
    assert one.count() == 10 and one.rdd.getNumPartitions() == 1  # other pages are not read
    two = rows.filter("page <= 2 and state = 'closed' and place > 3")
    assert sorted(r["id"] for r in two.collect()) == ["15", "17", "19", "5", "7", "9"] and two.rdd.getNumPartitions() == 2
    assert json.loads(rows.filter("id = '3'").first()["item"])["title"] == "é 3"
    assert [(r["id"], r["item"]) for r in rows.filter("page = 5").orderBy("place").collect()] == [(None, '"plain"'), (None, "7")]
    assert paged.listing(spark, str(tmp_path), "no_such_tool").count() == 0


def test_commits_between(spark, tmp_path):
    shas = [f"s{i:03d}" for i in range(25)]
    write(tmp_path, "list_commits", {n + 1: [{"sha": s} for s in shas[n * 5 : n * 5 + 5]] for n in range(5)})
    ids = lambda found: [r["id"] for r in found.orderBy("n").collect()]
    assert paged.head(spark, str(tmp_path)) == "s000" and paged.head(spark, f"{tmp_path}/none") is None
    found, met = paged.commits_between(spark, str(tmp_path), "s007", "s000")
    assert ids(found) == shas[:7] and met
    found, met = paged.commits_between(spark, str(tmp_path), "s012", "s004")
    assert ids(found) == shas[4:12] and met
    found, met = paged.commits_between(spark, str(tmp_path), "s003", "s003")
    assert ids(found) == [] and met
    found, met = paged.commits_between(spark, str(tmp_path), "s020", "s000", max_pages=2)
    assert ids(found) == shas[:10] and not met  # too far back


def test_stream_of_pages(spark, tmp_path):
    """Pages are read once, those that come later too, and none again after a restart."""
    told = []

    def run():
        keep = lambda b, _: told.append(sorted(r["id"] for r in b.collect()))
        paged.stream(spark, str(tmp_path / "in"), "events").writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()

    write(tmp_path / "in", "events", {1: [{"id": "a"}, {"id": "b"}], 2: [{"id": "c"}]})
    run()
    run()
    write(tmp_path / "in", "events", {3: [{"id": "d"}]})
    run()
    assert sorted(i for b in told for i in b) == ["a", "b", "c", "d"]


REF = "ord long, source string, raw string, kind string, file string"


def test_calls_with_deadlines(spark):
    rows = [(i, "s", f"r{i}", "call", f"{kind}.py") for kind in ("fine", "slow", "broken", "odd") for i in range(35)]
    numbered = answers.distinct_refs(spark.createDataFrame(rows, REF)).repartition(2)

    def call(refs):
        kind = refs[0]["file"]
        if kind == "slow.py":
            time.sleep(20)
        if kind == "broken.py":
            raise KeyError("no answer")
        if kind == "odd.py":
            return [{"ref_index": 99, "target": "never"}, {"ref_index": 0, "target": "old"}, {"ref_index": 0, "target": "new"}], 0.5
        return [{"ref_index": r["ref_index"], "target": "t:" + r["raw"], "reasoning": "because"} for r in refs], 1.25

    began = time.time()
    got = calls.resolve_chunks(numbered, call, deadline_s=2.0, at_once=3, tasks=2).collect()
    assert time.time() - began < 19
    by = {r["chunk"]: r for r in got}
    assert len(by) == 8 and sum(r["asked"] for r in got) == 140
    assert by["fine.py#1"]["outcome"] == "answered" and [a["target"] for a in by["fine.py#1"]["answers"]] == [f"t:r{i}" for i in range(30, 35)]
    assert all(by[f"slow.py#{k}"]["outcome"] == "timeout" and by[f"slow.py#{k}"]["answers"] == [] for k in (0, 1))
    assert by["broken.py#0"]["outcome"] == "error" and "no answer" in by["broken.py#0"]["error"]
    assert [a["target"] for a in by["odd.py#0"]["answers"]] == ["new"]
    done = spark.createDataFrame(got, calls.OUT)
    t = calls.totals(done).first()
    assert (t["calls"], t["answered"], t["timeout"], t["error"], t["asked"], t["resolved"], t["cost"]) == (8, 4, 2, 2, 140, 37, 3.5)
    assert calls.totals(done.limit(0)).first()["cost"] == 0.0
    told = answers.fan_out(spark.createDataFrame(rows, REF), numbered, calls.answered(done))
    assert told.filter("target is not null").count() == 37 and told.count() == 140
    assert calls.resolve_chunks(numbered.limit(0), call).count() == 0
