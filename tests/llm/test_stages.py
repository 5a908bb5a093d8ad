"""The stages of the pipeline, each on texts and columns of all kinds, and the mix's shards and places against plain Python."""

import os
import sys
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

from gneiss.llm import bpe, jaccard, mixing, pii, quality


def bag(df) -> Counter:
    return Counter(map(str, df.collect()))


def test_sanitise(docs, rows, empty):
    """Spans become placeholders, those that overlap one; null texts stay null, repeated rows are alike, other columns stay."""
    out = pii.sanitise(docs)
    assert out.columns == docs.columns and out.count() == len(rows) and pii.sanitise(empty).schema == empty.schema and pii.sanitise(empty).count() == 0
    added = brute.disclosing([r[1] for r in rows])
    want = []
    for r, more in zip(rows, added):
        text, end, parts = r[1], 0, []
        for s, e, k in sorted([(s, e, k) for s, _, k, e in brute.spans(text, brute.PII)] + [(s, e, k) for k, s, e in more]):
            if s >= end:
                parts += [text[end:s], pii.PLACEHOLDER[k]]
            end = max(end, e)
        want.append((*r[:1], None if text is None else "".join(parts) + text[end:], *r[2:]))
    assert Counter(tuple(r) for r in out.collect()) == Counter(want)


def test_one_of_each(docs, rows, empty):
    """The least id of a class stays with all its rows and columns; rows of null id and texts without words stay; nothing of nothing."""
    own = [r for r in dict.fromkeys(rows) if r[0] is not None]
    classes = brute.op6([r[0] for r in own], [r[1] for r in own], 5, 80)
    out = jaccard.one_of_each(docs)
    assert out.columns == docs.columns
    assert Counter(tuple(r) for r in out.collect()) == Counter(r for r in rows if r[0] is None or classes[r[0]][1] == r[0])
    assert any(c != k for k, (_, c) in classes.items()) and jaccard.one_of_each(empty).count() == 0


def test_clean(docs, rows, empty):
    """Documents that fail a rule go with all their rows, null and empty texts among them; the others keep all columns."""
    out = quality.clean(docs)
    assert out.columns == docs.columns
    assert Counter(tuple(r) for r in out.collect()) == Counter(r for r in rows if not brute.op4(r[1])["base_failed"])
    assert quality.clean(empty).count() == 0


def test_encode(spark, docs, rows, empty):
    """Null texts have no ids; kept columns keep nulls and types; columns named like the results give way; repeated rows stay."""
    out = bpe.encode(docs, keep=tuple(docs.columns))
    assert out.columns == [*docs.columns, "ids", "decoded"] and bpe.encode(empty, keep=tuple(empty.columns)).count() == 0
    plain = {r[1]: brute.op7([r[1]])[0] for r in rows}
    got = out.collect()
    assert Counter(tuple(r)[:-2] for r in got) == Counter(rows)
    assert all(len(r["ids"]) == plain[r["text"]]["n_tokens"] and brute.sha(r["decoded"].encode()) == plain[r["text"]]["decoded_sha256"] for r in got)
    odd = spark.createDataFrame([(1, "one two", "x", 3, [1]), (None, None, None, None, None)], "doc_id int, text string, ids string, decoded int, `a b` array<int>")
    kept = bpe.encode(odd, keep=tuple(odd.columns))
    assert kept.columns == ["doc_id", "text", "a b", "ids", "decoded"] and dict(kept.dtypes)["ids"] == "array<int>"
    assert {(r["doc_id"], r["text"], r["decoded"]) for r in kept.collect()} >= {(None, None, "")}


def test_mixed_rows(docs, rows, empty):
    """Rows are drawn whole, three times at most, and keep all columns; texts without words are never drawn; nothing of nothing."""
    out = mixing.mixed_documents(docs, block_words=400, shard_blocks=3)
    assert out.columns == docs.columns and mixing.mixed_documents(empty).count() == 0
    got, have = Counter(tuple(r) for r in out.collect()), Counter(rows)
    assert got and all(n <= 3 * have[r] and brute.WORD.search(r[1] or "") for r, n in got.items())
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(brute.WORD.findall(r[1] or ""))
    goal = {r["source"]: r["target"] for r in mixing.mix(docs)[1].select("source", "target").distinct().collect()}
    taken = Counter()
    for r, n in got.items():
        taken[r[3]] += n * len(brute.WORD.findall(r[1]))
    longest = {s: max(len(brute.WORD.findall(r[1] or "")) for r in rows if r[3] == s) for s in sizes}
    assert all(abs(taken[s] - goal[s]) <= longest[s] / 2 + 1 for s in sizes)  # half a document of a source, at most


def test_shards_and_places_against_plain_python(spark):
    """Permuted blocks, passes, words, shards and places of every draw, from the rows' hashes alone."""
    block_words, shard_blocks = 90, 24
    rows = [(i if i % 11 else 5, " ".join(f"w{i}x{j}" for j in range(1 + i * 7 % 40)) if i % 13 else None, ("a", "b", "b", "b", "c", None)[i % 6]) for i in range(400)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, doc_id int, text string, source string").repartition(3)
    key = F.xxhash64(F.lit(7), "doc_id", "text")
    hashed = {r["n"]: (r["k"], r["u"]) for r in docs.select("n", key.alias("k"), mixing._uniform(key).alias("u")).collect()}
    draws, known = mixing.mix(docs, block_words=block_words, shard_blocks=shard_blocks, row="n")
    goals = {r["source"]: round(r["target"]) for r in known.select("source", "target").distinct().collect()}
    got = {(r["row"], r["pass"]): (r["shard"], r["place"], r["words"]) for r in draws.collect()}
    assert draws.count() == len(got)

    size = [len(brute.WORD.findall(t or "")) for _, t, _ in rows]
    blocks = max(1, round(sum(size) / block_words))
    want, taken = {}, {}  # words of each draw; the rows of each turn of a source
    for source, goal in goals.items():
        held: dict = {}
        for i, r in enumerate(rows):
            if r[2] == source and size[i]:
                held.setdefault(int(hashed[i][1] * blocks), []).append(i)
        order = [sorted(held[b], key=lambda i: (hashed[i][0], rows[i][0], i)) for b in sorted(held)]
        at = 0
        for turn in range(3 * len(order)):  # a pass after another over the permuted blocks, until the target is reached
            if at >= goal:
                break
            for i in order[turn % len(order)]:
                if at < goal:
                    want[i, turn // len(order)] = min(size[i], goal - at)
                    taken.setdefault((source, turn), []).append((i, turn // len(order)))
                at += size[i]
    assert {k: v[2] for k, v in got.items()} == want

    shards = {k: {got[d][0] for d in v} for k, v in taken.items()}
    assert all(len(s) == 1 for s in shards.values())  # a block is whole in one shard
    for source in goals:
        run = [min(shards[k]) for k in sorted(k for k in shards if k[0] == source)]
        assert run == sorted(run) and len(run) > 1  # shards take disjoint runs of the permuted blocks
    load = Counter(min(s) for s in shards.values())
    assert max(load.values()) - min(load.values()) <= 1 and len(load) > 4  # an urn is halved at every node
    for shard in load:
        inside = sorted((v[1], k) for k, v in got.items() if v[0] == shard)
        assert [p for p, _ in inside] == list(range(1, len(inside) + 1))
        for what in ([rows[i][2] or "" for _, (i, _) in inside], [i for _, (i, _) in inside], [int(hashed[i][1] * blocks) for _, (i, _) in inside]):
            assert what != sorted(what)  # shuffled within the shard: neither by source nor by row nor by block


@pytest.mark.parametrize("full", [True, False])
def test_pipeline_on_odd_tables(spark, docs, empty, tmp_path, full):
    """Nulls in any column, empty and long texts, repeated rows, clashing columns and an empty table pass through all stages."""
    sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))]
    import corpus_pipeline

    (docs if full else empty).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 1, 0), (None, 0, 1), (7, None, None), (900, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*docs.columns, "ids", "decoded"]
    got = out.collect()
    assert bool(got) == full and all(r["text"] and r["ids"] for r in got)
    assert not any("x@y.z" in r["text"] for r in got) and max(Counter((r["doc_id"], r["text"]) for r in got).values(), default=0) <= 6  # three times each of two equal rows
