"""Chat formatting, whitening and alignment against plain versions."""

import itertools
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.llm import alignment, chat, whitening
from gneiss.llm import queries as Q

CONVERSATION = "conv_id long, turn long, role string, text string, place int, piece string, `last` boolean, start long"


def talks() -> list[tuple]:
    rng = random.Random(3)
    bits = [*chat.TEMPLATE.controls, "<", "[", "\\", ">", "]", "/", "s>", "INST]", "SYS>>", "[ROLE", " ", "\n", "é\U0001f600", "word"]
    odd = lambda: "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", odd()]), odd()) for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(100, 0, "user", None), (100, 1, "assistant", None), (100, 2, None, "no role"), (100, None, "assistant", "no turn"), (None, 0, "assistant", "no id"), (None, None, None, None)]
    rows += [(101, 0, "assistant", "same"), (101, 0, "assistant", "same"), (101, 0, "user", "tie"), (102, 5, "user", "never answered"), (103, 0, "assistant", "long " * 50_000)]
    rows += [(104, t, ("user", "assistant")[t % 2], f"turn {t} </s>") for t in range(300)]
    return rows


def test_chat(spark):
    rows = talks()
    frame = spark.createDataFrame([(*r, 1, "p", True, 9) for r in rows], CONVERSATION).repartition(3)
    turns = chat.format_turns(frame)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.read_back(turns).collect()}
    want = brute.op11(rows)
    assert got == {c: w[:4] for c, w in want.items()}
    assert turns.count() == len(rows)  # no example repeats its context
    empty = frame.limit(0)
    assert chat.read_back(chat.format_turns(empty)).count() == 0 == chat.examples(chat.format_turns(empty)).count()


def test_chat_examples_are_prefixes(spark):
    """Every reply has one example: all turns before it are there, and only the reply is under the mask."""
    rows = [r for r in talks() if r[0] is not None and r[0] != 103]
    turns = chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    asked = chat.examples(turns).filter("example is not null")
    texts = {(r["conv_id"], r["example"]): r for r in chat.expand(turns, asked).collect()}
    spans = {(r["conv_id"], r["example"]): r for r in asked.collect()}
    assert texts.keys() == spans.keys()
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv, own in itertools.groupby(sorted(rows, key=lambda r: (r[0], *order(r))), key=lambda r: r[0]):
        own = [(r[2] or "", r[3] or "") for r in own]
        for k, at in enumerate([i for i, r in enumerate(own) if r[0] == "assistant"], 1):
            x, span = texts[conv, k], spans[conv, k]
            assert chat.TEMPLATE.split(x["text"]) == (own[: at + 1], "")
            assert chat.TEMPLATE.unescape(x["text"][x["loss_start"] : x["loss_end"]]) == own[at][1]
            assert (span["n_context"], span["text_chars"]) == (at, len(x["text"])) and x["text"].endswith(span["piece"])
    total = {r["conv_id"]: r["formatted_chars"] for r in chat.read_back(turns).collect()}
    assert total[101] == sum(len(x["text"]) for (c, _), x in texts.items() if c == 101) + len("<s>same</s>" * 2 + "[INST]tie[/INST]")
    one = chat.expand(turns, spark.createDataFrame([(104, 7)], "conv_id long, example long")).collect()
    assert len(one) == 1 and one[0]["text"] == texts[104, 7]["text"]


def test_chat_query_reads_expanded_examples(spark, monkeypatch):
    """The query makes the text of every example, context before reply, and what is read from these is what the turns say."""
    turns = chat.format_turns(spark.createDataFrame(talks(), "conv_id long, turn long, role string, text string"))
    texts = chat.expanded(turns)
    by = {(r["conv_id"], r["place"]): r for r in texts.filter("conv_id <> 103").collect()}
    for r in chat.examples(turns).filter("conv_id <> 103").collect():
        x = by.pop((r["conv_id"], r["n_context"] + 1))
        assert (len(x["text"]), x["loss_start"], x["loss_end"]) == (r["text_chars"], r["loss_start"], r["loss_end"])
        assert chat.TEMPLATE.split(x["text"])[1] == "" and len(chat.TEMPLATE.split(x["text"])[0]) == r["n_context"] + 1
    assert {c for c, _ in by} <= {None}  # rows without conv_id are one conversation, which the filter leaves out
    key = lambda rows: sorted(map(tuple, rows), key=str)
    assert key(chat.read_examples(texts).collect()) == key(chat.read_back(turns).collect())
    asked = []
    made = chat.expanded
    monkeypatch.setattr(chat, "expanded", lambda t: asked.append(1) or made(t))
    Q.op11_chat_formatting(spark, "/root/testdata/sf0.001")
    assert asked


def test_chat_templates():
    with pytest.raises(ValueError):
        chat.Template(other=("[INST", "[TEXT]", "[/ROLE]"))
    with pytest.raises(ValueError):
        chat.TEMPLATE.split("[INST] user only </s>")


def test_chat_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    want = brute.op11([*rows, (-1, 0, "user", chat.PROBE), (-1, 1, "assistant", chat.PROBE)])
    got = Q.op11_chat_formatting(spark, sf).collect()
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got} == {c: w[:4] for c, w in want.items()}
    assert all(r["formatted_chars"] > want[r["conv_id"]][4] for r in got)


def whitened(found) -> dict:
    out: dict = {}
    for r in found.collect():
        out.setdefault(r["vec_id"], []).append((r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]))
    return {i: sorted(v) for i, v in out.items()}


def same_whitening(got: dict, want: dict):
    assert got.keys() == want.keys()
    signs = None
    for i in want:
        g, (n, deviation, w, explained) = got[i], want[i]
        assert [x[:3] for x in g] == [(c + 1, n, deviation) for c in range(len(w))]
        assert np.allclose([x[4] for x in g], explained, rtol=1e-9) and max(x[5] for x in g) < 1e-9
        y = np.array([x[3] for x in g])
        if signs is None and (np.abs(w) > 1e-3).all():
            signs = np.sign(y * w)
        assert np.allclose(np.abs(y), np.abs(w), atol=1e-7)
        assert signs is None or np.allclose(y * signs, w, atol=1e-7)


def test_whitening(spark):
    rng = np.random.default_rng(2)
    base = (rng.standard_normal((300, 12)) @ rng.standard_normal((12, 12))).tolist()
    rows = [(i, v) for i, v in enumerate(base)] + [(7, base[7]), (7, base[8]), (None, base[9])]
    bad = [(1000, None), (1001, []), (1002, [None] * 12), (1003, [float("nan")] + [0.0] * 11), (1004, [0.0] * 11 + [float("inf")]), (1005, [1.0, 2.0]), (1006, [*base[0][:5], None, *base[0][6:]])]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows + bad], "vec_id long, embedding array<double>, v string, i int").repartition(5)
    got = whitened(whitening.whiten(frame.filter("vec_id <> 7 or vec_id is null")))
    kept = [(i, v) for i, v in rows if i != 7]
    same_whitening(got, brute.op12(kept))
    repeated = whitening.whiten(frame).groupBy("vec_id").count().collect()
    assert {r["vec_id"]: r["count"] for r in repeated} == {i: 8 * sum(j == i for j, _ in rows) for i, _ in rows}
    assert whitening.whiten(frame.limit(0)).count() == 0
    short = whitening.whiten(frame.filter("vec_id in (1000, 1001, 1002, 1003, 1004, 1006)"))  # none takes part
    assert short.count() == 0 and short.columns == [f.split()[0] for f in whitening.OUT.split(", ")]


def test_whitening_without_variance(spark):
    frame = spark.createDataFrame([(i, [1.0, 2.0, float(i % 2)]) for i in range(6)], "vec_id long, embedding array<float>")
    got = whitened(whitening.whiten(frame))
    assert all([x[3] for x in v][1:] == [0.0, 0.0] and abs(abs(v[0][3]) - 1) < 1e-9 and v[0][4] == 1.0 for v in got.values())
    one = whitened(whitening.whiten(frame.filter("vec_id = 0")))
    assert [x[2:] for x in one[0]] == [(0, 0.0, 0.0, 0.0)] * 3
    far = whitened(whitening.whiten(spark.createDataFrame([(0, [1e30]), (1, [-1e30])], "vec_id long, embedding array<double>")))
    assert far[0][0][2] is None and abs(abs(far[0][0][3]) - 1) < 1e-9  # the deviation is beyond a long


def test_spectrum():
    """Eigenvalues and vectors of random, repeated, flat and clustered spectra."""
    rng = np.random.default_rng(1)
    for m, values in [(1, None), (2, None), (40, None), (24, np.repeat([4.0, 3, 2], 8)), (6, np.ones(6)), (30, np.r_[np.ones(3), np.zeros(27)]), (32, 1e6 + np.arange(32) * 1e-3)]:
        q = np.linalg.qr(rng.standard_normal((m, m)))[0]
        a = q * (np.exp(rng.standard_normal(m)) if values is None else values) @ q.T
        e, v = whitening.spectrum(a)
        scale = np.linalg.norm(a)
        assert np.allclose(e, np.linalg.eigvalsh((a + a.T) / 2)[::-1], atol=1e-13 * scale, rtol=0)
        assert np.abs(v.T @ v - np.eye(m)).max() < 1e-14 * m and np.linalg.norm(a @ v - v * e) < 1e-13 * scale


def test_whitening_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    same_whitening(whitened(Q.op12_whitening(spark, sf)), brute.op12(rows))


def aligned(found) -> list[tuple]:
    return sorted(((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in found.collect()), key=str)


def test_alignment(spark, docs, rows, empty):
    more = [(900, "a▁b plain"), (901, "<|endoftext|> </s> <s>"), (902, " "), (903, "  two  blanks\n\n x　y z\x1cq"), (904, "\x00nul"), (905, "x" * 5000 + " " + "中文字" * 700)]
    extra = spark.createDataFrame([(i, t, "en", None, None, None, None, None, None, None, None, None) for i, t in more], docs.schema)
    every = [(r[0], r[1]) for r in rows] + more
    want = sorted(((i, *w) for (i, _), w in zip(every, brute.op13([t for _, t in every]))), key=str)
    both = docs.unionByName(extra)
    assert aligned(alignment.digest(alignment.align(both))) == want
    # ranges that cut words, tokens' groups and characters, composed in many levels
    assert aligned(alignment.digest(alignment.align(both, range_bytes=97, fan_in=3))) == want
    assert alignment.digest(alignment.align(empty)).count() == 0


def test_fragments_compose_in_any_order():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randint(1, 40)
        ends = [np.array(sorted({*rng.sample(range(1, n + 1), rng.randint(0, n)), n})) for _ in range(2)]
        ids = [np.arange(len(e)) for e in ends]
        cuts = [0, *sorted(rng.sample(range(1, n + 1), min(n, rng.randint(0, 5)))), n]

        def part(lo, hi):
            at = [np.searchsorted(e, [lo, hi], "right") for e in ends]
            a, b = (x[p:q] for x, (p, q) in zip(ids, at))
            return alignment.fragment(a, b, *alignment.common(*(e[p:q] for e, (p, q) in zip(ends, at))))

        parts = [part(lo, hi) for lo, hi in zip(cuts, cuts[1:])]
        while len(parts) > 1:  # any tree
            k = rng.randrange(len(parts) - 1)
            parts[k : k + 2] = [alignment.compose(parts[k], parts[k + 1])]
        assert parts[0] == part(0, n) and parts[0].suffix == ([], [])


def test_segments_join():
    by = alignment.aligner(alignment.vocabularies())
    assert by.apart
    for text in ("one two three four " * 40, "x" * 300, "é中 文 " * 50, " lead  and  trail ", "a b"):
        parts = list(by.segments(text, 32))
        assert "".join(p for _, p in parts) == " " + text
        assert [s for s, _ in parts] == [len((" " + text)[: sum(len(p) for _, p in parts[:k])].encode()) for k in range(len(parts))]
        whole, cut = by.encode([" " + text]), [by.encode([p]) for _, p in parts]
        assert all(np.array_equal(whole[side][0], np.concatenate([c[side][0] for c in cut])) for side in (0, 1))


def test_alignment_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = sorted(((i, *w) for (i, _), w in zip(rows, brute.op13([t for _, t in rows]))), key=str)
    assert aligned(Q.op13_alignment(spark, sf)) == want
