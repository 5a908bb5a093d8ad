"""The corpus operators against plain Python, on texts with all kinds of edges."""

import brute
import pytest
from pyspark.sql import functions as F

from gneiss.llm import bpe, components, jaccard, mixing, pii, quality, secrets, suffixes, topk, toxicity, warc


def key(x):
    return "" if x is None else str(x)


def held(found, rows, want):
    """Results by id, in any order, equal ``want`` of each row in the columns that it has."""
    got = sorted(([key(r["doc_id"])] + [r[c] for c in want[0]] for r in found.collect()), key=str)
    assert got == sorted(([key(r[0])] + list(w.values()) for r, w in zip(rows, want)), key=str)


def test_pii(docs, rows, empty):
    held(pii.digest(pii.scan(docs)), rows, [brute.op1(r[1]) for r in rows])
    assert pii.digest(pii.scan(empty)).count() == 0


def test_pii_terms(spark):
    """A word that stands with one entity in different contexts, and nowhere else, is generalised; common words stay."""
    text = lambda i: f"report {i} filler{i} other{i} Quillfeather wrote to jane.roe@corp.example about item{i} thing{i} and more{i}"
    noise = [f"plain words number{i} wrote about item and report more" for i in range(300)]
    docs = spark.createDataFrame([(i, text(i)) for i in range(6)] + [(100 + i, t) for i, t in enumerate(noise)], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in pii.sanitise(docs, bits=4.0).collect()}
    assert all("Quillfeather" not in out[i] and "<EMAIL>" in out[i] and "<TERM>" in out[i] and "wrote" in out[i] for i in range(6))
    assert [out[100 + i] for i in range(300)] == noise


def test_methods_of_pii_and_secrets_act(spark):
    """On a given table both add spans, those that plain counting and plain comparison of all parts add."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    told = lambda found: {r["doc_id"]: r["spans"].split(",") if r["spans"] else [] for r in found.collect()}
    got, want = told(pii.digest(pii.scan(docs))), dict(zip(texts, brute.disclosing(list(texts.values()))))
    for i, t in texts.items():
        assert got[i] == [f"{k}:{s}:{e}" for s, _, k, e in brute.spans(t, brute.PII)] + [f"{k}:{s}:{e}" for k, s, e in want[i]]
    assert any(want.values())
    got, some = told(secrets.digest(secrets.scan(docs))), 0
    for i, t in texts.items():
        more = brute.linked(t)
        some += len(more)
        assert sorted(got[i]) == sorted([f"{k}:{s}:{e}" for s, _, k, e in brute.spans(t, brute.SECRETS)] + [f"{k}:{s}:{e}" for k, s, e in more])
    assert some


def test_long_keys_and_many_spans(spark):
    """A key is looked at to its end; hundreds of matches keep their places; many spans are replaced."""
    key = "q" * 500 + "Z9"
    many = " ".join(f"a{i}@x{i}.org" for i in range(700))
    docs = spark.createDataFrame([(0, f"user: alice77 {key}"), (1, many)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_linked"] for r in secrets.digest(secrets.scan(docs)).collect()}[0] == 2
    assert pii.digest(pii.scan(docs)).filter("doc_id = 1").first()["base_sha256"] == brute.op1(many)["base_sha256"]
    assert pii.sanitise(docs).filter("doc_id = 1").first()["text"] == " ".join(["<EMAIL>"] * 700)


def test_secrets(docs, rows, empty):
    found = secrets.digest(secrets.scan(docs))
    held(found, rows, [brute.op10(r[1]) for r in rows])
    linked = {r["doc_id"]: r["n_linked"] for r in found.collect()}
    assert linked[19] == 3 and linked[20] == 0  # complementary parts together; a lone weak part is not told
    assert secrets.digest(secrets.scan(empty)).count() == 0


def test_quality(docs, rows, empty):
    held(quality.judge(docs), rows, [brute.op4(r[1]) for r in rows])
    assert quality.judge(empty).count() == 0


def test_quality_lines(spark):
    rows = [(i, f"Buy now at our shop today\nown words {chr(97 + i)} " + " ".join(chr(97 + i) * (j + 1) for j in range(n)), "h") for i, n in [(k, 2 if k < 3 else 30) for k in range(12)]]
    docs = spark.createDataFrame(rows + [(99, rows[3][1].replace("own", "own2"), "other")], "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["n_line_words"], r["kept"]) for r in quality.judge(docs, max_line_docs=5, min_kept_share=0.9).collect()}
    assert all(got[i] == (6, False) for i in range(3)) and got[99] == (0, True)
    assert quality.clean(docs, max_line_docs=5, min_kept_share=0.5).count() == 10


def test_quality_lines_count_documents(spark):
    """Copies of a whole text are documents too; a line that one document repeats counts once; hosts are counted apart."""
    own = lambda i: f"own{chr(97 + i)} " + " ".join(chr(97 + i) * (j + 1) for j in range(30))
    copied = "shared line of the copies\n" + own(0)
    often = "\n".join(["line said often here"] * 9 + [own(1)])
    docs = spark.createDataFrame([(i, copied, "h") for i in range(6)] + [(10, often, "h"), (11, copied, None), (12, copied, "other")], "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["n_line_words"], r["kept"]) for r in quality.judge(docs, max_line_docs=5).collect()}
    assert all(got[i] == (36, False) for i in range(6))
    assert got[10][0] == 0 and got[11] == (0, True) == got[12]
    assert quality.judge(docs, max_line_docs=6).filter("n_line_words > 0").count() == 0


def test_suffixes(docs, rows, empty):
    held(suffixes.digest(suffixes.deduplicate(docs)), rows, brute.op2([r[1] for r in rows]))
    assert suffixes.deduplicate(empty).count() == 0


def test_suffixes_hot_anchor(docs, rows):
    """Anchors with many segments take the counted way, with the same result."""
    keyed = suffixes.repeated_ranges(docs, group=1)
    usual = suffixes.repeated_ranges(docs)
    ranges = lambda df: sorted((r["_h"], tuple(suffixes.keep_mask(20000, r["ranges"]).nonzero()[0].tolist())) for r in df.collect())
    assert ranges(keyed) == ranges(usual)


def test_columns():
    """The transform of each column, in the order of what precedes it, and the windows that neighbours share, against plain comparison."""
    import random

    import numpy as np

    rng = random.Random(1)
    for _ in range(200):
        length, base = rng.choice([3, 4, 6]), [rng.choice("ab") for _ in range(14)]
        texts, before = [], []
        for _ in range(rng.randint(1, 12)):
            lo = rng.randint(0, 5)
            t = base[lo : rng.randint(7, 14)]
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = rng.choice("abc")
            texts.append("".join(t).encode())
            before.append(6 - lo)
        got = suffixes.repeated_windows(texts, np.array(before), length)
        part = lambda j, c, n: texts[j][c + before[j] : c + before[j] + n] if c + before[j] >= 0 else b""
        for i, t in enumerate(texts):
            for w in range(len(t) - length + 1):
                assert got[i][w] == any(j != i and part(j, w - before[i], length) == t[w : w + length] for j in range(len(texts)))
        c = suffixes.Columns(texts, np.array(before))
        for column in range(min(-b for b in before), 4):
            assert sorted(c.insert(column)) == sorted(t[column + b] for t, b in zip(texts, before) if 0 <= column + b < len(t))
            past = [texts[i][: column + 1 + before[i]][::-1] for i in c.order]
            same = [next((n for n, (x, y) in enumerate(zip(p, q)) if x != y), min(len(p), len(q))) for p, q in zip(past, past[1:])]
            assert [column + 1 - s for s in c.since[1:]] == same and all(s == column + 1 for s in c.since[:1])


def test_jaccard(docs, rows, empty):
    own = [r for r in dict.fromkeys(rows) if r[0] is not None]
    for n, percent in ((4, 85), (5, 80)):
        want = brute.op6([r[0] for r in own], [r[1] for r in own], n, percent)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(docs, n, percent).collect()}
        assert {k: v for k, v in got.items() if k is not None} == want
    assert jaccard.near_duplicates(docs).count() == len(rows)
    assert jaccard.near_duplicates(empty).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100 + i, 100) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200, 202: 200}


def test_bpe(docs, rows, empty):
    held(bpe.digest(docs), rows, brute.op7([r[1] for r in rows]))
    assert bpe.digest(empty).count() == 0
    kept = bpe.encode(docs, keep=("text", "source")).filter("doc_id = 7").first()
    assert kept["text"] == rows[7][1] and len(kept["ids"]) == brute.op7([rows[7][1]])[0]["n_tokens"]


def test_mixing(docs, rows, empty):
    got = mixing.digest(*mixing.mix(docs, block_words=500, shard_blocks=4)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["taken"] <= 3 * r["size"]
    by: dict = {}
    for r in got:
        t = by.setdefault((r["source_size"], r["target"]), [0, 0])
        t[0] += r["taken"]
        t[1] += r["size"]
    assert all(abs(k[1] - v[0]) <= 0.5 + 1e-9 and k[0] == v[1] for k, v in by.items())
    assert abs(sum(k[1] for k in by) - sum(v[1] for v in by.values())) < 1e-6
    again = mixing.digest(*mixing.mix(docs.repartition(5), block_words=500, shard_blocks=4))
    assert sorted((key(r["doc_id"]), r["taken"]) for r in again.collect()) == sorted((key(r["doc_id"]), r["taken"]) for r in got)
    assert mixing.digest(*mixing.mix(empty)).count() == 0


def test_mixed_documents(spark, docs):
    """Rows that share an id are drawn each for itself; a column may have any name; sizes and targets agree with SQL."""
    import duckdb

    rows = [(7 if i % 2 else i, f"w{i} " * (5 + i % 9), "a" if i % 3 else "b", i, i, i) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, `_copy` int, row int, shard int")
    draws, sizes = mixing.mix(df.select("doc_id", "text", "source"), whole=True, block_words=60, shard_blocks=2)
    mixed = mixing.mixed_documents(df, block_words=60, shard_blocks=2)
    assert mixed.columns == df.columns
    times = {r["_copy"]: r["count"] for r in mixed.groupBy("_copy").count().collect()}
    assert sum(times.values()) == draws.count() and max(times.values()) <= 3
    got = {r["row"]: r["count"] for r in draws.groupBy("row").count().collect()}
    assert sorted(times.values()) == sorted(got.values())
    sf = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = {r[0]: r[1:] for r in db.execute(mixing.TARGET_SQL).fetchall()}
    for r in mixing.mix(spark.read.parquet(f"{sf}/documents.parquet"))[1].collect():
        assert (r["size"], r["source_size"]) == want[r["doc_id"]][:2] and abs(r["target"] - want[r["doc_id"]][2]) < 1e-6


def test_targets(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 5), (None, 100)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    assert got["a"] == 30 and got["c"] == 15
    assert abs(got["b"] + got[None] - 1070) < 1e-9 and got[None] == 300  # weights 2 and 1: a third would be 356


def test_splitting_tree(spark):
    """Quotas are conserved at every split, and shards differ by a block at most."""
    root = spark.createDataFrame([([400, 37, 0, 3],)], "quotas array<long>")
    rows = [r["quotas"] for r in mixing.split_quotas(root, 4, 1).collect()]
    assert len(rows) == 16 and [sum(x) for x in zip(*rows)] == [400, 37, 0, 3]
    assert {sum(r) for r in rows} <= {27, 28} and len({tuple(r) for r in rows}) > 1


@pytest.mark.parametrize("total, good, drawn", [(50, 20, 15), (50, 40, 30), (9, 4, 2), (2_000_000, 700_000, 1_000_000)])
def test_hypergeometric(spark, total, good, drawn):
    """Draws follow the distribution, in mean and variance, within what draws can come to; a large quota takes as many trials as a small one."""
    one = lambda x: F.lit(x).cast("long")
    n, p = 6000, good / total
    got = spark.range(n).select(mixing._hypergeometric(one(total), one(good), one(drawn), F.lit(3), F.col("id")).alias("k")).agg(F.avg("k"), F.var_pop("k"), F.min("k"), F.max("k")).first()
    var = drawn * p * (1 - p) * (total - drawn) / (total - 1)
    assert abs(got[0] - drawn * p) < 5 * (var / n) ** 0.5 and abs(got[1] / var - 1) < 0.12
    assert got[2] >= max(0, drawn - (total - good)) and got[3] <= min(good, drawn)
    ends = spark.range(3).select(*[mixing._hypergeometric(one(a), one(b), one(c), F.col("id")) for a, b, c in ((9, 0, 4), (9, 9, 4), (9, 3, 9), (9, 3, 0))]).first()
    assert tuple(ends) == (0, 4, 3, 0)


def test_running_sums(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("by"), F.col("id").alias("at"), (F.col("id") % 7).alias("n"))
    got = mixing.running(rows, "by", "at", {"n": "before"}).orderBy("at").collect()
    held = {0: 0, 1: 0, 2: 0}
    for r in got:
        assert r["before"] == held[r["by"]]
        held[r["by"]] += r["n"]


def test_warc(spark):
    long = "<html>é" + "x" * 200
    pages = [(5, "http://a/ b%", long), (3, "http://b", long), (9, None, "short"), (10, "u", "short"), (11, "u", None), (12, "u", ""), (13, "u", "\r\n\r\n" + "y" * 200000), (3, "http://b", long), (None, "u", long)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("record_type", F.lit("x")).repartition(3)
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(df).collect()), key=str)
    want = sorted(((i, len((h or "").encode()), brute.sha(h or ""), "revisit" if h == long and i != 3 else "response", 3 if h == long and i != 3 else None) for i, _, h in pages), key=str)
    assert got == want
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_splits(tmp_path):
    """Whatever the ranges, each record is owned by one."""
    import random

    rng = random.Random(1)
    recs = [warc.record(i, "u", "response", "d", None, rng.randbytes(rng.randint(0, 3000)) + warc.MAGIC * 3) for i in range(60)]
    data = warc.MAGIC + b"junk" + b"".join(recs)
    path = tmp_path / "a.warc.gz"
    path.write_bytes(data)
    for step in (1, 7, 100, 1000, 4096, len(data)):
        with open(path, "rb") as f:
            ids = [warc.parse(m)[0] for s in range(0, len(data), step) for m in warc.members(f, len(data), s, min(len(data), s + step), 512)]
        assert ids == list(range(60)), step


def test_top_k(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    vectors = [(i, rng.normal(size=8).round(2).tolist()) for i in range(400)]
    vectors += [(400 + i, vectors[0][1]) for i in range(60)] + [(1000, None), (1020, [None] * 8), (1040, [float("nan")] * 8), (1060, [float("inf")] * 8), (None, [1.0] * 8), (1080, [1.0, 2.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    q = {i: np.floor(64 * np.array(v)).astype(int) for i, v in vectors if i is not None and i < 1000}
    want = [(i, r + 1, j, s) for i in q if i % 20 == 0 for r, (s, j) in enumerate(sorted(((int(q[i] @ q[j]), j) for j in q if j != i), key=lambda x: (-x[0], x[1]))[:20])]
    got = topk.top_k(df, data_block=64, query_block=8)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == sorted(want)
    assert topk.top_k(df.limit(0)).count() == 0


def test_trees_prune():
    """On clustered vectors the walk takes far fewer products than there are pairs, and the levels of the tree cover and keep apart."""
    import numpy as np

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16)) * 500
    points = (centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16)) * 5).astype(np.int64)
    data = topk.Tree(points, [np.array([i]) for i in range(4000)])
    queries = topk.Tree(points[::20], [np.array([i]) for i in range(0, 4000, 20)])
    q, i, s, products = topk.search(queries, data, 20)
    assert products < 0.5 * 200 * 4000
    exact = points[::20] @ points.T
    for n in range(200):
        best = sorted(((-exact[n, j], j) for j in range(4000) if j != 20 * n))[:20]
        assert sorted(zip((-s[q == 20 * n]).tolist(), i[q == 20 * n].tolist())) == best
    for tree in (data, queries):
        for node, kids in enumerate(tree.children):
            x = points.astype(float)[:: 1 if tree is data else 20]
            assert np.sqrt(((x[tree.members[node]] - x[tree.centre[node]]) ** 2).sum(1)).max() <= tree.radius[node] + 1e-9
            assert sorted(np.concatenate([tree.members[k] for k in kids]).tolist()) == sorted(tree.members[node].tolist()) if kids else True


def test_bpe_repair():
    """Every chunk taken as shared: joins are mended for a tokenizer that drops white space and for one that does not."""
    import random

    import public_tokenizers

    texts = ["don't stop, Élan " * 300, "x" * 5000, "é́ " * 900, "", "  ", " ".join("y" * 700 for _ in range(9)), "<|endoftext|>" * 200, "a\n\n  b " * 700]
    rng = random.Random(3)
    texts.append("".join(rng.choice(["word", " ", "  ", "é", "'s ", ". ", "\n", "12", "中"]) for _ in range(20_000)))
    for name, apart in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        own = bpe.Coder(public_tokenizers.path(name), memory=50)
        assert own.apart == apart
        data = [t.encode() for t in texts]
        pieces = [[(s, e, x) for (s, e), x in zip(bpe.chunks(d), own.encode([d[s:e] for s, e in bpe.chunks(d)]))] for d in data]
        assert max(map(len, pieces)) > 2
        got, rounds = bpe.repair(data, pieces, own.encode)
        assert [x.tolist() for x in got] == [e.ids for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)] and rounds >= 1


def test_toxicity(spark):
    import random

    rng = random.Random(2)
    words = [f"word{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=30)) + (" vile slur" if i % 8 == 0 else ""), "x") for i in range(1500)]
    docs = spark.createDataFrame(rows + [(5000, None, "x"), (5001, "", "x"), (None, "vile slur", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(0, 1500, 2)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.classify(docs, labels).collect()}
    assert len(got) == 1503 and all(0 <= r["score"] <= 1 for r in got.values())
    assert sum(got[i]["predicted"] == (i % 8 == 0) for i in range(1500)) > 1480 and got[5000]["predicted"] == 0 == got[5001]["predicted"]
    assert toxicity.classify(docs, labels.limit(0)).filter("predicted = 1").count() == 0
    assert toxicity.classify(docs.limit(0), labels).count() == 0


def test_toxicity_against_plain_python(spark):
    """Words, prior and scores on a given table equal those of dense arithmetic over all labelled rows."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    known = {}
    for r in labels.collect():
        if r["toxic"] is not None:
            known[r["doc_id"]] = max(int(r["toxic"]), known.get(r["doc_id"], 0))
    words, prior, scores = brute.op9(texts, known)
    model = toxicity.train(docs, labels)
    assert model["words"] == words and words and abs(model["prior"] - prior) < 1e-9
    got = {r["doc_id"]: r["score"] for r in toxicity.classify(docs, labels).collect()}
    assert got.keys() == scores.keys() and max(abs(got[i] - scores[i]) for i in got) < 1e-3


def test_toxicity_held_out(spark):
    """On labelled rows that taught nothing most toxic texts are caught and nearly all others left alone; the prior is near the share of toxic rows."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.classify(docs, labels).filter("held_out").join(labels.select("doc_id", F.col("toxic").cast("int").alias("t")), "doc_id")
    n = {(r["t"], r["predicted"]): r["count"] for r in got.groupBy("t", "predicted").count().collect()}
    assert n[1, 1] > 4 * n[1, 0] and n[0, 0] > 30 * n[0, 1]


def test_rare_words_do_not_bound_the_prior(spark):
    """Of very many rare words some are by chance much rarer in unlabelled text; the words that most toxic texts hold tell the prior."""
    rows = [(f"slur{i}", 0.3, 0.03 + i * 1e-4, 0.005, 0.0009) for i in range(5)] + [(f"rare{i}", 0.0025, 0.0025 - i * 5e-7, 0.00055, 0.00025) for i in range(5000)]
    seen = spark.createDataFrame(rows, "word string, a double, b double, da double, db double")
    assert abs(toxicity.bound(seen) - 0.0309 / 0.295) < 1e-9
    assert abs(toxicity.bound(seen.filter("word = 'rare4999'")) - 0.25e-3 / 1.95e-3) < 1e-3 and toxicity.bound(seen.limit(0)) == toxicity.MOST_PRIOR


def test_drop_toxic(spark):
    """Rows that are called toxic go, copies alike; nulls and empty texts stay with all their columns; no table, no rows."""
    rows = [(i, f"plain text number{i}" + (" vile slur" if i % 4 == 0 else ""), "s", "x") for i in range(400)]
    rows += [(0, rows[0][1], None, None), (None, None, None, None), (900, "", "s", "x"), (None, "vile slur", "s", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string, score string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    out = toxicity.drop_toxic(docs, labels)
    assert out.columns == docs.columns and sorted(map(str, out.collect())) == sorted(str(r) for r in docs.collect() if "vile" not in (r["text"] or ""))
    few = labels.filter("toxic = 0 or doc_id < 13")
    assert toxicity.drop_toxic(docs, few).count() == len(rows)  # too few toxic examples to tell any word
    assert toxicity.drop_toxic(docs.limit(0), labels).count() == 0 and toxicity.drop_toxic(docs, labels.limit(0)).count() == len(rows)


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.filter("size(ids) = 0 and length(trim(text)) > 0").count() == 0 and out.count() > 50
    assert len(corpus_pipeline.STAGES) == 5
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    step = corpus_pipeline.near_copies(spark, docs, "/root/testdata/sf0.001")
    rows = docs.collect()
    want = brute.op6([r["doc_id"] for r in rows], [r["text"] for r in rows], 5, 80)
    assert sorted(r["doc_id"] for r in step.collect()) == sorted(k for k, (_, c) in want.items() if c == k) and step.columns == docs.columns


def test_warc_large_ids(spark):
    """Ids beyond 2**53, negative ones and null among them, come back as they are, and revisits find their response."""
    big = [2**60 + 1, 2**60 + 3, 2**53 + 1, 2**63 - 1, -(2**62) - 1]
    same, other = "x" * 200, "y" * 150
    rows = [(i, f"http://a/{k}", same) for k, i in enumerate(big)] + [(2**61 + 5, "u", other), (2**61 + 7, None, other), (None, "n", same), (2**54 + 1, "s", "short"), (2**54 + 3, "s", "short"), (2**55 + 1, "z", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect()}
    first = min(big)
    assert got == {i: (200, "response" if i == first else "revisit", None if i == first else first) for i in big} | {
        2**61 + 5: (150, "response", None), 2**61 + 7: (150, "revisit", 2**61 + 5), None: (200, "revisit", first), 2**54 + 1: (5, "response", None), 2**54 + 3: (5, "response", None), 2**55 + 1: (0, "response", None),
    }
