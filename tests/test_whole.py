"""Operators that do the whole job: no cap on rounds, no threshold, no rows left out."""

import random
import re
from collections import Counter

from gneiss.functions import text as X
from gneiss.operators import cluster
from gneiss.plans import queries as Q
from gneiss.session import materialise
from gneiss.sources import files

ORDER = "ord long, id string"
EDGES = "ord long, source string, target string, type string, weight double"


def test_communities_of_planted_groups_and_a_path(spark):
    """Every community hangs together, no two gain by merging, planted groups are found, and modularity is not below theirs."""
    rng = random.Random(1)
    pairs = [(a, b) for a in range(60) for b in range(a) if rng.random() < (0.6 if a % 4 == b % 4 else 0.02)]
    pairs += [(i, i + 1) for i in range(60, 139)]
    n, m = 140, len(pairs)
    ids = [f"n{i:04d}" for i in range(n)]
    edges = spark.createDataFrame([(i, ids[a], ids[b], "CALLS", 1.0) for i, (a, b) in enumerate(pairs)], EDGES)
    got = materialise(cluster.communities(spark.createDataFrame(list(enumerate(ids)), ORDER), edges))
    of = {r["id"]: r["community"] for r in got.collect()}
    of = [of[i] for i in ids]
    held, cut, root = Counter(), Counter(), list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        held[of[a]] += 1
        held[of[b]] += 1
        if of[a] == of[b]:
            root[find(a)] = find(b)
        else:
            cut[min(of[a], of[b]), max(of[a], of[b])] += 1
    assert not [p for p, w in cut.items() if w - held[p[0]] * held[p[1]] / (2 * m) > 1e-6]
    assert len({find(i) for i in range(n)}) == len(set(of))
    assert [len({of[i] for i in range(g, 60, 4)}) for g in range(4)] == [1] * 4 and len(set(of[:60])) == 4
    planted = spark.createDataFrame([(i, k % 4 if k < 60 else 10 + (k - 60) // 9) for k, i in enumerate(ids)], "id string, community int")
    assert cluster.modularity(edges, got).first()["q"] >= cluster.modularity(edges, planted).first()["q"] - 0.01


def test_communities_are_numbered_in_slices(spark):
    """Numbers follow size and place, though no task sorts all communities."""
    sizes = spark.range(5000).selectExpr("concat('c', id) as at", "case when id < 10 then 20 - id else 1 end as n", "5000 - id as first")
    got = cluster._numbered(sizes).join(sizes, "at").orderBy("community").collect()
    assert [r["community"] for r in got] == list(range(5000))
    assert [(-r["n"], r["first"]) for r in got] == sorted((-r["n"], r["first"]) for r in got)
    rows = [r["count"] for r in cluster._sliced(sizes).groupBy("slice").count().collect()]
    assert len(rows) > 1 and max(rows) < 5000


def test_every_token_has_its_frequencies(spark):
    sf = "/root/testdata/sf0.001"
    df, tf = Counter(), Counter()
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        words = re.findall(X.WORD, d["text"] or "")
        found = [t for w in words for t in [w.lower(), *(p.lower() for p in X._HUMP.split(w) if p.lower() != w.lower())]]
        tf.update(found)
        df.update(set(found))
    got = {r["token"]: (r["df"], r["tf"]) for r in Q.QUERIES["token_frequencies"](spark, sf).collect()}
    assert got == {t: (df[t], tf[t]) for t in tf} and min(df.values()) <= 20


def test_document_frequencies_count_all(spark):
    """Both figures of every token, as before its query was cut, and the SQL says so too."""
    sf = "/root/testdata/sf0.001"
    both = [Q.QUERIES[q](spark, sf) for q in ("document_frequencies", "token_frequencies")]
    one, other = ({tuple(r) for r in f.select("token", "df", "tf").collect()} for f in both)
    assert one == other and min(df for _, df, _ in one) == 1 and max(tf - df for _, df, tf in one) > 0
    assert "AS tf" in Q.SQL["document_frequencies"] and "HAVING" not in Q.SQL["document_frequencies"]


def test_imports_are_linked(spark):
    code = {
        "app/__init__.py": "",
        "app/models.py": "class User: pass\nclass Order: pass\ndef open(): pass\n",
        "app/util/__init__.py": "def go(): pass\n",
        "app/util/deep.py": "from ..models import User as U\nfrom . import other, gone\nfrom .nothing import a\nclass D(U):\n    def f(self): other(); a()\n",
        "app/util/other.py": "from app.models import *\n",
        "main.py": "import os, numpy\nimport app.models\nfrom app.models import User, Order, open\nfrom app.util import go\nfrom third import far, print\nfrom app.missing import x\nclass M(User, far): pass\n@go\n@far\ndef run():\n    Order(); go(); open(); far(); len(1); print(1)\n",
    }
    table = spark.createDataFrame([(p, "python", bytearray(c.encode())) for p, c in code.items()], "path string, language string, content binary")
    e, r = files.link(files.parse_python(table), table)
    edges = Counter((x["source"], x["target"], x["type"]) for x in e.filter("type <> 'CONTAINS'").collect())
    assert edges == Counter([
        ("app/util/deep.py", "app/models.py", "IMPORTS"), ("app/util/deep.py", "app/util/other.py", "IMPORTS"), ("app/util/other.py", "app/models.py", "IMPORTS"),
        ("main.py", "app/models.py", "IMPORTS"), ("main.py", "app/models.py", "IMPORTS"), ("main.py", "app/util/__init__.py", "IMPORTS"),
        ("app/util/deep.py::D", "app/models.py::User", "INHERITS"), ("app/util/deep.py::D.f", "app/util/other.py", "CALLS"), ("main.py::M", "app/models.py::User", "INHERITS"),
        ("main.py::run", "app/models.py::Order", "CALLS"), ("main.py::run", "app/util/__init__.py::go", "CALLS"), ("main.py::run", "app/models.py::open", "CALLS"),
        ("main.py::run", "app/util/__init__.py::go", "DECORATES"),
    ])
    assert sorted((x["file"], x["raw"], x["kind"]) for x in r.collect()) == [
        ("app/util/deep.py", "a", "call"), ("app/util/deep.py", "from .nothing import a", "import"),
        ("main.py", "far", "call"), ("main.py", "far", "inherits"), ("main.py", "from app.missing import x", "import"),
    ]
    assert e.select("ord").distinct().count() == e.count()
