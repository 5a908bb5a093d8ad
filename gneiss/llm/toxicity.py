"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic examples and unlabelled text are all that the classifier learns from. With class prior q, loss l and
score g, the risk is  q E_P[l(g)] + max(0, E_U[l(-g)] - q E_P[l(-g)]):  the second part estimates the risk on clean text
without any clean example, and holding it at zero keeps the model from explaining the unlabelled sample by heart.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.session import materialise, small_batches

#: Bounds of the training samples: confirmed toxic texts, and texts of any kind whose labels, if they have one, are not looked at.
POSITIVES, UNLABELLED = 10_000, 40_000
#: The greatest class prior that is taken from the samples: few positives leave its estimate too loose.
MOST_PRIOR = 0.3
#: How many times the least bound of the prior a word's own may be for the word to count.
NEARLY = 1.5
TOKEN = re.compile(r"[^\W\d_]+")
STEM = 5


def features(text: str | None) -> set[str]:
    """A text's words, lower-cased, and their first letters (marked), once each."""
    words = set(TOKEN.findall((text or "").lower()))
    return words | {w[:STEM] + "*" for w in words if len(w) > STEM}


def fit(p: list[list[int]], u: list[list[int]], width: int, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    """Weights (bias last) of a logistic model over ``width`` binary features that minimise the non-negative risk, by Adam over
    whole samples. A row of ``p`` and ``u`` lists the features that a text has."""
    (pi, pr), (ui, ur) = ((np.array([f for x in rows for f in x], np.int64), np.repeat(np.arange(len(rows)), [len(x) for x in rows])) for rows in (p, u))
    w = np.zeros(width + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    logistic = lambda at, row, n: 1 / (1 + np.exp(-(np.bincount(row, w[at], n) + w[-1])))
    mean = lambda at, row, g: np.append(np.bincount(at, g[row], width), g.sum()) / len(g)
    for t in range(1, steps + 1):
        gp, gu = logistic(pi, pr, len(p)), logistic(ui, ur, len(u))
        negative = -np.log1p(-np.minimum(gu, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(gp, 1 - 1e-12)).mean()
        clean = mean(ui, ur, gu) - prior * mean(pi, pr, gp)
        grad = prior * mean(pi, pr, gp - 1) + clean if negative >= 0 else -clean
        grad[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def held_out() -> Column:
    """Whether crc32 of the id as text leaves 0 modulo 5; a null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def bound(seen: DataFrame, most: float = MOST_PRIOR) -> float:
    """The class prior from words' shares a of toxic and b of unlabelled texts and their deviations da and db, ``most`` at most.

    Unlabelled text holds any word at least prior times as often as toxic text does, so b / a, with b some deviations up and a as many
    down, bounds the prior. The least of all words' ratios at one deviation would be that of a rare word which the samples got wrong, and
    the prior too small: of n words some are by chance as far off as sqrt(2 ln n) deviations. So only words count whose bound at that
    distance is nearly (``NEARLY``) the least, of these the least ratio at one deviation; where no word is that sure, all count.
    """
    ratio = lambda far: F.when(F.col("a") > far * F.col("da"), (F.col("b") + far * F.col("db")) / (F.col("a") - far * F.col("da")))
    sure = F.coalesce(ratio(float(np.sqrt(2 * np.log(max(seen.count(), 2))))), F.lit(float("inf")))
    least = seen.agg(F.min(sure)).first()[0]
    least = seen.filter(sure <= F.lit(NEARLY * least)).agg(F.min(ratio(1.0))).first()[0] if least is not None else None
    return min(max(least or 1.0, 1e-3), most)


def train(docs: DataFrame, labels: DataFrame, prior: float | None = None, positives: int = POSITIVES, unlabelled: int = UNLABELLED, most_prior: float = MOST_PRIOR) -> dict:
    """words, weights and prior. docs: doc_id, text; labels: doc_id, toxic. Rows that ``held_out`` marks teach nothing.

    Two samples, chosen by a hash, of at most about ``positives`` toxic and ``unlabelled`` texts: the second is drawn from all rows of ``docs``,
    labelled or not. Rows of null id teach nothing. Of repeated ids the smallest text counts, and the label is toxic where one
    is. Every word is a feature that positive texts have more often than unlabelled ones (by half, and by four deviations).
    The class prior, where none is given, comes from the two samples by ``bound``: a corpus of which more than ``most_prior`` is toxic
    needs a greater one, or its own ``prior``.
    Without a positive example there are no words and every score is 0; without a word that tells, every score is the prior.
    """
    known = labels.filter(~held_out() & (F.col("toxic").cast("int") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    known = materialise(known, "labels")
    teach = docs.select("doc_id", "text").filter(~held_out() & F.col("doc_id").isNotNull())
    n, toxic = teach.count(), known.count()
    if not n or not toxic:
        return {"words": [], "weights": None, "prior": 0.0}
    draw = lambda k: F.pmod(F.xxhash64(F.lit(k), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # the toxic ids chosen are at most about as many as their sample's bound
    chosen = known.filter(draw(1) < positives / toxic).select("doc_id", F.lit(1).alias("sure"))
    roles = F.array_compact(F.array("sure", F.when(draw(2) < unlabelled / n, 0)))
    texts = teach.join(F.broadcast(chosen), "doc_id", "left").select("doc_id", "text", roles.alias("roles")).filter(F.size("roles") > 0).groupBy("doc_id").agg(F.min("text").alias("text"), F.first("roles").alias("roles"))

    def bag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"roles": b["roles"], "words": [list(features(t)) for t in b["text"]]})

    bags = materialise(texts.select("roles", "text").mapInPandas(bag, "roles array<int>, words array<string>"), "bags")
    sizes = {r["label"]: r["n"] for r in bags.select(F.explode("roles").alias("label")).groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return {"words": [], "weights": None, "prior": prior or 0.0}
    count = lambda k: F.sum(F.array_contains("roles", k).cast("long")).cast("double")
    seen = bags.select("roles", F.explode("words").alias("word")).groupBy("word").agg(count(1).alias("a"), count(0).alias("b")).filter("a >= 5")
    a, b = F.col("a") / sizes[1], F.col("b") / sizes[0]
    da, db = F.sqrt(a * (1 - a) / sizes[1]), F.sqrt(b * (1 - b) / sizes[0] + 1 / sizes[0] ** 2)
    z = (a - b) / F.sqrt(da * da + db * db)
    seen = materialise(seen.select("word", a.alias("a"), b.alias("b"), da.alias("da"), db.alias("db"), ((z > 4) & (a > 1.5 * b)).alias("tells")), "words")
    if prior is None:
        prior = bound(seen, most_prior)
    words = sorted(r["word"] for r in seen.filter("tells").select("word").collect())
    if not words:
        return {"words": [], "weights": None, "prior": prior}
    place = {w: i for i, w in enumerate(words)}

    def lean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"roles": b["roles"], "at": [[place[w] for w in ws if w in place] for ws in b["words"]]})

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        p, u = ([x for x, r in zip(rows["at"], rows["roles"]) if k in r] for k in (1, 0))
        return pd.DataFrame({"w": [fit(p, u, len(place), prior).tolist()]})

    # the samples are bounded by parameters, and of their words only those that tell are kept, so one task can hold them
    weights = bags.mapInPandas(lean, "roles array<int>, at array<int>").withColumn("all", F.lit(0)).groupBy("all").applyInPandas(learn, "w array<double>").first()["w"]
    return {"words": words, "weights": weights, "prior": prior}


def score(text: Column, model: dict) -> Column:
    """The score of a text, 0 to 1; null and empty texts get the model's bias."""
    place, weights, prior = {w: i for i, w in enumerate(model["words"])}, model["weights"], model["prior"]
    if weights is None:
        return F.lit(float(prior))
    w = np.array(weights)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        z = [w[-1] + sum(w[place[f]] for f in features(t) & place.keys()) for t in texts]
        return pd.Series(1 / (1 + np.exp(-np.array(z, np.float64))))

    return run(F.coalesce(text, F.lit("")))


def classify(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``. Repeated rows each give a row; other columns are not read."""
    small_batches(docs.sparkSession)
    model = train(docs.select("doc_id", "text"), labels, **settings)
    out = docs.select("doc_id", held_out().alias("held_out"), score(F.col("text"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    small_batches(docs.sparkSession)
    model = train(docs.select("doc_id", "text"), labels, **settings)
    return docs.filter(score(F.col("text"), model) < 0.5)
